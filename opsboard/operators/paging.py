"""The detail table in pages: laid out once in its order, then read a page at a time.

Rows are numbered in the order of the table and laid out in blocks of consecutive rows. A file holds one block, or,
where there are many, consecutive ones: as many as keep the files of a perspective to ``FILES``, and no more than
``BLOCK_ROWS`` rows. A manifest has the first row of every block. A page is found by number, or by the last row
already shown (keyset), through the manifest, and reads the one or two blocks it lies in.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opsboard.operators.numbering import numbered
from opsboard.operators.panels import BY

BLOCK_ROWS = 100_000
FILES = 256  # of a perspective, as long as none has more than BLOCK_ROWS rows
ORDER = ("servicios", "nodo", "soa", "cuenta", "estatus")  # the first one largest first


def write_pages(detail: DataFrame, path: str, block_rows: int = BLOCK_ROWS) -> None:
    """Lay out :func:`opsboard.operators.panels.detail_table` (in any order of rows) below ``path``."""
    spark = detail.sparkSession
    placed = numbered(detail, [BY], [F.col(ORDER[0]).desc(), *ORDER[1:]])
    most = placed.agg(F.max("pos")).first()[0] or 0
    blocks = max(1, min(BLOCK_ROWS // block_rows, -(-most // (block_rows * FILES))))  # of a file
    block, file = (F.floor((F.col("pos") - 1) / rows).alias(name) for rows, name in ((block_rows, "bloque"), (blocks * block_rows, "archivo")))
    rows = placed.select("*", block, file).repartition(BY, "archivo").sortWithinPartitions(BY, "archivo", "pos")
    rows.write.partitionBy(BY, "archivo").parquet(f"{path}/filas")
    laid = spark.read.schema(rows.schema).parquet(f"{path}/filas")
    # a block's first row is told by its place, so that only those rows are carried along
    first = F.struct(*ORDER).alias("primera")
    heads = laid.filter((F.col("pos") - 1) % block_rows == 0).select(BY, "bloque", first, F.col("pos").alias("desde"), "archivo")
    ends = laid.groupBy(F.col(BY).alias("_de"), F.col("bloque").alias("_bloque")).agg(F.max("pos").alias("hasta"))
    manifest = heads.join(ends, F.col(BY).eqNullSafe(F.col("_de")) & (F.col("bloque") == F.col("_bloque"))).drop("_de", "_bloque")
    manifest.write.parquet(f"{path}/indice")


def _rows(spark: SparkSession, path: str, perspectiva: str, first_block: int) -> DataFrame:
    """Two blocks of a perspective; files without them are not looked at."""
    two = F.col("bloque").isin(first_block, first_block + 1)
    files = [r["archivo"] for r in _manifest(spark, path, perspectiva).filter(two).select("archivo").distinct().collect()]  # two at most
    blocks = spark.read.parquet(f"{path}/filas")
    return blocks.filter((F.col(BY) == perspectiva) & F.col("archivo").isin(files) & two)


def _shown(rows: DataFrame, size: int) -> DataFrame:
    return rows.orderBy("pos").limit(size).select(BY, "pos", *ORDER[1:], ORDER[0])


def _manifest(spark: SparkSession, path: str, perspectiva: str) -> DataFrame:
    return spark.read.parquet(f"{path}/indice").filter(F.col(BY) == perspectiva)


def _check(spark: SparkSession, path: str, perspectiva: str, size: int) -> None:
    least = _manifest(spark, path, perspectiva).filter("bloque = 0").select((F.col("hasta") - F.col("desde") + 1).alias("n")).first()
    several = not _manifest(spark, path, perspectiva).filter("bloque = 1").isEmpty()
    if several and size > least["n"]:
        raise ValueError(f"a page has at most as many rows as a block: {least['n']}")


def page(spark: SparkSession, path: str, perspectiva: str, number: int, size: int = 100) -> DataFrame:
    """Page ``number`` (from 1) of ``size`` rows."""
    _check(spark, path, perspectiva, size)
    first = (number - 1) * size + 1
    block = _manifest(spark, path, perspectiva).filter(F.col("desde") <= first).agg(F.max("bloque")).first()[0]
    return _shown(_rows(spark, path, perspectiva, -2 if block is None else block).filter(F.col("pos") >= first), size)


def _after(last: Mapping) -> Column:
    """Rows behind ``last`` in the order of the table."""
    behind, same = F.lit(False), F.lit(True)
    for place, name in enumerate(ORDER):
        value = F.lit(last[name])
        behind = behind | (same & (F.col(name) < value if place == 0 else F.col(name) > value))
        same = same & (F.col(name) == value)
    return behind


def page_after(spark: SparkSession, path: str, perspectiva: str, last: Mapping, size: int = 100) -> DataFrame:
    """The ``size`` rows behind the row ``last`` (a mapping with the columns of ``ORDER``), there or not."""
    _check(spark, path, perspectiva, size)
    firsts = _manifest(spark, path, perspectiva).select("bloque", "primera.*")
    block = firsts.filter(~_after(last)).agg(F.max("bloque")).first()[0]
    return _shown(_rows(spark, path, perspectiva, block or 0).filter(_after(last)), size)
