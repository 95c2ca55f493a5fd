"""Sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opsboard import schema
from opsboard.storage import shuffles_let_go


def write_detail_csv(detail: DataFrame, path: str, mode: str = "error") -> None:
    """The detail table as UTF-8 CSV with a header and upper-case names.

    A sorted input is range partitioned, so its part files read in name order keep the order.
    """
    order = [c for c in ("perspectiva", "nodo", "soa", "cuenta", "estatus", "servicios") if c in detail.columns]
    named = detail.select(*[detail[c].alias(c.upper()) for c in order])
    (
        named.write.mode(mode)
        .option("header", True)
        .option("encoding", "UTF-8")
        .option("escape", '"')
        .option("emptyValue", "")
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def read_detail_csv(spark: SparkSession, path: str) -> DataFrame:
    """What :func:`write_detail_csv` wrote, with its perspective column where it had one."""
    names = spark.read.option("header", True).csv(path).columns
    kinds = T.StructType([T.StructField(n.lower(), T.LongType() if n == "SERVICIOS" else T.StringType()) for n in names])
    reader = spark.read.schema(kinds).option("header", True).option("escape", '"').option("multiLine", True)
    return reader.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def interleaved(*columns: str, bits: int = 8) -> Column:
    """One sort key of several columns: the bits of their hashes in turn, so that rows alike in any one of
    them come to lie in few places."""
    key = F.lit(0).cast("long")
    for bit in reversed(range(bits)):
        for name in columns:
            key = F.shiftleft(key, 1).bitwiseOR(F.shiftright(F.xxhash64(name), bit).bitwiseAND(F.lit(1)))
    return key


# columns whose single values readers ask for
SOUGHT = ("nodo", "cuenta", "agente")


def write_services(services: DataFrame, path: str, mode: str = "error", only_months: bool = False) -> None:
    """Clean services as parquet by perspective and month, so period filters prune directories.

    Within a month rows are ordered by an interleaved key of node, account and coordinator, across files as
    within them (rows are dealt out by ranges of that key, so a big month gets many writers), and the files
    have Bloom filters: a reader who asks for one account skips the row groups without it. With
    ``only_months`` an overwrite replaces the months that have rows here and leaves the others.
    """
    columns = [c for c in (*schema.SERVICES.names, "archivo") if c in services.columns]
    layout = ["perspectiva", "mes"]
    view = F.coalesce("perspectiva", F.lit("?")).alias("perspectiva")  # never null: the writer needs no rule for that
    keyed = services.select(view, *[c for c in columns if c != "perspectiva"], interleaved(*SOUGHT).alias("_z"))
    ordered = keyed.repartitionByRange(*layout, "_z").sortWithinPartitions(*layout, "_z").drop("_z")
    writer = ordered.write.mode(mode).partitionBy(*layout).option("parquet.bloom.filter.adaptive.enabled", "true")
    for name in SOUGHT:
        writer = writer.option(f"parquet.bloom.filter.enabled#{name}", "true")
    if only_months:
        writer = writer.option("partitionOverwriteMode", "dynamic")
    with shuffles_let_go(services.sparkSession):
        writer.option("compression", "zstd").parquet(path)
