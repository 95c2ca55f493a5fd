"""The service store: extracts are read once, file by file, into a table that the boards read from then on.

A store is a folder of parquet tables:

* ``servicios``, clean services by perspective and month, with the file each row came from;
* ``rechazos``, rows that could not be read, by load;
* ``libro``, the ledger: every file that was loaded, with size, time and the months it has rows in;
* ``entrada``, ``recuento``, ``restos`` and ``pendiente``, what the load at hand is made of: its rows by destiny,
  perspective and year, how many of them each file and month has, what the touched months keep of other files, and
  its entries for the ledger.

A load looks at the files on offer that the ledger does not know as they are. Their rows are read in one
pass, put next to what the touched months hold from other files, and those months alone are written anew. A file
that changed gives up its old rows; one that is no longer offered keeps them. Up to ``pendiente`` nothing
readers see has changed; from then on the load can be finished from the store alone, and the next load does
so first if this one was cut off. One load may run at a time.

Months are written some at a time, as many as have ``ROWS_AT_A_TIME`` rows together, and what was shuffled for them
is let go before the next: beside the tables a load needs disk for that many rows (or one month, if that has more).
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from datetime import date, datetime, timezone
from functools import reduce
from itertools import groupby

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opsboard import schema
from opsboard.sources.export import write_services
from opsboard.sources.services import GOOD, REJECTED, listing, read_extract, sorted_out
from opsboard.storage import delete, shuffles_let_go, table_or_empty

_FILE = T.StructField("archivo", T.StringType())
STORED = T.StructType([*schema.SERVICES, _FILE])
LEDGER = T.StructType(
    [
        T.StructField("perspectiva", T.StringType()),
        _FILE,
        T.StructField("bytes", T.LongType()),
        T.StructField("modificado", T.TimestampType()),
        T.StructField("cargadas", T.LongType()),
        T.StructField("rechazadas", T.LongType()),
        T.StructField("meses", T.ArrayType(T.DateType())),  # at most the calendar; null where a row has no month
        T.StructField("carga", T.StringType()),
    ]
)
REJECTS = T.StructType(
    [
        T.StructField("perspectiva", T.StringType()),
        _FILE,
        T.StructField("motivo", T.StringType()),
        T.StructField("crudo", T.StringType()),
        T.StructField("carga", T.StringType()),
    ]
)
_DESTINY = T.StructField("destino", T.StringType())
_ENTERED = T.StructType([*(f for f in REJECTS if f.name != "carga"), _DESTINY])
_YEAR = T.StructField("anio", T.IntegerType())
_TAKEN = T.StructType([*STORED, _DESTINY, _YEAR])
_TALLY = T.StructType([T.StructField("perspectiva", T.StringType()), _FILE, _DESTINY, T.StructField("mes", T.DateType()), T.StructField("filas", T.LongType())])
_KNOWN = ["perspectiva", "archivo", "bytes", "modificado"]
_COUNTS = ("filas", "pruebas", "fechas", "cantidades", "cargadas")
ROWS_AT_A_TIME = 16_000_000


@dataclass(frozen=True)
class Load:
    """What a load did. ``filas`` is the sum of the four counts after it."""

    carga: str | None
    archivos: int = 0
    filas: int = 0
    pruebas: int = 0
    fechas: int = 0
    cantidades: int = 0
    cargadas: int = 0
    meses: tuple[tuple[str, date | None], ...] = ()


def read_services(spark: SparkSession, store: str) -> DataFrame:
    """Clean services of a store, as :func:`opsboard.sources.services.load_services` gives them."""
    return table_or_empty(spark, f"{store}/servicios", STORED).select(*schema.SERVICES.names)


def read_ledger(spark: SparkSession, store: str) -> DataFrame:
    """The files that the store holds, each as last loaded."""
    latest = Window.partitionBy("perspectiva", "archivo").orderBy(F.col("carga").desc())
    every = table_or_empty(spark, f"{store}/libro", LEDGER).withColumn("_n", F.row_number().over(latest))
    return every.filter("_n = 1").drop("_n")


def read_rejects(spark: SparkSession, store: str) -> DataFrame:
    """Rows that could not be read, of the files as last loaded."""
    current = read_ledger(spark, store).select("perspectiva", "archivo", "carga")
    return table_or_empty(spark, f"{store}/rechazos", REJECTS).join(current, ["perspectiva", "archivo", "carga"], "left_semi")


def _in_months(months: tuple[tuple[str, date | None], ...]) -> Column:
    """Rows of some months of some perspectives, as a filter that prunes directories."""
    by: dict[str, list] = {}
    for view, month in months:
        by.setdefault(view, []).append(month)

    def of(view: str) -> Column:
        dated = [m for m in by[view] if m is not None]
        among = F.col("mes").isin(dated) if dated else F.lit(False)
        return (F.col("perspectiva") == view) & (among | F.col("mes").isNull() if None in by[view] else among)

    return reduce(lambda a, b: a | b, map(of, sorted(by)), F.lit(False))


def _batches(rows: Mapping[tuple[str, date | None], int]) -> list[tuple[tuple[str, date | None], ...]]:
    """Months in the groups they are written in. A year goes whole where it can, as the rows of a load lie by year."""
    batches: list[tuple[tuple[str, date | None], ...]] = []
    size = 0
    in_order = sorted(rows, key=lambda of: (of[0], str(of[1])))
    for _, year in groupby(in_order, key=lambda of: (of[0], of[1] and of[1].year)):
        months = tuple(year)
        whole = sum(rows[m] for m in months) <= ROWS_AT_A_TIME
        for part in [months] if whole else [(m,) for m in months]:
            more = sum(rows[m] for m in part)
            if not batches or size + more > ROWS_AT_A_TIME:
                batches.append(())
                size = 0
            batches[-1] += part
            size += more
    return batches


def _of_years(months: tuple[tuple[str, date | None], ...]) -> Column:
    """Which years of a load's rows some months are in, as a filter that prunes directories. Rows without a year may be
    those of a load that an earlier version put down in one folder."""
    return F.col("anio").isin(sorted({month.year for _, month in months if month is not None})) | F.col("anio").isNull()


def _offered(spark: SparkSession, inputs: Mapping[str, str]) -> DataFrame:
    lists = [listing(spark, path).withColumn("perspectiva", F.lit(view)) for view, path in inputs.items()]
    return reduce(DataFrame.unionByName, lists)


def ingest(
    spark: SparkSession,
    store: str,
    inputs: Mapping[str, str],
    fmt: str = "parquet",
    date_format: str | None = None,
    test_accounts: str = schema.TEST_ACCOUNTS,
) -> Load:
    """Load what is new or changed at ``inputs`` (a folder or file per perspective) into ``store``."""
    unknown = set(inputs) - set(schema.PERSPECTIVES)
    if unknown or not inputs:
        raise ValueError(f"no perspective {', '.join(sorted(unknown))}; there are {', '.join(schema.PERSPECTIVES)}")
    finish(spark, store)
    ledger = read_ledger(spark, store)
    files = _offered(spark, inputs).join(ledger, _KNOWN, "left_anti").collect()  # one row per file to be opened
    if not files:
        return Load(None)
    carga = datetime.now(timezone.utc).strftime("%Y%m%dT%H%M%S.%fZ")
    taken = spark.createDataFrame(files).select(*_KNOWN)

    # one pass over the new files, both kinds of rows and all counts
    parts = []
    for view in inputs:
        mine = [f["ruta"] for f in files if f["perspectiva"] == view]
        if mine:
            seen = Observation(f"{carga}-{view}")
            raw = read_extract(spark, mine, fmt, archivo="archivo").withColumn("perspectiva", F.lit(view))
            parts.append((seen, sorted_out(raw, seen, date_format, test_accounts)))
    rows = reduce(DataFrame.unionByName, [part for _, part in parts])
    _put(rows.withColumn("anio", F.year("mes")), f"{store}/entrada", "destino", "perspectiva", "anio")
    counts = {name: sum(seen.get[name] for seen, _ in parts) for name in _COUNTS}

    entered = spark.read.schema(_TAKEN).parquet(f"{store}/entrada")
    tally = entered.groupBy("perspectiva", "archivo", "destino", "mes").agg(F.count(F.lit(1)).alias("filas"))
    _put(tally, f"{store}/recuento")
    good = F.col("destino") == GOOD
    found = spark.read.schema(_TALLY).parquet(f"{store}/recuento").groupBy("perspectiva", "archivo").agg(
        F.sum(F.when(good, F.col("filas"))).alias("cargadas"),
        F.sum(F.when(~good, F.col("filas"))).alias("rechazadas"),
        F.collect_set(F.when(good, F.struct("mes"))).alias("meses"),
    )
    entries = taken.join(found, ["perspectiva", "archivo"], "left").select(
        *_KNOWN,
        *[F.coalesce(n, F.lit(0)).alias(n) for n in ("cargadas", "rechazadas")],
        F.coalesce("meses.mes", F.array().cast("array<date>")).alias("meses"),
        F.lit(carga).alias("carga"),
    )
    before = ledger.join(taken, ["perspectiva", "archivo"], "left_semi").select(*LEDGER.names)
    touched = entries.select(*LEDGER.names).unionByName(before).select("perspectiva", F.explode("meses").alias("mes")).distinct()
    months = tuple(sorted(((r["perspectiva"], r["mes"]) for r in touched.collect()), key=repr))  # at most the calendar

    # with what is kept of them the touched months are complete before anything else changes
    kept = table_or_empty(spark, f"{store}/servicios", STORED).filter(_in_months(months))
    kept = kept.join(taken.select("perspectiva", "archivo"), ["perspectiva", "archivo"], "left_anti")
    _put(kept.select(*STORED.names), f"{store}/restos")
    _put(entries.select(*LEDGER.names), f"{store}/pendiente")
    _apply(spark, store, months)
    return Load(carga, len(files), **counts, meses=months)


def _put(rows: DataFrame, path: str, *by: str) -> None:
    """A table of the load at hand, in place of that of the load before."""
    with shuffles_let_go(rows.sparkSession):
        rows.write.mode("overwrite").option("partitionOverwriteMode", "static").option("compression", "zstd").partitionBy(*by).parquet(path)


def finish(spark: SparkSession, store: str) -> bool:
    """Finish a load that was cut off after it was complete; whether there was one."""
    waiting = table_or_empty(spark, f"{store}/pendiente", LEDGER)
    done = table_or_empty(spark, f"{store}/libro", LEDGER).select("carga").distinct()
    if waiting.join(done, "carga", "left_anti").isEmpty():
        return False
    before = read_ledger(spark, store).join(waiting, ["perspectiva", "archivo"], "left_semi")
    touched = waiting.unionByName(before).select("perspectiva", F.explode("meses").alias("mes")).distinct()
    _apply(spark, store, tuple((r["perspectiva"], r["mes"]) for r in touched.collect()))
    return True


def _apply(spark: SparkSession, store: str, months: tuple[tuple[str, date | None], ...]) -> None:
    """Bring the load at hand into the tables readers see. May be repeated."""
    kept = spark.read.schema(STORED).parquet(f"{store}/restos")
    taken = spark.read.schema(_TAKEN).parquet(f"{store}/entrada").filter(F.col("destino") == GOOD)
    waiting = spark.read.schema(LEDGER).parquet(f"{store}/pendiente")
    carga = waiting.first()["carga"]
    tally = spark.read.schema(_TALLY).parquet(f"{store}/recuento").filter(F.col("destino") == GOOD)
    held = kept.select("perspectiva", "mes", F.lit(1).cast("long").alias("filas")).unionByName(tally.select("perspectiva", "mes", "filas"))
    left = held.groupBy("perspectiva", "mes").agg(F.sum("filas").alias("filas")).collect()  # at most the calendar
    filled = {(r["perspectiva"], r["mes"]): r["filas"] for r in left}
    for some in _batches(filled) or [()]:
        merged = kept.unionByName(taken.filter(_of_years(some)).select(*STORED.names)).filter(_in_months(some))
        write_services(merged, f"{store}/servicios", "overwrite", only_months=True)
    for view, month in set(months) - set(filled):
        name = "__HIVE_DEFAULT_PARTITION__" if month is None else month.isoformat()
        delete(spark, f"{store}/servicios/perspectiva={view}/mes={name}")
    entered = spark.read.schema(_ENTERED).parquet(f"{store}/entrada")
    rejects = entered.filter(F.col("destino") == REJECTED).select("perspectiva", "archivo", "motivo", "crudo", F.lit(carga).alias("carga"))
    for rows, name in ((rejects, "rechazos"), (waiting, "libro")):  # the ledger last: it says the load is done
        writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd")
        writer.partitionBy("carga").parquet(f"{store}/{name}")
