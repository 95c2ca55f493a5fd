"""KPI facts and targets from tables or files, with the declared column contract."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opsboard import schema


def conform(df: DataFrame, struct: T.StructType) -> DataFrame:
    """Select the declared columns with the declared types; optional ones that are absent are null."""
    present = set(df.columns)
    missing = [f.name for f in struct if not f.nullable and f.name not in present]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.select(
        *[
            (F.col(f.name) if f.name in present else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in struct
        ]
    )


def read_kpi_actuals(spark: SparkSession, source: str, fmt: str | None = "parquet") -> DataFrame:
    """Facts from files, or from a catalog table when ``fmt`` is None."""
    raw = spark.table(source) if fmt is None else spark.read.format(fmt).load(source)
    return conform(raw, schema.KPI_ACTUALS)


def read_kpi_targets(spark: SparkSession, source: str, fmt: str | None = "parquet") -> DataFrame:
    raw = spark.table(source) if fmt is None else spark.read.format(fmt).load(source)
    return conform(raw, schema.KPI_TARGETS)
