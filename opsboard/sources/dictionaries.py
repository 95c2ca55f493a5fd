"""Small fixed tables. They are local relations, so their size is known to the optimizer."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from opsboard import schema


def small_table(spark: SparkSession, rows: list[tuple], struct: T.StructType) -> DataFrame:
    """A literal table of a few rows with a declared schema."""
    columns = list(zip(*rows)) if rows else [[] for _ in struct]
    arrow = pa.table([list(column) for column in columns], schema=to_arrow_schema(struct))
    return spark.createDataFrame(arrow, schema=struct)


def status_domain(spark: SparkSession) -> DataFrame:
    struct = T.StructType([T.StructField("estatus", T.StringType()), T.StructField("ord", T.IntegerType())])
    return small_table(spark, [(name, place) for place, name in enumerate(schema.STATUSES)], struct)


def months(spark: SparkSession) -> DataFrame:
    struct = T.StructType([T.StructField("mes_num", T.IntegerType()), T.StructField("label", T.StringType())])
    return small_table(spark, [(place, name) for place, name in enumerate(schema.MONTHS, 1)], struct)


def countries(spark: SparkSession) -> DataFrame:
    struct = T.StructType([T.StructField("code", T.StringType()), T.StructField("label", T.StringType())])
    return small_table(spark, list(schema.COUNTRIES.items()), struct)


def with_label(
    df: DataFrame, dictionary: DataFrame, key: str, code: str = "code", label: str = "label", out: str = "etiqueta"
) -> DataFrame:
    """Attach a dictionary label; a code the dictionary does not know stays as its own label."""
    names = dictionary.select(F.col(code).alias(key), F.col(label).alias(out))
    return df.join(names, key, "left").withColumn(out, F.coalesce(F.col(out), F.col(key)))


def status_order(estatus: Column) -> Column:
    """Display position of a known status, null for any other."""
    places = F.create_map(*[F.lit(x) for place, name in enumerate(schema.STATUSES) for x in (name, place)])
    return F.try_element_at(places, estatus)
