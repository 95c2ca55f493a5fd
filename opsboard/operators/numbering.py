"""Places in an order, without one task that sees all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsboard.storage import written

_LOCAL_BITS = 33  # of monotonically_increasing_id: above them the partition, in them the row within it


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], name: str = "pos") -> DataFrame:
    """``df`` with each row's place (from 1) among the rows of its ``keys`` in ``order``.

    Rows are dealt out by ranges of keys and order, sorted where they are, and written down as they lie. Only
    how many rows of a key each range holds is then summed up, which is as many numbers as there are ranges.
    ``order`` should name every row, or ties fall as they may.
    """
    at, part = F.col("_at"), F.shiftrightunsigned("_at", _LOCAL_BITS).alias("_part")
    by = [*map(F.col, keys), *[F.col(o) if isinstance(o, str) else o for o in order]]
    lying = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id())
    lying = written(lying, "numbered")
    ranges = lying.groupBy(*keys, part).agg(F.count(F.lit(1)).alias("_n"), F.min(at).alias("_first"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first") + 1
    ranges = written(ranges.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_part").alias("_of"), shift.alias("_shift")), "ranges")
    meet = F.shiftrightunsigned("_at", _LOCAL_BITS) == F.col("_of")
    for k in keys:
        meet = meet & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return lying.join(ranges, meet).select(*df.columns, (at + F.col("_shift")).alias(name))
