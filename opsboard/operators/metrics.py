"""KPI definitions as aggregations: ratios, per-entity averages, concentration, gaps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsboard import schema
from opsboard.functions.calendar import month_index, month_start


def rows_where(condition: Column) -> Column:
    """Row count as a measure: 1 where it holds."""
    return F.when(condition, F.lit(1)).otherwise(F.lit(0))


def ratio(part: Column, whole: Column) -> Column:
    """Quotient as double, null when the divisor is 0 or missing."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def ratio_kpi(df: DataFrame, num: Column, den: Column, by: Sequence[str | Column] = ()) -> DataFrame:
    """Sum of one measure over the sum of another, by period or entity."""
    return (
        df.groupBy(*by)
        .agg(F.coalesce(F.sum(num), F.lit(0)).alias("numerador"), F.coalesce(F.sum(den), F.lit(0)).alias("denominador"))
        .withColumn("ratio", ratio(F.col("numerador"), F.col("denominador")))
    )


def per_entity(df: DataFrame, measure: Column, entity: str, by: Sequence[str | Column] = ()) -> DataFrame:
    """Sum of a measure per distinct entity."""
    return (
        df.groupBy(*by)
        .agg(F.coalesce(F.sum(measure), F.lit(0)).alias("medida"), F.count_distinct(entity).alias("entidades"))
        .withColumn("por_entidad", ratio(F.col("medida"), F.col("entidades")))
    )


def topn_concentration(df: DataFrame, key: str, measure: Column, n: int = 10) -> DataFrame:
    """What the ``n`` largest members hold of everything.

    Sorting keeps ``n`` + 1 sums (rows without a member may be one of them). The grand total, a
    scalar, adds up the same member sums from the same shuffle.
    """
    sums = df.groupBy(key).agg(F.sum(measure).alias("valor"))
    largest = [F.col("valor").desc(), F.col(key).asc()]
    few = sums.orderBy(*largest).limit(n + 1).filter(F.col(key).isNotNull()).orderBy(*largest).limit(n)
    total = sums.agg(F.sum("valor").cast("double").alias("total")).scalar()
    return (
        few.agg(F.sum("valor").cast("double").alias("top"))
        .withColumn("total", total)
        .withColumn("concentracion", ratio(F.col("top"), F.col("total")))
    )


def segment_share(
    df: DataFrame, segment: str, measure: Column, by: Sequence[str] = (), order: Column | None = None
) -> DataFrame:
    """Sum and share per segment. Segments need not add up to 100; the share is of their sum.

    The headline is the first segment in declared ``order``, else the largest.
    """
    sums = df.groupBy(*by, segment).agg(
        F.sum(measure).alias("suma"), F.min(F.lit(0) if order is None else order).alias("_orden")
    )
    rank = F.struct("_orden", -F.col("suma"), F.col(segment))
    if by:
        total = F.sum("suma").over(Window.partitionBy(*by))
        first = F.min(rank).over(Window.partitionBy(*by))
    else:  # one row from the same sums: no task needs to see them all
        total = sums.agg(F.sum("suma")).scalar()
        first = sums.agg(F.min(rank)).scalar()
    return sums.withColumns({"_total": total, "_first": first}).select(
        *by,
        segment,
        F.col("suma").cast("double").alias("valor"),
        ratio(F.col("suma"), F.col("_total")).alias("participacion"),
        rank.eqNullSafe(F.col("_first")).alias("principal"),
    )


def gone_next_month(df: DataFrame, entity: str, moment: str) -> DataFrame:
    """Of the entities active in a month, how many were not in the next one.

    Activity collapses to (entity, month) before the window, so a busy entity is no longer than
    the calendar. The last month has no next one and is left out.
    """
    active = df.select(entity, month_start(F.col(moment)).alias("mes")).dropna().distinct()
    following = Window.partitionBy(entity).orderBy(month_index(F.col("mes"))).rangeBetween(1, 1)
    months = ratio_kpi(
        active.withColumn("sigue", F.max(F.lit(1)).over(following)),
        rows_where(F.col("sigue").isNull()),
        F.lit(1),
        ["mes"],
    )
    return (
        months.withColumn("ultimo", F.max("mes").over(Window.partitionBy()))  # one row per month
        .filter(F.col("mes") < F.col("ultimo"))
        .drop("ultimo")
    )


def with_target(values: DataFrame, targets: DataFrame, key: str = "kpi_id") -> DataFrame:
    """Constant target next to every point of its series; no target, no line."""
    return values.join(targets, key, "left")


OPEN_START, OPEN_END = "0001-01-01", "9999-12-31"


def with_period_target(values: DataFrame, targets: DataFrame, key: str = "kpi_id") -> DataFrame:
    """The target that holds in each point's month, next to it; no target, no line.

    ``targets`` has ``desde`` and ``hasta`` (both included; null is open) and ``target`` besides ``key``. Where
    several hold, the one that began last does, then the one that ends first, then the smaller one. A target whose
    end lies before its start never holds.

    The months of a point and the validity of a target meet on the key and the year: a target is unfolded
    into the years of its validity that have values, and only those pairs are held against the days.
    """
    year = F.year("mes")
    span = values.agg(F.struct(F.min(year).alias("lo"), F.max(year).alias("hi"))).scalar()
    since = F.coalesce("desde", F.lit(OPEN_START).cast("date"))
    until = F.coalesce("hasta", F.lit(OPEN_END).cast("date"))
    spans = targets.select(F.col(key).alias("_key"), since.alias("_desde"), until.alias("_hasta"), F.col("target").alias("_target"))
    spans = spans.withColumn("_span", span)
    first, last = F.greatest(F.year("_desde"), F.col("_span.lo")), F.least(F.year("_hasta"), F.col("_span.hi"))
    yearly = spans.filter((F.col("_desde") <= F.col("_hasta")) & (first <= last)).withColumn("_year", F.explode(F.sequence(first, last)))
    months = values.select(F.col(key).alias("_of"), F.col("mes").alias("_mes")).distinct()
    meets = (
        (F.col("_of") == F.col("_key"))
        & (F.year("_mes") == F.col("_year"))
        & (F.col("_mes") >= F.col("_desde"))
        & (F.col("_mes") <= F.col("_hasta"))
    )
    rank = F.struct(-F.unix_date("_desde"), F.unix_date("_hasta"), F.col("_target"))
    held = months.join(yearly, meets).groupBy("_of", "_mes").agg(F.min_by("_target", rank).alias("target"))
    return values.join(held, (F.col(key) == F.col("_of")) & (F.col("mes") == F.col("_mes")), "left").drop("_of", "_mes")


def target_gap(df: DataFrame, value: Column, target: Column, direction: Column) -> DataFrame:
    """Distance to the target in the value's own points, and whether it is met."""
    met = F.when(direction == "<=", value <= target).otherwise(value >= target)
    return df.withColumn("brecha", value - target).withColumn("cumple", met)


def scenario_tag(mes: Column, cutoff: Column) -> Column:
    """Actual through the cut-off month, forecast after it."""
    return F.when(mes <= cutoff, schema.REAL).otherwise(schema.FORECAST)
