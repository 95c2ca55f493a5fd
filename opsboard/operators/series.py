"""Series over months: comparisons, profiles, long and wide forms.

All of these take one row per key and month, that is, sums already made. Windows are partitioned
by series key, so a partition is as long as the calendar, not as the data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsboard import schema
from opsboard.functions.calendar import month_index


def monthly_total(facts: DataFrame, keys: Sequence[str] = ("kpi_id",)) -> DataFrame:
    """Consolidated months: all countries together. Decimal in, one double out."""
    return facts.groupBy(*keys, "mes").agg(F.sum("valor").cast("double").alias("valor"))


def months_before(value: str, keys: Sequence[str], months: int, mes: str = "mes") -> Column:
    """The value exactly ``months`` earlier in the same series, null if that month is not there.

    A range frame over month numbers looks up the month itself, where ``lag`` would take whatever
    row comes before.
    """
    window = Window.partitionBy(*keys).orderBy(month_index(F.col(mes))).rangeBetween(-months, -months)
    return F.max(value).over(window)


def relative_change(current: Column, base: Column) -> Column:
    """(current - base) / base; null where it is pending. A negative base keeps its sign."""
    return F.when(~is_pending_change(current, base), (current - base) / base)


def is_pending_change(current: Column, base: Column) -> Column:
    return current.isNull() | base.isNull() | (base == 0)


def change_vs(
    points: DataFrame, base: str | float | Column, keys: Sequence[str] = ("kpi_id",), value: str = "valor"
) -> DataFrame:
    """Change against a base: ``previous_month``, ``same_month_last_year``, ``first`` or a fixed value.

    Adds ``base``, ``pendiente`` and ``delta``.
    """
    if not isinstance(base, str):
        against = (base if isinstance(base, Column) else F.lit(base)).cast("double")
    elif base == "previous_month":
        against = months_before(value, keys, 1)
    elif base == "same_month_last_year":
        against = months_before(value, keys, 12)
    elif base == "first":
        since_start = Window.partitionBy(*keys).orderBy("mes").rowsBetween(
            Window.unboundedPreceding, Window.currentRow
        )
        against = F.first(value).over(since_start)
    else:
        raise ValueError(f"unknown base: {base}")
    current, reference = F.col(value), F.col("base")
    return (
        points.withColumn("base", against)
        .withColumn("pendiente", is_pending_change(current, reference))
        .withColumn("delta", relative_change(current, reference))
    )


def month_over_month(points: DataFrame, keys: Sequence[str] = ("kpi_id",)) -> DataFrame:
    return change_vs(points, "previous_month", keys)


def cagr(points: DataFrame, keys: Sequence[str] = ("kpi_id",), value: str = "valor", at: str = "mes") -> DataFrame:
    """Compound yearly growth between the first and the last point of each series."""
    ends = points.filter(F.col(value).isNotNull()).groupBy(*keys).agg(
        F.min(at).alias("desde"),
        F.max(at).alias("hasta"),
        F.min_by(value, at).alias("primero"),
        F.max_by(value, at).alias("ultimo"),
    )
    years = (month_index(F.col("hasta")) - month_index(F.col("desde"))) / 12
    growth = F.pow(F.try_divide(F.col("ultimo"), F.col("primero")), F.try_divide(F.lit(1.0), years)) - 1
    return ends.withColumn("cagr", growth)


def both_bounds(lower: Column, upper: Column) -> Column:
    """Confidence bounds as a struct, null unless both are there."""
    return F.when(
        lower.isNotNull() & upper.isNotNull(), F.struct(lower.alias("lower"), upper.alias("upper"))
    )


DEFAULT_GAP_DAYS = 365


def series_profile(points: DataFrame, keys: Sequence[str] = ("kpi_id",)) -> DataFrame:
    """Extent over values and bounds (a missing bound counts as the value), points with both bounds,
    and the smallest distance between consecutive dates."""
    value, lower, upper = F.col("valor"), F.col("ci_lower"), F.col("ci_upper")
    before = F.lag("mes").over(Window.partitionBy(*keys).orderBy("mes"))
    return (
        points.withColumn("dias", F.datediff(F.col("mes"), before))
        .groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("puntos"),
            F.min(F.least(value, F.coalesce(lower, value), F.coalesce(upper, value))).alias("minimo"),
            F.max(F.greatest(value, F.coalesce(lower, value), F.coalesce(upper, value))).alias("maximo"),
            F.count(both_bounds(lower, upper)).alias("con_banda"),
            F.coalesce(F.min("dias"), F.lit(DEFAULT_GAP_DAYS)).alias("dias_minimos"),
        )
    )


def trend_or_bars(bars: DataFrame, trend: DataFrame, keys: Sequence[str] = ("kpi_id",)) -> DataFrame:
    """The line to draw over bars: the trend of a series that has one, else its bars.

    The choice is made per series, never per point.
    """
    own_trend = trend.select(*keys).distinct()
    rest = bars.join(own_trend, list(keys), "left_anti")
    return trend.withColumn("origen", F.lit("tendencia")).unionByName(rest.withColumn("origen", F.lit("barras")))


def bars_and_line(points: DataFrame, keys: Sequence[str] = ("kpi_id",)) -> DataFrame:
    """Points of both scenarios with what draws them: actual ones are bars; the line is the forecast of a
    series that has one, else its bars. ``points`` are sums by series, scenario and month."""
    forecast = F.col("escenario") == schema.FORECAST
    has_trend = F.max(forecast).over(Window.partitionBy(*keys))
    return points.withColumns({"en_barras": ~forecast, "en_linea": forecast | ~has_trend})


def to_grouped(points: DataFrame, name: str, category: Column, order: str, value: str = "valor") -> DataFrame:
    """One row per series with arrays aligned to the categories of all series, null where a series has
    no value. Several points of one place are added up; a point without a place is left out.

    As long as the categories, so short. The common axis is a second sum over the same sums, one row, so
    no task sees the arrays of all series.
    """
    placed = points.filter(F.col(order).isNotNull())
    sums = placed.groupBy(F.col(name).alias("name"), F.col(order).alias("o")).agg(
        F.sum(value).cast("double").alias("v"), F.min(category).alias("c")
    )
    axis = sums.agg(F.array_sort(F.collect_set(F.struct("o", "c"))).alias("axis")).scalar()
    own = sums.groupBy("name").agg(F.map_from_entries(F.collect_list(F.struct("o", "v"))).alias("by_order"))
    return own.withColumn("axis", axis).select(
        F.col("axis.c").alias("categories"),
        "name",
        F.transform("axis", lambda a: F.try_element_at("by_order", a["o"])).alias("valores"),
    )


def grouped_long(series: DataFrame) -> DataFrame:
    """Position-aligned series as rows. Values missing at the end are null, surplus ones are left out."""
    return series.select("name", "valores", F.posexplode("categories").alias("pos", "categoria")).select(
        "name", "pos", "categoria", F.get("valores", F.col("pos")).alias("valor")
    )


def grouped_wide(long: DataFrame, names: Sequence[str]) -> DataFrame:
    """One row per category, one column per series. Naming the series saves a pass to find them."""
    return long.groupBy("pos", "categoria").pivot("name", list(names)).agg(F.first("valor"))


def wide_to_long(wide: DataFrame, names: Sequence[str]) -> DataFrame:
    """The inverse of :func:`grouped_wide`."""
    return wide.unpivot(["pos", "categoria"], list(names), "name", "valor")


def by_period(
    facts: DataFrame, start: Column, label: Column, keys: Sequence[str] = ("kpi_id",)
) -> DataFrame:
    """Sums by a longer period. The period's first day is the order, its label only a text: labels
    do not sort by time, and periods without data simply are not there."""
    return (
        facts.groupBy(*keys, start.alias("inicio"))
        .agg(F.sum("valor").cast("double").alias("valor"))
        .withColumn("periodo_label", label)
        .orderBy(*keys, "inicio")
    )


def baseline_first(points: DataFrame, baseline: DataFrame, label: str = "Baseline") -> DataFrame:
    """A period series with its baseline in front, and every point's change against it.

    ``points`` has ``inicio``, ``periodo_label`` and ``valor``; ``baseline`` is one row with
    ``valor``. The baseline has no date, which sorts before all dates.
    """
    reference = baseline.agg(F.max("valor").alias("valor")).scalar()
    front = baseline.select(
        F.lit(None).cast("date").alias("inicio"), F.lit(label).alias("periodo_label"), "valor"
    )
    joined = front.unionByName(points.select("inicio", "periodo_label", "valor"))
    return change_vs(joined, reference).orderBy(F.col("inicio").asc_nulls_first())


LEVEL, TREND, BAND = 0.5, 0.3, 1.96


def projected(
    points: DataFrame,
    months: int,
    keys: Sequence[str] = ("kpi_id",),
    level: float = LEVEL,
    trend: float = TREND,
    band: float = BAND,
) -> DataFrame:
    """Each series carried on for ``months`` months, with bounds from how far its own projections were off.

    A fold over the ordered months of a series keeps a level and a trend (double exponential smoothing). The
    first month sets the level, the second the trend; from the third on, what the fold expected for a month is
    held against its value. Bounds are ``band`` mean errors (root of the mean square) wide, growing with the
    root of the distance; null with fewer than three months. Months without a value are passed over, those
    missing in between count as steps of the trend. A series with one month stays at its level; several points
    of a month are added up.

    Result: the keys, ``mes``, ``paso`` (1 to ``months``), ``valor``, ``ci_lower``, ``ci_upper``.
    """
    sums = points.filter(F.col("mes").isNotNull()).groupBy(*keys, "mes").agg(F.sum("valor").cast("double").alias("valor"))
    known = sums.filter(F.col("valor").isNotNull())
    # a series is as long as the calendar
    series = known.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct(month_index(F.col("mes")).alias("m"), F.col("valor").alias("v")))).alias("serie"),
        F.max("mes").alias("ultimo"),
    )

    def state(at, n, base, slope, square) -> Column:
        kinds = {"at": "int", "n": "int", "base": "double", "slope": "double", "square": "double"}
        return F.struct(*[c.cast(k).alias(name) for (name, k), c in zip(kinds.items(), (at, n, base, slope, square))])

    def step(s: Column, x: Column) -> Column:
        gap = x["m"] - s["at"]
        expected = s["base"] + gap * s["slope"]
        base = level * x["v"] + (1 - level) * expected
        slope = F.when(s["n"] == 1, (x["v"] - s["base"]) / gap).otherwise(trend * (base - s["base"]) / gap + (1 - trend) * s["slope"])
        error = F.when(s["n"] >= 2, (x["v"] - expected) * (x["v"] - expected)).otherwise(F.lit(0.0))
        return F.when(s["n"] == 0, state(x["m"], F.lit(1), x["v"], F.lit(0.0), F.lit(0.0))).otherwise(
            state(x["m"], s["n"] + 1, F.when(s["n"] == 1, x["v"]).otherwise(base), slope, s["square"] + error)
        )

    zero = state(F.lit(0), F.lit(0), F.lit(0.0), F.lit(0.0), F.lit(0.0))
    folded = series.withColumn("s", F.aggregate("serie", zero, step)).withColumn("paso", F.explode(F.sequence(F.lit(1), F.lit(months))))
    s = F.col("s")
    wide = F.when(s["n"] >= 3, band * F.sqrt(s["square"] / (s["n"] - 2)) * F.sqrt(F.col("paso")))
    valor = s["base"] + F.col("paso") * s["slope"]
    return folded.select(
        *keys,
        F.add_months("ultimo", F.col("paso")).alias("mes"),
        "paso",
        valor.alias("valor"),
        (valor - wide).alias("ci_lower"),
        (valor + wide).alias("ci_upper"),
    )
