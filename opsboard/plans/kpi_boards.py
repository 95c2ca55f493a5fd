"""The KPI boards' definitions over the test tables, each with its SQL twin."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opsboard import schema
from opsboard.functions import calendar, numbers
from opsboard.operators import cards, filters, metrics, series
from opsboard.plans import testdata
from opsboard.plans.catalog import Query
from opsboard.plans.service_board import SERVICES_SQL
from opsboard.plans.testdata import amount, customer_lines, kpi_actuals, order_lines, segment_months, table
from opsboard.sources.dictionaries import small_table, with_label
from opsboard.sources.kpi_facts import conform, read_kpi_actuals, read_kpi_targets
from opsboard.storage import new_path

SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
CARD_MONTH, PREVIOUS_MONTH = date(2000, 12, 1), date(2000, 11, 1)

# Literal target lines; EBITDA has none.
GAP_TARGETS = [("INGRESOS", 25_000_000.0, ">="), ("SINIESTRALIDAD", 8_000_000.0, "<=")]

_FACTS_SQL = """
WITH priced AS (
  SELECT *, CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) AS amount
  FROM lineitem
), monthly AS (
  SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS mes, CAST(c_nationkey AS VARCHAR) AS pais,
    sum(amount) AS ingresos, coalesce(sum(amount) FILTER (l_returnflag = 'R'), 0) AS siniestralidad
  FROM priced JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY ALL
), long AS (
  SELECT 'INGRESOS' AS kpi_id, mes, pais, CAST(ingresos AS DECIMAL(38,4)) AS valor FROM monthly
  UNION ALL SELECT 'SINIESTRALIDAD', mes, pais, siniestralidad FROM monthly
  UNION ALL SELECT 'EBITDA', mes, pais, ingresos - siniestralidad FROM monthly
), facts AS (
  SELECT *, CASE WHEN mes <= DATE '2000-12-01' THEN 'REAL' ELSE 'FCST' END AS escenario,
    CASE WHEN month(mes) % 3 <> 0 THEN CAST(valor AS DOUBLE) * 0.9 END AS ci_lower,
    CASE WHEN month(mes) % 3 <> 0 THEN CAST(valor AS DOUBLE) * 1.1 END AS ci_upper
  FROM long
), total AS (
  SELECT kpi_id, mes, CAST(sum(valor) AS DOUBLE) AS valor FROM facts GROUP BY ALL
), seg AS (
  SELECT c_mktsegment AS segmento, CAST(date_trunc('month', o_orderdate) AS DATE) AS mes,
    CAST(sum(amount) AS DOUBLE) AS valor
  FROM priced JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY ALL
)
"""


def _change_sql(source: str, key: str, join: str) -> str:
    """Change against a joined base row ``b``."""
    return f"""
, changed AS (SELECT p.{key}, p.mes, p.valor, b.valor AS base FROM {source} p LEFT JOIN {join})
SELECT {key}, mes, valor, base, coalesce(base = 0, true) AS pendiente,
  (valor - base) / nullif(base, 0) AS delta FROM changed
"""


def _compact_sql(v: str, unit: str) -> str:
    return (
        f"CASE WHEN abs({v}) >= 1e9 THEN printf('%.2fB', {v} / 1e9) WHEN abs({v}) >= 1e6 THEN printf('%.3fM', {v} / 1e6) "
        f"WHEN abs({v}) >= 1e3 THEN printf('%.2fK', {v} / 1e3) ELSE printf('%.2f', {v}) END || ' ' || {unit}"
    )


def _delta_label_sql(delta: str) -> str:
    p = f"({delta} * 100)"
    return (
        f"CASE WHEN abs({p}) < 1 THEN printf('%.3f', {p}) WHEN abs({p}) < 10 THEN printf('%.1f', {p}) "
        f"ELSE CAST(CAST(floor({p} + 0.5) AS BIGINT) AS VARCHAR) END || '%'"
    )


def _ratio_sql(by: str, num: str, den: str, source: str) -> str:
    return f"""
SELECT {by.split(' AS ')[-1]}, numerador, denominador,
  CAST(numerador AS DOUBLE) / nullif(CAST(denominador AS DOUBLE), 0) AS ratio
FROM (SELECT {by}, {num} AS numerador, {den} AS denominador FROM {source} GROUP BY ALL)
"""


# ---- facts: change, cards, slicers, scenario, profile, periods ---------------------------


def kpi_mom(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.month_over_month(series.monthly_total(kpi_actuals(spark, sf_dir)))


def kpi_mom_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = series.month_over_month(series.monthly_total(kpi_actuals(spark, sf_dir)))
    return changed.select(
        "kpi_id",
        calendar.month_label(F.col("mes")).alias("mes_label"),
        numbers.delta_label(F.col("delta")).alias("etiqueta"),
        numbers.direction_arrow(F.col("delta")).alias("flecha"),
    )


def kpi_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = kpi_actuals(spark, sf_dir, (PREVIOUS_MONTH, CARD_MONTH))
    targets = testdata.kpi_targets(spark)
    return cards.flat_cards(cards.kpi_cards(facts, targets, CARD_MONTH))


def kpi_target_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    struct = T.StructType(
        [
            T.StructField("kpi_id", T.StringType()),
            T.StructField("target", T.DoubleType()),
            T.StructField("direction", T.StringType()),
        ]
    )
    points = metrics.with_target(
        series.monthly_total(kpi_actuals(spark, sf_dir)), small_table(spark, GAP_TARGETS, struct)
    )
    return metrics.target_gap(points, F.col("valor"), F.col("target"), F.col("direction"))


def kpi_period_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every consolidated month against the target that holds in it."""
    targets = small_table(spark, testdata.PERIOD_TARGET_ROWS, testdata.PERIOD_TARGETS)
    points = metrics.with_period_target(series.monthly_total(kpi_actuals(spark, sf_dir)), targets)
    return metrics.target_gap(points, F.col("valor"), F.col("target"), F.lit(">="))


def kpi_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.projected(_segment_points(spark, sf_dir), 6, ("segmento",))


def kpi_projection_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next quarter of every KPI and country."""
    return series.projected(kpi_actuals(spark, sf_dir), 3, ("kpi_id", "pais"))


def kpi_rate_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A percentage, a ratio and a pending card, as they are stored, and what they show."""
    facts = kpi_actuals(spark, sf_dir, (CARD_MONTH, CARD_MONTH))
    sums = facts.agg(*[F.sum(F.when(F.col("kpi_id") == kpi, F.col("valor"))).alias(kpi) for kpi in ("INGRESOS", "SINIESTRALIDAD", "EBITDA")])
    claims = metrics.ratio(F.col("SINIESTRALIDAD"), F.col("INGRESOS"))
    kept = metrics.ratio(F.col("EBITDA"), F.col("SINIESTRALIDAD"))

    def card(name: str, title: str, value: Column, kind: str, target: float | None, pending: str | None = None) -> Column:
        absent = F.lit(None).cast("string")
        fields = {"value": F.lit(target).cast("double")} | dict.fromkeys(
            ("unit", "formatted", "text", "period_label", "growth_label", "extra"), absent
        )
        return F.struct(
            F.lit(name).alias("id"),
            F.lit(title).alias("title"),
            value.alias("value"),
            F.lit(kind).alias("value_format"),
            F.lit(pending).cast("string").alias("pending_label"),
            F.struct(*[c.alias(f) for f, c in fields.items()]).alias("target"),
        )

    rows = sums.select(
        F.inline(
            F.array(
                card("RECLAMOS", "Reclamos sobre ventas", claims, "percent", 0.3),
                card("COBERTURA", "Ventas tras reclamos por reclamo", kept, "ratio", 2.5),
                card("MERMA", "Merma", F.lit(None).cast("double"), "percent", None),
            )
        )
    )
    shown = cards.money_card_faces(conform(rows, schema.KPI_CARD))
    return shown.select("id", "title", "pendiente", "texto", "meta_texto")


def kpi_slicers(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = kpi_actuals(spark, sf_dir, (date(1999, 1, 1), date(1999, 11, 1)))
    chosen = filters.slice_kpis(facts, ("3", "7"), (1999,), (1, 2, 3, 11))
    names = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("code"), "n_name")
    return (
        with_label(chosen, names, "pais", label="n_name")
        .select("kpi_id", "mes", "pais", "etiqueta", F.col("valor").cast("double").alias("valor"))
    )


def kpi_scenario(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actual months as bars; the line over them is the forecast of the KPIs that have one."""
    points = filters.without_gaps(series.monthly_total(kpi_actuals(spark, sf_dir), ("kpi_id", "escenario")))
    return series.bars_and_line(points)


def kpi_read_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts and targets as a source has them, read under their contracts: every month's distance to its KPI's target."""
    folder = new_path(spark, "kpis")
    kpi_actuals(spark, sf_dir).withColumn("nota", F.lit("x")).write.parquet(f"{folder}/actuals")
    testdata.kpi_targets(spark).write.json(f"{folder}/targets")
    facts = read_kpi_actuals(spark, f"{folder}/actuals")
    targets = read_kpi_targets(spark, f"{folder}/targets", "json").select("kpi_id", "target", "direction")
    points = metrics.with_target(series.monthly_total(facts), targets)
    return metrics.target_gap(points, F.col("valor"), F.col("target"), F.col("direction"))


def kpi_without_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    real = filters.scenario_filter(kpi_actuals(spark, sf_dir), with_forecast=False)
    return series.monthly_total(real)


def kpi_series_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = kpi_actuals(spark, sf_dir).withColumn("valor", F.col("valor").cast("double"))
    return series.series_profile(points, ("kpi_id", "pais"))


def kpi_quarterly(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = calendar.quarter_start(F.col("mes"))
    return series.by_period(kpi_actuals(spark, sf_dir), start, calendar.quarter_label(F.col("inicio")))


def kpi_half_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = calendar.half_year_start(F.col("mes"))
    return series.by_period(kpi_actuals(spark, sf_dir), start, calendar.half_year_label(F.col("inicio")))


# ---- series by segment --------------------------------------------------------------------


def _segment_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment_months(spark, sf_dir).withColumn("valor", F.col("valor").cast("double"))


def kpi_grouped_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrays = series.to_grouped(
        _segment_points(spark, sf_dir), "segmento", calendar.month_label(F.col("mes")), "mes"
    )
    return series.grouped_long(arrays)


def kpi_grouped_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.grouped_wide(kpi_grouped_long(spark, sf_dir), SEGMENTS)


def kpi_revenue_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.segment_share(
        customer_lines(spark, sf_dir).withColumnRenamed("c_mktsegment", "segmento"), "segmento", amount()
    )


def kpi_concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.topn_concentration(order_lines(spark, sf_dir), "o_custkey", amount(), 10)


def kpi_concentration_ebitda(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = F.when(F.col("l_returnflag") != "R", amount())
    return metrics.topn_concentration(order_lines(spark, sf_dir), "o_custkey", kept, 10)


def kpi_cycle_vs_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean days from order to shipment per quarter, against the first year's mean."""
    days = F.datediff("l_shipdate", "o_orderdate")
    quarters = (
        order_lines(spark, sf_dir)
        .groupBy(calendar.quarter_start(F.col("o_orderdate")).alias("inicio"))
        .agg(F.sum(days).alias("dias"), F.count(days).alias("n"))
    )
    first_year = F.col("inicio") < F.lit(date(1996, 1, 1))
    mean = metrics.ratio(F.sum("dias"), F.sum("n")).alias("valor")
    points = quarters.select(
        "inicio",
        calendar.quarter_label(F.col("inicio")).alias("periodo_label"),
        metrics.ratio(F.col("dias"), F.col("n")).alias("valor"),
    )
    return series.baseline_first(points, quarters.filter(first_year).agg(mean))


def kpi_yoy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.change_vs(_segment_points(spark, sf_dir), "same_month_last_year", ("segmento",))


def kpi_vs_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.change_vs(_segment_points(spark, sf_dir), "first", ("segmento",))


def kpi_vs_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.change_vs(_segment_points(spark, sf_dir), 1_000_000.0, ("segmento",))


def kpi_cagr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over all full years: those with a value in each of their twelve months."""
    yearly = (
        segment_months(spark, sf_dir)
        .groupBy("segmento", F.trunc("mes", "year").alias("mes"))
        .agg(F.sum("valor").cast("double").alias("valor"), F.count(F.lit(1)).alias("meses"))
        .filter("meses = 12")
        .drop("meses")
    )
    grown = series.cagr(yearly, ("segmento",))
    return grown.withColumn("cagr", F.round("cagr", 9))


# ---- ratios -----------------------------------------------------------------------------


def kpi_ebitda_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = kpi_actuals(spark, sf_dir)

    def of(kpi: str) -> Column:
        return F.when(F.col("kpi_id") == kpi, F.col("valor"))

    yearly = metrics.ratio_kpi(facts, of("EBITDA"), of("INGRESOS"), [F.year("mes").alias("anio")])
    return yearly.select(
        "anio",
        F.col("numerador").cast("double").alias("numerador"),
        F.col("denominador").cast("double").alias("denominador"),
        "ratio",
    )


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("dia", F.to_date("ts"))


def kpi_hit_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed over probable, by count and by amount."""
    kind, value = F.col("event_type"), F.col("value").cast("decimal(18,2)")
    counted = _events(spark, sf_dir).filter(kind.isin("purchase", "click")).groupBy("dia").agg(
        F.count_if(kind == "purchase").alias("cerrados"),
        F.count_if(kind == "click").alias("probables"),
        F.sum(F.when(kind == "purchase", value)).alias("monto_cerrado"),
        F.sum(F.when(kind == "click", value)).alias("monto_probable"),
    )
    return counted.select(
        "dia",
        "cerrados",
        "probables",
        metrics.ratio(F.col("cerrados"), F.col("probables")).alias("ratio"),
        F.col("monto_cerrado").cast("double").alias("monto_cerrado"),
        F.col("monto_probable").cast("double").alias("monto_probable"),
        metrics.ratio(F.col("monto_cerrado"), F.col("monto_probable")).alias("ratio_monto"),
    )


def kpi_sla(spark: SparkSession, sf_dir: str) -> DataFrame:
    on_time = F.col("l_shipdate") <= F.col("o_orderdate") + F.expr("INTERVAL 60 DAYS")
    mes = calendar.month_start(F.col("o_orderdate")).alias("mes")
    return metrics.ratio_kpi(order_lines(spark, sf_dir), metrics.rows_where(on_time), F.lit(1), [mes])


def kpi_on_time_countries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Countries whose lines are mostly on time, over countries with lines, per month."""
    on_time = F.col("l_shipdate") <= F.col("o_orderdate") + F.expr("INTERVAL 60 DAYS")
    mes = calendar.month_start(F.col("o_orderdate")).alias("mes")
    per_country = metrics.ratio_kpi(
        customer_lines(spark, sf_dir), metrics.rows_where(on_time), F.lit(1), [mes, "c_nationkey"]
    )
    return metrics.ratio_kpi(per_country, metrics.rows_where(F.col("ratio") >= 0.5), F.lit(1), ["mes"])


def kpi_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finished orders over customers, per region. Orders are counted per customer before the join,
    so a customer with very many orders joins as one row."""
    finished = (
        table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.count("*").alias("n"))
    )
    nations = table(spark, sf_dir, "nation").join(
        table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    customers = (
        table(spark, sf_dir, "customer")
        .join(finished, F.col("c_custkey") == F.col("o_custkey"), "left")
        .join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    )
    return metrics.ratio_kpi(customers, F.col("n"), F.lit(1), ["r_name"])


def kpi_supplier_adoption(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers active on a day over registered suppliers."""
    registered = table(spark, sf_dir, "supplier").agg(F.count("*").alias("n")).scalar()
    active = (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.to_date("l_shipdate").alias("dia"))
        .agg(F.count_distinct("l_suppkey").alias("numerador"))
    )
    return active.withColumn("denominador", registered).withColumn(
        "ratio", metrics.ratio(F.col("numerador"), F.col("denominador"))
    )


def kpi_uptime(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.ratio_kpi(
        _events(spark, sf_dir), metrics.rows_where(F.col("event_type") != "error"), F.lit(1), ["dia"]
    )


def kpi_fcr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations settled in one exchange over all, by who wrote the last turn."""
    talks = (
        table(spark, sf_dir, "conversations")
        .groupBy("conv_id")
        .agg(F.max("turn").alias("turn"), F.max_by("role", "turn").alias("ultimo"))
    )
    return metrics.ratio_kpi(talks, metrics.rows_where(F.col("turn") <= 1), F.lit(1), ["ultimo"])


def kpi_abandonment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.gone_next_month(table(spark, sf_dir, "orders"), "o_custkey", "o_orderdate")


def kpi_turnover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.gone_next_month(table(spark, sf_dir, "lineitem"), "l_suppkey", "l_shipdate")


def kpi_abandonment_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """This month's abandonment against last month's."""
    rates = kpi_abandonment(spark, sf_dir).select(F.lit("ABANDONO").alias("kpi_id"), "mes", F.col("ratio").alias("valor"))
    return series.month_over_month(rates)


def kpi_absence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier days without a shipment over all supplier days of the month."""
    suppliers = table(spark, sf_dir, "supplier").agg(F.count("*").alias("n")).scalar()
    present = (
        table(spark, sf_dir, "lineitem")
        .select("l_suppkey", F.to_date("l_shipdate").alias("dia"))
        .distinct()
        .groupBy(calendar.month_start(F.col("dia")).alias("mes"))
        .agg(F.count("*").alias("presentes"))
    )
    expected = suppliers * F.day(F.last_day("mes"))
    return present.withColumn("esperados", expected).select(
        "mes",
        (F.col("esperados") - F.col("presentes")).alias("numerador"),
        F.col("esperados").alias("denominador"),
        metrics.ratio(F.col("esperados") - F.col("presentes"), F.col("esperados")).alias("ratio"),
    )


def kpi_standardisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that meet the standard over all that were looked at, per group."""
    looked_at = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    return metrics.ratio_kpi(looked_at, metrics.rows_where(F.col("quality") == 1), F.lit(1), ["lang"])


def kpi_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed over managed, per half-year."""
    mes = calendar.half_year_start(F.col("o_orderdate")).alias("inicio")
    closed = metrics.rows_where(F.col("o_orderstatus") == "F")
    return metrics.ratio_kpi(table(spark, sf_dir, "orders"), closed, F.lit(1), [mes]).withColumn(
        "periodo_label", calendar.half_year_label(F.col("inicio"))
    )


def kpi_programme_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finished work so far over all work, per quarter; the running sum goes over one row per quarter."""
    start = calendar.quarter_start(F.col("o_orderdate")).alias("inicio")
    done = metrics.rows_where(F.col("o_orderstatus") == "F")
    quarters = metrics.ratio_kpi(table(spark, sf_dir, "orders"), done, F.lit(1), [start]).drop("ratio")
    so_far = Window.orderBy("inicio").rowsBetween(Window.unboundedPreceding, 0)
    everything = Window.partitionBy()
    return quarters.select(
        "inicio",
        calendar.quarter_label(F.col("inicio")).alias("periodo_label"),
        metrics.ratio(F.sum("numerador").over(so_far), F.sum("denominador").over(everything)).alias("avance"),
    )


def kpi_cases_per_agent(spark: SparkSession, sf_dir: str) -> DataFrame:
    services = testdata.services(spark, sf_dir).filter("nodo IS NOT NULL")
    return metrics.per_entity(services, F.col("servicios"), "agente", ["perspectiva", "nodo"])


def kpi_cases_card(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as one card per perspective with a row per node."""
    rows = kpi_cases_per_agent(spark, sf_dir)
    card = cards.multi_value_card(rows, "nodo", "por_entidad", "nodo", ("perspectiva",))
    return card.select(
        "perspectiva",
        cards.is_pending(F.lit(None).cast("double"), F.col("rows")).alias("pendiente"),
        F.size("rows").alias("filas"),
        cards.rows_text(F.col("rows")).alias("texto"),
    )


def kpi_board_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored cards of the three kinds – rows, value, pending – and the face each one shows."""
    rows = kpi_cases_per_agent(spark, sf_dir)
    cases = cards.multi_value_card(rows, "nodo", "por_entidad", "nodo", ("perspectiva",)).select(
        F.concat(F.lit("CASOS "), "perspectiva").alias("id"), "rows"
    )
    events = metrics.ratio_kpi(table(spark, sf_dir, "events"), metrics.rows_where(F.col("event_type") != "error"), F.lit(1))
    uptime = events.select(
        F.lit("DISPONIBILIDAD").alias("id"),
        F.col("ratio").alias("value"),
        numbers.percent(F.col("ratio"), 1).alias("display_value"),
        F.struct(F.lit("Eventos").alias("label"), numbers.grouped_number(F.col("denominador")).alias("value")).alias(
            "secondary_line"
        ),
    )
    # finished orders over all orders stand for usage
    finished = metrics.ratio_kpi(table(spark, sf_dir, "orders"), metrics.rows_where(F.col("o_orderstatus") == "F"), F.lit(1))
    adoption = finished.select(
        F.lit("ADOPCION").alias("id"), F.col("ratio").alias("value"), numbers.percent(F.col("ratio"), 1).alias("display_value")
    )
    stored = cases.unionByName(uptime, True).unionByName(adoption, True)
    return cards.card_faces(conform(stored, schema.KPI_CARD)).select("id", "pendiente", "cara", "texto", "segunda_linea")


def kpi_number_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces per segment and year, as the boards write them."""
    pieces = metrics.segment_share(
        customer_lines(spark, sf_dir).withColumn("anio", F.year("o_orderdate")),
        "c_mktsegment",
        F.col("l_quantity").cast("long"),
        ("anio",),
        order=F.when(F.col("c_mktsegment") == "HOUSEHOLD", 0).otherwise(1),
    )
    return pieces.select(
        "anio",
        "c_mktsegment",
        "principal",
        numbers.compact_count(F.col("valor")).alias("compacto"),
        numbers.grouped_number(F.col("valor")).alias("agrupado"),
        numbers.percent(F.col("participacion"), 0).alias("pct"),
    )


def kpi_cost_to_serve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims amount per customer served, per year."""
    claims = F.when(F.col("l_returnflag") == "R", amount())
    yearly = metrics.per_entity(
        order_lines(spark, sf_dir), claims, "o_custkey", [F.year("o_orderdate").alias("anio")]
    )
    return yearly.withColumn("medida", F.col("medida").cast("double"))


def kpi_milestones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as milestone cards: finished is green, open is red, anything else amber by default."""
    state = F.col("o_orderstatus")
    told = F.when(state == "F", "green").when(state == "O", "red").otherwise(state)
    return (
        table(spark, sf_dir, "orders")
        .groupBy(F.col("o_orderpriority").alias("title"), state.alias("subtitle"), told.alias("status"))
        .agg(F.count("*").alias("pedidos"))
        .withColumn("colour", cards.milestone_colour(F.col("status")))
    )


_MES = "CAST(date_trunc('month', o_orderdate) AS DATE) AS mes"
_LINES = "lineitem JOIN orders ON l_orderkey = o_orderkey"
_ON_TIME = "CAST(count(*) FILTER (l_shipdate <= o_orderdate + INTERVAL 60 DAY) AS BIGINT)"


def _gone_sql(source: str, entity: str, day: str) -> str:
    return f"""
WITH act AS (SELECT DISTINCT {entity} AS e, CAST(date_trunc('month', {day}) AS DATE) AS mes FROM {source}),
gone AS (
  SELECT a.mes, count(*) FILTER (n.e IS NULL) AS numerador, count(*) AS denominador
  FROM act a LEFT JOIN act n ON a.e = n.e AND n.mes = CAST(a.mes + INTERVAL 1 MONTH AS DATE) GROUP BY a.mes)
SELECT mes, numerador, denominador, numerador / denominador AS ratio FROM gone
WHERE mes < (SELECT max(mes) FROM act)
"""


_CASES_SQL = """
SELECT perspectiva, nodo, CAST(sum(servicios) AS BIGINT) AS medida, count(DISTINCT agente) AS entidades,
  CAST(sum(servicios) AS BIGINT) / count(DISTINCT agente) AS por_entidad
FROM services WHERE nodo IS NOT NULL GROUP BY perspectiva, nodo
"""

_CARDS_SQL = f"""
, t AS (SELECT * FROM (VALUES
  ('INGRESOS', 'Ventas del mes', 22000000.0, NULL, NULL),
  ('EBITDA', 'Ventas tras reclamos', 15500000.0, NULL, NULL),
  ('SINIESTRALIDAD', 'Reclamos del mes', NULL, 'sin meta', NULL),
  ('FLUJO', 'Caja del mes', NULL, NULL, 'sin dato')) AS v(kpi_id, title, meta, formatted, pending_label)),
c AS (
  SELECT t.kpi_id, title, a.valor, CAST(meta AS DOUBLE) AS meta, formatted, pending_label,
    coalesce(b.valor = 0, true) AS mom_pendiente, (a.valor - b.valor) / nullif(b.valor, 0) AS mom_delta
  FROM t LEFT JOIN total a ON a.kpi_id = t.kpi_id AND a.mes = DATE '2000-12-01'
  LEFT JOIN total b ON b.kpi_id = t.kpi_id AND b.mes = DATE '2000-11-01')
SELECT kpi_id, title, valor, valor IS NULL AS pendiente,
  coalesce({_compact_sql('valor', "'USD'")}, pending_label, title) AS texto, 'Dic' AS mes_label,
  mom_pendiente, mom_delta, {_delta_label_sql('mom_delta')} AS mom_etiqueta,
  CASE WHEN mom_delta < 0 THEN '↘' WHEN mom_delta > 0 THEN '↗' WHEN mom_delta = 0 THEN '→' END AS mom_flecha,
  'Nov' AS mom_mes_previo, meta,
  coalesce(formatted, CASE WHEN meta IS NULL THEN 'TBD' ELSE {_compact_sql('meta', "'USD'")} END) AS meta_texto
FROM c
"""

_MOM_JOIN = "total b ON b.kpi_id = p.kpi_id AND b.mes = CAST(p.mes - INTERVAL 1 MONTH AS DATE)"
_ABANDONED_SQL = _gone_sql("orders", "o_custkey", "o_orderdate")


def _period_sql(start: str, label: str) -> str:
    return f"""
SELECT kpi_id, inicio, CAST(sum(valor) AS DOUBLE) AS valor, {label} AS periodo_label
FROM (SELECT kpi_id, valor, {start} AS inicio FROM facts) GROUP BY kpi_id, inicio
"""


_YY = "substr(CAST(year(inicio) AS VARCHAR), 3, 2)"
_MONTH_LABEL = (
    "list_extract(['Ene','Feb','Mar','Abr','May','Jun','Jul','Ago','Sep','Oct','Nov','Dic'], CAST(month(mes) AS BIGINT))"
    " || ' ' || CAST(year(mes) AS VARCHAR)"
)
_HALF_START = "make_date(year({0}), CASE WHEN month({0}) <= 6 THEN 1 ELSE 7 END, 1)"
_HALF_LABEL = f"CASE WHEN month(inicio) <= 6 THEN '1er Sem''' ELSE '2do Sem''' END || {_YY}"
_QUARTER_LABEL = f"'Q' || CAST(quarter(inicio) AS VARCHAR) || '''' || {_YY}"
_LONG_SQL = f"""
, axis AS (SELECT mes, CAST(row_number() OVER (ORDER BY mes) - 1 AS INTEGER) AS pos FROM (SELECT DISTINCT mes FROM seg)),
names AS (SELECT DISTINCT segmento FROM seg),
grouped AS (SELECT names.segmento AS name, {_MONTH_LABEL} AS categoria, valor, pos
  FROM names CROSS JOIN axis LEFT JOIN (SELECT segmento, mes AS m, valor FROM seg) s ON s.segmento = names.segmento AND m = mes)
"""

_PERIOD_TARGETS_SQL = """
, t(kpi_id, desde, hasta, target) AS (VALUES
  ('INGRESOS', DATE '0001-01-01', DATE '1996-12-01', CAST(18000000 AS DOUBLE)),
  ('INGRESOS', DATE '1996-07-01', DATE '1999-06-30', 21000000),
  ('INGRESOS', DATE '1999-01-01', DATE '9999-12-31', 24000000),
  ('SINIESTRALIDAD', DATE '1997-01-15', DATE '1998-12-01', 7000000),
  ('EBITDA', DATE '2001-01-01', DATE '1995-01-01', 1)),
held AS (
  SELECT v.kpi_id, mes, valor, (SELECT arg_max(target, desde) FROM t
    WHERE t.kpi_id = v.kpi_id AND v.mes BETWEEN t.desde AND t.hasta) AS target FROM total v)
SELECT kpi_id, mes, valor, target, valor - target AS brecha, valor >= target AS cumple FROM held
"""


def _projection_sql(points: str, keys: str, months: int) -> str:
    names = keys.split(", ")
    same = " AND ".join(f"f.{k} = o.{k}" for k in names)
    of = ", ".join(f"o.{k}" for k in names)
    return f"""
, ordered AS (
  SELECT {keys}, mes, year(mes) * 12 + month(mes) AS m, v, row_number() OVER (PARTITION BY {keys} ORDER BY mes) AS n
  FROM (SELECT {keys}, mes, {points})),
fold AS (
  SELECT {keys}, mes, m, n, v AS base, CAST(0 AS DOUBLE) AS slope, CAST(0 AS DOUBLE) AS square FROM ordered WHERE n = 1
  UNION ALL
  SELECT {of}, o.mes, o.m, o.n,
    CASE WHEN f.n = 1 THEN o.v ELSE o.v * 5e-1 + (f.base + f.slope * (o.m - f.m)) * 5e-1 END,
    CASE WHEN f.n = 1 THEN (o.v - f.base) / (o.m - f.m)
      ELSE ((o.v * 5e-1 + (f.base + f.slope * (o.m - f.m)) * 5e-1) - f.base) * 3e-1 / (o.m - f.m) + f.slope * 7e-1 END,
    f.square + CASE WHEN f.n >= 2 THEN (o.v - (f.base + f.slope * (o.m - f.m))) * (o.v - (f.base + f.slope * (o.m - f.m)))
      ELSE 0 END
  FROM fold f JOIN ordered o ON {same} AND o.n = f.n + 1),
ends AS (SELECT * FROM fold QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY n DESC) = 1),
steps AS (SELECT *, base + paso * slope AS valor,
    CASE WHEN n >= 3 THEN sqrt(square / (n - 2)) * 196e-2 * sqrt(paso) END AS wide
  FROM ends, (SELECT CAST(unnest(range(1, {months + 1})) AS INTEGER) AS paso))
SELECT {keys}, CAST(mes + to_months(paso) AS DATE) AS mes, paso, valor, valor - wide AS ci_lower, valor + wide AS ci_upper FROM steps
"""


_RATE_CARDS_SQL = """
, s AS (SELECT sum(valor) FILTER (kpi_id = 'INGRESOS') AS i, sum(valor) FILTER (kpi_id = 'SINIESTRALIDAD') AS c,
  sum(valor) FILTER (kpi_id = 'EBITDA') AS e FROM facts WHERE mes = DATE '2000-12-01')
SELECT 'RECLAMOS' AS id, 'Reclamos sobre ventas' AS title, false AS pendiente,
  printf('%.2f', CAST(c AS DOUBLE) / CAST(i AS DOUBLE) * 100) || '%' AS texto, '30.00%' AS meta_texto FROM s
UNION ALL SELECT 'COBERTURA', 'Ventas tras reclamos por reclamo', false, printf('%.3f', CAST(e AS DOUBLE) / CAST(c AS DOUBLE)), '2.500' FROM s
UNION ALL SELECT 'MERMA', 'Merma', true, 'Merma', 'TBD'
"""

_RECURSIVE_FACTS_SQL = _FACTS_SQL.replace("WITH priced", "WITH RECURSIVE priced", 1)

QUERIES: dict[str, Query] = {
    "kpi_period_targets": Query(kpi_period_targets, _FACTS_SQL + _PERIOD_TARGETS_SQL),
    "kpi_projection": Query(
        kpi_projection, _RECURSIVE_FACTS_SQL + _projection_sql("valor AS v FROM seg", "segmento", 6)
    ),
    "kpi_projection_nations": Query(
        kpi_projection_nations,
        _RECURSIVE_FACTS_SQL + _projection_sql("CAST(valor AS DOUBLE) AS v FROM facts", "kpi_id, pais", 3),
    ),
    "kpi_read_facts": Query(
        kpi_read_facts,
        _FACTS_SQL
        + """
SELECT kpi_id, mes, valor, target, direction, valor - target AS brecha,
  CASE WHEN direction = '<=' THEN valor <= target ELSE valor >= target END AS cumple
FROM total LEFT JOIN (SELECT kpi_id, CAST(target AS DOUBLE) AS target, direction FROM (VALUES
  ('INGRESOS', 22000000.0, '>='), ('EBITDA', 15500000.0, '>='), ('SINIESTRALIDAD', NULL, '<=')) AS v(kpi_id, target, direction))
USING (kpi_id)""",
    ),
    "kpi_rate_cards": Query(kpi_rate_cards, _FACTS_SQL + _RATE_CARDS_SQL),
    "kpi_mom": Query(kpi_mom, _FACTS_SQL + _change_sql("total", "kpi_id", _MOM_JOIN)),
    "kpi_mom_label": Query(
        kpi_mom_label,
        _FACTS_SQL
        + f"""
, m AS (SELECT p.kpi_id, p.mes, (p.valor - b.valor) / nullif(b.valor, 0) AS delta FROM total p LEFT JOIN {_MOM_JOIN})
SELECT kpi_id, {_MONTH_LABEL} AS mes_label, {_delta_label_sql('delta')} AS etiqueta,
  CASE WHEN delta < 0 THEN '↘' WHEN delta > 0 THEN '↗' WHEN delta = 0 THEN '→' END AS flecha FROM m""",
    ),
    "kpi_cards": Query(kpi_cards, _FACTS_SQL + _CARDS_SQL),
    "kpi_target_gap": Query(
        kpi_target_gap,
        _FACTS_SQL
        + """
SELECT kpi_id, mes, valor, target, direction, valor - target AS brecha,
  CASE WHEN direction = '<=' THEN valor <= target ELSE valor >= target END AS cumple
FROM total LEFT JOIN (SELECT kpi_id, CAST(target AS DOUBLE) AS target, direction FROM (VALUES
  ('INGRESOS', 25000000.0, '>='), ('SINIESTRALIDAD', 8000000.0, '<=')) AS v(kpi_id, target, direction))
USING (kpi_id)""",
    ),
    "kpi_slicers": Query(
        kpi_slicers,
        _FACTS_SQL
        + """
SELECT kpi_id, mes, pais, coalesce(n_name, pais) AS etiqueta, CAST(valor AS DOUBLE) AS valor
FROM facts LEFT JOIN nation ON pais = CAST(n_nationkey AS VARCHAR)
WHERE pais IN ('3', '7') AND year(mes) = 1999 AND month(mes) IN (1, 2, 3, 11)""",
    ),
    "kpi_scenario": Query(
        kpi_scenario,
        _FACTS_SQL
        + """
, split AS (SELECT kpi_id, escenario, mes, CAST(sum(valor) AS DOUBLE) AS valor FROM facts GROUP BY ALL),
trend AS (SELECT DISTINCT kpi_id FROM split WHERE escenario = 'FCST')
SELECT *, escenario = 'REAL' AS en_barras, escenario = 'FCST' OR kpi_id NOT IN (SELECT kpi_id FROM trend) AS en_linea
FROM split""",
    ),
    "kpi_without_forecast": Query(
        kpi_without_forecast, _FACTS_SQL + "SELECT * FROM total WHERE mes <= DATE '2000-12-01'"
    ),
    "kpi_series_profile": Query(
        kpi_series_profile,
        _FACTS_SQL
        + """
, p AS (SELECT *, CAST(valor AS DOUBLE) AS v,
  mes - lag(mes) OVER (PARTITION BY kpi_id, pais ORDER BY mes) AS dias FROM facts)
SELECT kpi_id, pais, count(*) AS puntos, min(least(v, coalesce(ci_lower, v), coalesce(ci_upper, v))) AS minimo,
  max(greatest(v, coalesce(ci_lower, v), coalesce(ci_upper, v))) AS maximo,
  count(*) FILTER (ci_lower IS NOT NULL AND ci_upper IS NOT NULL) AS con_banda,
  CAST(coalesce(min(dias), 365) AS INTEGER) AS dias_minimos FROM p GROUP BY kpi_id, pais""",
    ),
    "kpi_quarterly": Query(
        kpi_quarterly, _FACTS_SQL + _period_sql("CAST(date_trunc('quarter', mes) AS DATE)", _QUARTER_LABEL)
    ),
    "kpi_half_year": Query(kpi_half_year, _FACTS_SQL + _period_sql(_HALF_START.format("mes"), _HALF_LABEL)),
    "kpi_grouped_long": Query(
        kpi_grouped_long, _FACTS_SQL + _LONG_SQL + "SELECT name, pos, categoria, valor FROM grouped"
    ),
    "kpi_grouped_wide": Query(
        kpi_grouped_wide,
        _FACTS_SQL
        + _LONG_SQL
        + "SELECT pos, categoria, "
        + ", ".join(f"max(valor) FILTER (name = '{s}') AS \"{s}\"" for s in SEGMENTS)
        + " FROM grouped GROUP BY pos, categoria",
    ),
    "kpi_revenue_mix": Query(
        kpi_revenue_mix,
        _FACTS_SQL
        + """
, mix AS (SELECT c_mktsegment AS segmento, sum(amount) AS suma FROM priced
  JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY ALL)
SELECT segmento, CAST(suma AS DOUBLE) AS valor,
  CAST(suma AS DOUBLE) / CAST(sum(suma) OVER () AS DOUBLE) AS participacion,
  row_number() OVER (ORDER BY suma DESC, segmento) = 1 AS principal FROM mix""",
    ),
    "kpi_concentration": Query(
        kpi_concentration,
        _FACTS_SQL
        + """
, best AS (SELECT o_custkey, sum(amount) AS v FROM priced JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL),
s AS (SELECT CAST((SELECT sum(v) FROM (SELECT v FROM best ORDER BY v DESC, o_custkey LIMIT 10)) AS DOUBLE) AS top,
  CAST((SELECT sum(v) FROM best) AS DOUBLE) AS total)
SELECT top, total, top / total AS concentracion FROM s""",
    ),
    "kpi_concentration_ebitda": Query(
        kpi_concentration_ebitda,
        _FACTS_SQL
        + """
, best AS (SELECT o_custkey, sum(amount) AS v FROM priced JOIN orders ON l_orderkey = o_orderkey
  WHERE l_returnflag <> 'R' GROUP BY ALL),
s AS (SELECT CAST((SELECT sum(v) FROM (SELECT v FROM best ORDER BY v DESC, o_custkey LIMIT 10)) AS DOUBLE) AS top,
  CAST((SELECT sum(v) FROM best) AS DOUBLE) AS total)
SELECT top, total, top / total AS concentracion FROM s""",
    ),
    "kpi_cycle_vs_baseline": Query(
        kpi_cycle_vs_baseline,
        f"""
WITH d AS (SELECT CAST(date_trunc('quarter', o_orderdate) AS DATE) AS inicio,
    date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS dias FROM {_LINES}),
b AS (SELECT CAST(sum(dias) AS DOUBLE) / count(dias) AS base FROM d WHERE inicio < DATE '1996-01-01'),
p AS (
  SELECT CAST(NULL AS DATE) AS inicio, 'Baseline' AS periodo_label, base AS valor FROM b
  UNION ALL SELECT inicio, {_QUARTER_LABEL}, CAST(sum(dias) AS DOUBLE) / count(dias) FROM d GROUP BY inicio)
SELECT p.*, base, false AS pendiente, (valor - base) / base AS delta FROM p, b""",
    ),
    "kpi_yoy": Query(
        kpi_yoy,
        _FACTS_SQL
        + _change_sql("seg", "segmento", "seg b ON b.segmento = p.segmento AND b.mes = CAST(p.mes - INTERVAL 1 YEAR AS DATE)"),
    ),
    "kpi_vs_baseline": Query(
        kpi_vs_baseline,
        _FACTS_SQL
        + _change_sql(
            "seg",
            "segmento",
            "(SELECT segmento, arg_min(valor, mes) AS valor FROM seg GROUP BY segmento) b ON b.segmento = p.segmento",
        ),
    ),
    "kpi_vs_reference": Query(
        kpi_vs_reference,
        _FACTS_SQL + _change_sql("seg", "segmento", "(SELECT CAST(1000000 AS DOUBLE) AS valor) b ON true"),
    ),
    "kpi_cagr": Query(
        kpi_cagr,
        _FACTS_SQL
        + """
, y AS (SELECT c_mktsegment AS segmento, CAST(date_trunc('year', o_orderdate) AS DATE) AS mes,
  CAST(sum(amount) AS DOUBLE) AS valor FROM priced JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey GROUP BY ALL HAVING count(DISTINCT month(o_orderdate)) = 12),
e AS (SELECT segmento, min(mes) AS desde, max(mes) AS hasta, arg_min(valor, mes) AS primero,
  arg_max(valor, mes) AS ultimo FROM y GROUP BY segmento)
SELECT *, round(pow(ultimo / primero, 1.0 / (year(hasta) - year(desde))) - 1, 9) AS cagr FROM e""",
    ),
    "kpi_ebitda_margin": Query(
        kpi_ebitda_margin,
        _FACTS_SQL
        + """
SELECT anio, CAST(e AS DOUBLE) AS numerador, CAST(i AS DOUBLE) AS denominador,
  CAST(e AS DOUBLE) / CAST(i AS DOUBLE) AS ratio FROM (
  SELECT CAST(year(mes) AS INTEGER) AS anio, sum(valor) FILTER (kpi_id = 'EBITDA') AS e,
    sum(valor) FILTER (kpi_id = 'INGRESOS') AS i FROM facts GROUP BY ALL)""",
    ),
    "kpi_hit_ratio": Query(
        kpi_hit_ratio,
        """
SELECT dia, cerrados, probables, cerrados / nullif(probables, 0) AS ratio,
  CAST(mc AS DOUBLE) AS monto_cerrado, CAST(mp AS DOUBLE) AS monto_probable,
  CAST(mc AS DOUBLE) / nullif(CAST(mp AS DOUBLE), 0) AS ratio_monto FROM (
  SELECT CAST(ts AS DATE) AS dia, count(*) FILTER (event_type = 'purchase') AS cerrados,
    count(*) FILTER (event_type = 'click') AS probables,
    sum(CAST(value AS DECIMAL(18,2))) FILTER (event_type = 'purchase') AS mc,
    sum(CAST(value AS DECIMAL(18,2))) FILTER (event_type = 'click') AS mp
  FROM events WHERE event_type IN ('purchase', 'click') GROUP BY ALL)""",
    ),
    "kpi_sla": Query(kpi_sla, _ratio_sql(_MES, _ON_TIME, "count(*)", _LINES)),
    "kpi_on_time_countries": Query(
        kpi_on_time_countries,
        f"""
WITH c AS (SELECT {_MES}, c_nationkey, {_ON_TIME} / count(*) AS r
  FROM {_LINES} JOIN customer ON o_custkey = c_custkey GROUP BY ALL)
SELECT mes, numerador, denominador, numerador / denominador AS ratio FROM (
  SELECT mes, count(*) FILTER (r >= 0.5) AS numerador, count(*) AS denominador FROM c GROUP BY mes)""",
    ),
    "kpi_frequency": Query(
        kpi_frequency,
        """
SELECT r_name, numerador, denominador, numerador / denominador AS ratio FROM (
  SELECT r_name, count(o_orderkey) AS numerador, count(DISTINCT c_custkey) AS denominador
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'F' GROUP BY r_name)""",
    ),
    "kpi_supplier_adoption": Query(
        kpi_supplier_adoption,
        """
SELECT dia, numerador, denominador, numerador / denominador AS ratio FROM (
  SELECT CAST(l_shipdate AS DATE) AS dia, count(DISTINCT l_suppkey) AS numerador,
    (SELECT count(*) FROM supplier) AS denominador FROM lineitem GROUP BY ALL)""",
    ),
    "kpi_uptime": Query(
        kpi_uptime,
        _ratio_sql("CAST(ts AS DATE) AS dia", "count(*) FILTER (event_type <> 'error')", "count(*)", "events"),
    ),
    "kpi_fcr": Query(
        kpi_fcr,
        _ratio_sql(
            "ultimo",
            "count(*) FILTER (turn <= 1)",
            "count(*)",
            "(SELECT conv_id, max(turn) AS turn, arg_max(role, turn) AS ultimo FROM conversations GROUP BY conv_id)",
        ),
    ),
    "kpi_abandonment": Query(kpi_abandonment, _ABANDONED_SQL),
    "kpi_turnover": Query(kpi_turnover, _gone_sql("lineitem", "l_suppkey", "l_shipdate")),
    "kpi_absence": Query(
        kpi_absence,
        """
WITH p AS (SELECT CAST(date_trunc('month', dia) AS DATE) AS mes, count(*) AS presentes FROM (
    SELECT DISTINCT l_suppkey, CAST(l_shipdate AS DATE) AS dia FROM lineitem) GROUP BY ALL),
e AS (SELECT mes, presentes, (SELECT count(*) FROM supplier) * day(last_day(mes)) AS esperados FROM p)
SELECT mes, esperados - presentes AS numerador, esperados AS denominador,
  (esperados - presentes) / esperados AS ratio FROM e""",
    ),
    "kpi_abandonment_change": Query(
        kpi_abandonment_change,
        f"WITH rates AS (SELECT 'ABANDONO' AS kpi_id, mes, ratio AS valor FROM ({_ABANDONED_SQL}))"
        + _change_sql("rates", "kpi_id", "rates b ON b.mes = CAST(p.mes - INTERVAL 1 MONTH AS DATE)"),
    ),
    "kpi_standardisation": Query(
        kpi_standardisation,
        _ratio_sql("lang", "count(*) FILTER (quality = 1)", "count(*)", "labels JOIN documents USING (doc_id)"),
    ),
    "kpi_contracts": Query(
        kpi_contracts,
        f"SELECT *, {_HALF_LABEL} AS periodo_label FROM ("
        + _ratio_sql(
            _HALF_START.format("o_orderdate") + " AS inicio", "count(*) FILTER (o_orderstatus = 'F')", "count(*)", "orders"
        )
        + ")",
    ),
    "kpi_programme_progress": Query(
        kpi_programme_progress,
        f"""
SELECT inicio, {_QUARTER_LABEL} AS periodo_label,
  CAST(sum(n) OVER (ORDER BY inicio) AS DOUBLE) / CAST(sum(d) OVER () AS DOUBLE) AS avance FROM (
  SELECT CAST(date_trunc('quarter', o_orderdate) AS DATE) AS inicio,
    count(*) FILTER (o_orderstatus = 'F') AS n, count(*) AS d FROM orders GROUP BY ALL)""",
    ),
    "kpi_cases_per_agent": Query(kpi_cases_per_agent, SERVICES_SQL + _CASES_SQL),
    "kpi_cases_card": Query(
        kpi_cases_card,
        SERVICES_SQL
        + f"""
, cases AS ({_CASES_SQL})
SELECT perspectiva, false AS pendiente, CAST(count(*) AS INTEGER) AS filas,
  string_agg(nodo || ' ' || rtrim(rtrim(format('{{:,.3f}}', por_entidad), '0'), '.'), ' | ' ORDER BY nodo) AS texto
FROM cases GROUP BY perspectiva""",
    ),
    "kpi_board_cards": Query(
        kpi_board_cards,
        SERVICES_SQL
        + f"""
, cases AS ({_CASES_SQL}), e AS (SELECT count(*) AS n, count(*) FILTER (event_type <> 'error') AS ok FROM events)
SELECT 'CASOS ' || perspectiva AS id, false AS pendiente, 'filas' AS cara, string_agg(
  nodo || ' ' || rtrim(rtrim(format('{{:,.3f}}', por_entidad), '0'), '.'), ' | ' ORDER BY nodo) AS texto,
  '' AS segunda_linea FROM cases GROUP BY perspectiva
UNION ALL SELECT 'DISPONIBILIDAD', false, 'valor', printf('%.1f', ok / n * 100) || '%',
  'Eventos ' || format('{{:,}}', n) FROM e
UNION ALL SELECT 'ADOPCION', false, 'valor', printf('%.1f', count(*) FILTER (o_orderstatus = 'F') / count(*) * 100) || '%', ''
  FROM orders""",
    ),
    "kpi_number_labels": Query(
        kpi_number_labels,
        """
WITH p AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS anio, c_mktsegment, CAST(sum(l_quantity) AS BIGINT) AS v
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY ALL)
SELECT anio, c_mktsegment, c_mktsegment = 'HOUSEHOLD' AS principal,
  CASE WHEN v >= 1e6 THEN printf('%.1fM', v / 1e6)
       WHEN v >= 1e3 THEN CAST(CAST(floor(v / 1e3 + 0.5) AS BIGINT) AS VARCHAR) || 'K'
       ELSE CAST(v AS VARCHAR) END AS compacto,
  format('{:,}', v) AS agrupado,
  printf('%.0f', v / CAST(sum(v) OVER (PARTITION BY anio) AS DOUBLE) * 100) || '%' AS pct FROM p""",
    ),
    "kpi_cost_to_serve": Query(
        kpi_cost_to_serve,
        _FACTS_SQL
        + """
SELECT anio, CAST(m AS DOUBLE) AS medida, entidades, CAST(m AS DOUBLE) / entidades AS por_entidad FROM (
  SELECT CAST(year(o_orderdate) AS INTEGER) AS anio, coalesce(sum(amount) FILTER (l_returnflag = 'R'), 0) AS m,
    count(DISTINCT o_custkey) AS entidades FROM priced JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL)""",
    ),
    "kpi_milestones": Query(
        kpi_milestones,
        """
SELECT title, subtitle, status, pedidos, CASE WHEN status IN ('green', 'amber', 'red') THEN status ELSE 'amber' END
  AS colour FROM (SELECT o_orderpriority AS title, o_orderstatus AS subtitle, CASE o_orderstatus WHEN 'F' THEN 'green'
  WHEN 'O' THEN 'red' ELSE o_orderstatus END AS status, count(*) AS pedidos FROM orders GROUP BY ALL)""",
    ),
}
