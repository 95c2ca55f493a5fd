import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from opsboard import schema
from opsboard.operators import cards, metrics, series
from opsboard.sources.dictionaries import small_table


def month(index):
    return dt.date(2024 + index // 12, index % 12 + 1, 1)


@pytest.fixture
def points(spark):
    """Series points from (key, month number, value)."""

    def make(*values):
        return spark.createDataFrame(
            [(k, month(m), v) for k, m, v in values], "kpi_id string, mes date, valor double"
        )

    return make


def test_month_over_month_looks_at_the_previous_month_only(points, rows):
    df = points(
        ("k", 0, 100.0), ("k", 1, 150.0), ("k", 3, 90.0), ("k", 4, 0.0), ("k", 5, 5.0), ("k", 6, None), ("k", 7, 1.0),
        ("neg", 0, -10.0), ("neg", 1, -5.0), ("one", 11, 1.0),
    )
    got = rows(series.month_over_month(df).orderBy("kpi_id", "mes"), "kpi_id", "base", "pendiente", "delta")
    assert got == [
        ("k", None, True, None),
        ("k", 100.0, False, 0.5),
        ("k", None, True, None),  # its previous month is missing
        ("k", 90.0, False, -1.0),
        ("k", 0.0, True, None),
        ("k", 5.0, True, None),
        ("k", None, True, None),
        ("neg", None, True, None),
        ("neg", -10.0, False, -0.5),
        ("one", None, True, None),
    ]


def test_other_bases(points, rows):
    df = points(("k", 0, 80.0), ("k", 3, 40.0), ("k", 12, 120.0), ("k", 13, 30.0))

    def deltas(base):
        return [d for (d,) in rows(series.change_vs(df, base).orderBy("mes"), "delta")]

    assert deltas("same_month_last_year") == [None, None, 0.5, None]
    assert deltas("first") == [0.0, -0.5, 0.5, -0.625]
    assert deltas(80.0) == [0.0, -0.5, 0.5, -0.625]
    assert deltas(0) == [None] * 4


def test_cagr(points, rows):
    df = points(("k", 0, 100.0), ("k", 12, 999.0), ("k", 24, 121.0), ("z", 0, 0.0), ("z", 12, 5.0), ("one", 0, 7.0))
    got = dict(rows(series.cagr(df), "kpi_id", "cagr"))
    assert got["k"] == pytest.approx(0.1) and got["z"] is None and got["one"] is None


def test_series_profile(spark, rows):
    df = small_table(
        spark,
        [
            ("k", month(0), None, None, Decimal(100), 85.0, 118.0),
            ("k", month(2), None, None, Decimal(200), None, 90.0),
            ("k", month(1), None, None, Decimal(150), None, None),
            ("one", month(0), None, None, Decimal(5), None, None),
        ],
        schema.KPI_ACTUALS,
    ).withColumn("valor", F.col("valor").cast("double"))
    got = rows(
        series.series_profile(df).orderBy("kpi_id"), "kpi_id", "puntos", "minimo", "maximo", "con_banda", "dias_minimos"
    )
    assert got == [("k", 3, 85.0, 200.0, 1, 29), ("one", 1, 5.0, 5.0, 0, 365)]


def test_both_bounds(spark, rows):
    df = spark.sql("SELECT * FROM VALUES (1, 1D, 2D), (2, 1D, NULL), (3, NULL, 2D), (4, NULL, NULL) AS t(i, lo, hi)")
    got = [r[0] for r in df.orderBy("i").select(series.both_bounds(F.col("lo"), F.col("hi"))).collect()]
    assert [g and tuple(g) for g in got] == [(1.0, 2.0), None, None, None]


def test_trend_replaces_whole_series(points, rows):
    bars = points(("a", 0, 1.0), ("a", 1, 2.0), ("b", 0, 3.0))
    trend = points(("a", 5, 9.0))
    got = rows(series.trend_or_bars(bars, trend).orderBy("kpi_id"), "kpi_id", "valor", "origen")
    assert got == [("a", 9.0, "tendencia"), ("b", 3.0, "barras")]
    assert series.trend_or_bars(bars, trend.limit(0)).count() == 3


def test_grouped_series_long_and_wide(spark, rows):
    df = spark.createDataFrame(
        [(["Ene", "Feb", "Mar"], "x", [1.0, 2.0]), (["Ene", "Feb", "Mar"], "y", [5.0, None, 7.0, 8.0])],
        schema.GROUPED_SERIES,
    )
    long = series.grouped_long(df)
    assert rows(long.orderBy("name", "pos"), "name", "pos", "categoria", "valor") == [
        ("x", 0, "Ene", 1.0), ("x", 1, "Feb", 2.0), ("x", 2, "Mar", None),
        ("y", 0, "Ene", 5.0), ("y", 1, "Feb", None), ("y", 2, "Mar", 7.0),
    ]
    wide = series.grouped_wide(long, ("x", "y"))
    assert rows(wide.orderBy("pos"), "categoria", "x", "y") == [("Ene", 1.0, 5.0), ("Feb", 2.0, None), ("Mar", None, 7.0)]
    back = series.wide_to_long(wide, ("x", "y"))
    assert sorted(map(str, rows(back, "name", "pos", "categoria", "valor"))) == sorted(
        map(str, rows(long, "name", "pos", "categoria", "valor"))
    )


def test_to_grouped_orders_by_position(points, rows):
    df = points(("b", 2, 3.0), ("b", 0, 1.0), ("a", 1, None))
    got = rows(series.to_grouped(df, "kpi_id", F.month("mes").cast("string"), "mes").orderBy("name"), "name", "categories", "valores")
    axis = ["1", "2", "3"]
    assert got == [("a", axis, [None, None, None]), ("b", axis, [1.0, None, 3.0])]


def test_grouped_series_share_one_axis(points, rows):
    df = points(("a", 0, 1.0), ("a", 1, 2.0), ("a", 2, 3.0), ("b", 0, 4.0), ("b", 2, 6.0))
    long = series.grouped_long(series.to_grouped(df, "kpi_id", F.month("mes").cast("string"), "mes"))
    wide = series.grouped_wide(long, ("a", "b")).orderBy("pos")
    assert rows(wide, "pos", "categoria", "a", "b") == [(0, "1", 1.0, 4.0), (1, "2", 2.0, None), (2, "3", 3.0, 6.0)]


def test_the_line_is_the_forecast_where_there_is_one(spark, rows):
    df = spark.createDataFrame(
        [("x", "REAL", 1), ("x", "FCST", 2), ("y", "REAL", 3)], "kpi_id string, escenario string, valor int"
    )
    got = rows(series.bars_and_line(df).orderBy("valor"), "valor", "en_barras", "en_linea")
    assert got == [(1, True, False), (2, False, True), (3, True, True)]


def test_periods_do_not_invent_missing_ones(points, rows):
    from opsboard.functions import calendar

    df = points(("k", 0, 1.0), ("k", 2, 2.0), ("k", 11, 4.0)).withColumn("valor", F.col("valor").cast("decimal(38,4)"))
    quarters = series.by_period(df, calendar.quarter_start(F.col("mes")), calendar.quarter_label(F.col("inicio")))
    assert rows(quarters, "periodo_label", "valor") == [("Q1'24", 3.0), ("Q4'24", 4.0)]


def test_baseline_comes_first(spark, rows):
    points = spark.createDataFrame([(month(3), "Q2'24", 40.0), (month(0), "Q1'24", 43.0)], "inicio date, periodo_label string, valor double")
    got = rows(series.baseline_first(points, spark.sql("SELECT 50D AS valor")), "periodo_label", "valor", "delta")
    assert got == [("Baseline", 50.0, 0.0), ("Q1'24", 43.0, -0.14), ("Q2'24", 40.0, -0.2)]


def test_ratio_kpi_never_divides_by_zero(spark, rows):
    df = spark.sql("SELECT * FROM VALUES ('a', 11, 238), ('b', 1, 0), ('c', NULL, 5) AS t(k, n, d)")
    got = rows(metrics.ratio_kpi(df, F.col("n"), F.col("d"), ["k"]).orderBy("k"), "k", "numerador", "ratio")
    assert got == [("a", 11, 11 / 238), ("b", 1, None), ("c", 0, 0.0)]
    overall = metrics.ratio_kpi(df, metrics.rows_where(F.col("n") > 1), F.lit(1))
    assert rows(overall, "numerador", "denominador") == [(1, 3)]


def test_per_entity(spark, rows):
    df = spark.sql("SELECT * FROM VALUES ('x', 'a', 4), ('x', 'b', 2), ('x', 'a', 3), ('y', NULL, 9) AS t(k, e, v)")
    got = rows(metrics.per_entity(df, F.col("v"), "e", ["k"]).orderBy("k"), "k", "medida", "entidades", "por_entidad")
    assert got == [("x", 9, 2, 4.5), ("y", 9, 0, None)]


def test_concentration_counts_rows_without_a_member_in_the_total_only(spark, rows):
    df = spark.sql("SELECT * FROM VALUES ('a', 5), ('b', 3), ('b', 1), ('c', 1), (NULL, 90) AS t(k, v)")
    for n, top in ((1, 5.0), (2, 9.0), (3, 10.0), (10, 10.0)):
        assert rows(metrics.topn_concentration(df, "k", F.col("v"), n), "top", "total", "concentracion") == [
            (top, 100.0, top / 100)
        ]


def test_segment_share_need_not_add_up(spark, rows):
    df = spark.sql("SELECT * FROM VALUES ('Asist', 87.5D), ('Log', 12D), ('Tec', 1.1D) AS t(s, v)")
    got = rows(metrics.segment_share(df, "s", F.col("v")).orderBy("s"), "s", "participacion", "principal")
    assert got == [("Asist", 87.5 / 100.6, True), ("Log", 12 / 100.6, False), ("Tec", 1.1 / 100.6, False)]


def test_declared_order_decides_the_headline(spark, rows):
    df = spark.sql("SELECT * FROM VALUES ('Pendiente', 42, 1), ('Completado', 58, 2) AS t(s, v, o)")
    got = rows(metrics.segment_share(df, "s", F.col("v"), order=F.col("o")).orderBy("s"), "s", "participacion", "principal")
    assert got == [("Completado", 0.58, False), ("Pendiente", 0.42, True)]


def test_gone_next_month(spark, rows):
    df = spark.createDataFrame(
        [("a", month(0)), ("a", month(0)), ("a", month(1)), ("b", month(0)), ("b", month(2)), ("c", month(2)), (None, month(0))],
        "e string, d date",
    )
    got = rows(metrics.gone_next_month(df, "e", "d").orderBy("mes"), "mes", "numerador", "denominador", "ratio")
    assert got == [(month(0), 1, 2, 0.5), (month(1), 1, 1, 1.0)]


def test_target_gap_by_direction(spark, rows):
    df = spark.sql(
        "SELECT * FROM VALUES (1, 99.1D, 99.5D, '>='), (2, 0.7D, 3D, '<='), (3, 5D, NULL, NULL), (4, 95D, 95D, '>=') AS t(i, v, t, d)"
    )
    got = rows(metrics.target_gap(df, F.col("v"), F.col("t"), F.col("d")).orderBy("i"), "brecha", "cumple")
    assert [g[1] for g in got] == [False, True, None, True]
    assert got[0][0] == pytest.approx(-0.4) and got[2][0] is None


def test_scenario_tag(spark):
    df = spark.createDataFrame([(month(1),), (month(2),)], "mes date").orderBy("mes")
    tag = metrics.scenario_tag(F.col("mes"), F.lit(month(1)))
    assert [r[0] for r in df.select(tag).collect()] == ["REAL", "FCST"]


def test_kpi_cards(spark, rows):
    def fact(kpi, m, value):
        return (kpi, month(m), "gt", "REAL", None if value is None else Decimal(value), None, None)

    facts = small_table(
        spark,
        [fact("A", 1, 60), fact("A", 1, 40), fact("A", 0, 80), fact("B", 1, 7), fact("C", 0, 7), fact("A", 2, 999)],
        schema.KPI_ACTUALS,
    )
    targets = small_table(
        spark,
        [
            ("A", "Uno", "currency", "USD", 17566000.0, ">=", "2026", None, None),
            ("B", "Dos", "currency", "USD", 5.0, ">=", "2026", "listo", None),
            ("C", "Tres", "percent", "%", None, ">=", "2026", None, "Pronto"),
            ("D", "Cuatro", "percent", "%", 0.18, ">=", "2026", None, None),
        ],
        schema.KPI_TARGETS,
    )
    built = cards.kpi_cards(facts, targets, month(1))
    assert dict(built.dtypes)["target"].startswith("struct")
    got = rows(
        cards.flat_cards(built).orderBy("kpi_id"),
        "kpi_id", "texto", "pendiente", "mom_pendiente", "mom_delta", "mom_etiqueta", "mom_flecha", "mom_mes_previo", "meta_texto",
    )
    assert got == [
        ("A", "100.00 USD", False, False, 0.25, "25%", "↗", "Ene", "17.566M USD"),
        ("B", "7.00 USD", False, True, None, None, None, "Ene", "listo"),
        ("C", "Pronto", True, True, None, None, None, "Ene", "TBD"),
        ("D", "Cuatro", True, True, None, None, None, "Ene", "18.00%"),
    ]


def test_cards_with_rows(spark, rows):
    df = spark.sql("SELECT * FROM VALUES ('Dos', 1522.0D, 2), ('Tres', 441.5D, 3), ('Uno', 259D, 1) AS t(l, v, o)")
    card = cards.multi_value_card(df, "l", "v", "o")
    value = F.lit(None).cast("double")
    got = card.select(cards.rows_text(F.col("rows")), cards.is_pending(value, F.col("rows")), cards.is_pending(value)).first()
    assert tuple(got) == ("Uno 259 | Dos 1,522 | Tres 441.5", False, True)
    empty = spark.sql("SELECT array() AS none, CAST(NULL AS array<int>) AS missing")
    assert tuple(empty.select(cards.is_pending(value, F.col("none")), cards.is_pending(value, F.col("missing"))).first()) == (True, True)


def test_stored_card_faces(spark, rows):
    def card(key, **given):
        return tuple({"id": key, "title": f"T{key}", **given}.get(n) for n in schema.KPI_CARD.names)

    target = dict.fromkeys(schema.KPI_CARD["target"].dataType.names)
    stored = small_table(
        spark,
        [
            card("a", value=0.91, display_value="91%", status="off-track", target={**target, "text": "≥ 95%"}),
            card("b", pending_label="+TBC", rows=[]),
            card("c"),
            card("d", rows=[{"label": "X", "value": 259.0}, {"label": "Y", "value": 1522.0}]),
            card("e", value=1.0, display_value="85,450", secondary_line={"label": "Concluidos", "value": "65,185"}),
        ],
        schema.KPI_CARD,
    )
    got = rows(cards.card_faces(stored).orderBy("id"), "id", "status", "pendiente", "cara", "texto", "segunda_linea", "meta_texto")
    assert got == [
        ("a", "off-track", False, "valor", "91%", "", "≥ 95%"),
        ("b", None, True, "pendiente", "+TBC", "", None),
        ("c", None, True, "pendiente", "TBD", "", None),
        ("d", None, False, "filas", "X 259 | Y 1,522", "", None),
        ("e", None, False, "valor", "85,450", "Concluidos 65,185", None),
    ]
    money = small_table(
        spark,
        [
            card("a", value=0.18, value_format="percent", value_unit="%", target={**target, "value": 0.18, "unit": "%"}),
            card("b", value_format="currency", rows=[{"label": "X", "value": 1.0}], target={**target, "unit": "USD"}),
            card("c", value=7514000.0, value_format="currency", value_unit="USD", target={**target, "value": 1.0, "formatted": "18%"}),
        ],
        schema.KPI_CARD,
    )
    got = rows(cards.money_card_faces(money).orderBy("id"), "id", "pendiente", "texto", "meta_texto")
    assert got == [("a", False, "18.00%", "18.00%"), ("b", True, "Tb", "TBD"), ("c", False, "7.514M USD", "18%")]


def test_milestone_colour(spark):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(["green", "amber", "red", "blue", None])], "i int, s string")
    got = [r[0] for r in df.orderBy("i").select(cards.milestone_colour(F.col("s"))).collect()]
    assert got == ["green", "amber", "red", "amber", "amber"]


def test_changes_against_brute_force(points, rows):
    rng = random.Random(3)
    data = {
        (k, m): rng.choice([None, 0.0, rng.uniform(-50, 50)])
        for k in "abc" for m in range(40) if rng.random() < 0.7
    }
    df = points(*[(k, m, v) for (k, m), v in data.items()])
    for base, back in (("previous_month", 1), ("same_month_last_year", 12)):
        got = {(k, d): x for k, d, x in rows(series.change_vs(df, base), "kpi_id", "mes", "delta")}
        for (k, m), now in data.items():
            before = data.get((k, m - back))
            expected = None if now is None or not before else (now - before) / before
            assert got[(k, month(m))] == expected


def test_repeated_and_missing_months_in_grouped_series(spark, rows):
    points = spark.createDataFrame(
        [("a", dt.date(2025, 1, 1), 1.0), ("a", dt.date(2025, 1, 1), 2.0), ("a", None, 9.0), ("b", dt.date(2025, 3, 1), None), ("c", None, 1.0), (None, dt.date(2025, 3, 1), 4.0)],
        "s string, mes date, valor double",
    )
    wide = series.to_grouped(points, "s", F.date_format("mes", "yyyy-MM"), "mes")
    got = {r["name"]: (r["categories"], r["valores"]) for r in wide.collect()}
    axis = ["2025-01", "2025-03"]
    assert got == {"a": (axis, [3.0, None]), "b": (axis, [None, None]), None: (axis, [None, 4.0])}
    assert "Window" not in wide._jdf.queryExecution().optimizedPlan().toString()


def test_shares_without_a_key_need_no_window(spark):
    df = spark.createDataFrame([("x", 1), ("y", 3), ("x", 2), (None, 2)], "s string, v int")
    shares = metrics.segment_share(df, "s", F.col("v"))
    assert "Window" not in shares._jdf.queryExecution().optimizedPlan().toString()
    got = {(r["s"], r["participacion"], r["principal"]) for r in shares.collect()}
    assert got == {("x", 0.375, True), ("y", 0.375, False), (None, 0.25, False)}


def test_target_of_the_period(spark):
    day = dt.date
    values = spark.createDataFrame([("K", day(y, m, 1), 1.0) for y in (2023, 2024, 2025) for m in (1, 7)] + [("L", day(2024, 1, 1), 1.0), ("K", None, 2.0)], "kpi_id string, mes date, valor double")
    targets = spark.createDataFrame(
        [("K", None, day(2023, 7, 1), 1.0), ("K", day(2023, 7, 1), day(2024, 3, 1), 2.0), ("K", day(2023, 7, 1), day(2024, 2, 1), 3.0), ("K", day(2025, 1, 2), None, 4.0), ("K", day(2025, 9, 1), day(2024, 1, 1), 5.0), (None, None, None, 6.0)],
        "kpi_id string, desde date, hasta date, target double",
    )
    got = {(r["kpi_id"], r["mes"]): r["target"] for r in metrics.with_period_target(values, targets).collect()}
    assert got == {
        ("K", day(2023, 1, 1)): 1.0, ("K", day(2023, 7, 1)): 3.0, ("K", day(2024, 1, 1)): 3.0, ("K", day(2024, 7, 1)): None,
        ("K", day(2025, 1, 1)): None, ("K", day(2025, 7, 1)): 4.0, ("L", day(2024, 1, 1)): None, ("K", None): None,
    }
    assert metrics.with_period_target(values, targets.limit(0)).filter("target IS NOT NULL").count() == 0
    assert metrics.with_period_target(values.limit(0), targets).count() == 0


def test_projection_against_a_loop(spark):
    months = [(2024, m) for m in (1, 2, 3, 5, 9, 10, 12)]
    values = [10.0, 12.0, 11.0, 15.0, 14.0, 18.0, 21.0]
    rows = [("a", dt.date(y, m, 1), v) for (y, m), v in zip(months, values)] + [("one", dt.date(2024, 1, 1), 5.0), ("gap", None, 1.0), ("none", dt.date(2024, 1, 1), None)]
    rows += [("two", dt.date(2024, 1, 1), 5.0), ("two", dt.date(2024, 3, 1), 6.0), ("two", dt.date(2024, 3, 1), 3.0)]
    got = {(r["kpi_id"], r["paso"]): tuple(r)[1:] for r in series.projected(spark.createDataFrame(rows, "kpi_id string, mes date, valor double"), 2).collect()}
    base, slope, square, at = values[0], 0.0, 0.0, 1
    for n, ((_, m), v) in enumerate(zip(months[1:], values[1:]), 1):
        gap, expected = m - at, base + (m - at) * slope
        if n == 1:
            base, slope = v, (v - base) / gap
        else:
            square += (v - expected) ** 2
            new = 0.5 * v + 0.5 * expected
            slope = 0.3 * (new - base) / gap + 0.7 * slope
            base = new
        at = m
    for step in (1, 2):
        wide = 1.96 * (square / 5) ** 0.5 * step**0.5
        mes, _, valor, low, high = got["a", step]
        assert mes == dt.date(2025, step, 1) and (valor, low, high) == pytest.approx((base + step * slope, base + step * slope - wide, base + step * slope + wide))
    assert got["one", 1] == (dt.date(2024, 2, 1), 1, 5.0, None, None)
    assert got["two", 2] == (dt.date(2024, 5, 1), 2, 13.0, None, None)
    assert {k for k, _ in got} == {"a", "one", "two"}
