import datetime as dt
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from opsboard import schema
from opsboard.operators import options, panels
from opsboard.operators.filters import Selection, apply_selection
from opsboard.plans.service_board import ServiceBoard, board_summary, monthly_cube

DONE, OPEN, NOW, LATER = schema.STATUSES


def test_kpi_block_denominator_counts_unknown_but_not_missing_status(services, rows):
    df = services(
        {"estatus": DONE, "servicios": 3, "cuenta": "a"},
        {"estatus": NOW, "servicios": 2, "cuenta": "b", "soa": None},
        {"estatus": LATER, "servicios": 1, "cuenta": None},
        {"estatus": "Otro", "servicios": 4, "cuenta": "a", "soa": "P2"},
        {"estatus": None, "servicios": 90, "cuenta": "c"},
        {"estatus": None, "servicios": None, "cuenta": "c"},
    )
    assert rows(panels.kpi_block(df), "servicios_totales", "cuentas_activas", "paises", "pct_concluido", "pct_cancelado") == [
        (100, 3, 2, 3 / 10 * 100, 3 / 10 * 100)
    ]


def test_kpi_block_without_any_status_divides_by_one(services, rows):
    df = services({"estatus": None, "servicios": 7}, {"estatus": DONE, "servicios": 0})
    assert rows(panels.kpi_block(df), "servicios_totales", "pct_concluido", "pct_cancelado") == [(7, 0.0, 0.0)]


def test_status_totals_complete_the_domain(services, rows):
    df = services({"estatus": NOW, "servicios": 4}, {"estatus": "Otro"}, {"estatus": None})
    assert sorted(rows(panels.status_totals(df), "ord", "estatus", "servicios")) == [
        (0, DONE, 0), (1, OPEN, 0), (2, NOW, 4), (3, LATER, 0)
    ]


def test_status_share_is_of_known_positive_statuses(services, rows):
    df = services(
        {"estatus": LATER, "servicios": 199},
        {"estatus": DONE, "servicios": 1},
        {"estatus": OPEN, "servicios": 0},
        {"estatus": "Otro", "servicios": 500},
        {"estatus": None, "servicios": 500},
    )
    assert rows(panels.status_share(df), "ord", "estatus", "servicios", "participacion", "etiqueta") == [
        (0, DONE, 1, 1 / 200, ""),
        (3, LATER, 199, 199 / 200, "99.5%"),
    ]


def test_monthly_trend_drops_zero_series_and_missing_months(services, rows):
    jan, mar = dt.date(2025, 1, 1), dt.date(2025, 3, 1)
    df = services(
        {"mes": mar, "servicios": 2},
        {"mes": jan, "servicios": 1},
        {"mes": jan, "servicios": 5},
        {"mes": jan, "estatus": OPEN, "servicios": 0},
        {"mes": None, "servicios": 50},
        {"mes": jan, "estatus": "Otro", "servicios": 50},
    )
    assert rows(panels.monthly_trend(df), "mes", "estatus", "servicios") == [(jan, DONE, 6), (mar, DONE, 2)]


def test_participation_is_of_all_rows_with_key_as_tie_break(services, rows):
    df = services(
        {"cuenta": "b", "servicios": 2},
        {"cuenta": "a", "servicios": 2},
        {"cuenta": "c", "servicios": 5},
        {"cuenta": "d", "servicios": 1},
        {"cuenta": None, "servicios": 10},
    )
    assert rows(panels.participation(df, "cuenta"), "cuenta", "servicios", "pct") == [
        ("c", 5, 25.0), ("a", 2, 10.0), ("b", 2, 10.0), ("d", 1, 5.0)
    ]
    assert rows(panels.top_accounts(df, 2), "pos", "cuenta", "pct") == [(1, "c", 25.0), (2, "a", 10.0)]
    assert rows(panels.top_accounts(df, 30), "cuenta") == [("c",), ("a",), ("b",), ("d",)]


def test_participation_of_zero_total_divides_by_one(services, rows):
    df = services({"cuenta": "a", "servicios": 0}, {"cuenta": "b", "servicios": 0})
    assert rows(panels.participation(df, "cuenta", 1), "cuenta", "pct") == [("a", 0.0)]


def test_perspectives_are_answered_apart(services, rows):
    df = services(
        {"perspectiva": "apertura", "cuenta": "a", "servicios": 1},
        {"perspectiva": "gestion", "cuenta": "a", "servicios": 1},
        {"perspectiva": "gestion", "cuenta": "b", "servicios": 3},
    )
    assert rows(panels.top_accounts(df, 1), "perspectiva", "cuenta", "pct") == [
        ("apertura", "a", 100.0), ("gestion", "b", 75.0)
    ]


def test_status_mix_grid(services, rows):
    df = services(
        {"nodo": "x", "estatus": DONE, "servicios": 3},
        {"nodo": "x", "estatus": "Otro", "servicios": 1},
        {"nodo": "y", "estatus": NOW, "servicios": 1},
        {"nodo": "y", "estatus": None, "servicios": 9},
        {"nodo": "z", "estatus": OPEN, "servicios": 0},
        {"nodo": "z", "estatus": DONE, "servicios": 0},
        {"nodo": "w", "estatus": None, "servicios": 2},
        {"nodo": None, "servicios": 100},
    )
    # nobody has open or later-cancelled services; the unknown status only counts in the divisor
    assert rows(panels.status_mix(df, "nodo"), "nodo", "estatus", "servicios", "pct") == [
        ("z", DONE, 0, None), ("z", NOW, None, None),
        ("w", DONE, None, None), ("w", NOW, None, None),
        ("x", DONE, 3, 75.0), ("x", NOW, None, None),
        ("y", DONE, None, None), ("y", NOW, 1, 100.0),
    ]


def test_hierarchy_keeps_positive_leaves_with_both_keys(services, rows):
    df = services(
        {"nodo": "x", "soa": "p", "servicios": 3},
        {"nodo": "x", "soa": "q", "servicios": 1},
        {"nodo": "y", "soa": "p", "servicios": 4},
        {"nodo": "y", "soa": "r", "servicios": 0},
        {"nodo": None, "soa": "p", "servicios": 50},
        {"nodo": "x", "soa": None, "servicios": 50},
    )
    assert rows(panels.hierarchy_rollup(df), "nivel", "nodo", "soa", "servicios", "pct_padre") == [
        (0, None, None, 8, 100.0),
        (1, "x", None, 4, 50.0),
        (1, "y", None, 4, 50.0),
        (2, "x", "p", 3, 75.0),
        (2, "x", "q", 1, 25.0),
        (2, "y", "p", 4, 100.0),
    ]


def test_top_agents_merges_names_and_lists_three_codes(services, rows):
    df = services(
        *[{"agente": "Ana", "coord_code": c, "servicios": 1} for c in ("c4", "c2", "c3", "c1", "—", "c1")],
        {"agente": "Luis", "coord_code": "—", "servicios": 6},
        {"agente": "Eva", "coord_code": "k", "servicios": 8},
        {"agente": "Zoe", "coord_code": "z", "servicios": 0},
    )
    assert rows(panels.top_agents(df, 3), "pos", "agente", "codigo", "servicios", "pct") == [
        (1, "Eva", "k", 8, 40.0), (2, "Ana", "c1/c2/c3", 6, 30.0), (3, "Luis", "—", 6, 30.0)
    ]


def test_detail_drops_rows_with_any_missing_key(services, rows):
    df = services(
        {"cuenta": "a", "servicios": 1}, {"cuenta": "b", "servicios": 1}, {"cuenta": "b", "servicios": 5},
        {"nodo": None}, {"soa": None}, {"cuenta": None}, {"estatus": None},
    )
    assert rows(panels.detail_table(df), "cuenta", "servicios") == [("b", 6), ("a", 1)]


def test_reconciliation_is_a_full_outer_join(services, rows):
    jan, feb, mar = (dt.date(2025, m, 1) for m in (1, 2, 3))
    df = services(
        {"perspectiva": "apertura", "mes": jan, "servicios": 5},
        {"perspectiva": "gestion", "mes": mar, "servicios": 4},
        {"perspectiva": "apertura", "mes": feb, "servicios": 2},
        {"perspectiva": "gestion", "mes": feb, "servicios": 3},
        {"perspectiva": "gestion", "mes": None, "servicios": 9},
    )
    assert rows(panels.reconciliation(df), "mes", "apertura", "gestion", "diferencia", "diferencia_acumulada") == [
        (jan, 5, 0, 5, 5), (feb, 2, 3, -1, 4), (mar, 0, 4, -4, 0)
    ]


def test_member_counts_skip_null(services, rows):
    df = services({"cuenta": "a"}, {"cuenta": None, "mes": None}, {"cuenta": "a", "agente": "A2"}, {"cuenta": "b"})
    assert rows(panels.member_counts(df), "cuentas", "agentes", "meses") == [(2, 2, 1)]


def test_options(services, rows):
    df = services(
        {"nodo": "x", "soa": "p", "cuenta": "a"},
        {"nodo": "x", "soa": "q", "cuenta": "b"},
        {"nodo": "y", "soa": "p", "cuenta": "c"},
        {"nodo": "y", "soa": "r", "cuenta": "d"},
        {"nodo": None, "soa": "s", "cuenta": "e"},
        {"nodo": "y", "soa": "r", "cuenta": None},
    )
    assert rows(options.members(df, "nodo"), "nodo") == [("x",), ("y",)]
    assert rows(options.membership(df, "nodo", "soa"), "nodo", "soa") == [
        ("x", "p"), ("x", "q"), ("y", "p"), ("y", "r")
    ]
    # accounts of the offered countries, whichever node their rows are in
    assert rows(options.cascade_options(df, ("x",)), "nivel", "opcion") == [
        ("cuenta", "a"), ("cuenta", "b"), ("cuenta", "c"), ("pais", "p"), ("pais", "q")
    ]
    assert rows(options.cascade_options(df, ("x",), ("r",)), "nivel", "opcion") == [
        ("cuenta", "d"), ("pais", "p"), ("pais", "q")
    ]
    assert [o for n, o in rows(options.cascade_options(df), "nivel", "opcion") if n == "pais"] == ["p", "q", "r"]


def test_agent_options_join_both_perspectives(services, rows):
    df = services(
        {"perspectiva": "apertura", "agente": "a", "servicios": 2},
        {"perspectiva": "gestion", "agente": "a", "servicios": 2},
        {"perspectiva": "gestion", "agente": "b", "servicios": 3},
        {"perspectiva": "gestion", "agente": "c", "servicios": 9, "nodo": "out"},
    )
    assert rows(options.agent_options(df, Selection(nodos=("N1",))), "agente", "servicios") == [("a", 4), ("b", 3)]


def test_panels_of_nothing_are_empty(services):
    nothing = apply_selection(services({}), Selection(nodos=("NX",)))
    for name, panel in ServiceBoard(nothing).panels().items():
        assert panel.collect() == [], name


@pytest.fixture
def random_services(services):
    """Skewed rows with gaps: one node and one account hold most of them."""
    rng = random.Random(7)
    pick = lambda heavy, rest: heavy if rng.random() < 0.6 else rng.choice(rest)
    return services(
        *[
            {
                "perspectiva": rng.choice(schema.PERSPECTIVES),
                "nodo": pick("N1", ["N2", "N3", None]),
                "soa": pick("P1", ["P2", "P3", None]),
                "cuenta": pick("C1", [f"C{i}" for i in range(2, 40)] + [None]),
                "estatus": rng.choice([*schema.STATUSES, "Otro", None]),
                "servicios": rng.choice([0, 1, 2, 7, None]),
                "mes": rng.choice([dt.date(2025, m, 1) for m in range(1, 7)] + [None]),
                "agente": pick("A1", [f"A{i}" for i in range(2, 20)]),
                "coord_code": rng.choice(["—", *[f"c{i}" for i in range(6)]]),
            }
            for _ in range(1500)
        ]
    )


def test_panels_against_brute_force(random_services):
    data = [r.asDict() for r in random_services.collect()]
    for view in schema.PERSPECTIVES:
        mine = [r for r in data if r["perspectiva"] == view]
        amount = lambda r: r["servicios"] or 0
        grand = sum(map(amount, mine))
        by_account, by_agent, codes = Counter(), Counter(), defaultdict(set)
        for r in mine:
            if r["cuenta"] is not None:
                by_account[r["cuenta"]] += amount(r)
            by_agent[r["agente"]] += amount(r)
            codes[r["agente"]].add(r["coord_code"])
        best = sorted(by_account.items(), key=lambda kv: (-kv[1], kv[0]))[:5]
        got = panels.top_accounts(random_services, 5).filter(F.col("perspectiva") == view).collect()
        assert [(r["cuenta"], r["servicios"], r["pct"]) for r in got] == [(k, v, v / grand * 100) for k, v in best]
        best = sorted(by_agent.items(), key=lambda kv: (-kv[1], kv[0]))[:5]
        got = panels.top_agents(random_services, 5).filter(F.col("perspectiva") == view).collect()
        assert [(r["agente"], r["servicios"], r["codigo"]) for r in got] == [
            (k, v, "/".join(sorted(codes[k] - {"—"})[:3]) or "—") for k, v in best
        ]


def test_invariants(random_services):
    one = random_services.filter("perspectiva = 'gestion'")
    with_month = one.filter("mes IS NOT NULL")
    trend = panels.monthly_trend(with_month).groupBy("estatus").agg(F.sum("servicios").alias("s")).collect()
    assert {r["estatus"]: r["s"] for r in trend} == {
        r["estatus"]: r["servicios"] for r in panels.status_share(with_month).collect()
    }
    levels = panels.hierarchy_rollup(one).groupBy("nivel").agg(F.sum("servicios").alias("s")).collect()
    assert len({r["s"] for r in levels}) == 1 and len(levels) == 3
    known = one.filter(F.col("estatus").isin(*schema.STATUSES))
    for r in panels.status_mix(known, "nodo").groupBy("nodo").agg(F.sum("pct").alias("p")).collect():
        assert r["p"] == pytest.approx(100)
    keyed = one.dropna(subset=["nodo", "soa", "cuenta", "estatus"])
    assert panels.detail_table(one).agg(F.sum("servicios")).first()[0] == keyed.agg(F.sum("servicios")).first()[0]


def test_kept_cube_needs_a_shared_folder(random_services, monkeypatch):
    monkeypatch.setattr("pyspark.SparkContext.getCheckpointDir", lambda self: None)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        ServiceBoard(random_services).keep()


def test_cube_gives_the_same_panels(spark, random_services, tmp_path):
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(str(tmp_path))
    chosen = Selection(meses=(dt.date(2025, 2, 1), dt.date(2025, 5, 1)), nodos=("N1", "N2"))
    raw = ServiceBoard(random_services.drop("periodo")).select(chosen)
    direct = apply_selection(random_services.drop("periodo"), chosen)
    shown = raw.keep().panels(5)
    assert shown["estatus"].collect() == panels.status_share(direct).collect()
    assert shown["tendencia"].collect() == panels.monthly_trend(direct).collect()
    assert shown["nodo"].collect() == panels.participation(direct, "nodo").collect()
    assert shown["mezcla_nodo"].collect() == panels.status_mix(direct, "nodo").collect()
    assert shown["jerarquia"].collect() == panels.hierarchy_rollup(direct).collect()
    offered = raw.keep().options(("N1",))
    assert offered["nodos"].collect() == options.members(random_services, "nodo").collect()
    assert offered["cascada"].collect() == options.cascade_options(random_services, ("N1",)).collect()
    assert offered["meses"].collect() == options.members(random_services, "mes").collect()
    bare = random_services.drop("periodo")  # the fixture's is one day in January, whatever the month
    assert offered["coordinadores"].collect() == options.agent_options(bare, chosen).collect()
    busiest = offered["coordinadores"].first()["agente"]
    one = ServiceBoard(bare).select(Selection(meses=chosen.meses, coordinadores=(busiest,))).options()
    assert one["meses"].count() == options.members(random_services, "mes").count()
    assert one["coordinadores"].count() == options.agent_options(bare, Selection(meses=chosen.meses)).count() > 1
    narrowed = ServiceBoard(random_services.drop("periodo")).select(Selection(cuentas=("C1",)))
    assert narrowed.panels()["nodo"].collect() == panels.participation(
        random_services.filter("cuenta = 'C1'"), "nodo"
    ).collect()


def test_board_summary_sets(random_services):
    summary = board_summary(monthly_cube(random_services))
    sums = {r["panel"]: r["s"] for r in summary.groupBy("panel").agg(F.sum("servicios").alias("s")).collect()}
    assert set(sums) == {"total", "estatus", "tendencia", "nodo", "mezcla", "jerarquia"}
    assert len(set(sums.values())) == 1
