"""Distinct counts, largest members, places and pages without a task that sees everything."""

import datetime as dt
import glob
import random

import pytest
from pyspark.sql import functions as F

from opsboard import schema
from opsboard.operators import distinct, leaders, metrics, numbering, paging, panels
from opsboard.operators.filters import Selection, apply_selection
from opsboard.plans.service_board import ServiceBoard, monthly_cube


@pytest.fixture
def many(spark, services):
    """Services with hot accounts, null keys, ties, zeros and corrections below zero."""
    rng = random.Random(17)

    def rows(low, accounts):
        return services(
            *[
                {
                    "perspectiva": rng.choice(schema.PERSPECTIVES),
                    "nodo": rng.choice(["N1", "N2", None]),
                    "soa": rng.choice(["P1", "P2", "P3", None]),
                    "cuenta": rng.choice(["hot", "hot", None, *[f"C{i}" for i in range(accounts)]]) if rng.random() < 0.5 else f"C{min(accounts - 1, int(rng.expovariate(0.1)))}",
                    "estatus": rng.choice([*schema.STATUSES, "Otro", None]),
                    "servicios": rng.choice([low, 0, 1, 2, 5, None]),
                    "mes": rng.choice([dt.date(2025, 1, 1), dt.date(2025, 2, 1), None]),
                    "periodo": None,
                    "agente": f"A{rng.randrange(9)}",
                }
                for _ in range(2500)
            ]
        )

    return rows


def collected(df):
    return [tuple(r) for r in df.collect()]


def test_numbered_is_a_row_number(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), rng.randrange(50), i) for i in range(700)]
    df = spark.createDataFrame(rows, "k string, v int, i int").repartition(7)
    for keys, order, key in (
        (["k"], [F.col("v").desc(), "i"], lambda r: (r[0] is not None, r[0], -r[1], r[2])),
        ([], ["v", "i"], lambda r: (r[1], r[2])),
    ):
        want, seen = {}, {}
        for r in sorted(rows, key=key):
            group = r[0] if keys else 0
            seen[group] = seen.get(group, 0) + 1
            want[r[2]] = seen[group]
        assert {r["i"]: r["pos"] for r in numbering.numbered(df, keys, order).collect()} == want
    assert numbering.numbered(df.limit(0), ["k"], ["v"]).collect() == []


def test_counts_and_averages_from_bitmaps(spark, many):
    data = many(0, 90)
    cube, accounts = monthly_cube(data), distinct.member_bitmaps(data, "cuenta").cache()
    assert sorted(collected(distinct.kpi_block(cube, accounts))) == sorted(collected(panels.kpi_block(data)))
    # over a choice of cells, where sums of counts would count accounts twice
    chosen = Selection(meses=(dt.date(2025, 1, 1), dt.date(2025, 1, 31)), nodos=("N1",))
    data = data.drop("periodo")
    narrowed = distinct.kpi_block(apply_selection(cube, chosen), apply_selection(accounts, chosen))
    assert sorted(collected(narrowed)) == sorted(collected(panels.kpi_block(apply_selection(data, chosen))))
    agents = distinct.member_bitmaps(data, "agente")
    for by in (["perspectiva", "nodo"], ["soa", "mes"], ["perspectiva"]):
        ours, theirs = distinct.per_entity(cube, agents, by), metrics.per_entity(data, F.col("servicios"), "agente", by)
        assert sorted(collected(ours), key=repr) == sorted(collected(theirs.select(*ours.columns)), key=repr)
    accounts.unpersist()


def test_numbers_have_no_gaps_and_follow_the_country(spark, many):
    rows = distinct.member_numbers(many(0, 90), "cuenta").collect()
    assert sorted(r["numero"] for r in rows) == list(range(1, len(rows) + 1)) and None not in {r["cuenta"] for r in rows}


def test_more_members_than_a_block_holds(spark):
    data = spark.range(70_000).selectExpr(
        "'apertura' AS perspectiva", "date'2025-01-01' AS mes", "'N' AS nodo", "concat('P', id % 3) AS soa", "'Concluido' AS estatus", "id AS cuenta"
    )
    bitmaps = distinct.member_bitmaps(data.unionByName(data), "cuenta").cache()
    assert bitmaps.select("bloque").distinct().count() == 3
    assert bitmaps.count() <= 5  # three countries over three blocks, each country in one or two
    assert collected(distinct.count_members(bitmaps, ["perspectiva"], "n")) == [("apertura", 70_000)]
    bitmaps.unpersist()


@pytest.mark.parametrize("low, accounts, listed", [(0, 60, 4), (0, 60, 64), (-9, 60, 4), (1, 400, 2), (-9, 400, 16)])
@pytest.mark.parametrize("n", [1, 5, 30])
def test_top_members_from_a_summary(spark, many, low, accounts, listed, n):
    data = many(low, accounts)
    summary = leaders.summarise(data, "cuenta", most=listed)
    want = panels.top_accounts(data, n)
    assert collected(leaders.top_members(summary, monthly_cube(data), n)) == collected(want)


def test_a_summary_spares_most_members(spark, services):
    data = services(*[{"cuenta": f"C{i}", "servicios": 2000 // (i + 1) + 1, "mes": dt.date(2025, 1 + i % 3, 1)} for i in range(900)])
    summary = leaders.summarise(data, "cuenta", most=32)
    needed, few = leaders.candidates(summary, 10)
    assert [r["todos"] for r in needed.collect()] == [False] and 10 <= few.count() < 40
    even = services(*[{"cuenta": f"C{i}"} for i in range(300)])
    needed, _ = leaders.candidates(leaders.summarise(even, "cuenta", most=8), 10)
    assert [r["todos"] for r in needed.collect()] == [True]


def test_places_beyond_what_spark_ranks_before_the_shuffle(spark, many, monkeypatch):
    data = many(0, 400)
    cube, summary = monthly_cube(data), leaders.summarise(data, "cuenta", most=8)
    want = collected(panels.top_accounts(data, 25))
    monkeypatch.setattr(leaders, "RANKED", 10)
    shown = leaders.top_members(summary, cube, 25)
    assert collected(shown) == want
    assert "row_number" not in shown._jdf.queryExecution().optimizedPlan().toString()
    assert len(collected(leaders.top_members(summary, cube, 5000))) == data.dropna(subset=["cuenta"]).select("perspectiva", "cuenta").distinct().count()


def test_concentration_from_a_summary(spark, many):
    data = many(0, 60)
    got = {r["perspectiva"]: (r["top"], r["total"]) for r in leaders.concentration(leaders.summarise(data, "cuenta", most=6), monthly_cube(data), 4).collect()}
    for view in schema.PERSPECTIVES:
        mine = data.filter(F.col("perspectiva") == view)
        best = panels.top_accounts(mine, 4).agg(F.sum("servicios")).first()[0]
        assert got[view] == (best, mine.agg(F.sum("servicios")).first()[0])


def test_kept_board_answers_from_what_it_kept(spark, many, tmp_path):
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(str(tmp_path / "checkpoints"))
    many(0, 60).write.parquet(f"{tmp_path}/extract")
    data = spark.read.parquet(f"{tmp_path}/extract").drop("periodo")
    kept = ServiceBoard(data).keep()
    chosen = Selection(nodos=("N1",), estatus=(schema.CONCLUDED, schema.CANCELLED_LATER))
    for board, rows in ((kept, data), (kept.select(chosen), apply_selection(data, chosen))):
        shown = board.panels(7)
        assert sorted(collected(shown["kpis"])) == sorted(collected(panels.kpi_block(rows)))
        assert collected(shown["cuentas"]) == collected(panels.top_accounts(rows, 7))
        for name in ("kpis", "cuentas"):
            assert f"{tmp_path}/extract" not in shown[name]._jdf.queryExecution().executedPlan().toString()
    one = kept.select(Selection(cuentas=("hot",)))
    assert one.kept is None
    assert sorted(collected(one.panels()["kpis"])) == sorted(collected(panels.kpi_block(data.filter("cuenta = 'hot'"))))


# ---- pages --------------------------------------------------------------------------------


@pytest.fixture
def laid(spark, many, tmp_path):
    detail = panels.detail_table(many(0, 200))
    paging.write_pages(detail, f"{tmp_path}/pages", block_rows=64)
    return detail, f"{tmp_path}/pages"


def test_all_pages_are_the_detail_table(spark, laid):
    detail, path = laid
    files = glob.glob(f"{path}/filas/*/*/*.parquet")
    blocks = glob.glob(f"{path}/filas/*/*")
    assert len(files) == len(blocks) > 6  # a block is one file
    for view in schema.PERSPECTIVES:
        want = [tuple(r[c] for c in paging.ORDER) for r in detail.collect() if r["perspectiva"] == view]
        by_number, by_key, number, last = [], [], 1, None
        while rows := paging.page(spark, path, view, number, 50).collect():
            by_number += [tuple(r[c] for c in paging.ORDER) for r in rows]
            number += 1
        step = paging.page(spark, path, view, 1, 37).collect()
        while step:
            by_key += [tuple(r[c] for c in paging.ORDER) for r in step]
            step = paging.page_after(spark, path, view, step[-1].asDict(), 37).collect()
        assert by_number == want and by_key == want


def test_a_page_reads_two_files_at_most(spark, laid):
    _, path = laid
    for shown in (paging.page(spark, path, "apertura", 3, 40), paging.page_after(spark, path, "apertura", paging.page(spark, path, "apertura", 2, 40).collect()[-1].asDict(), 40)):
        shown.collect()
        leaf = shown._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
        assert leaf.metrics().apply("numFiles").value() <= 2


def test_odd_pages(spark, laid):
    detail, path = laid
    first = detail.filter("perspectiva = 'gestion'").first()
    gone = first.asDict() | {"servicios": first["servicios"] + 1}  # a row that is not there: what follows its place
    assert paging.page_after(spark, path, "gestion", gone, 1).first()["cuenta"] == first["cuenta"]
    assert paging.page(spark, path, "gestion", 10_000, 10).collect() == [] and paging.page(spark, path, "otra", 1, 10).collect() == []
    with pytest.raises(ValueError, match="at most"):
        paging.page(spark, path, "gestion", 1, 65)


def test_many_blocks_share_a_file(spark, many, tmp_path, monkeypatch):
    monkeypatch.setattr(paging, "FILES", 3, raising=False)
    detail, path = panels.detail_table(many(0, 200)), f"{tmp_path}/few"
    paging.write_pages(detail, path, block_rows=16)
    blocks = spark.read.parquet(f"{path}/indice")
    assert len(glob.glob(f"{path}/filas/*/*/*.parquet")) <= 6 < blocks.count()
    want = [tuple(r[c] for c in paging.ORDER) for r in detail.collect() if r["perspectiva"] == "gestion"]
    for number in (1, 2, 5):
        rows = paging.page(spark, path, "gestion", number, 15).collect()
        assert [tuple(r[c] for c in paging.ORDER) for r in rows] == want[(number - 1) * 15 : number * 15]
    behind = paging.page_after(spark, path, "gestion", rows[-1].asDict(), 16).collect()
    assert [tuple(r[c] for c in paging.ORDER) for r in behind] == want[75:91]


def test_bitmaps_are_made_once_for_a_cell_and_block(spark, many):
    plan = distinct.member_bitmaps(many(0, 60), "agente")._jdf.queryExecution().executedPlan().toString()
    made = plan.split("functions=[bitmap_construct_agg")[1].split("partial_bitmap_construct_agg")[0]
    assert "Exchange" not in made  # else there are as many as tasks times blocks


def test_bitmaps_of_cells_with_null_keys(spark, services):
    data = services({"nodo": None, "mes": None, "cuenta": "X"}, {"nodo": None, "mes": None, "cuenta": "X"}, {"soa": None, "cuenta": "Y"}, {"cuenta": None})
    bitmaps = distinct.member_bitmaps(data, "cuenta")
    assert bitmaps.columns == [*distinct.CUBE_KEYS, "bloque", "mapa"]
    got = distinct.count_members(bitmaps, ["nodo", "soa"], "n").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, [(None, "P1", 1), ("N1", None, 1)]))
