"""Every registered query against its SQL twin, and what the plans must look like."""

import re

import duckdb
import pytest

import __spark_entry__ as entry_point
from opsboard.operators import filters, panels
from opsboard.plans import kpi_boards, service_board
from opsboard.plans import testdata as inputs
from opsboard.plans.service_board import PICKED
from opsboard.sources.services import canonical, clean

REGISTERED = entry_point.queries()
CATALOG = {**service_board.QUERIES, **kpi_boards.QUERIES}
QUERIES, TWINS = {name: REGISTERED[name] for name in CATALOG}, entry_point.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    connection = duckdb.connect()
    for name in inputs.TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    yield connection
    connection.close()


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    names = sorted(df.columns)
    result = duck.execute(TWINS[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == names
    theirs = [tuple(row[columns.index(n)] for n in names) for row in result.fetchall()]
    ours = [tuple(row[n] for n in names) for row in df.collect()]
    assert sorted(ours, key=repr) == sorted(theirs, key=repr)
    assert ours or name == "svc_empty_filter"


def test_entry(spark):
    assert entry_point.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_plan_has_no_python_and_no_wide_cross_join(spark, sf_dir, name):
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"PythonUDF|MapInPandas|ArrowEval|BatchEvalPython|Join Cross", plan)


@pytest.mark.parametrize(
    "name", ["svc_top_accounts", "svc_participation_cuenta", "svc_status_mix_agente", "svc_top_agents", "kpi_concentration"]
)
def test_totals_read_the_lines_once(spark, sf_dir, name):
    plan = final_plan(QUERIES[name](spark, sf_dir))
    assert len(re.findall(r"FileScan parquet [^\n]*lineitem\.parquet", plan)) <= 1
    assert "ReusedExchange" in plan


def test_ranking_is_limited_before_the_shuffle(spark, sf_dir):
    plan = final_plan(QUERIES["svc_top_accounts"](spark, sf_dir))
    assert re.search(r"WindowGroupLimit .* 16, Partial", plan)


@pytest.mark.parametrize("perspectiva, column", [("apertura", "o_orderdate"), ("gestion", "l_shipdate")])
def test_period_filter_reaches_the_scan(spark, sf_dir, perspectiva, column):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    services = clean(canonical(inputs.raw_extract(spark, sf_dir, perspectiva)))
    plan = filters.apply_selection(services, PICKED)._jdf.queryExecution().executedPlan().toString()
    pushed = " ".join(re.findall(r"PushedFilters: \[[^\]]*\]", plan))
    assert f"GreaterThanOrEqual({column},1996-01-01T00:00" in pushed
    assert f"LessThan({column},1998-07-01T00:00" in pushed
    assert "In(r_name, [ASIA,EUROPE]" in pushed


def test_scan_reads_only_needed_columns(spark, sf_dir):
    plan = panels.participation(inputs.services(spark, sf_dir), "nodo")._jdf.queryExecution().executedPlan().toString()
    lines = next(x for x in re.findall(r"FileScan parquet [^\n]*", plan) if "l_orderkey" in x)
    assert "l_returnflag" not in lines and "l_extendedprice" not in lines


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_windows_without_key_only_see_calendar_rows(spark, sf_dir, name):
    """A window with no partition key puts all its rows into one task: only sums per month or
    quarter (or per segment of a donut) may go there."""
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    if "Exchange SinglePartition" in plan and "Window" in plan:
        assert name in {
            "svc_reconciliation", "kpi_programme_progress", "kpi_abandonment", "kpi_abandonment_change",
            "kpi_turnover", "kpi_revenue_mix", "kpi_grouped_long", "kpi_grouped_wide",
        }


@pytest.mark.parametrize("name", ["svc_status_mix_agente", "svc_top_agents", "svc_cascade_options", "kpi_cards", "kpi_scenario"])
def test_same_result_when_nothing_is_small_enough_to_broadcast(spark, sf_dir, name):
    usual = sorted(map(repr, QUERIES[name](spark, sf_dir).collect()))
    limits = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    try:
        for limit in limits:
            spark.conf.set(limit, "-1")
        assert sorted(map(repr, QUERIES[name](spark, sf_dir).collect())) == usual
    finally:
        for limit in limits:
            spark.conf.unset(limit)


@pytest.mark.parametrize("name", ["svc_clean_summary", "svc_cascade_options", "svc_cascade_countries"])
def test_facts_are_joined_once(spark, sf_dir, name):
    plan = final_plan(QUERIES[name](spark, sf_dir))
    assert len(re.findall(r"FileScan parquet [^\n]*lineitem\.parquet", plan)) == 1


@pytest.mark.parametrize("name, day", [("kpi_cards", "2000-11-01"), ("kpi_slicers", "1999-01-01"), ("kpi_rate_cards", "2000-12-01")])
def test_months_of_facts_reach_the_scan(spark, sf_dir, name, day):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert f"GreaterThanOrEqual(o_orderdate,{day}T00:00" in plan and "LessThan(o_orderdate," in plan
