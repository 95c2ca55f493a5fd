import datetime as dt

import pytest

from opsboard import schema
from opsboard.operators import filters
from opsboard.operators.filters import Selection, apply_selection
from opsboard.sources.dictionaries import small_table

JAN, FEB, MAR = dt.date(2025, 1, 1), dt.date(2025, 2, 1), dt.date(2025, 3, 1)


def at(month, **row):
    moment = None if month is None else dt.datetime(month.year, month.month, 28, 23, 59)
    return {"mes": month, "periodo": moment, **row}


@pytest.fixture
def sample(services):
    return services(
        at(JAN, cuenta="a"),
        at(FEB, cuenta="b", nodo=None),
        at(MAR, cuenta="c", soa="P2", estatus=schema.IN_PROGRESS, agente="A2"),
        at(None, cuenta="d", nodo="N2", estatus=None),
        at(MAR, cuenta=None, nodo="N2"),
    )


def kept(df):
    return sorted(str(r["cuenta"]) for r in df.select("cuenta").collect())


def test_empty_selection_keeps_everything(sample):
    assert apply_selection(sample, Selection()).count() == 5


def test_month_range_includes_both_ends_and_drops_missing_months(sample):
    assert kept(filters.months_between(sample, JAN, FEB)) == ["a", "b"]
    assert kept(filters.months_between(sample, JAN, MAR)) == ["None", "a", "b", "c"]
    assert kept(filters.months_between(sample, MAR, MAR)) == ["None", "c"]
    assert kept(filters.months_between(sample.drop("periodo"), FEB, MAR)) == ["None", "b", "c"]
    assert kept(filters.months_between(sample, dt.date(2025, 1, 2), dt.date(2025, 2, 27))) == ["b"]


@pytest.mark.parametrize(
    "chosen, expected",
    [
        (Selection(nodos=("N1",)), ["a", "c"]),
        (Selection(paises=("P2",)), ["c"]),
        (Selection(cuentas=("a", "d")), ["a", "d"]),
        (Selection(estatus=(schema.CONCLUDED,)), ["None", "a", "b"]),
        (Selection(coordinadores=("A2",)), ["c"]),
        (Selection(meses=(FEB, MAR), nodos=("N1", "N2"), paises=("P1",)), ["None"]),
        (Selection(nodos=("NX",)), []),
    ],
)
def test_choices(sample, chosen, expected):
    assert kept(apply_selection(sample, chosen)) == expected


@pytest.mark.parametrize("length", [998, 999, 5000])
def test_long_lists_change_nothing(sample, length):
    many = [f"x{i}" for i in range(length)] + ["a", "c"]
    long = filters.one_of(sample, "cuenta", many)
    assert kept(long) == ["a", "c"]
    assert long.columns == sample.columns


def test_is_empty(sample):
    assert filters.is_empty(apply_selection(sample, Selection(nodos=("NX",))))
    assert not filters.is_empty(sample)


def test_slicers_and_scenario(spark):
    facts = small_table(
        spark,
        [
            ("K", JAN, "gt", "REAL", None, None, None),
            ("K", dt.date(2024, 1, 1), "mx", "REAL", None, None, None),
            ("K", MAR, "gt", "FCST", None, None, None),
            ("K", MAR, None, None, None, None, None),
        ],
        schema.KPI_ACTUALS,
    )

    def months(df):
        return sorted(r["mes"] for r in df.collect())

    assert len(months(filters.slice_kpis(facts))) == 4
    assert months(filters.slice_kpis(facts, paises=("gt",), years=(2024, 2025), months=(1,))) == [JAN]
    assert months(filters.slice_kpis(facts, years=(2024, 2026))) == [dt.date(2024, 1, 1)]
    assert months(filters.slice_kpis(facts, months=(3,))) == [MAR, MAR]
    assert months(filters.scenario_filter(facts, with_forecast=False)) == [dt.date(2024, 1, 1), JAN]
    assert len(months(filters.scenario_filter(facts, with_forecast=True))) == 4
