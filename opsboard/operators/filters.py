"""Filters of the boards. An empty choice always means everything."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsboard import schema
from opsboard.functions.calendar import months_covered


@dataclass(frozen=True)
class Selection:
    """What the reader of a board has picked."""

    meses: tuple[date, date] | None = None
    nodos: tuple[str, ...] = ()
    paises: tuple[str, ...] = ()
    cuentas: tuple[str, ...] = ()
    estatus: tuple[str, ...] = ()
    coordinadores: tuple[str, ...] = ()


def one_of(df: DataFrame, column: str, members: Iterable) -> DataFrame:
    """Keep rows whose ``column`` is among ``members``; null never is. Spark turns a long list into a hash set."""
    members = list(members)
    return df.filter(F.col(column).isin(members)) if members else df


def months_between(df: DataFrame, lo: date, hi: date) -> DataFrame:
    """Months ``lo`` to ``hi``, both included; rows without a month go.

    Asked of ``mes``, on which a table laid out by month prunes directories, and of the raw moment
    where there is one, as a comparison the file scan understands.
    """
    first, end = months_covered(lo, hi)
    if "mes" in df.columns:
        df = df.filter((F.col("mes") >= F.lit(first)) & (F.col("mes") < F.lit(end)))
    if "periodo" in df.columns:
        since = F.lit(first.isoformat()).cast("timestamp_ntz")
        until = F.lit(end.isoformat()).cast("timestamp_ntz")
        df = df.filter((F.col("periodo") >= since) & (F.col("periodo") < until))
    return df


def shared_filters(services: DataFrame, chosen: Selection) -> DataFrame:
    """Period, node, country, account and status. Catalyst merges them into one predicate."""
    kept = months_between(services, *chosen.meses) if chosen.meses else services
    kept = one_of(kept, "nodo", chosen.nodos)
    kept = one_of(kept, "soa", chosen.paises)
    kept = one_of(kept, "cuenta", chosen.cuentas)
    return one_of(kept, "estatus", chosen.estatus)


def apply_selection(services: DataFrame, chosen: Selection) -> DataFrame:
    """Shared filters, then the coordinator filter, which goes for every perspective."""
    return one_of(shared_filters(services, chosen), "agente", chosen.coordinadores)


def is_empty(services: DataFrame) -> bool:
    """Whether a board has anything to show; reads no more than the first row."""
    return services.isEmpty()


# ---- KPI boards -------------------------------------------------------------------------


def _years(mes: Column, years: Iterable[int]) -> Column:
    """Year choice as date ranges, which prune files; ``year(mes)`` would not."""
    ranges = [(mes >= F.lit(date(y, 1, 1))) & (mes < F.lit(date(y + 1, 1, 1))) for y in sorted(set(years))]
    keep = ranges[0]
    for more in ranges[1:]:
        keep = keep | more
    return keep


def slice_kpis(
    facts: DataFrame, paises: Iterable[str] = (), years: Iterable[int] = (), months: Iterable[int] = ()
) -> DataFrame:
    """Country, year and month-of-year choices on KPI facts."""
    kept = one_of(facts, "pais", paises)
    years, months = list(years), list(months)
    if years:
        kept = kept.filter(_years(F.col("mes"), years))
    if months:
        kept = kept.filter(F.month("mes").isin(months))
    return kept


def scenario_filter(facts: DataFrame, with_forecast: bool) -> DataFrame:
    """Actuals only when the forecast is switched off."""
    return facts if with_forecast else facts.filter(F.col("escenario") == schema.REAL)


def without_gaps(points: DataFrame, value: str = "valor") -> DataFrame:
    """Points of a line: a missing value is a gap, not a zero."""
    return points.filter(F.col(value).isNotNull())
