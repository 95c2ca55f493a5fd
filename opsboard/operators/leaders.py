"""The largest members from a summary, exactly.

Of every cell of the cube the summary keeps the largest members with their sums, and how much a member that is
not listed has there at most (``techo``) and at least (``piso``). Summaries of cells add up: over any choice of
cells a listed member's sum lies between what is listed, plus the ``piso`` of the cells it is not listed in,
and the same with ``techo``. Members whose upper bound is below the lower bounds of ``n`` others are out; the
rest are counted exactly. Where even an unlisted member could be among the first (cells too even to tell),
all members of that perspective are counted.

Nothing here ranks all members in one task: a threshold comes from a histogram of bounds, and places beyond
``RANKED`` from ranges (:mod:`opsboard.operators.numbering`).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opsboard.operators.distinct import CUBE_KEYS
from opsboard.operators.metrics import ratio
from opsboard.operators.numbering import numbered
from opsboard.operators.panels import BY, or_one, pct_of, services_sum
from opsboard.storage import written

LISTED = 64
RANKED = 1000  # beyond, Spark would rank all rows of a perspective in one task
BINS = 16  # of the histogram, for each doubling


@dataclass(frozen=True)
class Summary:
    """``sums`` holds every member of every cell, for the exact count; ``listed`` and ``cells`` are short."""

    member: str
    sums: DataFrame
    listed: DataFrame
    cells: DataFrame

    def where(self, chosen: Callable[[DataFrame], DataFrame]) -> Summary:
        """Over a choice of cells."""
        return Summary(self.member, chosen(self.sums), chosen(self.listed), chosen(self.cells))


def summarise(services: DataFrame, member: str, keys: Sequence[str] = CUBE_KEYS, most: int = LISTED) -> Summary:
    """Sums per cell and member, and what is to be known of each cell. Spark limits the ranks before the shuffle."""
    order = Window.partitionBy(*keys).orderBy(F.col("valor").desc(), member)
    sums = services.filter(F.col(member).isNotNull()).groupBy(*keys, member).agg(services_sum().alias("valor"))
    sums = written(sums, "sums")
    ranked = sums.withColumn("lugar", F.row_number().over(order)).filter(F.col("lugar") <= most + 1)
    ranked = written(ranked, "ranked")
    cut = F.max(F.when(F.col("lugar") > most, F.col("valor")))
    cuts = ranked.groupBy(*keys).agg(F.greatest(F.coalesce(cut, F.lit(0)), F.lit(0)).alias("techo"))
    # a member that is in no row of a cell has 0 there
    lows = sums.groupBy(*keys).agg(F.least(F.min("valor"), F.lit(0)).alias("piso"))
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    cells = written(cuts.alias("a").join(lows.alias("b"), same).select(*[f"a.{k}" for k in keys], "techo", "piso"), "cells")
    of_cell = [F.col(f"l.{k}").eqNullSafe(F.col(f"c.{k}")) for k in keys]
    listed = ranked.filter(F.col("lugar") <= most).alias("l").join(cells.alias("c"), of_cell)
    listed = written(listed.select(*[f"l.{k}" for k in keys], f"l.{member}", "l.valor", "c.techo", "c.piso"), "listed")
    return Summary(member, sums, listed, cells)


def _threshold(values: DataFrame, value: str, n: int) -> DataFrame:
    """Per perspective a value (``minimo``) that ``n`` rows reach; null where fewer have a positive one.

    It is the lower edge of a histogram bin, so a little more than ``n`` rows may reach it.
    """
    place = F.floor(F.log2(value) * BINS)
    bins = values.filter(F.col(value) >= 1).groupBy(BY, place.alias("cajon")).agg(F.count(F.lit(1)).alias("filas"))
    above = Window.partitionBy(BY).orderBy(F.col("cajon").desc())  # at most BINS x 63 rows
    reached = bins.withColumn("hasta", F.sum("filas").over(above)).filter(F.col("hasta") >= n)
    edge = F.pow(F.lit(2.0), F.max("cajon") / BINS) * (1 - 1e-9)
    return reached.groupBy(BY).agg(edge.alias("minimo"))


def candidates(summary: Summary, n: int) -> tuple[DataFrame, DataFrame]:
    """Per perspective whether every member has to be counted (``todos``); and the members that may be among the
    first ``n`` where not."""
    whole = summary.cells.groupBy(BY).agg(F.sum("techo").alias("techos"), F.sum("piso").alias("pisos"))
    own = summary.listed.groupBy(BY, summary.member).agg(
        *[F.sum(c).alias(c) for c in ("valor", "techo", "piso")]
    )
    bounds = own.join(F.broadcast(whole), BY).select(  # one row per perspective
        BY,
        summary.member,
        (F.col("valor") + F.col("pisos") - F.col("piso")).alias("minimo_propio"),
        (F.col("valor") + F.col("techos") - F.col("techo")).alias("maximo"),
    )
    needed = whole.join(_threshold(bounds, "minimo_propio", n), BY, "left")
    needed = needed.select(BY, "minimo", (F.col("minimo").isNull() | (F.col("techos") >= F.col("minimo"))).alias("todos"))
    few = bounds.join(F.broadcast(needed), BY).filter(~F.col("todos") & (F.col("maximo") >= F.col("minimo")))
    return needed, few.select(BY, summary.member)


def counted(summary: Summary, n: int) -> DataFrame:
    """Exact sums of at least the first ``n`` members of each perspective."""
    needed, few = candidates(summary, n)
    sums = summary.sums.join(F.broadcast(needed.select(BY, "todos")), BY)
    rows = sums.filter("todos").drop("todos")
    some = sums.filter("NOT todos").drop("todos").join(few, [BY, summary.member], "left_semi")
    return rows.unionByName(some).groupBy(BY, summary.member).agg(F.sum("valor").alias("servicios"))


def top_members(summary: Summary, cube: DataFrame, n: int) -> DataFrame:
    """The ``n`` largest members with place and share of all services, as
    :func:`opsboard.operators.panels.participation` gives them. ``cube`` has the services of members and others."""
    member, largest = summary.member, [F.col("servicios").desc(), F.col(summary.member)]
    exact = counted(summary, n)
    if n <= RANKED:
        order = Window.partitionBy(BY).orderBy(*largest)
        placed = exact.withColumn("pos", F.row_number().over(order)).filter(F.col("pos") <= n)
    else:
        exact = written(exact, "counted")
        least = _threshold(exact, "servicios", n)
        enough = exact.join(F.broadcast(least), BY, "left").filter(F.col("minimo").isNull() | (F.col("servicios") >= F.col("minimo")))
        placed = numbered(enough.drop("minimo"), [BY], largest).filter(F.col("pos") <= n)
    totals = cube.groupBy(BY).agg(services_sum().alias("total"))
    return (
        placed.join(F.broadcast(totals), BY)
        .select(BY, F.col("pos").cast("int").alias("pos"), member, "servicios", pct_of(F.col("servicios"), or_one(F.col("total"))).alias("pct"))
        .orderBy(BY, "pos")
    )


def concentration(summary: Summary, cube: DataFrame, n: int = 10) -> DataFrame:
    """What the ``n`` largest members of each perspective hold of all its services."""
    top = top_members(summary, cube, n).groupBy(BY).agg(F.sum("servicios").cast("double").alias("top"))
    total = cube.groupBy(BY).agg(services_sum().cast("double").alias("total"))
    return total.join(top, BY, "left").select(BY, "top", "total", ratio(F.col("top"), F.col("total")).alias("concentracion"))
