"""Exact distinct counts that add up: bitmaps of dense member numbers for every cell of the cube.

A count of distinct accounts cannot be summed over months or nodes; a set of them can be united. Members get
numbers without gaps, and a cell keeps one bit for each of its members, in blocks of 32,768 numbers.
Numbers follow the country first, so the members of a cell (which has one country) share few blocks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsboard import schema
from opsboard.operators.metrics import ratio
from opsboard.operators.numbering import numbered
from opsboard.operators.panels import BY, or_one, pct_of, services_sum, sum_where
from opsboard.storage import written

CUBE_KEYS = ("perspectiva", "mes", "nodo", "soa", "estatus")


def member_numbers(services: DataFrame, member: str) -> DataFrame:
    """Every member with a number from 1 on, by its first country and name; null is no member."""
    first = services.filter(F.col(member).isNotNull()).groupBy(member).agg(F.min("soa").alias("soa"))
    return numbered(first, [], ["soa", member], "numero").select(member, "numero")


def member_bitmaps(services: DataFrame, member: str, keys: Sequence[str] = CUBE_KEYS) -> DataFrame:
    """The members of each cell as bits: ``keys``, ``bloque`` and ``mapa``.

    What is needed of the rows is written down first, and cells get numbers, so that no task holds more of a row
    than two numbers or a number and a member. Rows shrink to one per cell and member before they meet their
    numbers, and those of a cell and block (no more than a block has bits) come together before their bitmap is
    made: bitmaps made by many tasks and united later would be as many as tasks times blocks.
    """
    rows = services.filter(F.col(member).isNotNull()).select(*dict.fromkeys([*keys, "soa", member]))
    rows = written(rows, "rows")
    cells = written(rows.select(*keys).distinct().withColumn("_celda", F.monotonically_increasing_id()), "cells")
    of_cell = [F.col(f"r.{k}").eqNullSafe(F.col(f"c.{k}")) for k in keys]
    pairs = rows.alias("r").join(cells.alias("c"), of_cell).select("c._celda", f"r.{member}").distinct()
    placed = pairs.join(member_numbers(rows, member), member)
    block = F.bitmap_bucket_number("numero").alias("bloque")
    met = placed.select("_celda", block, F.bitmap_bit_position("numero").alias("_bit")).repartition("_celda", "bloque")
    maps = met.groupBy("_celda", "bloque").agg(F.bitmap_construct_agg("_bit").alias("mapa"))
    return maps.join(cells, "_celda").select(*keys, "bloque", "mapa")


def count_members(bitmaps: DataFrame, by: Sequence[str | Column], name: str) -> DataFrame:
    """How many members the cells of each ``by`` have between them. Partial unions are made before the shuffle."""
    united = bitmaps.groupBy(*by, "bloque").agg(F.bitmap_or_agg("mapa").alias("mapa"))
    keys = [c for c in united.columns if c not in ("bloque", "mapa")]
    return united.groupBy(*keys).agg(F.sum(F.bitmap_count("mapa")).alias(name))


def kpi_block(cube: DataFrame, accounts: DataFrame) -> DataFrame:
    """:func:`opsboard.operators.panels.kpi_block` from the cube and the bitmaps of its accounts."""
    estatus = F.col("estatus")
    sums = cube.groupBy(BY).agg(
        services_sum().alias("servicios_totales"),
        F.count_distinct("soa").alias("paises"),
        sum_where(estatus == schema.CONCLUDED).alias("concluido"),
        sum_where(estatus.isin(schema.CANCELLED_AT_ONCE, schema.CANCELLED_LATER)).alias("cancelado"),
        sum_where(estatus.isNotNull()).alias("con_estatus"),
    )
    divisor = or_one(F.col("con_estatus"))
    return sums.join(count_members(accounts, [BY], "cuentas"), BY, "left").select(
        BY,
        "servicios_totales",
        F.coalesce("cuentas", F.lit(0)).alias("cuentas_activas"),
        "paises",
        pct_of(F.col("concluido"), divisor).alias("pct_concluido"),
        pct_of(F.col("cancelado"), divisor).alias("pct_cancelado"),
    )


def per_entity(cube: DataFrame, members: DataFrame, by: Sequence[str]) -> DataFrame:
    """:func:`opsboard.operators.metrics.per_entity` of services, from the cube and the bitmaps of the entity."""
    sums = cube.groupBy(*by).agg(services_sum().alias("medida"))
    counts = count_members(members, [F.col(k).alias(f"_{k}") for k in by], "entidades")
    meet = F.lit(True)
    for k in by:
        meet = meet & F.col(k).eqNullSafe(F.col(f"_{k}"))
    joined = sums.join(counts, meet, "left").select(*by, "medida", F.coalesce("entidades", F.lit(0)).alias("entidades"))
    return joined.withColumn("por_entidad", ratio(F.col("medida"), F.col("entidades")))
