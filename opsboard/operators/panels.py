"""Panels of the service board.

Every panel takes clean services (raw rows or an additive pre-aggregate of them) and answers for
all perspectives at once. Rows are summed before anything else happens to them: map-side partial
sums absorb a node or account that holds most of the rows, and shares, ranks and grids work on the
few summed rows only. As in the tables these panels follow, a row with a null key belongs to no
group, while grand totals count every row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsboard import schema
from opsboard.functions.numbers import fixed
from opsboard.sources.dictionaries import status_order

BY = "perspectiva"


def services_sum() -> Column:
    """Additive measure; the sum of nothing is 0."""
    return F.coalesce(F.sum("servicios"), F.lit(0))


def sum_where(condition: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, F.col("servicios"))), F.lit(0))


def or_one(total: Column) -> Column:
    """Divisor that never is 0."""
    return F.when(total == 0, 1).otherwise(total)


def pct_of(part: Column, total: Column) -> Column:
    return part / total * 100


def kpi_block(services: DataFrame) -> DataFrame:
    """Total, active accounts, countries, and shares concluded and cancelled.

    The total counts all rows; the shares are of rows that have a status, known or not. Rows are
    summed per account first, so the distinct counts fan out over accounts and not over rows.
    """
    estatus = F.col("estatus")
    measures = {
        "servicios_totales": services_sum(),
        "concluido": sum_where(estatus == schema.CONCLUDED),
        "cancelado": sum_where(estatus.isin(schema.CANCELLED_AT_ONCE, schema.CANCELLED_LATER)),
        "con_estatus": sum_where(estatus.isNotNull()),
    }
    accounts = services.groupBy(BY, "soa", "cuenta").agg(*[m.alias(name) for name, m in measures.items()])
    sums = accounts.groupBy(BY).agg(
        F.count_distinct("cuenta").alias("cuentas_activas"),
        F.count_distinct("soa").alias("paises"),
        *[F.sum(name).alias(name) for name in measures],
    )
    divisor = or_one(F.col("con_estatus"))
    return sums.select(
        BY,
        "servicios_totales",
        "cuentas_activas",
        "paises",
        pct_of(F.col("concluido"), divisor).alias("pct_concluido"),
        pct_of(F.col("cancelado"), divisor).alias("pct_cancelado"),
    )


def small_slice_label(part: Column, total: Column) -> Column:
    """One-decimal percentage, left out below one percent."""
    return F.when(part / total >= 0.01, F.concat(fixed(pct_of(part, total), 1, "even"), F.lit("%"))).otherwise("")


def _unfolded(*columns: str) -> Column:
    """One row per known status from one value column per status, in display order."""
    return F.inline(
        F.array(
            *[
                F.struct(F.lit(place).alias("ord"), F.lit(name).alias("estatus"), F.col(value).alias("servicios"))
                for place, (name, value) in enumerate(zip(schema.STATUSES, columns))
            ]
        )
    )


def status_totals(services: DataFrame) -> DataFrame:
    """Sum of each known status, 0 where there is none; other statuses do not appear.

    The domain is completed by conditional sums unfolded into rows, so no join with it is needed.
    """
    sums = [f"s{place}" for place in range(len(schema.STATUSES))]
    folded = services.groupBy(BY).agg(
        *[sum_where(F.col("estatus") == name).alias(s) for name, s in zip(schema.STATUSES, sums)]
    )
    return folded.select(BY, _unfolded(*sums))


def status_share(services: DataFrame) -> DataFrame:
    """Known statuses with a positive sum, in display order, and their share of each other."""
    total = F.sum("servicios").over(Window.partitionBy(BY))  # at most four rows per perspective
    return (
        status_totals(services)
        .filter("servicios > 0")
        .withColumn("total", total)
        .select(
            BY,
            "ord",
            "estatus",
            "servicios",
            (F.col("servicios") / F.col("total")).alias("participacion"),
            small_slice_label(F.col("servicios"), F.col("total")).alias("etiqueta"),
        )
        .orderBy(BY, "ord")
    )


def monthly_trend(services: DataFrame) -> DataFrame:
    """Sum by month and known status; statuses that are 0 all along are no series."""
    sums = (
        services.filter(F.col("mes").isNotNull() & F.col("estatus").isin(*schema.STATUSES))
        .groupBy(BY, "mes", "estatus")
        .agg(services_sum().alias("servicios"))
    )
    whole_series = F.sum("servicios").over(Window.partitionBy(BY, "estatus"))  # one row per month
    return (
        sums.withColumn("serie", whole_series)
        .filter("serie != 0")
        .select(BY, "mes", status_order(F.col("estatus")).alias("ord"), "estatus", "servicios")
        .orderBy(BY, "mes", "ord")
    )


def _totals(groups: DataFrame) -> DataFrame:
    """Grand total per perspective, from sums already made: one row each, so it can be broadcast.

    Where the same sums are listed too, both read one shuffle of them (exchange reuse). That needs
    the null group to be there until the total is attached, which is why :func:`_share` and not a
    filter on the member takes it out.
    """
    return groups.groupBy(BY).agg(services_sum().alias("total"))


def _share(groups: DataFrame, totals: DataFrame, member: str) -> DataFrame:
    """Attach ``pct`` of the grand total and drop the null group, which has no share."""
    pct = F.when(F.col(member).isNotNull(), pct_of(F.col("servicios"), or_one(F.col("total"))))
    return groups.join(F.broadcast(totals), BY).withColumn("pct", pct).filter(F.col("pct").isNotNull())


def _best(groups: DataFrame, totals: DataFrame, member: str, top: int, *extra: str) -> DataFrame:
    """The ``top`` largest members with their place and share.

    Ranking comes first and keeps ``top`` + 1 rows (the null group may hold a place); Spark applies
    such a limit before the shuffle, so what follows sees a handful of rows.
    """
    order = Window.partitionBy(BY).orderBy(F.col("servicios").desc(), member)
    few = groups.withColumn("lugar", F.row_number().over(order)).filter(F.col("lugar") <= top + 1)
    return (
        _share(few, totals, member)
        .withColumn("pos", F.row_number().over(order))
        .filter(F.col("pos") <= top)
        .select(BY, "pos", member, *extra, "servicios", "pct")
        .orderBy(BY, "pos")
    )


def participation(services: DataFrame, member: str, top: int | None = None) -> DataFrame:
    """Sum by any dimension, largest first, and its share of *all* rows.

    ``top`` keeps the largest members only; their shares stay shares of everything.
    """
    groups = services.groupBy(BY, member).agg(services_sum().alias("servicios"))
    if top is not None:
        return _best(groups, _totals(groups), member, top)
    return (
        _share(groups, _totals(groups), member)
        .select(BY, member, "servicios", "pct")
        .orderBy(BY, F.col("servicios").desc(), member)
    )


def top_accounts(services: DataFrame, n: int = 15) -> DataFrame:
    return participation(services, "cuenta", n)


def status_mix(services: DataFrame, member: str) -> DataFrame:
    """Percentage of each known status within each member, as a full member x status grid.

    The divisor counts every status, known or not; a status the member lacks has a null share, and
    a status nobody has is left out. Each member's sums end up in one row, and the grid is that
    row unfolded.
    """
    estatus, servicios = F.col("estatus"), F.col("servicios")
    sums = [f"s{place}" for place in range(len(schema.STATUSES))]
    cells = (
        services.filter(F.col(member).isNotNull())
        .groupBy(BY, member, "estatus")
        .agg(services_sum().alias("servicios"))
    )
    # at most the known statuses per perspective, so it can be broadcast; asked of the sums and not
    # of the status, or this branch would no longer read the same shuffle as the other
    known = F.sum(F.when(estatus.isin(*schema.STATUSES), servicios))
    used = cells.groupBy(BY, "estatus").agg(known.alias("usado")).filter("usado != 0")
    rows = cells.groupBy(BY, member).agg(
        services_sum().alias("total_miembro"),
        F.sum(F.when(estatus.isNotNull(), servicios)).alias("con_estatus"),
        *[F.sum(F.when(estatus == name, servicios)).alias(s) for name, s in zip(schema.STATUSES, sums)],
    )
    share = F.try_divide(servicios, F.col("con_estatus")) * 100
    return (
        rows.select(BY, member, "total_miembro", "con_estatus", _unfolded(*sums))
        .join(F.broadcast(used), [BY, "estatus"], "left_semi")
        .select(BY, member, "total_miembro", "ord", "estatus", "servicios", share.alias("pct"))
        .orderBy(BY, "total_miembro", member, "ord")
    )


def hierarchy_rollup(services: DataFrame) -> DataFrame:
    """Total > node > country with the share of the parent. Only positive leaves take part."""
    leaves = (
        services.filter(F.col("nodo").isNotNull() & F.col("soa").isNotNull())
        .groupBy(BY, "nodo", "soa")
        .agg(services_sum().alias("servicios"))
        .filter("servicios > 0")
    )
    levels = leaves.groupingSets([[BY, "nodo", "soa"], [BY, "nodo"], [BY]], BY, "nodo", "soa").agg(
        services_sum().alias("servicios"), (2 - F.grouping("nodo") - F.grouping("soa")).cast("int").alias("nivel")
    )

    def at_level(level: int, *keys: str) -> Column:
        return F.max(F.when(F.col("nivel") == level, F.col("servicios"))).over(Window.partitionBy(BY, *keys))

    parent = F.when(F.col("nivel") == 2, F.col("del_nodo")).otherwise(F.col("del_total"))
    return (
        levels.withColumn("del_nodo", at_level(1, "nodo"))
        .withColumn("del_total", at_level(0))
        .select(BY, "nivel", "nodo", "soa", "servicios", pct_of(F.col("servicios"), parent).alias("pct_padre"))
        .orderBy(BY, "nivel", "nodo", "soa")
    )


def top_agents(services: DataFrame, n: int = 15) -> DataFrame:
    """Best coordinators by services, with up to three of their codes and the share of all rows.

    Rows collapse to (coordinator, code) sums first. Codes are then numbered in order, so only
    the first three of a coordinator are ever gathered, however many there are.
    """
    pairs = services.groupBy(BY, "agente", "coord_code").agg(services_sum().alias("servicios"))
    no_code = F.col("coord_code") == schema.NO_CODE
    in_order = Window.partitionBy(BY, "agente").orderBy(no_code, "coord_code")
    first_codes = F.collect_list(F.when((F.col("n") <= 3) & ~no_code, F.col("coord_code")))
    agents = (
        pairs.withColumn("n", F.row_number().over(in_order))
        .groupBy(BY, "agente")
        .agg(services_sum().alias("servicios"), first_codes.alias("codes"))
    )
    codigo = F.coalesce(F.nullif(F.array_join(F.array_sort("codes"), "/"), F.lit("")), F.lit(schema.NO_CODE))
    named = agents.select(BY, "agente", codigo.alias("codigo"), "servicios")
    return _best(named, _totals(pairs), "agente", n, "codigo")


def detail_table(services: DataFrame) -> DataFrame:
    """Node, country, account and status with their sum, largest first; rows with a null key go."""
    keys = ["nodo", "soa", "cuenta", "estatus"]
    return (
        services.dropna(subset=keys)
        .groupBy(BY, *keys)
        .agg(services_sum().alias("servicios"))
        .orderBy(BY, F.col("servicios").desc(), *keys)
    )


def clean_summary(services: DataFrame) -> DataFrame:
    """Row and sum counts of a load, with what the cleaning rules left and marked; one cheap pass."""
    return services.groupBy(BY).agg(
        F.count(F.lit(1)).alias("filas"),
        services_sum().alias("servicios"),
        F.count_if(F.col("cuenta").isNull()).alias("sin_cuenta"),
        F.count_if(F.col("agente") == schema.UNASSIGNED).alias("sin_asignar"),
        F.count_if(F.col("coord_code") == schema.NO_CODE).alias("sin_codigo"),
        F.min("mes").alias("primer_mes"),
        F.max("mes").alias("ultimo_mes"),
    )


def member_counts(services: DataFrame) -> DataFrame:
    """Distinct members of the large dimensions and distinct months. Exact, so every row is looked
    at once per count; only distinct values reach the shuffle."""
    return services.groupBy(BY).agg(
        F.count_distinct("cuenta").alias("cuentas"),
        F.count_distinct("agente").alias("agentes"),
        F.count_distinct("mes").alias("meses"),
    )


def reconciliation(services: DataFrame) -> DataFrame:
    """Monthly sums of the two perspectives side by side, their difference and its running sum.

    Conditional sums stand in for a full outer join: a month only one perspective has is 0 in the
    other. The running sum goes over one row per month.
    """
    opened, handled = schema.PERSPECTIVES
    months = (
        services.filter(F.col("mes").isNotNull())
        .groupBy("mes")
        .agg(
            sum_where(F.col(BY) == opened).alias(opened),
            sum_where(F.col(BY) == handled).alias(handled),
        )
        .withColumn("diferencia", F.col(opened) - F.col(handled))
    )
    so_far = Window.orderBy("mes").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return months.withColumn("diferencia_acumulada", F.sum("diferencia").over(so_far)).orderBy("mes")
