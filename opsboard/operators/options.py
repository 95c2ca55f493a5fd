"""Members the filters offer, as distinct sorted rows. Null is no member.

Lists stay rows: the accounts of one country may be too many for an array in one row.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsboard.operators.filters import Selection, one_of, shared_filters
from opsboard.operators.panels import services_sum


def members(services: DataFrame, column: str) -> DataFrame:
    """Sorted distinct members over all perspectives; months, nodes and so on."""
    return services.select(column).dropna().distinct().orderBy(column)


def hierarchy_members(services: DataFrame) -> DataFrame:
    """Distinct node, country and account: all that the lists below need of the services."""
    return services.select("nodo", "soa", "cuenta").distinct()


def membership(services: DataFrame, parent: str, child: str) -> DataFrame:
    """Which children occur under which parent, over all perspectives."""
    return services.select(parent, child).dropna().distinct().orderBy(parent, child)


def cascade_options(services: DataFrame, nodos: Iterable[str] = (), paises: Iterable[str] = ()) -> DataFrame:
    """Countries of the chosen nodes, and accounts of the chosen countries.

    With no country chosen, the accounts are those of every country offered; an account belongs to
    a country whichever node its rows are in. ``services`` may be :func:`hierarchy_members`.
    """
    offered = (
        one_of(services.filter(F.col("nodo").isNotNull()), "nodo", nodos).select("soa").dropna().distinct()
    )
    paises = list(paises)
    if paises:
        accounts = one_of(services, "soa", paises)
    else:
        accounts = services.join(offered, "soa", "left_semi")
    return (
        offered.select(F.lit("pais").alias("nivel"), F.col("soa").alias("opcion"))
        .unionByName(
            accounts.select("cuenta").dropna().distinct().select(
                F.lit("cuenta").alias("nivel"), F.col("cuenta").alias("opcion")
            )
        )
        .orderBy("nivel", "opcion")
    )


def agent_options(services: DataFrame, chosen: Selection = Selection()) -> DataFrame:
    """Coordinators of all perspectives under the shared filters, busiest first."""
    return (
        shared_filters(services, chosen)
        .groupBy("agente")
        .agg(services_sum().alias("servicios"))
        .orderBy(F.col("servicios").desc(), "agente")
    )
