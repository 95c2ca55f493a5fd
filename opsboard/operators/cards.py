"""KPI cards: current value, change, target and their labels in one row per KPI."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsboard import schema
from opsboard.functions import numbers
from opsboard.functions.calendar import month_name
from opsboard.operators.series import is_pending_change, relative_change


def is_pending(value: Column, rows: Column | None = None) -> Column:
    """No value to show. A card with ``rows`` shows those instead; money cards have none."""
    if rows is None:
        return value.isNull()
    return value.isNull() & (rows.isNull() | (F.size(rows) <= 0))


def target_text(formatted: Column, target: Column, kind: Column, unit: Column) -> Column:
    """The ready text if there is one, else the formatted target, else TBD."""
    return F.coalesce(
        formatted, F.when(target.isNull(), F.lit("TBD")).otherwise(numbers.by_kind(target, kind, unit))
    )


def milestone_colour(status: Column) -> Column:
    """Colour of a milestone; what is not a known colour is amber."""
    return F.when(status.isin(*schema.MILESTONE_COLOURS), status).otherwise(F.lit(schema.DEFAULT_MILESTONE))


def kpi_cards(facts: DataFrame, targets: DataFrame, month: date) -> DataFrame:
    """One card per target row for one month, all countries together.

    Two conditional sums over the two months involved; targets without facts stay, pending.
    """
    this_month = F.lit(month)
    last_month = F.add_months(this_month, -1)
    sums = (
        facts.filter(F.col("mes").between(last_month, this_month))
        .groupBy("kpi_id")
        .agg(
            F.sum(F.when(F.col("mes") == this_month, F.col("valor"))).cast("double").alias("valor"),
            F.sum(F.when(F.col("mes") == last_month, F.col("valor"))).cast("double").alias("previo"),
        )
    )
    valor, previo = F.col("valor"), F.col("previo")
    delta = relative_change(valor, previo)
    mom = F.struct(
        is_pending_change(valor, previo).alias("pendiente"),
        delta.alias("delta"),
        numbers.delta_label(delta).alias("etiqueta"),
        numbers.direction_arrow(delta).alias("flecha"),
        month_name(last_month).alias("mes_previo"),
    )
    target = F.struct(
        F.col("target").alias("valor"),
        F.col("unit").alias("unidad"),
        F.col("direction").alias("sentido"),
        F.col("period_label").alias("periodo"),
        target_text(F.col("formatted"), F.col("target"), F.col("value_format"), F.col("unit")).alias("texto"),
    )
    display = F.when(
        is_pending(valor), F.coalesce("pending_label", "title")
    ).otherwise(numbers.by_kind(valor, F.col("value_format"), F.col("unit")))
    return targets.join(sums, "kpi_id", "left").select(
        "kpi_id",
        "title",
        "valor",
        is_pending(valor).alias("pendiente"),
        display.alias("texto"),
        month_name(this_month).alias("mes_label"),
        mom.alias("mom"),
        target.alias("target"),
    )


def card_faces(stored: DataFrame) -> DataFrame:
    """What a board shows of its stored cards: rows if there are any, else the pending label, else
    the ready display value; plus the second line and the target's own text."""
    rows = F.col("rows")
    pending = is_pending(F.col("value"), rows)
    has_rows = F.coalesce(F.size(rows) > 0, F.lit(False))
    second = F.col("secondary_line")
    return stored.select(
        "id",
        "title",
        "status",
        pending.alias("pendiente"),
        F.when(has_rows, "filas").when(pending, "pendiente").otherwise("valor").alias("cara"),
        F.when(has_rows, rows_text(rows))
        .when(pending, F.coalesce("pending_label", F.lit("TBD")))
        .otherwise(F.col("display_value"))
        .alias("texto"),
        F.concat_ws(" ", second["label"], second["value"]).alias("segunda_linea"),
        F.col("target.text").alias("meta_texto"),
    )


def money_card_faces(stored: DataFrame) -> DataFrame:
    """The same for money cards, which know no rows, format their value themselves and name a
    pending card by its title."""
    value, kind, unit = F.col("value"), F.col("value_format"), F.col("value_unit")
    target = F.col("target")
    return stored.select(
        "id",
        "title",
        "status",
        is_pending(value).alias("pendiente"),
        F.when(is_pending(value), F.coalesce("pending_label", "title"))
        .otherwise(numbers.by_kind(value, kind, unit))
        .alias("texto"),
        target_text(target["formatted"], target["value"], kind, target["unit"]).alias("meta_texto"),
    )


def flat_cards(cards: DataFrame) -> DataFrame:
    """Cards without nesting, for sinks that know no structs."""
    return cards.select(
        "kpi_id",
        "title",
        "valor",
        "pendiente",
        "texto",
        "mes_label",
        F.col("mom.pendiente").alias("mom_pendiente"),
        F.col("mom.delta").alias("mom_delta"),
        F.col("mom.etiqueta").alias("mom_etiqueta"),
        F.col("mom.flecha").alias("mom_flecha"),
        F.col("mom.mes_previo").alias("mom_mes_previo"),
        F.col("target.valor").alias("meta"),
        F.col("target.texto").alias("meta_texto"),
    )


def multi_value_card(values: DataFrame, label: str, value: str, order: str, by: Sequence[str] = ()) -> DataFrame:
    """Card with one row per group instead of a single value, in declared order."""
    rows = F.array_sort(
        F.collect_list(F.struct(F.col(order).alias("o"), F.col(label).alias("label"), F.col(value).alias("value")))
    )
    return values.groupBy(*by).agg(
        F.transform(rows, lambda r: F.struct(r["label"].alias("label"), r["value"].alias("value"))).alias("rows")
    )


def rows_text(rows: Column) -> Column:
    """Rows of a card as text, numbers with thousands separators."""
    return F.array_join(
        F.transform(rows, lambda r: F.concat(r["label"], F.lit(" "), numbers.grouped_number(r["value"]))), " | "
    )
