"""Month grain and period labels. Everything is DATE, so no session time zone is involved."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

from opsboard import schema


def month_start(moment: Column) -> Column:
    return F.trunc(moment, "MM")


def month_index(day: Column) -> Column:
    """Consecutive integers for consecutive months, for range windows over months."""
    return F.year(day) * 12 + F.month(day)


def month_name(day: Column) -> Column:
    return F.element_at(F.array(*[F.lit(name) for name in schema.MONTHS]), F.month(day))


def month_label(day: Column) -> Column:
    """``Ene 2025``."""
    return F.concat(month_name(day), F.lit(" "), F.year(day).cast("string"))


def _two_digit_year(day: Column) -> Column:
    return F.lpad((F.year(day) % 100).cast("string"), 2, "0")


def quarter_label(day: Column) -> Column:
    """``Q1'26``."""
    return F.concat(F.lit("Q"), F.quarter(day).cast("string"), F.lit("'"), _two_digit_year(day))


def half_year_label(day: Column) -> Column:
    """``1er Sem'26`` / ``2do Sem'26``."""
    half = F.when(F.month(day) <= 6, "1er Sem'").otherwise("2do Sem'")
    return F.concat(half, _two_digit_year(day))


def quarter_start(day: Column) -> Column:
    return F.trunc(day, "quarter")


def half_year_start(day: Column) -> Column:
    first_month = F.when(F.month(day) <= 6, 1).otherwise(7)
    return F.make_date(F.year(day), first_month, F.lit(1))


def next_month(day: date) -> date:
    return date(day.year + day.month // 12, day.month % 12 + 1, 1)


def months_covered(lo: date, hi: date) -> tuple[date, date]:
    """Half-open day range of the month starts ``lo <= m <= hi``."""
    first = lo if lo.day == 1 else next_month(lo)
    return first, next_month(hi)
