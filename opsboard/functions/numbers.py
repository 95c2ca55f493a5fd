"""Number labels. Numbers stay numeric everywhere else; a label is a last projection.

Labels round the exact binary value of the double, as C, Python and JavaScript do. Spark's own
``round``/``format_number``/``format_string`` round its shortest decimal text instead (0.15 to
one place gives 0.2 there, 0.1 here), so :func:`fixed` does the rounding in double arithmetic.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# 2**27 + 1 splits a double into two halves whose products with small integers are exact.
_SPLITTER = 134217729.0


def _named(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times in ``body``; keeps label plans small."""
    return F.transform(F.array(value), body)[0]


def _rounded_units(magnitude: Column, digits: int, ties: str) -> Column:
    """``magnitude * 10**digits`` rounded to a whole number, exact for results below 2**52."""
    scale = float(10**digits)

    def rounded(x: Column) -> Column:
        high = x * _SPLITTER - (x * _SPLITTER - x)
        lost = (high * scale - x * scale) + (x - high) * scale  # exact product = x * scale + lost
        tie_up = F.lit(True) if ties == "away" else F.floor(x * scale) % 2 == 1
        rest = x * scale - F.floor(x * scale)
        up = (rest > 0.5) | ((rest == 0.5) & ((lost > 0) | ((lost == 0) & tie_up)))
        return F.floor(x * scale) + F.when(up, 1).otherwise(0)

    return _named(magnitude, rounded)


def fixed(value: Column, digits: int, ties: str = "away") -> Column:
    """Text with a fixed number of decimals; ``ties`` is ``away`` (from zero) or ``even``."""
    value = value.cast("double")

    def placed(units: Column) -> Column:
        if digits == 0:
            return units
        padded = F.lpad(units, F.greatest(F.length(units), F.lit(digits + 1)), F.lit("0"))
        return F.concat(F.left(padded, F.length(padded) - digits), F.lit("."), F.right(padded, F.lit(digits)))

    units = _rounded_units(F.abs(value), digits, ties).cast("string")
    return F.concat(F.when(value < 0, "-").otherwise(""), _named(units, placed))


def whole_number(value: Column) -> Column:
    """Nearest integer, halves towards plus infinity."""
    return F.floor(value + 0.5)


def compact_money(value: Column, digits: int | None = None) -> Column:
    """B, M and K with 2, 3 and 2 decimals, plain numbers with 2; ``digits`` overrides all."""
    size = F.abs(value)
    billions, millions, thousands = size >= 1e9, size >= 1e6, size >= 1e3
    scaled = value / F.when(billions, 1e9).when(millions, 1e6).when(thousands, 1e3).otherwise(1.0)
    suffix = F.when(billions, "B").when(millions, "M").when(thousands, "K").otherwise("")
    if digits is not None:
        return F.concat(fixed(scaled, digits), suffix)
    return F.concat(F.when(millions & ~billions, fixed(scaled, 3)).otherwise(fixed(scaled, 2)), suffix)


def plain_number(value: Column) -> Column:
    """Shortest text of a number, whole numbers without a decimal point."""
    text = value.cast("double").cast("string")
    return F.regexp_replace(text, r"\.0$", "")


def compact_count(value: Column) -> Column:
    """Millions with one decimal, whole thousands, smaller numbers as they are."""
    size = F.abs(value)
    return (
        F.when(size >= 1e6, F.concat(fixed(value / 1e6, 1), F.lit("M")))
        .when(size >= 1e3, F.concat(whole_number(value / 1e3).cast("string"), F.lit("K")))
        .otherwise(plain_number(value))
    )


def percent(ratio: Column, digits: int = 1) -> Column:
    """A ratio as a percentage with fixed decimals."""
    return F.concat(fixed(ratio * 100, digits), F.lit("%"))


def grouped_number(value: Column) -> Column:
    """Thousands separated by commas, at most three decimals.

    Locale-aware formatting rounds the shortest decimal text of a number, unlike fixed decimals, so
    here Spark's own cast to decimal is right.
    """
    value = value.cast("double")

    def written(rounded: Column) -> Column:
        whole = F.format_number(F.floor(rounded), 0)
        decimals = F.regexp_replace(F.right(rounded.cast("string"), F.lit(3)), "0+$", "")
        return F.concat(whole, F.when(decimals == "", "").otherwise(F.concat(F.lit("."), decimals)))

    return F.concat(F.when(value < 0, "-").otherwise(""), _named(F.abs(value).cast("decimal(25,3)"), written))


def by_kind(value: Column, kind: Column, unit: Column) -> Column:
    """Text by format kind; anything but ``percent`` and ``ratio`` reads as money with its unit."""
    return (
        F.when(kind == "percent", percent(value, 2))
        .when(kind == "ratio", fixed(value, 3))
        .otherwise(F.concat(compact_money(value), F.lit(" "), unit))
    )


def delta_label(delta: Column) -> Column:
    """Relative change: the smaller it is, the more decimals it shows."""
    pct = delta * 100
    size = F.abs(pct)
    return F.concat(
        F.when(size < 1, fixed(pct, 3))
        .when(size < 10, fixed(pct, 1))
        .otherwise(whole_number(pct).cast("string")),
        F.lit("%"),
    )


def direction_arrow(delta: Column) -> Column:
    return F.when(delta < 0, "↘").when(delta > 0, "↗").when(delta == 0, "→")
