"""Numbers: lenient parsing, the two roundings in use, clamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def num(text: Column) -> Column:
    """A trimmed string as a double; anything that is no finite number is 0."""
    value = F.trim(text).try_cast("double")
    return F.coalesce(F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value), F.lit(0.0))


def num_commas(text: Column) -> Column:
    """As ``num``, with thousands separators taken out first."""
    return num(F.replace(text, F.lit(","), F.lit("")))


def whole(text: Column) -> Column:
    """A string as a long, cut towards zero; 0 where it is no number."""
    return num(text).cast("long")


def round_even(x: Column) -> Column:
    """Nearest whole number, ties to even."""
    return F.rint(x).cast("long")


def round_up_half(x: Column) -> Column:
    """Nearest whole number, ties upwards."""
    return F.floor(x + 0.5)


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def percent_of(part: Column, total: Column) -> Column:
    """Whole per cent, ties to even; 0 where the total is 0."""
    return F.when(total > 0, round_even(part / F.nullif(total, F.lit(0)) * 100)).otherwise(F.lit(0)).cast("long")


def clean_prefs(capital: Column, risk: Column, positions: Column) -> tuple[Column, Column, Column]:
    """Saved preferences inside their bounds: capital, risk per cent, number of positions."""
    def sure(x: Column, default: float) -> Column:
        x = x.cast("double")
        return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), F.lit(default)).otherwise(x)

    return (
        clamp(sure(capital, 1e6), 0.0, 1e12),
        clamp(sure(risk, 1.0), 0.0, 100.0),
        clamp(F.floor(sure(positions, 6.0) + 0.5).cast("double"), 1.0, 100.0),
    )
