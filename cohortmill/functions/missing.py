"""Column helpers with statistical-language missing-value rules.

Spark follows SQL: NULL is skipped by aggregates and by ``concat_ws``, and a NULL test
falls into the ``otherwise`` branch. The analyses rebuilt here expect a missing test to
stay missing, so the differences live in this module and nowhere else.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, functions as F

ColumnLike = Column | str

# A plain or scientific decimal; Spark alone would also accept Java suffixes such as "1d".
_DECIMAL = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
_HEX = r"^0[xX][0-9a-fA-F]+$"
_INFINITE = r"(?i)^[+-]?(inf|infinity)$"


def as_column(value: ColumnLike) -> Column:
    return F.col(value) if isinstance(value, str) else value


def _literal(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def if_else(condition: Column, yes, no) -> Column:
    """Two-way choice in which a NULL condition gives NULL, not ``no``."""
    return F.when(condition, _literal(yes)).when(~condition, _literal(no))


def is_in(column: ColumnLike, values: Iterable) -> Column:
    """Membership that is false, never NULL, for a NULL input."""
    return F.coalesce(as_column(column).isin(list(values)), F.lit(False))


def na_if(column: ColumnLike, value) -> Column:
    return F.nullif(as_column(column), _literal(value))


def replace_na(column: ColumnLike, value) -> Column:
    return F.coalesce(as_column(column), _literal(value))


def prefer(preferred: ColumnLike, fallback: ColumnLike) -> Column:
    return F.coalesce(as_column(preferred), as_column(fallback))


def paste(*columns: ColumnLike, sep: str = " ") -> Column:
    """Join values as text; a missing value becomes the text ``NA``."""
    parts = [F.coalesce(as_column(c).cast("string"), F.lit("NA")) for c in columns]
    return F.concat_ws(sep, *parts)


def paste0(*columns: ColumnLike) -> Column:
    return paste(*columns, sep="")


def str_c(*columns: ColumnLike, sep: str = "") -> Column:
    """Join values as text; one missing value makes the whole result missing.

    Without a separator different keys can give the same text ("A1"+"2", "A"+"12"), so
    joins in this package use the key columns themselves and keep this only for output.
    """
    parts: list[Column] = []
    for c in columns:
        if parts and sep:
            parts.append(F.lit(sep))
        parts.append(as_column(c).cast("string"))
    return F.concat(*parts)


def as_number(column: ColumnLike) -> Column:
    """Text to double; anything that is not a number, NaN included, becomes NULL instead of failing.

    Spark sorts NaN above all numbers and finds it greater than any, where every comparison should be missing.
    """
    text = F.trim(as_column(column).cast("string"))
    return (
        F.when(text.rlike(_DECIMAL) | text.rlike(_INFINITE), text.try_cast("double"))
        .when(text.rlike(_HEX), F.conv(F.substring(text, 3, 64), 16, 10).try_cast("double"))
    )


def present_number(column: ColumnLike) -> Column:
    """A number column as double, with NaN as missing."""
    return F.nullif(as_column(column).try_cast("double"), F.lit(float("nan")))


def finite(column: ColumnLike) -> Column:
    """A number column as double; NaN and the infinities, which have no place on an axis, are missing."""
    x = as_column(column).try_cast("double")
    return F.when(F.abs(x) < float("inf"), x)


def round_half_even(column: ColumnLike, digits: int = 0) -> Column:
    """Round to the nearer of the two neighbouring decimals, ties to the even one.

    The distance is taken on the stored binary value, so 0.15 goes down to 0.1 while
    ``bround``, which rounds the printed decimal, would give 0.2.
    """
    x = as_column(column).cast("double")
    scale = F.lit(float(10**digits))
    steps = F.floor(x * scale).cast("double")
    low = steps / scale
    high = F.ceil(x * scale).cast("double") / scale
    gap = (high - x) - (x - low)
    is_odd = F.pmod(steps, F.lit(2.0)) == 1
    return F.when((gap < 0) | ((gap == 0) & is_odd), high).otherwise(low)


def positive_log10(column: ColumnLike) -> Column:
    """log10 of positive finite values; all others have no place on a log axis."""
    x = finite(column)
    return F.when(x > 0, F.log10(x))


def blank_when_zero(column: ColumnLike) -> Column:
    """Counts as text for a report, with 0 shown as an empty cell."""
    x = as_column(column)
    return F.when(x == 0, F.lit("")).otherwise(x.cast("string"))
