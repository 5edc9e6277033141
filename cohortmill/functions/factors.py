"""Factors: categories with a declared, ordered list of levels.

The levels are kept in the metadata of the column, which selections, filters, joins, groupings and staged tables pass on. Tables
complete themselves from them and models take their indicator columns from them, so nobody has to look through the data for levels.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

LEVELS = "levels"


def factor(df: DataFrame, column: str, levels: Sequence[str], missing: str | None = None, unlisted: str = "missing") -> DataFrame:
    """``column`` as text with these levels, in this order, the first being the reference.

    A value that is no level becomes missing, or fails the query with ``unlisted="fail"``. ``missing`` names a last level for missing
    values, which otherwise stay missing.
    """
    names = [str(v) for v in levels]
    if len(set(names)) < len(names):
        raise ValueError(f"{column} is given a level twice")
    text = F.col(column).cast("string")
    if unlisted == "fail":
        other = F.raise_error(F.concat(F.lit(f"{column} has a value that is no level: "), text)).cast("string")
        known = F.when(text.isin(names), text).when(text.isNotNull(), other)
    else:
        known = F.when(text.isin(names), text)
    if missing is not None:
        known, names = F.coalesce(known, F.lit(missing)), [*names, missing]
    return df.withColumn(column, known).withMetadata(column, {LEVELS: names})


def levels_of(df: DataFrame, column: str) -> list[str] | None:
    """The declared levels of a column, None if it has none."""
    return df.schema[column].metadata.get(LEVELS)


def level_rank(df: DataFrame, column: str) -> Column:
    """The place of a value among its levels, from 1; missing for a missing value."""
    place = F.array_position(F.array(*[F.lit(v) for v in levels_of(df, column)]), F.col(column))
    return F.when(place > 0, place.cast("int"))


def may_be_missing(df: DataFrame, column: str) -> bool:
    return df.schema[column].nullable
