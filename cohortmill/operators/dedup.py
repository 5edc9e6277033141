"""Row selection by key with a declared order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """First row of every key in the given order.

    Spark turns this into a group limit before the shuffle as well as after it, so a map
    task sends at most one row per key and a hot key does not pile up in one reducer.
    """
    ranked = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rank", F.row_number().over(ranked)).filter("__rank = 1").drop("__rank")


def distinct_rows(df: DataFrame, *columns: str) -> DataFrame:
    """Distinct rows, over the given columns or over all."""
    return (df.select(*columns) if columns else df).distinct()
