"""Running values over a whole order, worked out in parallel.

Rows are dealt into ranges of the order, so a range is as large as a task and no task sees a whole group. Totals per range
are few: as many as there are ranges, and one more for every group that begins within a range. Running over these gives
what lies before each range, and the rest is found within it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from cohortmill.operators.joins import inner_join
from cohortmill.sources.files import stage

#: Fixed value: the bits that Spark's increasing row numbers keep for the place within a partition.
PLACE_BITS = 33

Order = Sequence[Column | str]


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores in front where ``df`` has such a column."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def in_ranges(df: DataFrame, order: Order, block: str, place: str | None = None) -> DataFrame:
    """``df`` written in ranges of the order: ``block`` numbers the ranges, ``place`` the rows of each from 0.

    Rows that are equal in the order stand in one range, so the order should tell rows apart. Its bounds are sampled
    from ``df``: stage what is costly and does not end in a shuffle. Without ``place`` the ranges are not sorted.
    """
    dealt = df.repartitionByRange(*order)
    if place is None:
        return stage(dealt.withColumn(block, F.spark_partition_id()))
    numbered = dealt.sortWithinPartitions(*order).withColumn(block, F.monotonically_increasing_id())
    within = F.col(block).bitwiseAND((1 << PLACE_BITS) - 1)
    return stage(numbered.withColumn(place, within).withColumn(block, F.shiftright(block, PLACE_BITS)))


def number_rows(df: DataFrame, order: Order, name: str = "number") -> DataFrame:
    """Add ``name``: 1, 2, 3 ... in the given order, over the whole table.

    Rows that the order does not tell apart are numbered one after the other. A table without rows stays so.
    """
    block, place, before, size = unused(df, "__block", "__place", "__before", "__size")
    rows = in_ranges(df, order, block, place)
    sizes = rows.groupBy(block).agg(F.count(F.lit(1)).alias(size))
    earlier = Window.orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(block, F.coalesce(F.sum(size).over(earlier), F.lit(0)).alias(before))
    met = inner_join(rows, offsets, [block])
    return met.withColumn(name, F.col(before) + F.col(place) + 1).drop(block, place, before)


def running(
    df: DataFrame,
    by: Sequence[str],
    order: Order,
    block: str,
    values: Mapping[str, tuple[Column, Column, Column]],
    backwards: bool = False,
) -> DataFrame:
    """Add running values over the rows of a group up to and including this one, or from it on if ``backwards``.

    ``block`` numbers ranges of the order, one after the other within each group. ``values`` gives for each name the
    aggregate over the rows of a range, the aggregate over those of several ranges (under the same name), and how what
    lies within the range and what lies before it (``name`` and ``name__before``, missing if nothing does) make one
    value. ``total`` and ``product`` below are such values.
    """
    by = list(by)
    start, end = Window.unboundedPreceding, Window.unboundedFollowing
    within = Window.partitionBy(block, *by).orderBy(*order).rowsBetween(*((0, end) if backwards else (start, 0)))
    others = Window.partitionBy(*by).orderBy(block).rowsBetween(*((1, end) if backwards else (start, -1)))
    # a row per range and group: few, however large the group
    parts = df.groupBy(block, *by).agg(*[own.alias(name) for name, (own, _, _) in values.items()])
    before = parts.select(
        block, *by, *[over.over(others).alias(f"{name}__before") for name, (_, over, _) in values.items()]
    )
    rows = df.select("*", *[own.over(within).alias(name) for name, (own, _, _) in values.items()])
    met = inner_join(rows, before, [block, *by])
    return met.withColumns({name: both for name, (_, _, both) in values.items()}).drop(*[f"{n}__before" for n in values])


def total(name: str, of: Column) -> tuple[Column, Column, Column]:
    """A running sum; what is missing adds nothing."""
    zero = F.lit(0)
    return F.sum(of), F.sum(name), F.coalesce(F.col(name), zero) + F.coalesce(F.col(f"{name}__before"), zero)


def product(name: str, of: Column) -> tuple[Column, Column, Column]:
    return F.product(of), F.product(name), F.col(name) * F.coalesce(F.col(f"{name}__before"), F.lit(1.0))
