"""Exact quantiles without gathering a group's values in one task.

Spark's ``percentile`` and ``median`` keep all distinct values of a group in one
aggregation buffer. Here the values are selected in parallel:

1. count the rows per (group, value), and deal the counts into ranges of value;
2. from the totals of the ranges, find those in which the wanted ranks fall;
3. order the values of these ranges, one range per task, and read the ranks off.

A range is as large as a task, whatever the size of a group, and the data are read once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from cohortmill.functions.missing import ColumnLike, as_column, present_number
from cohortmill.operators.joins import inner_join
from cohortmill.operators.ranges import in_ranges

ACCURACY = 10_000


def attach(df: DataFrame, stats: DataFrame, by: Sequence[str]) -> DataFrame:
    """Add per-group statistics to every row; without groups they are scalar subqueries."""
    if by:
        return inner_join(df, stats, list(by))
    packed = stats.select(F.struct(*stats.columns).alias("s")).scalar()
    return df.withColumn("__stats", packed).select("*", "__stats.*").drop("__stats")


def _positions(prob: float, definition: str) -> tuple[Column, Column, Column]:
    """Ranks (from 1) to read, and the weight of the higher one."""
    n = F.col("__n").cast("double")
    if definition == "linear":
        h = (n - 1) * F.lit(float(prob))
        return F.floor(h) + 1, F.ceil(h) + 1, h - F.floor(h)
    if definition == "averaged":
        h = n * F.lit(float(prob))
        low = F.floor(h)
        whole = h == low
        first = F.when(whole, F.greatest(low, F.lit(1))).otherwise(low + 1)
        second = F.least(low + 1, F.col("__n"))
        return first, second, F.when(whole, F.lit(0.5)).otherwise(F.lit(1.0))
    raise ValueError(f"unknown quantile definition {definition!r}")


def value_counts(df: DataFrame, value: ColumnLike, by: Sequence[str] = ()) -> DataFrame:
    """Rows per (group, value) as ``__x`` and ``__k``; missing values are left out.

    Equal values are combined before the shuffle, and the shuffle key holds the value, so a
    large group is spread over all tasks.
    """
    rows = df.select(*by, present_number(value).alias("__x")).filter("__x IS NOT NULL")
    return rows.groupBy(*by, "__x").agg(F.count(F.lit(1)).alias("__k"))


def exact_quantiles(
    df: DataFrame,
    value: ColumnLike,
    probs: Sequence[float],
    names: Sequence[str],
    by: Sequence[str] = (),
    definition: str = "linear",
    count_name: str | None = None,
) -> DataFrame:
    """One row per group with one column per probability; missing values are left out.

    ``definition`` is "linear" (interpolate between neighbours) or "averaged" (a value of
    the data, or the mean of two where the rank falls between them). A group with no
    present value has no row. ``df`` is read once.
    """
    return quantiles_of_counts(ranged_counts(df, value, by), probs, names, by, definition, count_name)


def ranged_counts(df: DataFrame, value: ColumnLike, by: Sequence[str] = ()) -> DataFrame:
    """``value_counts`` written in ranges of (group, value), numbered by ``__block``."""
    return in_ranges(value_counts(df, value, by), [*by, "__x"], "__block")


def quantiles_of_counts(
    counts: DataFrame,
    probs: Sequence[float],
    names: Sequence[str],
    by: Sequence[str] = (),
    definition: str = "linear",
    count_name: str | None = None,
) -> DataFrame:
    """``exact_quantiles`` of ``ranged_counts``."""
    by = list(by)
    # A row per range, and one more for every group that begins within one.
    running = Window.partitionBy(*by).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    totals = counts.groupBy(*by, "__block").agg(F.sum("__k").alias("__size"))
    totals = totals.withColumn("__n", F.sum("__size").over(Window.partitionBy(*by)))
    totals = totals.withColumn("__before", F.coalesce(F.sum("__size").over(running), F.lit(0)))
    wanted = [_positions(p, definition) for p in probs]
    ranks = F.array(*[r.cast("long") for low, high, _ in wanted for r in (low, high)])

    def holds(start: str, size: str) -> Column:
        return F.exists(ranks, lambda r: (r > F.col(start)) & (r <= F.col(start) + F.col(size)))

    needed = totals.filter(holds("__before", "__size")).select(*by, "__block", "__before", "__n")
    ordered = Window.partitionBy(*by, "__block").orderBy("__x").rowsBetween(Window.unboundedPreceding, 0)
    hits = (
        inner_join(counts, needed, [*by, "__block"])
        .withColumn("__start", F.col("__before") + F.sum("__k").over(ordered) - F.col("__k"))
        .filter(holds("__start", "__k"))
    )

    columns = []
    for (low, high, weight), name in zip(wanted, names):
        def at(rank):
            return F.max(F.when((rank > F.col("__start")) & (rank <= F.col("__start") + F.col("__k")), F.col("__x")))

        share = F.max(weight)
        columns.append((at(low) + (at(high) - at(low)) * share).alias(name))
    if count_name:
        columns.append(F.max("__n").alias(count_name))
    return hits.groupBy(*by).agg(*columns)


def exact_median(df: DataFrame, value: ColumnLike, name: str, by: Sequence[str] = ()) -> DataFrame:
    return exact_quantiles(df, value, [0.5], [name], by)


def approximate_quantiles(
    df: DataFrame, value: ColumnLike, probs: Sequence[float], names: Sequence[str], by: Sequence[str] = ()
) -> DataFrame:
    """Sketched quantiles in one pass, for when a small rank error is acceptable."""
    x = as_column(value).cast("double")
    return df.groupBy(*by).agg(*[F.percentile_approx(x, p, ACCURACY).alias(n) for p, n in zip(probs, names)])
