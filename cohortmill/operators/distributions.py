"""The tables behind distribution plots: binned counts, density curves, box summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from cohortmill.functions.missing import ColumnLike, finite, positive_log10, present_number
from cohortmill.operators.quantiles import attach, quantiles_of_counts, ranged_counts


def _scalar_struct(stats: DataFrame) -> Column:
    return stats.select(F.struct(*stats.columns).alias("s")).scalar()


def histogram(
    df: DataFrame, value: ColumnLike, bins: int, facets: Sequence[str] = (), log10: bool = False
) -> DataFrame:
    """Counts in equal bins shared by all facets; every facet lists all bins, empty ones with 0.

    The first and last bin are centred on the smallest and the largest value, and a value
    on an edge belongs to the lower bin. NaN and infinite values are left out. ``log10`` bins the
    logarithm and leaves out values that have none. One row per (facet, bin) leaves each map task.
    """
    x = positive_log10(value) if log10 else finite(value)
    rows = df.select(*facets, x.alias("__x")).filter(F.col("__x").isNotNull())
    span = _scalar_struct(rows.agg(F.min("__x").alias("lo"), F.max("__x").alias("hi")))
    lo, hi = F.col("__span.lo"), F.col("__span.hi")
    raw = (hi - lo) / F.lit(float(max(bins - 1, 1)))
    width = F.when(raw > 0, raw).otherwise(F.lit(0.1))
    place = F.ceil((F.col("__x") - lo) / F.col("__w") - 0.5)
    index = F.greatest(F.lit(0), F.least(F.lit(bins - 1), place)).cast("int")
    counted = (
        rows.withColumn("__span", span)
        .withColumn("__w", width)
        .groupBy(*facets, index.alias("bin"), lo.alias("__lo"), "__w")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    # one row per facet, with at most ``bins`` entries
    full = counted.groupBy(*facets, "__lo", "__w").agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("__n"))
    return full.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1)))).select(
        *facets,
        "bin",
        (F.col("__lo") + (F.col("bin") - 0.5) * F.col("__w")).alias("lower"),
        (F.col("__lo") + (F.col("bin") + 0.5) * F.col("__w")).alias("upper"),
        F.coalesce(F.try_element_at("__n", F.col("bin")), F.lit(0)).alias("n"),
    )


def dropped_by_log(df: DataFrame, value: ColumnLike) -> DataFrame:
    """How many present values a log axis cannot show; NaN is not present."""
    x = present_number(value)
    return df.agg(F.count_if(x.isNotNull() & positive_log10(x).isNull()).alias("n_dropped"))


def density_curve(df: DataFrame, value: ColumnLike, points: int = 512, scale_to_count: bool = True) -> DataFrame:
    """Gaussian kernel density on an even grid over the data range.

    The values are counted in one read, and all that follows works on the counts. Each value is split linearly between
    its two neighbouring grid points, so the kernel sums run over at most ``points`` weights, never over the data. The
    bandwidth is the usual rule of thumb, 0.9 s n^(-1/5), with s the least of sd and IQR/1.34; where that is zero, the sd,
    else the size of the smallest value, else 1. Data without spread get a grid of three bandwidths on either side.
    NaN and infinite values are left out; without values there is no curve.
    """
    counts = ranged_counts(df, finite(value))
    x, k = F.col("__x"), F.col("__k")
    basic = counts.agg(F.sum("__k").alias("n"), F.min("__x").alias("lo"), F.max("__x").alias("hi"), (F.sum(x * k) / F.sum(k)).alias("mean"))
    basic = basic.withColumn("q", quantiles_of_counts(counts, [0.25, 0.75], ["q1", "q3"]).select(F.struct("q1", "q3").alias("q")).scalar())
    square = counts.withColumn("m", _scalar_struct(basic)).agg(F.sum(k * (x - F.col("m.mean")) * (x - F.col("m.mean"))).alias("ss"))
    n = F.col("n").cast("double")
    sized = attach(basic, square, ()).withColumn("sd", F.when(n > 1, F.sqrt(F.col("ss") / (n - 1))))
    spread = F.least("sd", (F.col("q.q3") - F.col("q.q1")) / 1.34)
    scale = F.coalesce(*[F.when(x > 0, x) for x in (spread, F.col("sd"), F.abs("lo"))], F.lit(1.0))
    sized = sized.withColumn("bw", 0.9 * scale * F.pow(n, F.lit(-0.2)))
    wide = F.col("hi") > F.col("lo")
    low, high = (F.when(wide, F.col(c)).otherwise(F.col(c) + side * F.col("bw")) for c, side in (("lo", -3), ("hi", 3)))
    stats = _scalar_struct(sized.select("n", low.alias("lo"), ((high - low) / (points - 1)).alias("step"), "bw"))
    at = (x - F.col("s.lo")) / F.col("s.step")
    node = F.least(F.floor(at), F.lit(points - 2))
    halves = (
        counts.withColumn("s", stats)
        .select(node.alias("node"), (at - node).alias("up"), "__k")
        .groupBy("node")
        .agg(F.sum((1 - F.col("up")) * k).alias("here"), F.sum(F.col("up") * k).alias("next"))
    )
    pair = F.array(
        F.struct(F.col("node").alias("node"), F.col("here").alias("w")),
        F.struct((F.col("node") + 1).alias("node"), F.col("next").alias("w")),
    )
    weights = (
        halves.select(F.explode(pair).alias("p"))
        .groupBy(F.col("p.node").alias("node"))
        .agg(F.sum("p.w").alias("w"))
    )
    z = (F.col("grid") - F.col("node")) * F.col("s.step") / F.col("s.bw")
    kernel = F.col("w") * F.exp(-0.5 * z * z)
    norm = F.col("s.bw") * F.sqrt(2 * F.pi())
    total = norm if scale_to_count else norm * F.col("s.n")
    return (
        weights.withColumn("s", stats)
        .withColumn("grid", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
        .groupBy("grid", "s")
        .agg(F.sum(kernel).alias("k"))
        .select("grid", (F.col("s.lo") + F.col("grid") * F.col("s.step")).alias("x"), (F.col("k") / total).alias("y"))
    )


def box_summary(df: DataFrame, value: ColumnLike, by: Sequence[str] = ()) -> DataFrame:
    """Quartiles, whiskers at the last points within 1.5 IQR, and the number beyond them.

    The values are counted in one read, and the rest works on the counts.
    """
    by = list(by)
    counts = ranged_counts(df, value, by)
    quartiles = quantiles_of_counts(counts, [0.25, 0.5, 0.75], ["q1", "med", "q3"], by, "linear", "n")
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = F.col("__x").between(F.col("q1") - reach, F.col("q3") + reach)
    return (
        attach(counts, quartiles, by)
        .groupBy(*by, "n", "q1", "med", "q3")
        .agg(
            F.min(F.when(inside, F.col("__x"))).alias("__low"),
            F.max(F.when(inside, F.col("__x"))).alias("__high"),
            F.sum(F.when(inside, 0).otherwise(F.col("__k"))).alias("n_outliers"),
        )
        .select(
            *by,
            "n",
            F.least("__low", "q1").alias("whisker_low"),
            "q1",
            F.col("med").alias("median"),
            "q3",
            F.greatest("__high", "q3").alias("whisker_high"),
            "n_outliers",
        )
    )


def bar_counts(df: DataFrame, *columns: str) -> DataFrame:
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))
