"""Descriptive summaries: study characteristics, baseline tables, shares, missingness."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from cohortmill.functions.missing import as_number, blank_when_zero, present_number, round_half_even
from cohortmill.operators.aggregates import n_missing, n_rows, strict_count_true
from cohortmill.operators.dedup import first_per_key
from cohortmill.operators.joins import left_join
from cohortmill.operators.quantiles import exact_median, quantiles_of_counts
from cohortmill.operators.ranges import in_ranges, number_rows
from cohortmill.operators.tables import with_empty_rows
from cohortmill.sources.files import stage


def study_characteristics(
    df: DataFrame,
    study: str,
    subject: str,
    order: Sequence[Column | str],
    median_of: Mapping[str, str],
    counts: Mapping[str, Column],
    blank_zero: Sequence[str] = (),
) -> DataFrame:
    """One row per study: subjects, rounded medians, conditional counts, running number.

    Subjects are reduced to their first row within the study, and these rows are written
    once. A median or count over a missing value is missing. ``num`` numbers the studies by
    size.
    """
    firsts = first_per_key(df, [study, subject], order)
    tests = {f"__is_{name}": condition for name, condition in counts.items()}
    people = stage(firsts.select(study, *set(median_of.values()), *[c.alias(n) for n, c in tests.items()]))
    table = people.groupBy(study).agg(
        n_rows().alias("n"),
        *[strict_count_true(F.col(f"__is_{name}")).alias(name) for name in counts],
        *[n_missing(source).alias(f"__missing_{name}") for name, source in median_of.items()],
    )
    medians = medians_of(people, dict(median_of), [study])
    table = left_join(table, medians.withColumnsRenamed({n: f"__median_{n}" for n in median_of}), [study])
    for name in median_of:
        complete = F.when(F.col(f"__missing_{name}") == 0, F.col(f"__median_{name}"))
        table = table.withColumn(name, round_half_even(complete, 1)).drop(f"__median_{name}", f"__missing_{name}")
    for name in blank_zero:
        table = table.withColumn(name, blank_when_zero(name))
    by_size = [F.col("n").desc_nulls_last(), F.col(study).asc_nulls_last()]
    return number_rows(table, by_size, "num").withColumn("num", F.col("num").cast("int"))


def medians_of(df: DataFrame, measures: Mapping[str, str], by: Sequence[str]) -> DataFrame:
    """One row per group with the exact median of every measure, all found in one read."""
    long = df.select(*by, F.explode(_measures({n: F.col(c) for n, c in measures.items()})).alias("v"))
    found = exact_median(long.select(*by, "v.variable", "v.x"), "x", "__median", [*by, "variable"])
    return found.groupBy(*by).agg(*[F.max(F.when(F.col("variable") == n, F.col("__median"))).alias(n) for n in measures])


def _measures(columns: Mapping[str, Column]) -> Column:
    return F.array(*[F.struct(F.lit(n).alias("variable"), c.cast("double").alias("x")) for n, c in columns.items()])


def _percent_text(share: Column) -> Column:
    """Whole percents from 10 up, one decimal below, ``<0.1%`` for less, ``0%`` for none."""
    percent = share * 100
    return (
        F.when(percent >= 10, F.format_string("%.0f%%", round_half_even(percent, 0)))
        .when(percent >= 0.1, F.format_string("%.1f%%", round_half_even(percent, 1)))
        .when(percent > 0, F.lit("<0.1%"))
        .otherwise(F.lit("0%"))
    )


def baseline_summary(
    df: DataFrame, by: str, continuous: Sequence[str], categorical: Sequence[str]
) -> DataFrame:
    """Long table per group: median and quartiles of numbers, n and share of categories.

    Missing values are left out of both. Every group lists every level that any group has, with
    ``0 (0%)`` where it has none. Quartiles are values of the data or the mean of
    two neighbours, never interpolated further. Rows are counted once per group, variable and value, for
    categories and numbers together, and all else works on these counts.
    """
    entries = [F.struct(F.lit(c).alias("variable"), F.col(c).cast("string").alias("level"), F.lit(None).cast("double").alias("__x")) for c in categorical]
    entries += [F.struct(F.lit(c).alias("variable"), F.lit(None).cast("string").alias("level"), present_number(c).alias("__x")) for c in continuous]
    present = F.filter(F.array(*entries), lambda p: p["level"].isNotNull() | p["__x"].isNotNull())
    rows = df.select(by, F.explode(present).alias("p")).select(by, "p.*")
    values = rows.groupBy(by, "variable", "level", "__x").agg(F.count(F.lit(1)).alias("__k"))
    values = in_ranges(values, [by, "variable", "level", "__x"], "__block")
    counted = values.filter("level IS NOT NULL").select(by, "variable", "level", F.col("__k").alias("n"))
    # Counted categories only: one row per (group, variable, level).
    counted = with_empty_rows(counted, [by], ["variable", "level"])
    share = F.try_divide(F.col("n"), F.sum("n").over(Window.partitionBy(by, "variable")))
    parts = [
        counted.withColumn("share", share).select(
            "variable",
            "level",
            by,
            "n",
            "share",
            F.lit(None).cast("double").alias("median"),
            F.lit(None).cast("double").alias("p25"),
            F.lit(None).cast("double").alias("p75"),
            F.concat(F.col("n").cast("string"), F.lit(" ("), _percent_text(F.col("share")), F.lit(")")).alias("text"),
        )
    ]
    if continuous:
        numbers = values.filter("__x IS NOT NULL").drop("level")
        q = quantiles_of_counts(numbers, [0.25, 0.5, 0.75], ["p25", "median", "p75"], [by, "variable"], "averaged", "n")
        parts.append(
            q.select(
                "variable",
                F.lit(None).cast("string").alias("level"),
                by,
                "n",
                F.lit(None).cast("double").alias("share"),
                "median",
                "p25",
                "p75",
                F.format_string("%.1f (%.1f, %.1f)", *[round_half_even(x, 1) for x in ("median", "p25", "p75")]).alias(
                    "text"
                ),
            )
        )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def share_within(counts: DataFrame, group: Sequence[str], n: str = "n") -> DataFrame:
    """Add the group total, each row's share of it, and a rank of groups by total.

    For counted categories, where a group is a handful of rows.
    """
    total = F.sum(n).over(Window.partitionBy(*group))
    out = counts.withColumn("total_n", total).withColumn("prop", F.try_divide(F.col(n), F.col("total_n")))
    ranks = number_rows(out.select(*group, "total_n").distinct(), ["total_n", *group], "group_rank")
    return left_join(out, ranks.drop("total_n").withColumn("group_rank", F.col("group_rank").cast("int")), list(group))


def missing_by_subject(df: DataFrame, subject: Sequence[str], column: str, numeric: bool = False) -> DataFrame:
    """Missing values per subject; with ``numeric``, text that is no number is missing too."""
    value = as_number(column) if numeric else F.col(column)
    return df.groupBy(*subject).agg(n_missing(value).alias("n_missing"))


def subjects_where(df: DataFrame, subject: Sequence[str], condition: Column, name: str = "n") -> DataFrame:
    """Number of subjects with at least one row that meets the condition."""
    return df.filter(condition).select(*subject).distinct().agg(F.count(F.lit(1)).alias(name))
