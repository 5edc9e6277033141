"""Kaplan-Meier estimates.

Subjects are first counted per (stratum, time). The counts are dealt into ranges of time, and
running values are taken within ranges and over the totals of ranges, never over a whole
stratum: first those at risk, from the last time backwards, then the curve.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from cohortmill.functions.missing import ColumnLike, as_column, if_else, present_number
from cohortmill.operators.ranges import in_ranges, product, running, total
from cohortmill.operators.tables import categories
from cohortmill.sources.files import stage

# Fixed value: the 97.5 % point of the standard normal distribution.
Z_95 = 1.959963984540054


def survival_input(
    df: DataFrame, subject: Sequence[str], time: str, outcome: ColumnLike, event: str, strata: Sequence[str] = ()
) -> DataFrame:
    """Distinct (subject, time, event, strata) with the event known and the time present.

    A NaN time is missing.
    """
    return (
        df.withColumn("event", if_else(as_column(outcome) == event, 1, 0))
        .select(*subject, F.col(time).alias("time"), "event", *strata)
        .distinct()
        .filter(F.col("event").isNotNull() & present_number("time").isNotNull())
    )


def event_counts(df: DataFrame, time: ColumnLike, event: ColumnLike, by: Sequence[str] = ()) -> DataFrame:
    """Events and censorings per stratum and time; a NaN time is missing and left out."""
    happened = as_column(event).cast("int")
    return (
        df.select(*by, present_number(time).alias("time"), happened.alias("__e"))
        .filter("time IS NOT NULL AND __e IS NOT NULL")
        .groupBy(*by, "time")
        .agg(F.sum("__e").alias("n_event"), F.sum(1 - F.col("__e")).alias("n_censor"))
    )


def kaplan_meier(
    df: DataFrame,
    time: ColumnLike,
    event: ColumnLike,
    by: Sequence[str] = (),
    z: float = Z_95,
    block_width: float | None = None,
) -> DataFrame:
    """Survival curve with its log-transformed confidence interval, per stratum.

    Once the curve reaches zero, standard error and interval are missing. The counted times are dealt into ranges by
    stratum and time, or into stretches of ``block_width`` where that is given, which saves the sampling of bounds.
    """
    counts = event_counts(df, time, event, by)
    if block_width is None:
        counts = in_ranges(counts, [*by, "time"], "__block")
    else:
        counts = counts.withColumn("__block", F.floor(F.col("time") / float(block_width)))
    everyone = F.col("n_event") + F.col("n_censor")
    risk = running(counts, by, ["time"], "__block", {"n_risk": total("n_risk", everyone)}, backwards=True)
    d, n = F.col("n_event").cast("double"), F.col("n_risk").cast("double")
    steps = {"surv": product("surv", 1 - d / n), "__v": total("__v", F.try_divide(d, n * (n - d)))}
    curve = running(risk, by, ["time"], "__block", steps)
    alive = F.col("surv") > 0
    spread = F.sqrt("__v")
    return curve.select(
        *by,
        "time",
        "n_risk",
        "n_event",
        "n_censor",
        "surv",
        F.when(alive, F.col("surv") * spread).alias("std_err"),
        F.when(alive, F.exp(F.log("surv") - z * spread)).alias("lower"),
        F.when(alive, F.least(F.lit(1.0), F.exp(F.log("surv") + z * spread))).alias("upper"),
    )


def risk_table(
    df: DataFrame, time: ColumnLike, event: ColumnLike, times: Sequence[float], by: Sequence[str] = ()
) -> DataFrame:
    """At each chosen time: subjects still at risk and events so far."""
    counts = event_counts(df, time, event, by)
    entries: list[Column] = []
    aggregates: list[Column] = []
    for i, t in enumerate(times):
        at_risk = F.when(F.col("time") >= t, F.col("n_event") + F.col("n_censor")).otherwise(0)
        so_far = F.when(F.col("time") <= t, F.col("n_event")).otherwise(0)
        aggregates += [F.sum(at_risk).alias(f"r{i}"), F.sum(so_far).alias(f"e{i}")]
        entries.append(
            F.struct(
                F.lit(float(t)).alias("time"), F.col(f"r{i}").alias("n_risk"), F.col(f"e{i}").alias("cum_event")
            )
        )
    wide = counts.groupBy(*by).agg(*aggregates)
    return wide.select(*by, F.explode(F.array(*entries)).alias("t")).select(
        *by,
        "t.*",
        F.format_string("%d (%d)", "t.n_risk", "t.cum_event").alias("label"),
    )


def survival_at(curve: DataFrame, time: float, by: Sequence[str] = ()) -> DataFrame:
    """Survival at one time: the last step at or before it, 1 before the first step."""
    reached = F.when(F.col("time") <= time, F.col("time"))
    return curve.groupBy(*by).agg(
        F.lit(float(time)).alias("time"), F.coalesce(F.max_by("surv", reached), F.lit(1.0)).alias("surv")
    )


def log_rank(df: DataFrame, time: ColumnLike, event: ColumnLike, group: str, strata: Sequence[str] = (), limit: int = 40) -> DataFrame:
    """Whether the curves of the groups differ: (chi_square, degrees, p_value) in one row.

    At each time the events are shared out over the groups by those at risk; observed less expected events and their covariance
    are summed over all times, within strata where these are given. Subjects are counted per time first, those at risk are running
    totals over ranges of time, and only the sums, of the size of the groups, reach the driver. A missing group, time or event is left
    out. Groups without expected events do not count; with fewer than two others there is no test, and chi_square is missing.
    """
    strata = list(strata)
    counts = event_counts(df.filter(F.col(group).isNotNull()), time, event, [*strata, group])
    counts = stage(counts)
    levels = categories(counts, group, limit)
    if not levels:
        return _tested(df, np.zeros(0), np.zeros(0), np.zeros((0, 0)))
    own = [F.col(group) == F.lit(v) for v in levels]
    wide = counts.groupBy(*strata, "time").agg(
        F.sum("n_event").alias("__d"),
        *[F.sum(F.when(g, F.col("n_event")).otherwise(0)).alias(f"__d{i}") for i, g in enumerate(own)],
        *[F.sum(F.when(g, F.col("n_event") + F.col("n_censor")).otherwise(0)).alias(f"__m{i}") for i, g in enumerate(own)],
    )
    ranged = in_ranges(wide, [*strata, "time"], "__block")
    at_risk = {f"__n{i}": total(f"__n{i}", F.col(f"__m{i}")) for i in range(len(levels))}
    risk = running(ranged, strata, ["time"], "__block", at_risk, backwards=True)
    here = [F.col(f"__n{i}").cast("double") for i in range(len(levels))]
    risk = risk.withColumn("__n", sum(here[1:], here[0]))
    d, n = F.col("__d").cast("double"), F.col("__n")
    weight = F.when(n > 1, d * (n - d) / (n - 1)).otherwise(0.0)
    pairs = [(i, j) for i in range(len(levels)) for j in range(i, len(levels))]
    sums = risk.agg(
        *[F.sum(f"__d{i}").alias(f"o{i}") for i in range(len(levels))],
        *[F.sum(d * here[i] / n).alias(f"e{i}") for i in range(len(levels))],
        *[F.sum(weight * here[i] / n * (float(i == j) - here[j] / n)).alias(f"v{i}_{j}") for i, j in pairs],
    ).first()
    covariance = np.zeros((len(levels), len(levels)))
    for i, j in pairs:
        covariance[i, j] = covariance[j, i] = sums[f"v{i}_{j}"]
    observed, expected = (np.array([float(sums[f"{x}{i}"]) for i in range(len(levels))]) for x in "oe")
    return _tested(df, observed, expected, covariance)


def _tested(df: DataFrame, observed: np.ndarray, expected: np.ndarray, covariance: np.ndarray) -> DataFrame:
    kept = np.flatnonzero(expected > 0)
    row = (None, max(0, len(kept) - 1), None)
    if len(kept) > 1:
        some = kept[:-1]  # the last follows from the others
        gap = (observed - expected)[some]
        statistic = float(gap @ np.linalg.pinv(covariance[np.ix_(some, some)]) @ gap)
        row = (statistic, len(some), chi_square_beyond(statistic, len(some)))
    return df.sparkSession.createDataFrame([row], "chi_square double, degrees int, p_value double")


def chi_square_beyond(x: float, degrees: int) -> float:
    """The chance that a chi-square variable is greater than ``x``, as a finite sum."""
    y = max(0.0, x / 2)
    if degrees % 2:
        term, out = math.sqrt(y) * math.exp(-y) / math.gamma(1.5), math.erfc(math.sqrt(y))
    else:
        term, out = math.exp(-y), 0.0
    for k in range(degrees // 2):
        out += term
        term *= y / (k + 1.5 if degrees % 2 else k + 1)
    return out
