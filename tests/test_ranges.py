"""Values over a whole order that no task sees whole: numbering, curves, quantiles, the log-rank test."""

import itertools
import math

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from cohortmill.operators import distributions as D
from cohortmill.operators import survival as K
from cohortmill.operators import summaries as U
from cohortmill.operators.quantiles import exact_median, exact_quantiles, ranged_counts
from cohortmill.operators.ranges import in_ranges, number_rows, product, running, total


@pytest.fixture
def many_ranges(spark):
    """Small tables in several ranges, too."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    yield
    spark.conf.unset(name)


def test_numbers_follow_the_order(spark, many_ranges):
    rng = np.random.default_rng(4)
    data = [(int(k), float(v)) for k, v in enumerate(rng.integers(0, 40, 3000))]
    df = spark.createDataFrame([*data, (9999, None)], "id int, x double")
    got = number_rows(df, [F.col("x").desc_nulls_last(), "id"], "place").collect()
    want = [i for i, _ in sorted(data, key=lambda r: (-r[1], r[0]))] + [9999]
    assert [r["id"] for r in sorted(got, key=lambda r: r["place"])] == want
    assert sorted(r["place"] for r in got) == list(range(1, 3002))
    assert list(got[0].asDict()) == ["id", "x", "place"]


def test_numbers_of_equal_rows_and_of_none(spark):
    df = spark.createDataFrame([("a", 1)] * 5 + [("b", 1)], "__block string, x int")
    got = number_rows(df, ["x", "__block"], "n")
    assert got.columns == ["__block", "x", "n"]
    assert sorted((r["n"], r["__block"]) for r in got.collect()) == [(1, "a"), (2, "a"), (3, "a"), (4, "a"), (5, "a"), (6, "b")]
    assert number_rows(df.limit(0), ["x"]).collect() == []


@pytest.mark.parametrize("backwards", [False, True])
def test_running_values_over_ranges(spark, many_ranges, backwards):
    rng = np.random.default_rng(8)
    data = [(f"g{g}" if g else None, int(t), float(v)) for g, t, v in zip(rng.integers(0, 3, 900), rng.permutation(900), rng.uniform(0.5, 1.5, 900), strict=True)]
    df = in_ranges(spark.createDataFrame(data, "g string, t int, v double"), ["g", "t"], "b")
    assert df.select("b").distinct().count() > 3
    values = {"s": total("s", F.col("v")), "p": product("p", F.col("v"))}
    for r in running(df, ["g"], ["t"], "b", values, backwards).collect():
        own = [v for g, t, v in data if g == r["g"] and (t >= r["t"] if backwards else t <= r["t"])]
        assert math.isclose(r["s"], sum(own), rel_tol=1e-9) and math.isclose(r["p"], math.prod(own), rel_tol=1e-6)


def test_curve_of_fine_times_in_several_ranges(spark, many_ranges):
    rng = np.random.default_rng(13)
    data = [(str(g), float(t), int(e)) for g, t, e in zip(rng.integers(0, 2, 4000), rng.exponential(9, 4000), rng.integers(0, 2, 4000), strict=True)]
    df = spark.createDataFrame(data, "g string, t double, e int")
    assert in_ranges(K.event_counts(df, "t", "e", ["g"]), ["g", "time"], "b").groupBy("b").count().agg(F.max("count")).first()[0] < 2000
    ranged = K.kaplan_meier(df, "t", "e", ["g"]).orderBy("g", "time").collect()
    for g in ("0", "1"):
        own = sorted((t, e) for h, t, e in data if h == g)
        surv, v = 1.0, 0.0
        for k, r in enumerate(x for x in ranged if x["g"] == g):
            n, d = len(own) - k, own[k][1]  # all times differ
            surv *= 1 - d / n
            v += d / (n * (n - d)) if n > d else 0
            assert (r["time"], r["n_risk"], r["n_event"]) == (own[k][0], n, d)
            assert math.isclose(r["surv"], surv, rel_tol=1e-9, abs_tol=1e-15)
            if surv > 0:
                assert math.isclose(r["std_err"], surv * math.sqrt(v), rel_tol=1e-9)


def test_a_time_that_is_no_number_is_left_out(frame, rows):
    df = frame("id int, t double, o string", (1, 1.0, "R"), (2, float("nan"), "R"), (3, 2.0, "x"), (4, None, "R"))
    assert rows(K.survival_input(df, ["id"], "t", "o", "R"), "id") == [(1,), (3,)]
    curve = K.kaplan_meier(df, "t", F.col("o") == "R").orderBy("time").collect()
    assert [(r["time"], r["n_risk"], r["surv"]) for r in curve] == [(1.0, 2, 0.5), (2.0, 1, 0.5)]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_windows_of_a_curve_stand_within_ranges(spark):
    df = spark.createDataFrame([("a", 1.0, 1), ("b", 2.0, 0)], "g string, t double, e int")
    for line in plan(K.kaplan_meier(df, "t", "e", ["g"])).splitlines():
        if "Window [" in line:
            # over rows: range and group; over the totals of ranges: the group, and no column of the rows
            assert "__block" in line.split("], [")[1] or "__before" in line


def test_a_million_distinct_values_in_one_group(spark, many_ranges):
    n = 1_000_000
    df = spark.range(n).select(F.lit("g").alias("g"), ((F.col("id") * 7919) % n).cast("double").alias("x"))
    counts = ranged_counts(df, "x", ["g"])
    sizes = [r["count"] for r in counts.groupBy("__block").count().collect()]
    assert sum(sizes) == n and max(sizes) < n / 4
    r = exact_quantiles(df, "x", [0, 0.25, 0.5, 0.9, 1], ["a", "b", "c", "d", "e"], ["g"], count_name="n").first()
    assert (r["a"], r["b"], r["c"], r["e"], r["n"]) == (0, 249999.75, 499999.5, n - 1, n)
    assert math.isclose(r["d"], 0.9 * (n - 1))


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["p", "q", None]), st.one_of(st.none(), st.floats(allow_nan=True, width=16))), min_size=1, max_size=30))
def test_medians_of_any_groups(spark, data):
    got = {r["g"]: r["m"] for r in exact_median(spark.createDataFrame(data, "g string, x double"), "x", "m", ["g"]).collect()}
    groups = {g: [x for h, x in data if h == g and x is not None and not math.isnan(x)] for g, _ in data}
    want = {}
    for g, x in groups.items():
        x.sort()
        if x:
            low, high = x[(len(x) - 1) // 2], x[len(x) // 2]
            want[g] = low + (high - low) * (0.5 if len(x) % 2 == 0 else 0.0)
    assert got.keys() == want.keys()
    for g, m in want.items():
        assert got[g] == m or math.isclose(got[g], m, rel_tol=1e-6) or (math.isnan(got[g]) and not math.isfinite(m))


def test_summaries_read_their_input_once(spark, tmp_path):
    path = str(tmp_path / "x.parquet")
    spark.range(5000).select((F.col("id") % 3).cast("string").alias("g"), F.sqrt("id").alias("x"), (F.col("id") % 4).cast("string").alias("c"), F.col("id").alias("k")).write.parquet(path)
    source = spark.read.parquet(path)
    for run in (
        lambda: exact_median(source, "x", "m", ["g"]),
        lambda: D.box_summary(source, "x", ["g"]),
        lambda: D.density_curve(source, "x", 16),
        lambda: U.baseline_summary(source, "g", ["x", "k"], ["c"]),
        lambda: U.medians_of(source, {"a": "x", "b": "k"}, ["g"]),
    ):
        # what is left to run reads the staged counts alone
        assert path not in plan(run())


def log_rank_by_hand(data):
    """(chi-square, degrees) of (group, time, event)."""
    groups = sorted({g for g, _, _ in data})
    gap, cov = np.zeros(len(groups)), np.zeros((len(groups), len(groups)))
    for t in sorted({t for _, t, e in data if e}):
        n = np.array([sum(1 for g, u, _ in data if g == h and u >= t) for h in groups], float)
        d = np.array([sum(1 for g, u, e in data if g == h and u == t and e) for h in groups], float)
        gap += d - d.sum() * n / n.sum()
        if n.sum() > 1:
            cov += d.sum() * (n.sum() - d.sum()) / (n.sum() - 1) * (np.diag(n / n.sum()) - np.outer(n, n) / n.sum() ** 2)
    return gap[:-1] @ np.linalg.solve(cov[:-1, :-1], gap[:-1]), len(groups) - 1


@pytest.mark.parametrize("groups", [2, 3, 5])
def test_log_rank_matches_the_sums_by_hand(spark, many_ranges, groups):
    rng = np.random.default_rng(groups)
    data = [(f"g{g}", float(t), int(e)) for g, t, e in zip(rng.integers(0, groups, 250), rng.integers(1, 30, 250), rng.integers(0, 2, 250), strict=True)]
    data = [(g, t + 4 * (g == "g1"), e) for g, t, e in data]
    df = spark.createDataFrame([*data, (None, 3.0, 1), ("g0", None, 1), ("g0", float("nan"), 1)], "g string, t double, e int")
    chi, degrees = log_rank_by_hand(data)
    r = K.log_rank(df, "t", "e", "g").first()
    assert math.isclose(r["chi_square"], chi, rel_tol=1e-9) and r["degrees"] == degrees
    # the tail by adding up the density
    x = np.linspace(chi, chi + 200, 2_000_001)
    y = x ** (degrees / 2 - 1) * np.exp(-x / 2) / (2 ** (degrees / 2) * math.gamma(degrees / 2))
    assert math.isclose(r["p_value"], np.trapezoid(y, x), rel_tol=1e-4)


def test_log_rank_within_strata(spark):
    rng = np.random.default_rng(3)
    data = [(f"s{s}", f"g{g}", float(t + 9 * s), int(e)) for s, g, t, e in zip(rng.integers(0, 2, 200), rng.integers(0, 2, 200), rng.integers(1, 20, 200), rng.integers(0, 2, 200), strict=True)]
    gap = var = 0.0
    for s in ("s0", "s1"):
        own = [(g, t, e) for z, g, t, e in data if z == s]
        for t in sorted({t for _, t, e in own if e}):
            n = [sum(1 for g, u, _ in own if g == h and u >= t) for h in ("g0", "g1")]
            d = [sum(1 for g, u, e in own if g == h and u == t and e) for h in ("g0", "g1")]
            gap += d[0] - sum(d) * n[0] / sum(n)
            var += sum(d) * (sum(n) - sum(d)) / (sum(n) - 1) * n[0] * n[1] / sum(n) ** 2 if sum(n) > 1 else 0
    r = K.log_rank(spark.createDataFrame(data, "s string, g string, t double, e int"), "t", "e", "g", ["s"]).first()
    assert math.isclose(r["chi_square"], gap**2 / var, rel_tol=1e-9)


def test_log_rank_without_a_comparison(frame):
    one = frame("g string, t int, e int", ("a", 1, 1), ("a", 2, 0))
    assert tuple(K.log_rank(one, "t", "e", "g").first()) == (None, 0, None)
    assert tuple(K.log_rank(one.limit(0), "t", "e", "g").first()) == (None, 0, None)
    same = frame("g string, t int, e int", *[(g, t, 1) for g, t in itertools.product("ab", range(1, 9))])
    r = K.log_rank(same, "t", "e", "g").first()
    assert abs(r["chi_square"]) < 1e-12 and math.isclose(r["p_value"], 1.0, abs_tol=1e-6)


def test_histograms_leave_out_what_is_not_finite(frame):
    df = frame("x double", (1.0,), (2.0,), (3.0,), (float("nan"),), (float("inf"),), (float("-inf"),), (None,))
    assert [r["n"] for r in D.histogram(df, "x", 3).orderBy("bin").collect()] == [1, 1, 1]
    assert [r["n"] for r in D.histogram(df, "x", 3, log10=True).orderBy("bin").collect()] == [1, 1, 1]
    assert D.dropped_by_log(df, "x").first()["n_dropped"] == 2


@pytest.mark.parametrize("values", [[5.0] * 9, [5.0], [0.0], [-3.0, -3.0], [float("nan"), 5.0, float("inf"), 5.0]])
def test_a_curve_of_values_without_spread(frame, values):
    curve = D.density_curve(frame("x double", *[(v,) for v in values]), "x", 65, scale_to_count=False).orderBy("grid").collect()
    assert len(curve) == 65 and all(math.isfinite(r["y"]) and r["y"] > 0 for r in curve)
    area = sum((a["y"] + b["y"]) / 2 * (b["x"] - a["x"]) for a, b in itertools.pairwise(curve))
    assert math.isclose(area, 1, abs_tol=0.02)
    finite = [v for v in values if math.isfinite(v)]
    assert math.isclose(curve[32]["x"], finite[0], abs_tol=1e-9) and curve[32]["y"] == max(r["y"] for r in curve)


def test_no_curve_of_no_values(frame):
    assert D.density_curve(frame("x double", (None,), (float("nan"),)), "x", 8).collect() == []
