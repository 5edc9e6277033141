"""Quantiles, tables, summaries, distributions, survival, regression against brute force."""

import math

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from cohortmill.operators import distributions as D
from cohortmill.operators import quantiles as Q
from cohortmill.operators import summaries as U
from cohortmill.operators import survival as K
from cohortmill.operators import tables as T
from cohortmill.operators.models import glm


def averaged(values, p):
    """Quantile that is a value of the data, or the mean of two where the rank falls between."""
    x, np_ = sorted(values), len(values) * p
    j = math.floor(np_)
    if np_ == j:
        return (x[max(j, 1) - 1] + x[min(j + 1, len(x)) - 1]) / 2
    return x[j]


@settings(max_examples=10, deadline=None)
@given(st.lists(st.floats(-1e6, 1e6), min_size=1, max_size=60), st.lists(st.sampled_from([0.0, 0.1, 0.25, 0.5, 0.9, 1.0]), min_size=1, max_size=3, unique=True))
def test_quantiles_match_numpy(spark, values, probs):
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "x double")
    names = [f"q{i}" for i in range(len(probs))]
    linear = Q.exact_quantiles(df, "x", probs, names).first()
    assert np.allclose(list(linear), [np.quantile(values, p) for p in probs], rtol=1e-9, atol=1e-6)
    middle = Q.exact_quantiles(df, "x", probs, names, definition="averaged").first()
    assert np.allclose(list(middle), [averaged(values, p) for p in probs], rtol=1e-9, atol=1e-6)


def test_quantiles_are_exact_however_the_values_are_ranged(spark, monkeypatch):
    """With all values in one range the answer stays."""
    monkeypatch.setattr(Q, "in_ranges", lambda df, order, block: df.withColumn(block, F.lit(0)))
    rng = np.random.default_rng(1)
    data = [(int(g), float(x)) for g, x in zip(rng.integers(0, 3, 3000), rng.lognormal(9, 2, 3000).round(0))]
    got = Q.exact_quantiles(spark.createDataFrame(data, "g int, x double"), "x", [0.25, 0.5], ["a", "b"], ["g"], count_name="n")
    for row in got.collect():
        x = [v for g, v in data if g == row["g"]]
        assert (row["a"], row["b"], row["n"]) == (np.quantile(x, 0.25), np.quantile(x, 0.5), len(x))


def test_group_without_values_has_no_quantile(frame, rows):
    df = frame("g string, x double", ("a", 1.0), ("a", 3.0), ("b", None), (None, 5.0), ("c", float("nan")))
    assert rows(Q.exact_median(df, "x", "m", ["g"])) == [("a", 2.0), (None, 5.0)]


def test_approximate_quantiles_within_rank_error(spark):
    df = spark.range(0, 100_000).select(F.col("id").cast("double").alias("x"))
    row = Q.approximate_quantiles(df, "x", [0.25, 0.5], ["a", "b"]).first()
    assert abs(row["a"] - 25_000) <= 20 and abs(row["b"] - 50_000) <= 20


def test_frequency_shares(frame, rows):
    got = rows(T.frequency(frame("x string", ("a",), ("a",), ("b",), (None,)), "x"))
    assert got == [("a", 2, 0.5, 2 / 3), ("b", 1, 0.25, 1 / 3), (None, 1, 0.25, None)]


def test_two_way_table_names_the_missing_column(frame):
    df = frame("x string, y string", ("a", "p"), ("a", None), (None, "q"))
    got = T.cross_frequency(df, "x", "y")
    assert got.columns == ["x", "p", "q", "NA_"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted([("a", 1, 0, 1), (None, 0, 1, 0)], key=str)


def test_categories_are_bounded(spark):
    with pytest.raises(ValueError, match="more than 10"):
        T.categories(spark.range(11), "id", limit=10)


def test_totals_add_cells_and_not_ids(frame):
    """An id in two cells counts twice in the total."""
    df = frame("g string, c string, id int", ("a", "p", 1), ("a", "q", 1), ("b", "p", 2))
    from cohortmill.operators.aggregates import n_distinct

    table = T.totals(T.count_table(df, ["g"], "c", n_distinct("id")), "both")
    assert {r["g"]: tuple(r)[1:] for r in table.collect()} == {"a": (1, 1, 2), "b": (1, 0, 1), "Total": (2, 1, 3)}


def test_totals_skip_missing_cells_and_text(frame):
    df = frame("g int, note string, p long, q long", (1, "x", 1, None), (2, "y", None, None))
    got = {r["g"]: (r["note"], r["p"], r["q"], r["Total"]) for r in T.totals(df, "both").collect()}
    assert got == {"1": ("x", 1, None, 1), "2": ("y", None, None, 0), "Total": (None, 1, 0, 1)}


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("abc"), st.sampled_from("pq"), st.integers(0, 5)), min_size=1, max_size=30))
def test_column_percentages_sum_to_one(spark, data):
    from cohortmill.operators.aggregates import n_distinct

    df = spark.createDataFrame(data, "g string, c string, id int")
    table = T.column_percentages(T.count_table(df, ["g"], "c", n_distinct("id"), ["p", "q"]), ["p", "q"])
    rows = table.collect()
    for c in "pq":
        shares = [r[f"{c}_pct"] for r in rows if r["g"] != "Total"]
        total = next(r for r in rows if r["g"] == "Total")
        assert total[c] == sum(r[c] for r in rows if r["g"] != "Total")
        if total[c]:
            assert math.isclose(sum(shares), 1) and total[f"{c}_pct"] == 1 and total[f"{c}_text"] == f"{total[c]} (100.00%)"
        else:
            assert set(shares) == {None} and total[f"{c}_text"] is None


def test_sorted_report_puts_missing_last(frame):
    df = frame("k string, n int", ("a", None), ("b", 1), ("c", 3), ("d", 3))
    assert [r["k"] for r in T.sorted_report(df, ["n"], ["k"]).collect()] == ["c", "d", "b", "a"]
    assert T.sorted_report(df, ["n"], ["k"], limit=2).count() == 2


def test_threshold_table_leaves_out_missing(frame, rows):
    assert rows(T.threshold_table(frame("x double", (1.0,), (5.0,), (None,)), "x", 2)) == [(False, 1), (True, 1)]


def test_characteristics_dedup_subjects_within_study(frame):
    df = frame(
        "s string, id string, age double, sex string, o int",
        ("A", "1", 2.0, "F", 1), ("A", "1", 9.0, "M", 2), ("A", "2", 2.5, "M", 1), ("B", "1", 3.0, "M", 1), ("B", "9", None, "M", 1), ("B", "8", 1.0, None, 1),
    )
    counts = {"f": F.col("sex") == "F", "m": F.col("sex") == "M"}
    got = {r["s"]: r.asDict() for r in U.study_characteristics(df, "s", "id", ["o"], {"age": "age"}, counts, ["f"]).collect()}
    assert got["A"] == {"s": "A", "n": 2, "f": "1", "m": 1, "age": 2.2, "num": 2}
    assert got["B"] == {"s": "B", "n": 3, "f": None, "m": None, "age": None, "num": 1}


def test_baseline_summary_quartiles_and_shares(frame):
    df = frame("arm string, x double, g string", *[("a", float(i), "F" if i < 4 else None) for i in range(1, 5)])
    got = {(r["variable"], r["level"]): r for r in U.baseline_summary(df, "arm", ["x"], ["g"]).collect()}
    x = got[("x", None)]
    assert (x["p25"], x["median"], x["p75"], x["text"]) == (1.5, 2.5, 3.5, "2.5 (1.5, 3.5)")
    assert (got[("g", "F")]["n"], got[("g", "F")]["share"], got[("g", "F")]["text"]) == (3, 1.0, "3 (100%)")


def test_histogram_covers_the_data(spark):
    x = np.random.default_rng(3).normal(size=500)
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "x double")
    bins = D.histogram(df, "x", 20).collect()
    assert sum(r["n"] for r in bins) == 500 and {r["bin"] for r in bins} <= set(range(20))
    width = (x.max() - x.min()) / 19
    for r in bins:
        assert r["n"] == ((x > r["lower"] + 1e-12) & (x <= r["upper"] + 1e-12)).sum()
        assert math.isclose(r["upper"] - r["lower"], width)


def test_histogram_of_one_value(frame):
    assert [(r["bin"], r["n"]) for r in D.histogram(frame("x double", (2.0,), (2.0,)), "x", 5).collect()] == [(0, 2), (1, 0), (2, 0), (3, 0), (4, 0)]


def test_log_histogram_drops_what_has_no_logarithm(frame):
    df = frame("x double", (1.0,), (10.0,), (0.0,), (-3.0,), (None,))
    assert sum(r["n"] for r in D.histogram(df, "x", 30, log10=True).collect()) == 2
    assert D.dropped_by_log(df, "x").first()["n_dropped"] == 2


def test_density_curve_is_close_to_the_kernel_sum(spark):
    x = np.random.default_rng(5).gamma(2, 3, 400)
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    curve = D.density_curve(df, "x", 256, scale_to_count=False).collect()
    iqr = np.quantile(x, 0.75) - np.quantile(x, 0.25)
    bw = 0.9 * min(x.std(ddof=1), iqr / 1.34) * len(x) ** -0.2
    for r in curve[::16]:
        direct = np.exp(-0.5 * ((r["x"] - x) / bw) ** 2).sum() / (len(x) * bw * math.sqrt(2 * math.pi))
        assert abs(direct - r["y"]) < 2e-4


def test_box_summary(frame):
    values = [1.0, 2.0, 3.0, 4.0, 5.0, 100.0]
    r = D.box_summary(frame("g string, x double", *[("a", v) for v in values], ("a", None)), "x", ["g"]).first()
    assert (r["n"], r["q1"], r["median"], r["q3"]) == (6, 2.25, 3.5, 4.75)
    assert (r["whisker_low"], r["whisker_high"], r["n_outliers"]) == (1.0, 5.0, 1)


def km_by_hand(data):
    times, s, v, out = sorted({t for t, _ in data}), 1.0, 0.0, []
    for t in times:
        n = sum(1 for u, _ in data if u >= t)
        d = sum(1 for u, e in data if u == t and e)
        s *= 1 - d / n
        v += d / (n * (n - d)) if n > d else 0.0
        out.append((t, n, d, s, v))
    return out


SUBJECTS = [(1, 1), (1, 0), (3, 1), (3, 1), (3, 0), (5, 0), (7, 1), (7, 0), (9, 0), (12, 1)]


def test_kaplan_meier_with_ties_and_a_last_event(frame):
    df = frame("g string, t int, e int", *[("a", t, e) for t, e in SUBJECTS], ("b", None, 1), ("b", 4, None))
    curve = K.kaplan_meier(df, "t", "e", ["g"]).orderBy("time").collect()
    assert [r["g"] for r in curve] == ["a"] * 6
    for r, (t, n, d, s, v) in zip(curve, km_by_hand(SUBJECTS)):
        assert (r["time"], r["n_risk"], r["n_event"]) == (t, n, d)
        assert math.isclose(r["surv"], s, abs_tol=1e-12)
        if s > 0:
            assert math.isclose(r["std_err"], s * math.sqrt(v), abs_tol=1e-12)
            assert math.isclose(r["upper"], min(1.0, math.exp(math.log(s) + K.Z_95 * math.sqrt(v))))
    assert curve[-1]["surv"] == 0 and curve[-1]["lower"] is None and curve[-1]["std_err"] is None


@settings(max_examples=6, deadline=None)
@given(st.lists(st.integers(1, 9), min_size=1, max_size=20))
def test_curve_without_censoring_is_the_surviving_share(spark, times):
    df = spark.createDataFrame([(t, 1) for t in times], "t int, e int")
    for r in K.kaplan_meier(df, "t", "e").collect():
        assert math.isclose(r["surv"], sum(t > r["time"] for t in times) / len(times), abs_tol=1e-9)


@pytest.mark.parametrize("width", [1, 4, 100])
def test_blocks_of_time_change_nothing(spark, width):
    rng = np.random.default_rng(13)
    data = [(str(g), float(t), int(e)) for g, t, e in zip(rng.integers(0, 2, 200), rng.integers(0, 30, 200) / 2, rng.integers(0, 2, 200))]
    df = spark.createDataFrame(data, "g string, t double, e int")
    plain = K.kaplan_meier(df, "t", "e", ["g"]).orderBy("g", "time").collect()
    blocked = K.kaplan_meier(df, "t", "e", ["g"], block_width=width).orderBy("g", "time").collect()
    assert len(plain) == len(blocked)
    for a, b in zip(plain, blocked):
        assert tuple(a)[:5] == tuple(b)[:5]
        for x, y in zip(tuple(a)[5:], tuple(b)[5:]):
            assert (x is None) == (y is None) and (x is None or math.isclose(x, y, abs_tol=1e-12))


def test_risk_table_and_survival_at(frame):
    df = frame("t int, e int", *SUBJECTS)
    got = {r["time"]: (r["n_risk"], r["cum_event"], r["label"]) for r in K.risk_table(df, "t", "e", [0, 3, 100]).collect()}
    assert got == {0.0: (10, 0, "10 (0)"), 3.0: (8, 3, "8 (3)"), 100.0: (0, 5, "0 (5)")}
    curve = K.kaplan_meier(df, "t", "e")
    assert math.isclose(K.survival_at(curve, 4).first()["surv"], 0.9 * 6 / 8)
    assert K.survival_at(curve, 0.5).first()["surv"] == 1.0


def test_survival_input_drops_unknown_events(frame, rows):
    df = frame("id int, t int, o string", (1, 2, "R"), (1, 2, "R"), (1, 3, "x"), (2, None, "R"), (3, 4, None))
    assert rows(K.survival_input(df, ["id"], "t", "o", "R"), "id", "time", "event") == [(1, 2, 1), (1, 3, 0)]


def test_gaussian_model_matches_least_squares(spark):
    rng = np.random.default_rng(7)
    sex, age = rng.choice(["F", "M"], 200), rng.uniform(0, 5, 200)
    y = 1 + 0.5 * (sex == "M") - 0.2 * age + rng.normal(0, 0.1, 200)
    df = spark.createDataFrame([(str(s), float(a), float(v)) for s, a, v in zip(sex, age, y)] + [(None, 1.0, 1.0)], "sex string, age double, y double")
    fit = {r["term"]: r for r in glm(df, "y ~ sex + age").collect()}
    x = np.column_stack([np.ones(200), sex == "M", age])
    beta, residual = np.linalg.lstsq(x, y, rcond=None)[:2]
    error = np.sqrt(residual[0] / 197 * np.diag(np.linalg.inv(x.T @ x)))
    for term, b, e in zip(["(Intercept)", "sex_M", "age"], beta, error):
        assert math.isclose(fit[term]["estimate"], b, rel_tol=1e-6) and math.isclose(fit[term]["std_error"], e, rel_tol=1e-6)


def test_binomial_model_matches_newton(spark):
    rng = np.random.default_rng(9)
    age = rng.uniform(0, 5, 300)
    y = (rng.uniform(size=300) < 1 / (1 + np.exp(1 - 0.6 * age))).astype(float)
    df = spark.createDataFrame([(float(a), float(v)) for a, v in zip(age, y)], "age double, y double")
    fit = {r["term"]: r["estimate"] for r in glm(df, "y ~ age", "binomial").collect()}
    x, b = np.column_stack([np.ones(300), age]), np.zeros(2)
    for _ in range(25):
        p = 1 / (1 + np.exp(-x @ b))
        b += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x, x.T @ (y - p))
    assert np.allclose([fit["(Intercept)"], fit["age"]], b, rtol=1e-5)


def test_share_within_group(frame):
    df = frame("s string, o string, n long", ("a", "x", 1), ("a", "y", 3), ("b", "x", 2))
    got = {(r["s"], r["o"]): (r["total_n"], r["prop"], r["group_rank"]) for r in U.share_within(df, ["s"]).collect()}
    assert got == {("a", "x"): (4, 0.25, 2), ("a", "y"): (4, 0.75, 2), ("b", "x"): (2, 1.0, 1)}


def test_missing_by_subject_counts_bad_numbers(frame, rows):
    df = frame("id int, x string", (1, "5"), (1, "NA"), (2, None), (3, "7"))
    assert rows(U.missing_by_subject(df, ["id"], "x", numeric=True)) == [(1, 1), (2, 1), (3, 0)]
    assert rows(U.missing_by_subject(df, ["id"], "x")) == [(1, 0), (2, 1), (3, 0)]


def test_pivot_meets_an_unlisted_category(frame, rows):
    cells = frame("id string, kind string, n int", ("a", "x", 1), ("a", "y", 2), ("b", None, 4))
    with pytest.raises(Exception, match="kind has a category without a column"):
        T.pivot_wider(cells, ["id"], "kind", "n", ["x"]).collect()
    assert rows(T.pivot_wider(cells, ["id"], "kind", "n", ["x"], fill=0, other="rest")) == [("a", 1, 2), ("b", 0, 4)]
    assert rows(T.pivot_wider(cells, ["id"], "kind", "n", ["x", "y", None])) == [("a", 1, 2, None), ("b", None, None, 4)]


def test_every_layer_and_group_lists_every_level(frame, rows):
    df = frame("arm string, row string, kind string", ("a", "r", "k"), ("a", "s", "k"), ("b", "r", "k"), ("b", None, "k"))
    table = T.layered_frequency(df, "row", "kind", "arm")
    assert rows(table) == [("a", "r", 1), ("a", "s", 1), ("a", None, 0), ("b", "r", 1), ("b", "s", 0), ("b", None, 1)]
