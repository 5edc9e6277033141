"""Null-safe joins, suffixes, merges, hot keys, first rows."""

import itertools

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from cohortmill.operators import joins as J
from cohortmill.operators.dedup import first_per_key


def full_outer(frames, n_keys):
    """Successive full joins by brute force; a missing key equals a missing key."""
    out = [(r[:n_keys], r[n_keys:]) for r in frames[0]]
    width = len(frames[0][0]) - n_keys
    for f in frames[1:]:
        extra = len(f[0]) - n_keys
        merged, used = [], set()
        for key, payload in out:
            found = [i for i, r in enumerate(f) if r[:n_keys] == key]
            used.update(found)
            merged += [(key, payload + f[i][n_keys:]) for i in found] or [(key, payload + (None,) * extra)]
        merged += [(r[:n_keys], (None,) * width + r[n_keys:]) for i, r in enumerate(f) if i not in used]
        out, width = merged, width + extra
    return [k + p for k, p in out]


def ordered(values):
    return sorted(values, key=lambda r: tuple((v is None, str(v)) for v in r))


A = [("x", 1, "a1"), ("x", 1, "a2"), ("y", None, "a3"), (None, None, "a4"), ("only", 1, "a5")]
B = [("x", 1, "b1"), ("y", None, "b2"), ("y", None, "b3"), (None, None, "b4"), ("late", 2, "b5")]
C = [("x", 1, "c1"), ("late", 2, "c2"), ("new", 3, "c3"), ("new", 3, "c4")]
KEYS = ["k", "t"]


@pytest.fixture
def abc(frame):
    return [frame(f"k string, t int, {n} string", *rows) for n, rows in (("a", A), ("b", B), ("c", C))]


def test_missing_keys_match(abc, rows):
    left, right, _ = abc
    got = rows(J.left_join(left, right, KEYS))
    want = [l + (r[2],) for l in A for r in B if r[:2] == l[:2]] + [l + (None,) for l in A if l[:2] not in [r[:2] for r in B]]
    assert got == ordered(want)
    plain = J.left_join(left, right, KEYS, na_match=False).filter("b IS NOT NULL")
    assert rows(plain, "a", "b") == [("a1", "b1"), ("a2", "b1")]


@pytest.mark.parametrize("hot_rows", [None, 1_000_000, 1, 2])
def test_full_merge_equals_successive_full_joins(abc, rows, hot_rows):
    got = rows(J.full_merge(abc, KEYS, hot_rows=hot_rows))
    assert got == ordered(full_outer([A, B, C], 2))


@settings(max_examples=8, deadline=None)
@given(st.lists(st.lists(st.tuples(st.sampled_from(["p", "q", None]), st.integers(0, 1)), min_size=1, max_size=7), min_size=2, max_size=3))
def test_hot_keys_change_nothing(spark, tables):
    data = [[(k, t, f"{i}.{j}") for j, (k, t) in enumerate(rows)] for i, rows in enumerate(tables)]
    frames = [spark.createDataFrame(d, f"k string, t int, v{i} string") for i, d in enumerate(data)]
    got = [tuple(r) for r in J.full_merge(frames, KEYS, hot_rows=2).collect()]
    assert ordered(got) == ordered(full_outer(data, 2))


def test_hot_left_join_changes_nothing(spark, rows):
    left = spark.createDataFrame([("hot" if i % 3 else f"k{i}", i) for i in range(60)] + [(None, 1), (None, 2)], "k string, v int")
    right = spark.createDataFrame([("hot", "h1"), ("hot", "h2"), ("k3", "c"), (None, "n")], "key string, w string")
    pair = [("k", "key")]
    assert rows(J.left_join(left, right, pair, hot_rows=5)) == rows(J.left_join(left, right, pair))


def test_hot_rows_reach_several_tasks(spark):
    frame = spark.createDataFrame([("hot", i) for i in range(400)], "k string, v int")
    hot = J._hot_keys([frame], ["k"], 100)
    assert hot.first()["__parts"] == 4
    assert J._dealt(frame, 0, hot, ["k"]).groupBy("__part").count().count() == 4


def test_suffixes_repeat_until_unique(frame):
    one = frame("k int, id int, other int", (1, 10, 5))
    step = J.full_join(one, frame("k int, id int", (1, 20)), ["k"])
    assert step.columns == ["k", "id_x", "other", "id_y"]
    step = J.full_join(step, frame("k int, id int", (1, 30)), ["k"])
    assert step.columns == ["k", "id_x", "other", "id_y", "id"]
    step = J.left_join(step, frame("k int, id int", (1, 40)), ["k"])
    assert step.columns == ["k", "id_x", "other", "id_y", "id_x_x", "id_y_y"]
    assert tuple(step.first()) == (1, 10, 5, 20, 30, 40)


def test_right_payload_named_like_a_left_key(frame):
    out = J.left_join(frame("day int, v int", (1, 2)), frame("lastday int, day string", (1, "x")), [("day", "lastday")])
    assert out.columns == ["day", "v", "day_y"]


def test_expected_uniqueness_is_checked(frame, rows):
    left, right = frame("k int", (1,), (1,)), frame("k int, v int", (1, 1), (1, 2))
    with pytest.raises(Exception, match="right side repeats"):
        J.left_join(left, right, ["k"], expect="m:1").collect()
    with pytest.raises(Exception, match="left side repeats"):
        J.left_join(left, right.limit(1), ["k"], expect="1:1").collect()
    once = frame("k int, v int", (1, 5), (None, 6), (3, None))
    got = J.left_join(frame("k int", (1,), (1,), (None,), (2,)), once, ["k"], expect="m:1")
    assert rows(got) == rows(J.left_join(frame("k int", (1,), (1,), (None,), (2,)), once, ["k"]))
    assert rows(J.inner_join(once, once.withColumnRenamed("v", "w"), ["k"], expect="1:1")) == [(1, 5, 5), (3, None, None), (None, 6, 6)]


def test_checking_a_promise_runs_no_job(spark, frame):
    left, right = frame("k int", (1,)), frame("k int, v int", (1, 1), (1, 2))
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("promise", "build the plan")
    J.left_join(left, right, ["k"], expect="1:1")
    assert list(tracker.getJobIdsForGroup("promise")) == []
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_full_joins_can_be_split_and_count_no_keys(spark):
    """A key that holds most rows of both sides reaches many tasks, in the inner join that holds all its combinations."""
    settings = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "20"}
    old = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        n = 40_000
        a = spark.range(n).select(F.when(F.col("id") % 10 < 8, -1).otherwise(F.col("id")).alias("k"), F.xxhash64("id").alias("a"))
        b = spark.range(n).select(F.when(F.col("id") % 10_000 == 0, -1).otherwise(F.col("id")).alias("k"), F.xxhash64("id").alias("b"))
        full = J.full_join(a, b, ["k"])
        assert "FullOuter" not in plan(full)
        tasks = full.groupBy(F.spark_partition_id().alias("task")).agg(F.count_if((F.col("k") == -1) & (F.col("a") != F.col("b"))).alias("hot"), F.max("a"), F.max("b")).where("hot > 0").collect()
        assert sum(r["hot"] for r in tasks) > 127_000 and max(r["hot"] for r in tasks) < 40_000
        want = 32_000 * 4 + (8_000 - sum(1 for i in range(n) if i % 10 >= 8 and i % 10_000 == 0)) + sum(1 for i in range(n) if i % 10_000 and i % 10 < 8)
        assert full.count() == want
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_natural_join_needs_a_common_column(frame):
    with pytest.raises(ValueError):
        J.natural_left_join(frame("a int", (1,)), frame("b int", (1,)))


def test_semi_and_anti(abc, rows):
    left, right, _ = abc
    assert rows(J.semi_join(left, right, KEYS), "a") == [("a1",), ("a2",), ("a3",), ("a4",)]
    assert rows(J.anti_join(left, right, KEYS), "a") == [("a5",)]


def test_missing_payload_form_differs_only_when_the_payload_is_missing(frame, rows):
    left, right = frame("k int", (1,), (2,), (3,)), frame("k int, flag boolean", (1, True), (2, None))
    assert rows(J.without_payload(left, right, ["k"], "flag"), "k") == [(2,), (3,)]
    assert rows(J.anti_join(left, right, ["k"])) == [(3,)]
    assert rows(J.with_payload(left, right, ["k"], "flag"), "k") == [(1,)]


def test_presence(frame, rows):
    got = J.presence({"a": frame("k int", (1,), (1,), (None,)), "b": frame("k int", (1,), (2,))}, ["k"])
    assert rows(got) == [(1, True, True), (2, False, True), (None, True, False)]


def test_first_row_and_fill_keep_missing_values(frame, rows):
    df = frame("k string, o int, v string", ("a", 2, "second"), ("a", 1, None), ("b", None, "last"), ("b", 5, "first"), (None, 1, "n"))
    order = [F.col("o").asc_nulls_last()]
    assert rows(first_per_key(df, ["k"], order), "k", "v") == [("a", None), ("b", "first"), (None, "n")]
    filled = J.fill_from_first_row(df, ["k"], order, {"v": "w"})
    assert rows(filled, "k", "v", "w") == [("a", "second", None), ("a", None, None), ("b", "first", "first"), ("b", "last", "first"), (None, "n", "n")]


def test_lookup_fallback_multiplies_on_several_matches(frame, rows):
    df = frame("k int, own string", (1, "x"), (2, "y"), (3, None))
    table = frame("k int, name string", (1, "A"), (1, "B"), (2, None))
    got = J.lookup_with_fallback(df, table, ["k"], "name", "own", "place")
    assert rows(got, "k", "place") == [(1, "A"), (1, "B"), (2, "y"), (3, None)]


def test_merge_order_puts_left_rows_first(frame, rows):
    a = frame("k int, t int, a string, _row int", (1, 1, "a", 7))
    b = frame("k int, t int, b string, _row int", (1, 1, "late", 9), (1, 1, "early", 3), (2, 1, "z", 1))
    merged = J.full_merge([a, b], KEYS, order="_row")
    firsts = first_per_key(merged, ["k"], J.merged_order(2))
    assert rows(firsts, "k", "a", "b") == [(1, "a", "early"), (2, None, "z")]


def test_combinations_of_a_key_hot_in_two_tables(frame):
    a = frame("k int, a int", *[(1, i) for i in range(9)])
    b = frame("k int, b int", *[(1, i) for i in range(7)])
    got = J.full_join(a, b, ["k"], hot_rows=2)
    assert sorted((r["a"], r["b"]) for r in got.collect()) == sorted(itertools.product(range(9), range(7)))
