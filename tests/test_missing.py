"""Missing-value rules, number parsing, rounding."""

import math

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from cohortmill.functions import missing as M
from cohortmill.operators import aggregates as A


def value(frame, schema, row, column):
    return frame(schema, row).select(column.alias("v")).first()["v"]


def test_if_else_keeps_missing_condition(frame, rows):
    df = frame("x int", (1,), (9,), (None,))
    assert rows(df.select("x", M.if_else(F.col("x") < 5, "low", "high").alias("f"))) == [(1, "low"), (9, "high"), (None, None)]


def test_is_in_is_never_missing(frame, rows):
    df = frame("x string", ("a",), ("b",), (None,))
    assert rows(df.select("x", M.is_in("x", ["a"]).alias("f"))) == [("a", True), ("b", False), (None, False)]


def test_text_joins_treat_missing_differently(frame):
    schema, row = "a string, b int", (None, 7)
    assert value(frame, schema, row, M.paste("a", "b")) == "NA 7"
    assert value(frame, schema, row, M.paste0("a", "b")) == "NA7"
    assert value(frame, schema, row, M.str_c("a", "b")) is None
    assert value(frame, "a string, b int", ("S", 7), M.str_c("a", "b", sep="-")) == "S-7"


@pytest.mark.parametrize(
    "text, number",
    [
        ("12", 12.0), (" 12 ", 12.0), ("1e5", 1e5), ("-.5", -0.5), ("7.", 7.0), ("1d", None), ("0x1A", 26.0), ("NA", None),
        ("", None), ("abc", None), (None, None), ("1 2", None), ("Inf", math.inf),
    ],
)
def test_as_number(frame, text, number):
    assert value(frame, "x string", (text,), M.as_number("x")) == number


@pytest.mark.parametrize(
    "x, digits, expected",
    [(2.25, 1, 2.2), (2.35, 1, 2.4), (0.15, 1, 0.1), (2.5, 0, 2.0), (3.5, 0, 4.0), (-2.5, 0, -2.0), (1.0, 1, 1.0), (12.345, 2, 12.35)],
)
def test_round_half_even_on_the_stored_value(frame, x, digits, expected):
    assert value(frame, "x double", (x,), M.round_half_even("x", digits)) == expected


def test_round_half_even_of_missing(frame):
    assert value(frame, "x double", (None,), M.round_half_even("x", 1)) is None


def test_log_of_non_positive_is_missing(frame, rows):
    df = frame("x double", (100.0,), (0.0,), (-1.0,), (None,))
    assert rows(df.select(M.positive_log10("x").alias("l"))) == [(2.0,), (None,), (None,), (None,)]


def test_blank_when_zero(frame, rows):
    assert rows(frame("x int", (0,), (3,), (None,)).select(M.blank_when_zero("x").alias("t"))) == [("",), ("3",), (None,)]


def test_distinct_count_counts_missing_once(frame, rows):
    df = frame("g string, x int", ("a", 1), ("a", None), ("a", None), ("b", None), ("c", 2), ("c", 2))
    out = df.groupBy("g").agg(A.n_distinct("x").alias("n"), A.n_distinct("x", na_rm=True).alias("m"))
    assert rows(out) == [("a", 2, 1), ("b", 1, 0), ("c", 1, 1)]


def test_sums_under_both_policies(frame, rows):
    df = frame("g string, x int", ("a", 1), ("a", 2), ("b", 1), ("b", None), ("c", None))
    out = df.groupBy("g").agg(
        A.sum_present("x").alias("s"),
        A.strict(F.sum("x"), "x").alias("t"),
        A.strict_count_true(F.col("x") == 1).alias("c"),
        A.count_true(F.col("x") == 1).alias("d"),
        A.mean_present("x").alias("m"),
    )
    assert rows(out) == [("a", 3, 3, 1, 1, 1.5), ("b", 1, None, None, 1, 1.0), ("c", 0, None, None, 0, None)]


@settings(max_examples=20, deadline=None)
@given(st.lists(st.one_of(st.none(), st.integers(0, 3)), min_size=1, max_size=20))
def test_distinct_count_matches_a_set(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "x int")
    assert df.agg(A.n_distinct("x").alias("n")).first()["n"] == len(set(values))
