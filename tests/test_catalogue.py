"""Every registered query against its SQL twin, and the plans of the central operators."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import parity
from cohortmill.catalogue import Tables, load
from cohortmill.operators import joins as J
from cohortmill.operators.dedup import first_per_key
from cohortmill.operators.quantiles import exact_median

NO_TWIN = {"quantiles_approximate", "glm_fit_binomial"}


@pytest.fixture(scope="module")
def twin(folder):
    return parity.connect(folder)


@pytest.mark.parametrize("name", sorted(load()))
def test_query_matches_its_twin(spark, folder, twin, name):
    item = load()[name]
    df = item.run(Tables(spark, folder))
    if item.sql is None:
        assert name in NO_TWIN and df.count() > 0
    else:
        assert parity.compare(df, twin, item.sql) == []


def test_driver_contract(spark):
    assert entry.entry(spark).count() == 6
    assert set(load()) <= set(entry.queries())
    assert set(load()) & set(entry.oracle_sql()) == set(load()) - NO_TWIN


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_null_safe_joins_stay_equi_joins(spark, folder):
    t = Tables(spark, folder)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        left = J.left_join(t.orders, t.customer, [("o_custkey", "c_custkey")])
        full = J.full_join(t.orders.withColumnRenamed("o_orderkey", "k"), t.lineitem.withColumnRenamed("l_orderkey", "k"), ["k"])
        for df, kinds in ((left, ["LeftOuter"]), (full, ["Inner", "LeftAnti"])):
            text = plan(df)
            assert all(re.search(rf"SortMergeJoin .*{kind}", text) for kind in kinds) and "FullOuter" not in text
            assert "NestedLoop" not in text and "Cartesian" not in text
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_first_rows_are_limited_before_the_shuffle(spark, folder):
    t = Tables(spark, folder)
    text = plan(first_per_key(t.lineitem, ["l_orderkey"], ["l_linenumber", "l_partkey"]))
    assert text.count("WindowGroupLimit") == 2 and text.count("Exchange hashpartitioning") == 1


def test_scans_read_only_what_is_used(spark, folder):
    t = Tables(spark, folder)
    text = plan(t.orders.filter(F.col("o_totalprice") > 100).groupBy("o_orderstatus").count())
    assert "GreaterThan(o_totalprice,100.0)" in text
    assert re.search(r"ReadSchema: struct<o_orderstatus:string,o_totalprice:double>", text)


def test_no_query_plans_a_cross_join(spark, folder):
    """Scalar subqueries and explode take the place of joins without keys."""
    t = Tables(spark, folder)
    for name in ("hist_faceted", "kde_binned", "km_risk_table", "crosstab_col_percent", "freq_1way", "box_summary"):
        text = plan(load()[name].run(t))
        assert "NestedLoop" not in text and "Cartesian" not in text, name


def test_median_never_holds_a_group_in_one_buffer(spark, folder):
    text = plan(exact_median(Tables(spark, folder).orders, "o_totalprice", "m", ["o_orderstatus"]))
    assert "percentile" not in text and "collect_" not in text


def test_rows_meet_their_quantiles_where_they_are_read(spark, tmp_path):
    """The sketches exceed what may be broadcast, their quantiles do not; no task gets all rows of a flag."""
    n = 40_000
    flag = F.when(F.col("id") % 10 < 2, "R").when(F.col("id") % 10 < 9, "A")
    price = ((F.col("id") * 7919) % n).cast("double")
    lines = spark.range(0, n, 1, 4).select(flag.alias("l_returnflag"), price.alias("l_extendedprice"))
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "64k")
    try:
        df = load()["quantiles_approximate_rank"].run(Tables(spark, str(tmp_path)))
        got = {(r["l_returnflag"], r["p"]): r["near"] for r in df.collect()}
        text = plan(df)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == {(g, p): g and True for g in ("A", "R", None) for p in (0.25, 0.5, 0.75)}
    assert "SortMergeJoin" not in text and not re.search(r"hashpartitioning\(l_returnflag#\d+, \d+\)", text)
