"""Row selection: membership, missing values, eligibility, first rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortmill.catalogue import Tables, query
from cohortmill.functions import missing, text
from cohortmill.operators.aggregates import n_distinct, n_rows
from cohortmill.operators.dedup import distinct_rows, first_per_key
from cohortmill.operators.joins import fill_from_first_row, left_join
from cohortmill.operators.tables import sorted_report, threshold_table
from cohortmill.plans.cohort import select_subjects, selection_counts

# A full order of line items: it leaves no ties at any scale of the shared tables.
LINE_ORDER = [
    "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate",
]
LINE_ORDER_SQL = ", ".join(LINE_ORDER)


@query(
    "null_aware_exclusion",
    """
WITH x AS (SELECT event_id, nullif(event_type, 'error') AS kind, CASE WHEN event_id % 4 = 0 THEN NULL ELSE value END AS v,
                  CASE WHEN event_id % 9 = 0 THEN NULL ELSE event_id % 3 END AS day FROM events)
SELECT event_id, kind, v, day FROM x
WHERE NOT (day = 1 AND v IS NULL) AND NOT (kind = 'view' AND day = 2) AND NOT day < 0""",
)
def null_aware_exclusion(t: Tables):
    x = t.events.select(
        "event_id",
        missing.na_if("event_type", "error").alias("kind"),
        F.when(F.col("event_id") % 4 != 0, F.col("value")).alias("v"),
        F.when(F.col("event_id") % 9 != 0, F.col("event_id") % 3).alias("day"),
    )
    return x.filter(
        ~((F.col("day") == 1) & F.col("v").isNull())
        & ~((F.col("kind") == "view") & (F.col("day") == 2))
        & ~(F.col("day") < 0)
    )


@query(
    "membership_filter",
    """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag, l_linestatus
FROM lineitem WHERE l_returnflag IN ('A', 'R') AND l_quantity > 45 AND l_linestatus = 'F'
  AND NOT regexp_matches(l_returnflag || l_linestatus, 'RO|NF') AND l_discount BETWEEN 0.02 AND 0.08""",
)
def membership_filter(t: Tables):
    return t.lineitem.filter(
        F.col("l_returnflag").isin("A", "R")
        & (F.col("l_quantity") > 45)
        & (F.col("l_linestatus") == "F")
        & ~text.contains(F.concat("l_returnflag", "l_linestatus"), "RO", "NF")
        & F.col("l_discount").between(0.02, 0.08)
    ).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_linestatus")


@query(
    "eligibility_cohort",
    """
WITH x AS (SELECT o_orderkey, o_totalprice, c_acctbal / 1000 AS age, c_mktsegment, o_orderdate
           FROM orders LEFT JOIN customer ON o_custkey = c_custkey)
SELECT c_mktsegment, count(*) AS n_eligible, count(DISTINCT o_orderkey) AS n_orders,
       count(*) FILTER (WHERE o_totalprice > 250000) AS n_high
FROM x WHERE age < 5 AND c_mktsegment IN ('BUILDING', 'MACHINERY', 'FURNITURE') AND o_orderdate >= TIMESTAMP '1996-01-01'
GROUP BY c_mktsegment""",
)
def eligibility_cohort(t: Tables):
    x = left_join(t.orders, t.customer, [("o_custkey", "c_custkey")], na_match=False)
    kept = x.filter(
        (F.col("c_acctbal") / 1000 < 5)
        & F.col("c_mktsegment").isin("BUILDING", "MACHINERY", "FURNITURE")
        & (F.col("o_orderdate") >= F.lit("1996-01-01").cast("timestamp_ntz"))
    )
    return kept.groupBy("c_mktsegment").agg(
        n_rows().alias("n_eligible"),
        n_distinct("o_orderkey").alias("n_orders"),
        F.count_if(F.col("o_totalprice") > 250000).alias("n_high"),
    )


@query(
    "regex_ci_patient_select",
    """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM lineitem WHERE l_orderkey IN (
  SELECT l_orderkey FROM lineitem JOIN part ON l_partkey = p_partkey
  WHERE regexp_matches(p_name, 'RED WIDGET|Hot Bolt|old\\s+GEAR', 'i'))""",
)
def regex_ci_patient_select(t: Tables):
    lines = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    named = left_join(lines, t.part.select("p_partkey", "p_name"), [("l_partkey", "p_partkey")], na_match=False)
    wanted = text.contains("p_name", "RED WIDGET", "Hot Bolt", r"old\s+GEAR", ignore_case=True)
    return select_subjects(named, ["l_orderkey"], wanted).drop("p_name")


@query(
    "dedup_first_row",
    f"""
SELECT l_orderkey, {LINE_ORDER_SQL}, l_discount FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY {LINE_ORDER_SQL}) = 1""",
)
def dedup_first_row(t: Tables):
    rows = t.lineitem.select("l_orderkey", *LINE_ORDER, "l_discount")
    return first_per_key(rows, ["l_orderkey"], LINE_ORDER)


@query("distinct_rows", "SELECT DISTINCT c_nationkey, nullif(c_mktsegment, 'BUILDING') AS segment FROM customer")
def distinct_rows_query(t: Tables):
    x = t.customer.withColumn("segment", missing.na_if("c_mktsegment", "BUILDING"))
    return distinct_rows(x, "c_nationkey", "segment")


@query(
    "first_attribute_fill",
    """
WITH f AS (SELECT user_id, nullif(event_type, 'click') AS first_type, value AS first_value FROM events
           QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1)
SELECT event_id, e.user_id, value, first_type, first_value FROM events e LEFT JOIN f ON e.user_id = f.user_id""",
)
def first_attribute_fill(t: Tables):
    x = t.events.withColumn("kind", missing.na_if("event_type", "click"))
    filled = fill_from_first_row(
        x, ["user_id"], [F.col("ts"), F.col("event_id")], {"kind": "first_type", "value": "first_value"}
    )
    return filled.select("event_id", "user_id", "value", "first_type", "first_value")


@query(
    "threshold_table",
    """
WITH x AS (SELECT CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS v FROM orders)
SELECT v > 100000 AS above, count(*) AS n FROM x WHERE v IS NOT NULL GROUP BY 1""",
)
def threshold(t: Tables):
    return threshold_table(t.orders, F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")), 100000)


@query(
    "sorted_report",
    """
SELECT p_brand, n, max_price FROM (
  SELECT p_brand, count(*) AS n, max(CASE WHEN p_size > 45 THEN p_retailprice END) AS max_price FROM part GROUP BY p_brand)
ORDER BY max_price DESC NULLS LAST, p_brand LIMIT 10""",
)
def sorted_report_query(t: Tables):
    large = F.when(F.col("p_size") > 45, F.col("p_retailprice"))
    table = t.part.groupBy("p_brand").agg(n_rows().alias("n"), F.max(large).alias("max_price"))
    return sorted_report(table, ["max_price"], ["p_brand"], limit=10)


@query(
    "selection_counts",
    """
SELECT 'all' AS step, count(*) AS n_rows, count(DISTINCT o_custkey) AS n_subjects FROM orders
UNION ALL SELECT 'not pending', count(*), count(DISTINCT o_custkey) FROM orders WHERE o_orderstatus <> 'P'
UNION ALL SELECT 'customer with a large order', count(*), count(DISTINCT o_custkey) FROM orders
  WHERE o_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 490000)""",
)
def selection_counts_query(t: Tables):
    orders = t.orders
    return selection_counts(
        {
            "all": orders,
            "not pending": orders.filter(F.col("o_orderstatus") != "P"),
            "customer with a large order": select_subjects(orders, ["o_custkey"], F.col("o_totalprice") > 490000),
        },
        ["o_custkey"],
    )
