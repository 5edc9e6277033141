"""Joins and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortmill.catalogue import Tables, query
from cohortmill.catalogue import sqltext as S
from cohortmill.catalogue.derived import EVENT_DAY_SQL, event_day
from cohortmill.functions import missing
from cohortmill.operators import joins
from cohortmill.operators.aggregates import n_rows
from cohortmill.operators.dedup import first_per_key
from cohortmill.plans.reports import studies_not_in

STATUS = "nullif(o_orderstatus, 'P')"


@query(
    "left_join_nullsafe",
    f"""
WITH o AS (SELECT o_orderkey, {STATUS} AS st, o_custkey % 50 AS grp FROM orders),
c AS (SELECT CASE c_custkey % 3 WHEN 0 THEN 'F' WHEN 1 THEN 'O' END AS st, CAST(c_nationkey AS BIGINT) AS grp,
             count(*) AS n_cust, max(c_acctbal) AS top FROM customer GROUP BY 1, 2)
SELECT o_orderkey, o.st, o.grp, n_cust, top FROM o LEFT JOIN c ON o.st IS NOT DISTINCT FROM c.st AND o.grp IS NOT DISTINCT FROM c.grp""",
)
def left_join_nullsafe(t: Tables):
    o = t.orders.select("o_orderkey", missing.na_if("o_orderstatus", "P").alias("st"), (F.col("o_custkey") % 50).alias("grp"))
    third = F.col("c_custkey") % 3
    c = (
        t.customer.groupBy(
            F.when(third == 0, "F").when(third == 1, "O").alias("st"), F.col("c_nationkey").cast("long").alias("grp")
        ).agg(n_rows().alias("n_cust"), F.max("c_acctbal").alias("top"))
    )
    return joins.left_join(o, c, ["st", "grp"])


@query(
    "left_join_renamed_keys",
    """
SELECT c.c_custkey, c.c_nationkey, c.c_name AS name_x, c.c_acctbal AS balance, n.n_name AS name_y, n.n_regionkey
FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey AND n.n_regionkey < 3""",
)
def left_join_renamed_keys(t: Tables):
    people = t.customer.select("c_custkey", "c_nationkey", F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    places = t.nation.filter("n_regionkey < 3").withColumnRenamed("n_name", "name")
    return joins.left_join(people, places, [("c_nationkey", "n_nationkey")])


@query(
    "natural_left_join",
    """
SELECT c_custkey, nationkey, c_mktsegment, n_name, n_regionkey
FROM (SELECT c_custkey, c_nationkey AS nationkey, c_mktsegment FROM customer) LEFT JOIN
     (SELECT n_nationkey AS nationkey, n_name, n_regionkey FROM nation WHERE n_regionkey <> 1) USING (nationkey)""",
)
def natural_left_join(t: Tables):
    people = t.customer.select("c_custkey", F.col("c_nationkey").alias("nationkey"), "c_mktsegment")
    places = t.nation.filter("n_regionkey <> 1").withColumnRenamed("n_nationkey", "nationkey")
    return joins.natural_left_join(people, places)


@query(
    "full_join_coalesced",
    """
WITH o AS (SELECT o_orderkey AS k, nullif(o_orderstatus, 'P') AS st, o_totalprice AS price FROM orders),
l AS (SELECT l_orderkey AS k, nullif(l_linestatus, 'O') AS st, l_quantity AS qty FROM lineitem)
SELECT coalesce(o.k, l.k) AS k, coalesce(o.st, l.st) AS st, price, qty
FROM o FULL JOIN l ON o.k IS NOT DISTINCT FROM l.k AND o.st IS NOT DISTINCT FROM l.st""",
)
def full_join_coalesced(t: Tables):
    orders = t.orders.select(
        F.col("o_orderkey").alias("k"), missing.na_if("o_orderstatus", "P").alias("st"), F.col("o_totalprice").alias("price")
    )
    lines = t.lineitem.select(
        F.col("l_orderkey").alias("k"), missing.na_if("l_linestatus", "O").alias("st"), F.col("l_quantity").alias("qty")
    )
    return joins.full_join(orders, lines, ["k", "st"])


def _slice_sql(kind: list[str], name: str, row: str) -> str:
    return (
        f"(SELECT user_id AS uid, CASE WHEN day = 30 THEN NULL ELSE day END AS day, value AS {name}, event_id AS {row} "
        f"FROM d WHERE event_type IN ({', '.join(map(S.quote, kind))}))"
    )


KINDS = [["view"], ["click"], ["signup"], ["purchase", "error"]]
MERGE_SQL = f"""
WITH d AS (SELECT *, {EVENT_DAY_SQL} AS day FROM events),
a AS {_slice_sql(KINDS[0], "v0", "r0")}, b AS {_slice_sql(KINDS[1], "v1", "r1")},
c AS {_slice_sql(KINDS[2], "v2", "r2")}, e AS {_slice_sql(KINDS[3], "v3", "r3")},
m1 AS (SELECT coalesce(a.uid, b.uid) AS uid, coalesce(a.day, b.day) AS day, v0, r0, v1, r1
       FROM a FULL JOIN b ON a.uid IS NOT DISTINCT FROM b.uid AND a.day IS NOT DISTINCT FROM b.day),
m2 AS (SELECT coalesce(m.uid, c.uid) AS uid, coalesce(m.day, c.day) AS day, v0, r0, v1, r1, v2, r2
       FROM m1 m FULL JOIN c ON m.uid IS NOT DISTINCT FROM c.uid AND m.day IS NOT DISTINCT FROM c.day),
m3 AS (SELECT coalesce(m.uid, e.uid) AS uid, coalesce(m.day, e.day) AS day, v0, r0, v1, r1, v2, r2, v3, r3
       FROM m2 m FULL JOIN e ON m.uid IS NOT DISTINCT FROM e.uid AND m.day IS NOT DISTINCT FROM e.day)"""


def _slices(t: Tables):
    day = event_day()
    return [
        t.events.filter(F.col("event_type").isin(kind)).select(
            F.col("user_id").alias("uid"),
            F.when(day != 30, day).alias("day"),
            F.col("value").alias(f"v{i}"),
            F.col("event_id").alias("_row"),
        )
        for i, kind in enumerate(KINDS)
    ]


@query(
    "multiway_full_merge",
    MERGE_SQL
    + """
SELECT uid, day, v0, v1, v2, v3 FROM m3
QUALIFY row_number() OVER (PARTITION BY uid, day ORDER BY r0 NULLS LAST, r1 NULLS LAST, r2 NULLS LAST, r3 NULLS LAST) = 1""",
)
def multiway_full_merge(t: Tables):
    firsts = joins.merge_first_rows(_slices(t), ["uid", "day"], "_row")
    return firsts.select("uid", "day", "v0", "v1", "v2", "v3")


@query(
    "multiway_full_merge_rows",
    MERGE_SQL
    + """
SELECT count(*) AS n_rows, count(v0) AS n0, count(v1) AS n1, count(v2) AS n2, count(v3) AS n3,
       round(sum(v0 + v1 + v2 + v3), 2) AS total FROM m3""",
)
def multiway_full_merge_rows(t: Tables):
    merged = joins.full_merge(_slices(t), ["uid", "day"], order="_row")
    values = [F.col(f"v{i}") for i in range(4)]
    return merged.agg(
        n_rows().alias("n_rows"),
        *[F.count(f"v{i}").alias(f"n{i}") for i in range(4)],
        F.round(F.sum(values[0] + values[1] + values[2] + values[3]), 2).alias("total"),
    )


@query(
    "semi_by_key",
    f"""
SELECT c_custkey, c_name FROM customer c WHERE EXISTS (
  SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 480000)""",
)
def semi_by_key(t: Tables):
    large = t.orders.filter("o_totalprice > 480000")
    return joins.semi_join(t.customer, large, [("c_custkey", "o_custkey")], na_match=False).select("c_custkey", "c_name")


@query(
    "anti_by_missing_flag",
    "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)",
)
def anti_by_missing_flag(t: Tables):
    flagged = joins.presence({"has_lines": t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"))}, ["o_orderkey"])
    return joins.without_payload(t.orders, flagged, ["o_orderkey"], "has_lines", na_match=False).select(
        "o_orderkey", "o_totalprice"
    )


@query(
    "anti_direct",
    "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)",
)
def anti_direct(t: Tables):
    pair = [("o_orderkey", "l_orderkey")]
    return joins.anti_join(t.orders, t.lineitem, pair, na_match=False).select("o_orderkey", "o_totalprice")


@query(
    "inner_restrict",
    """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, brand FROM lineitem
JOIN (SELECT p_partkey, nullif(p_brand, 'Brand#2') AS brand FROM part WHERE p_size < 20) ON l_partkey = p_partkey
WHERE brand IS NOT NULL""",
)
def inner_restrict(t: Tables):
    listed = t.part.filter("p_size < 20").select("p_partkey", missing.na_if("p_brand", "Brand#2").alias("brand"))
    lines = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return joins.with_payload(lines, listed, [("l_partkey", "p_partkey")], "brand", expect="m:1", na_match=False)


@query(
    "coverage_flags",
    """
WITH s AS (SELECT doc_id, true AS d, false AS l, false AS p FROM documents
           UNION ALL SELECT doc_id, false, true, false FROM labels UNION ALL SELECT page_id, false, false, true FROM pages),
k AS (SELECT doc_id, bool_or(d) AS in_documents, bool_or(l) AS in_labels, bool_or(p) AS in_pages FROM s GROUP BY doc_id)
SELECT in_documents, in_labels, in_pages, count(*) AS n FROM k GROUP BY ALL""",
)
def coverage_flags(t: Tables):
    frames = {
        "in_documents": t.documents.select("doc_id"),
        "in_labels": t.labels.select("doc_id"),
        "in_pages": t.pages.select(F.col("page_id").alias("doc_id")),
    }
    return joins.presence(frames, ["doc_id"]).groupBy(*frames).agg(n_rows().alias("n"))


@query(
    "coverage_missing",
    """
SELECT DISTINCT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""",
)
def coverage_missing(t: Tables):
    return studies_not_in(t.documents, t.labels, ["doc_id"])


@query(
    "lookup_with_fallback",
    """
SELECT c_custkey, c_mktsegment, preferred, coalesce(preferred, c_mktsegment) AS place
FROM customer LEFT JOIN (SELECT n_nationkey, nullif(n_name, 'FRANCE') AS preferred FROM nation WHERE n_regionkey < 4)
  ON c_nationkey = n_nationkey""",
)
def lookup_with_fallback(t: Tables):
    table = t.nation.filter("n_regionkey < 4").select("n_nationkey", missing.na_if("n_name", "FRANCE").alias("preferred"))
    filled = joins.lookup_with_fallback(
        t.customer, table, [("c_nationkey", "n_nationkey")], "preferred", "c_mktsegment", "place"
    )
    return filled.select("c_custkey", "c_mktsegment", "preferred", "place")


@query(
    "event_day_alignment",
    f"""
WITH d AS (SELECT *, {EVENT_DAY_SQL} - 1 AS day FROM events),
o AS (SELECT user_id, max(day) AS lastday, round(max(value), 2) AS best FROM d WHERE event_type = 'purchase' GROUP BY user_id)
SELECT event_id, d.user_id, day + 1 AS day, best FROM d LEFT JOIN o ON d.user_id = o.user_id AND d.day = o.lastday""",
)
def event_day_alignment(t: Tables):
    d = t.events.select("event_id", "user_id", (event_day() - 1).alias("day"), "value", "event_type")
    outcome = (
        d.filter("event_type = 'purchase'").groupBy("user_id").agg(F.max("day").alias("lastday"), F.round(F.max("value"), 2).alias("best"))
    )
    joined = joins.left_join(d.drop("value", "event_type"), outcome, ["user_id", ("day", "lastday")])
    return joined.withColumn("day", F.col("day") + 1)


@query(
    "union_harmonised",
    """
SELECT DISTINCT * FROM (
  SELECT CAST(c_custkey AS VARCHAR) AS id, c_nationkey AS nation, c_acctbal AS balance, c_mktsegment AS segment, 'CUSTOMER' AS origin FROM customer
  UNION ALL
  SELECT CAST(s_suppkey AS VARCHAR), s_nationkey, TRY_CAST(CASE WHEN s_suppkey % 5 = 0 THEN 'unknown' ELSE CAST(s_acctbal AS VARCHAR) END AS DOUBLE),
         NULL, 'SUPPLIER' FROM supplier)
QUALIFY row_number() OVER (PARTITION BY id, nation ORDER BY origin) = 1""",
)
def union_harmonised(t: Tables):
    people = t.customer.select(
        F.col("c_custkey").cast("string").alias("id"),
        F.col("c_nationkey").alias("nation"),
        F.col("c_acctbal").alias("balance"),
        F.col("c_mktsegment").alias("segment"),
        F.lit("CUSTOMER").alias("origin"),
    )
    as_text = F.when(F.col("s_suppkey") % 5 != 0, F.col("s_acctbal").cast("string")).otherwise("unknown")
    firms = t.supplier.select(
        F.lit("SUPPLIER").alias("origin"),
        F.col("s_suppkey").cast("string").alias("id"),
        missing.as_number(as_text).alias("balance"),
        F.col("s_nationkey").alias("nation"),
        F.lit(None).cast("string").alias("segment"),
    )
    return first_per_key(people.unionByName(firms), ["id", "nation"], ["origin"])
