"""Frequency tables, pivots, totals and percentages."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortmill.catalogue import Tables, query
from cohortmill.catalogue import sqltext as S
from cohortmill.catalogue.derived import EVENT_DAY_SQL, event_day
from cohortmill.functions.bands import Band, band_label, band_rank, labels
from cohortmill.functions.factors import factor, level_rank
from cohortmill.functions.missing import na_if
from cohortmill.operators import tables as T
from cohortmill.operators.aggregates import n_distinct, n_rows
from cohortmill.operators.joins import left_join
from cohortmill.plans.domains import first_value_pivot

SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
PRICE_BANDS = [
    Band("< 10,000", None, 10_000, closed=False),
    Band("10,000-99,999", 10_000, 100_000, closed=False),
    Band("100,000-249,999", 100_000, 250_000, closed=False),
    Band("250,000-399,999", 250_000, 400_000, closed=False),
    Band(">= 400,000", 400_000),
]


@query(
    "freq_1way",
    """
WITH x AS (SELECT nullif(o_orderstatus, 'P') AS status FROM orders), c AS (SELECT status, count(*) AS n FROM x GROUP BY status)
SELECT status, n, round(n / (SELECT sum(n) FROM c), 10) AS percent,
       CASE WHEN status IS NOT NULL THEN round(n / (SELECT sum(n) FROM c WHERE status IS NOT NULL), 10) END AS valid_percent
FROM c""",
)
def freq_1way(t: Tables):
    table = T.frequency(t.orders.select(na_if("o_orderstatus", "P").alias("status")), "status")
    return table.withColumns({c: F.round(c, 10) for c in ("percent", "valid_percent")})


def _counts(column: str, values, name=str) -> str:
    parts = [f'count(*) FILTER (WHERE {column} = {S.quote(v)}) AS "{name(v)}"' for v in values]
    return ", ".join(parts)


@query(
    "freq_2way",
    f"""
SELECT o_orderpriority, {_counts("status", ["F", "O"])}, count(*) FILTER (WHERE status IS NULL) AS "NA_"
FROM (SELECT *, nullif(o_orderstatus, 'P') AS status FROM orders) GROUP BY o_orderpriority""",
)
def freq_2way(t: Tables):
    return T.cross_frequency(t.orders.withColumn("status", na_if("o_orderstatus", "P")), "o_orderpriority", "status")


# One level occurs in one layer only.
QUANTITY = "CASE WHEN l_linestatus = 'O' OR CAST(l_quantity AS INTEGER) % 10 < 7 THEN CAST(l_quantity AS INTEGER) % 10 ELSE 99 END"


@query(
    "freq_3way",
    f"""
SELECT l_linestatus, qty, {", ".join(f'count(*) FILTER (WHERE x.l_returnflag = {S.quote(v)}) AS "{v}"' for v in ("A", "N", "R"))}
FROM (SELECT l_linestatus, qty FROM (SELECT DISTINCT l_linestatus FROM lineitem), (SELECT DISTINCT {QUANTITY} AS qty FROM lineitem)) g
LEFT JOIN (SELECT *, {QUANTITY} AS qty FROM lineitem) x USING (l_linestatus, qty) GROUP BY l_linestatus, qty""",
)
def freq_3way(t: Tables):
    quantity = F.col("l_quantity").cast("int")
    x = t.lineitem.withColumn("qty", F.when((F.col("l_linestatus") == "O") | (quantity % 10 < 7), quantity % 10).otherwise(99))
    return T.layered_frequency(x, "qty", "l_returnflag", "l_linestatus")


@query(
    "crosstab_totals_both",
    f"""
WITH c AS (SELECT c_mktsegment, o_orderpriority AS p, count(DISTINCT o_custkey) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
w AS (SELECT c_mktsegment AS segment, {", ".join(f"CAST(coalesce(sum(n) FILTER (WHERE p = '{p}'), 0) AS BIGINT) AS \"{p}\"" for p in PRIORITIES)},
             CAST(sum(n) AS BIGINT) AS "Total" FROM c GROUP BY c_mktsegment)
SELECT * FROM w UNION ALL SELECT 'Total', {", ".join(f'CAST(sum("{p}") AS BIGINT)' for p in PRIORITIES)}, CAST(sum("Total") AS BIGINT) FROM w""",
)
def crosstab_totals_both(t: Tables):
    x = left_join(t.orders, t.customer, [("o_custkey", "c_custkey")], na_match=False)
    x = x.withColumnRenamed("c_mktsegment", "segment")
    return T.totals(T.count_table(x, ["segment"], "o_orderpriority", n_distinct("o_custkey")), "both")


@query(
    "crosstab_outcome_sorted",
    f"""
WITH c AS (SELECT o_custkey % 30 AS study, o_orderpriority AS p, count(DISTINCT o_custkey) AS n FROM orders GROUP BY ALL)
SELECT study, {", ".join(f"CAST(sum(n) FILTER (WHERE p = '{p}') AS BIGINT) AS \"{p}\"" for p in PRIORITIES)}, CAST(sum(n) AS BIGINT) AS "Total"
FROM c GROUP BY study""",
)
def crosstab_outcome_sorted(t: Tables):
    x = t.orders.withColumn("study", F.col("o_custkey") % 30)
    wide = T.count_table(x, ["study"], "o_orderpriority", n_distinct("o_custkey"), fill=None)
    return T.sorted_report(T.totals(wide, "col"), ["Total"], ["study"])


def _col_percent_sql() -> str:
    cells = ", ".join(f"count(DISTINCT CASE WHEN c_mktsegment = '{s}' THEN o_custkey END) AS \"{s}\"" for s in SEGMENTS)
    sums = ", ".join(f'CAST(sum("{s}") AS BIGINT)' for s in SEGMENTS)
    shares = ", ".join(f'"{s}" / (SELECT sum("{s}") FROM b) AS "{s}_p"' for s in SEGMENTS)
    final = ", ".join(
        f'"{s}", round("{s}_p", 10) AS "{s}_pct", printf(\'%d (%.2f%%)\', "{s}", {S.half_even(f"{chr(34)}{s}_p{chr(34)} * 100", 2)}) AS "{s}_text"'
        for s in SEGMENTS
    )
    return f"""
WITH x AS (SELECT {S.case_bands("o_totalprice", PRICE_BANDS)} AS price_band, {S.band_rank("o_totalprice", PRICE_BANDS)} AS price_rank,
                  c_mktsegment, o_custkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F'),
b AS (SELECT price_band, price_rank, {cells} FROM x GROUP BY ALL),
w AS (SELECT * FROM b UNION ALL SELECT 'Total', NULL, {sums} FROM b),
s AS (SELECT *, {shares} FROM w)
SELECT price_band, price_rank, {final} FROM s"""


@query("crosstab_col_percent", _col_percent_sql())
def crosstab_col_percent(t: Tables):
    """Customers per price band and segment among finished orders, with column percentages."""
    x = left_join(
        t.orders.filter("o_orderstatus = 'F'"), t.customer, [("o_custkey", "c_custkey")], na_match=False
    ).select(
        band_label("o_totalprice", PRICE_BANDS).alias("price_band"),
        band_rank("o_totalprice", PRICE_BANDS).alias("price_rank"),
        "c_mktsegment",
        "o_custkey",
    )
    counts = T.count_table(x, ["price_band", "price_rank"], "c_mktsegment", n_distinct("o_custkey"), SEGMENTS)
    table = T.column_percentages(counts, SEGMENTS)
    table = table.withColumns({f"{s}_pct": F.round(f"{s}_pct", 10) for s in SEGMENTS})
    return table.orderBy(F.col("price_rank").asc_nulls_last())


@query(
    "pivot_banded_sizes",
    f"""
SELECT p_brand, {", ".join(f"count(*) FILTER (WHERE {S.case_bands('p_size', [Band('small', None, 10), Band('middle', 11, 30), Band('large', 31)])} = '{b}') AS {b}" for b in ("small", "middle", "large"))}
FROM part GROUP BY p_brand""",
)
def pivot_banded_sizes(t: Tables):
    sizes = [Band("small", None, 10), Band("middle", 11, 30), Band("large", 31)]
    x = t.part.withColumn("size_band", band_label("p_size", sizes))
    cells = x.groupBy("p_brand", "size_band").agg(n_rows().alias("n"))
    return T.fill_missing(T.pivot_wider(cells, ["p_brand"], "size_band", "n", labels(sizes)))


FIRST_KINDS = ["click", "error", "purchase", "signup", "view"]


@query(
    "first_value_pivot",
    f"""
WITH d AS (SELECT user_id, {EVENT_DAY_SQL} AS day, event_type,
                  CASE WHEN event_id % 8 = 0 THEN NULL ELSE value END AS value, event_id FROM events),
f AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY user_id, day, event_type ORDER BY event_id) = 1)
SELECT user_id, day, {", ".join(f"max(value) FILTER (WHERE event_type = '{k}') AS {k}" for k in FIRST_KINDS)} FROM f GROUP BY user_id, day""",
)
def first_value_pivot_query(t: Tables):
    d = t.events.select(
        "user_id",
        event_day().alias("day"),
        "event_type",
        F.when(F.col("event_id") % 8 != 0, F.col("value")).alias("value"),
        "event_id",
    )
    return first_value_pivot(d, ["user_id", "day"], "event_type", "value", F.col("event_id"), FIRST_KINDS)


#: One level never occurs, and one priority is no level.
LEVELS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "9-NEVER"]


def _ranked_orders(t: Tables):
    return factor(t.orders, "o_orderpriority", LEVELS)


@query(
    "factor_columns",
    f"""
SELECT o_orderstatus, {_counts("o_orderpriority", LEVELS)}, count(*) FILTER (WHERE o_orderpriority NOT IN ({", ".join(map(S.quote, LEVELS))})) AS "NA_"
FROM orders GROUP BY o_orderstatus""",
)
def factor_columns(t: Tables):
    """The columns of the table are the declared levels, which came through a join and a filter."""
    x = left_join(_ranked_orders(t), t.customer, [("o_custkey", "c_custkey")], na_match=False).filter("o_orderkey IS NOT NULL")
    return T.cross_frequency(x, "o_orderstatus", "o_orderpriority")


@query(
    "factor_rows",
    f"""
WITH x AS (SELECT o_orderstatus, CASE WHEN o_orderpriority IN ({", ".join(map(S.quote, LEVELS))}) THEN o_orderpriority END AS p, o_custkey % 2 AS half FROM orders),
l AS (SELECT unnest([{", ".join(map(S.quote, LEVELS))}, NULL]) AS p)
SELECT g.o_orderstatus, l.p AS o_orderpriority, count(x.half) FILTER (WHERE half = 0) AS "0", count(x.half) FILTER (WHERE half = 1) AS "1"
FROM (SELECT DISTINCT o_orderstatus FROM x) g CROSS JOIN l LEFT JOIN x ON x.o_orderstatus = g.o_orderstatus AND x.p IS NOT DISTINCT FROM l.p
GROUP BY g.o_orderstatus, l.p""",
)
def factor_rows(t: Tables):
    x = _ranked_orders(t).withColumn("half", F.col("o_custkey") % 2)
    return T.layered_frequency(x, "o_orderpriority", "half", "o_orderstatus", [0, 1])


@query(
    "factor_frequency",
    f"""
WITH x AS (SELECT CASE WHEN o_orderpriority IN ({", ".join(map(S.quote, LEVELS))}) THEN o_orderpriority ELSE 'other' END AS p FROM orders),
l AS (SELECT unnest([{", ".join(map(S.quote, [*LEVELS, "other"]))}]) AS p, unnest(range(1, {len(LEVELS) + 2})) AS place)
SELECT l.p AS o_orderpriority, l.place::INT AS place, count(x.p) AS n, round(count(x.p) / (SELECT count(*) FROM x), 10) AS percent FROM l LEFT JOIN x ON x.p = l.p GROUP BY l.p, l.place""",
)
def factor_frequency(t: Tables):
    table = T.frequency(factor(t.orders, "o_orderpriority", LEVELS, missing="other"), "o_orderpriority")
    return table.select("o_orderpriority", level_rank(table, "o_orderpriority").alias("place"), "n", F.round("percent", 10).alias("percent"))
