"""Aggregation under both missing-value policies, medians, profiles, summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortmill.catalogue import Tables, query
from cohortmill.catalogue import sqltext as S
from cohortmill.catalogue.derived import EVENT_DAY_SQL, event_day
from cohortmill.functions import missing
from cohortmill.operators import aggregates as A
from cohortmill.operators.joins import left_join
from cohortmill.operators.quantiles import approximate_quantiles, exact_median, exact_quantiles
from cohortmill.operators.summaries import (
    baseline_summary,
    missing_by_subject,
    share_within,
    study_characteristics,
    subjects_where,
)
from cohortmill.operators.tables import sorted_report
from cohortmill.plans.reports import mean_density_by_day, recrudescence_by_study
from cohortmill.sources.files import stage

STATUS = "nullif(o_orderstatus, 'P')"


@query(
    "n_distinct_with_na",
    f"""
SELECT o_orderpriority, count(DISTINCT {STATUS}) + max(CASE WHEN {STATUS} IS NULL THEN 1 ELSE 0 END) AS n_with_na,
       count(DISTINCT {STATUS}) AS n_present, count(DISTINCT o_custkey) AS n_customers FROM orders GROUP BY o_orderpriority""",
)
def n_distinct_with_na(t: Tables):
    x = t.orders.withColumn("st", missing.na_if("o_orderstatus", "P"))
    return x.groupBy("o_orderpriority").agg(
        A.n_distinct("st").alias("n_with_na"),
        A.n_distinct("st", na_rm=True).alias("n_present"),
        A.n_distinct("o_custkey").alias("n_customers"),
    )


@query(
    "rows_and_distinct",
    "SELECT count(DISTINCT user_id) AS n_users, count(DISTINCT (user_id, event_type)) AS n_pairs, count(*) AS n FROM events",
)
def rows_and_distinct(t: Tables):
    return t.events.agg(
        A.n_distinct("user_id").alias("n_users"),
        A.n_distinct("user_id", "event_type").alias("n_pairs"),
        A.n_rows().alias("n"),
    )


@query(
    "conditional_sums_na",
    f"""
WITH x AS (SELECT o_custkey % 40 AS grp, CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE o_orderstatus END AS st,
                  CASE WHEN o_custkey % 40 < 2 THEN NULL ELSE o_totalprice END AS price FROM orders)
SELECT grp, count(*) AS n, CAST(coalesce(sum(CASE WHEN st = 'F' THEN 1 WHEN st <> 'F' THEN 0 END), 0) AS BIGINT) AS failures,
       CASE WHEN count(*) = count(st) THEN count(*) FILTER (WHERE st = 'F') END AS strict_failures,
       CASE WHEN count(*) = count(st) THEN count(*) FILTER (WHERE st = 'O') END AS strict_open,
       round(coalesce(sum(price), 0), 2) AS spent, round(avg(price), 4) AS mean_price,
       CASE WHEN count(*) = count(price) THEN round(sum(price), 2) END AS strict_spent
FROM x GROUP BY grp""",
)
def conditional_sums_na(t: Tables):
    grp = F.col("o_custkey") % 40
    x = t.orders.select(
        grp.alias("grp"),
        F.when(F.col("o_orderkey") % 97 != 0, F.col("o_orderstatus")).alias("st"),
        F.when(grp >= 2, F.col("o_totalprice")).alias("price"),
    )
    failed = F.col("st") == "F"
    return x.groupBy("grp").agg(
        A.n_rows().alias("n"),
        A.sum_present(missing.if_else(failed, 1, 0)).alias("failures"),
        A.strict_count_true(failed).alias("strict_failures"),
        A.strict_count_true(F.col("st") == "O").alias("strict_open"),
        F.round(A.sum_present("price"), 2).alias("spent"),
        F.round(A.mean_present("price"), 4).alias("mean_price"),
        A.strict(F.round(F.sum("price"), 2), "price").alias("strict_spent"),
    )


@query(
    "failures_by_study",
    """
SELECT o_custkey % 150 AS sid, count(DISTINCT o_custkey) AS n,
       CAST(coalesce(sum(CASE WHEN st = 'F' THEN 1 WHEN st <> 'F' THEN 0 END), 0) AS BIGINT) AS failure
FROM (SELECT *, nullif(o_orderstatus, 'P') AS st FROM orders) GROUP BY 1
ORDER BY failure DESC NULLS LAST, sid""",
)
def failures_by_study(t: Tables):
    x = t.orders.select((F.col("o_custkey") % 150).alias("sid"), "o_custkey", missing.na_if("o_orderstatus", "P").alias("st"))
    return recrudescence_by_study(x, "sid", "o_custkey", "st", "F")


@query(
    "missing_profile",
    """
SELECT user_id, count(*) FILTER (WHERE v IS NULL) AS n_missing
FROM (SELECT user_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE value END AS v FROM events) GROUP BY user_id""",
)
def missing_profile(t: Tables):
    x = t.events.select("user_id", F.when(F.col("event_id") % 5 != 0, F.col("value")).alias("v"))
    return missing_by_subject(x, ["user_id"], "v")


@query(
    "subjects_followed",
    f"""
SELECT count(DISTINCT user_id) AS n FROM events WHERE {EVENT_DAY_SQL} > 27""",
)
def subjects_followed(t: Tables):
    return subjects_where(t.events, ["user_id"], event_day() > 27)


@query(
    "mean_by_day",
    f"""
SELECT dayofobs, round(avg(CASE WHEN v <> 'NA' THEN CAST(v AS DOUBLE) END), 6) AS mean_pfmicl
FROM (SELECT {EVENT_DAY_SQL} AS dayofobs, CASE WHEN event_id % 6 = 0 THEN 'NA' ELSE CAST(value AS VARCHAR) END AS v FROM events)
GROUP BY dayofobs""",
)
def mean_by_day(t: Tables):
    as_text = F.when(F.col("event_id") % 6 != 0, F.col("value").cast("string")).otherwise("NA")
    x = t.events.select(event_day().alias("dayofobs"), as_text.alias("pfmicl"))
    return mean_density_by_day(x).withColumn("mean_pfmicl", F.round("mean_pfmicl", 6))


@query(
    "conditional_median",
    f"""
WITH x AS (SELECT o_orderpriority, CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_totalprice END AS price, o_orderstatus FROM orders)
SELECT o_orderpriority AS grp, round(median(price), 6) AS median FROM x GROUP BY 1
UNION ALL SELECT 'all', round(median(price), 6) FROM x
UNION ALL SELECT 'finished', round(median(CASE WHEN o_orderstatus = 'F' THEN price END), 6) FROM x""",
)
def conditional_median(t: Tables):
    price = F.when(F.col("o_orderkey") % 13 != 0, F.col("o_totalprice"))
    finished = F.when(F.col("o_orderstatus") == "F", price)
    parts = [(F.col("o_orderpriority"), price), (F.lit("all"), price), (F.lit("finished"), finished)]
    entries = F.array(*[F.struct(grp.alias("grp"), x.alias("price")) for grp, x in parts])
    long = t.orders.select(F.explode(entries).alias("e")).select("e.*")
    return exact_median(long, "price", "median", ["grp"]).withColumn("median", F.round("median", 6))


@query(
    "quantiles_by_group",
    """
SELECT l_returnflag, nullif(l_linestatus, 'O') AS st, round(quantile_cont(l_extendedprice, 0.0), 4) AS q0,
       round(quantile_cont(l_extendedprice, 0.1), 4) AS q10, round(quantile_cont(l_extendedprice, 0.5), 4) AS q50,
       round(quantile_cont(l_extendedprice, 0.99), 4) AS q99, round(quantile_cont(l_extendedprice, 1.0), 4) AS q100,
       count(*) AS n
FROM lineitem GROUP BY ALL""",
)
def quantiles_by_group(t: Tables):
    x = t.lineitem.withColumn("st", missing.na_if("l_linestatus", "O"))
    names = ["q0", "q10", "q50", "q99", "q100"]
    q = exact_quantiles(x, "l_extendedprice", [0.0, 0.1, 0.5, 0.99, 1.0], names, ["l_returnflag", "st"], count_name="n")
    return q.select("l_returnflag", "st", *[F.round(c, 4).alias(c) for c in names], "n")


@query("quantiles_approximate", None)
def quantiles_approximate(t: Tables):
    return approximate_quantiles(t.lineitem, "l_extendedprice", [0.25, 0.5, 0.75], ["q25", "q50", "q75"], ["l_returnflag"])


@query(
    "quantiles_approximate_rank",
    """
SELECT l_returnflag, p, true AS near FROM (SELECT DISTINCT l_returnflag FROM lineitem), (SELECT unnest([0.25, 0.5, 0.75])::DOUBLE AS p)""",
)
def quantiles_approximate_rank(t: Tables):
    """Whether the sketched quantiles stand within a thousandth of the wanted rank.

    The sketches in the shuffle are large and their quantiles are few: written down first, these show Spark their size, and
    the rows are joined where they are read. In one plan the rows would be dealt by flag, all of a flag to one task.
    """
    probs = [0.25, 0.5, 0.75]
    sketched = stage(approximate_quantiles(t.lineitem, "l_extendedprice", probs, ["q25", "q50", "q75"], ["l_returnflag"]))
    x = left_join(t.lineitem.select("l_returnflag", "l_extendedprice"), sketched, ["l_returnflag"], na_match=False)
    pairs = F.array(*[F.struct(F.lit(p).alias("p"), F.col(q).alias("q")) for p, q in zip(probs, ["q25", "q50", "q75"], strict=True)])
    met = x.select("l_returnflag", "l_extendedprice", F.explode(pairs).alias("e")).groupBy("l_returnflag", "e.p").agg(
        F.avg((F.col("l_extendedprice") < F.col("e.q")).cast("double")).alias("below"),
        F.avg((F.col("l_extendedprice") <= F.col("e.q")).cast("double")).alias("upto"),
    )
    near = (F.col("below") <= F.col("p") + 0.001) & (F.col("upto") >= F.col("p") - 0.001)
    return met.select("l_returnflag", "p", near.alias("near"))


@query(
    "study_characteristics",
    f"""
WITH p AS (SELECT c_nationkey AS study, o_custkey AS subject,
                  CASE WHEN c_nationkey = 3 AND o_custkey % 2 = 0 THEN NULL ELSE c_acctbal / 7 END AS age,
                  o_orderstatus AS sex, CASE WHEN c_nationkey = 5 THEN nullif(o_orderpriority, '5-LOW') ELSE o_orderpriority END AS arm, o_orderkey
           FROM orders JOIN customer ON o_custkey = c_custkey
           QUALIFY row_number() OVER (PARTITION BY c_nationkey, o_custkey ORDER BY o_orderkey) = 1),
g AS (SELECT study, count(DISTINCT subject) AS n, CASE WHEN count(*) = count(age) THEN median(age) END AS m,
             count(*) FILTER (WHERE sex = 'F') AS f, count(*) FILTER (WHERE sex = 'X') AS x,
             CASE WHEN count(*) = count(arm) THEN count(*) FILTER (WHERE arm = '1-URGENT') END AS urgent
      FROM p GROUP BY study)
SELECT study, n, {S.half_even("m", 1)} AS age, CASE WHEN f = 0 THEN '' ELSE CAST(f AS VARCHAR) END AS sex_f,
       CASE WHEN x = 0 THEN '' ELSE CAST(x AS VARCHAR) END AS sex_x, urgent,
       CAST(row_number() OVER (ORDER BY n DESC, study) AS INTEGER) AS num FROM g""",
)
def study_characteristics_query(t: Tables):
    x = left_join(t.orders, t.customer, [("o_custkey", "c_custkey")], na_match=False)
    nation = F.col("c_nationkey")
    x = x.select(
        nation.alias("study"),
        F.col("o_custkey").alias("subject"),
        F.when(~((nation == 3) & (F.col("o_custkey") % 2 == 0)), F.col("c_acctbal") / 7).alias("age"),
        F.col("o_orderstatus").alias("sex"),
        F.when(~((nation == 5) & (F.col("o_orderpriority") == "5-LOW")), F.col("o_orderpriority")).alias("arm"),
        "o_orderkey",
    )
    counts = {"sex_f": F.col("sex") == "F", "sex_x": F.col("sex") == "X", "urgent": F.col("arm") == "1-URGENT"}
    return study_characteristics(x, "study", "subject", ["o_orderkey"], {"age": "age"}, counts, ["sex_f", "sex_x"])


def _type2(p: float) -> str:
    return (
        f"(max(CASE WHEN rn = CASE WHEN n * {p} = floor(n * {p}) THEN greatest(floor(n * {p}), 1) ELSE floor(n * {p}) + 1 END THEN v END)"
        f" + max(CASE WHEN rn = CASE WHEN n * {p} = floor(n * {p}) THEN least(floor(n * {p}) + 1, n) ELSE floor(n * {p}) + 1 END THEN v END)) / 2"
    )


def _percent_text(n: str, share: str) -> str:
    return (
        f"CAST({n} AS VARCHAR) || ' (' || CASE WHEN {share} * 100 >= 10 THEN printf('%.0f%%', {S.half_even(share + ' * 100', 0)}) "
        f"WHEN {share} * 100 >= 0.1 THEN printf('%.1f%%', {S.half_even(share + ' * 100', 1)}) WHEN {share} > 0 THEN '<0.1%' ELSE '0%' END || ')'"
    )


@query(
    "baseline_summary_by_group",
    f"""
WITH x AS (SELECT c_mktsegment AS arm, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_totalprice END AS price,
                  c_acctbal AS balance, CASE WHEN o_orderstatus = 'P' AND c_mktsegment = 'BUILDING' THEN 'only here' ELSE nullif(o_orderstatus, 'P') END AS status, o_orderpriority AS priority
           FROM orders JOIN customer ON o_custkey = c_custkey),
c AS (SELECT 'status' AS variable, status AS level, arm FROM x UNION ALL SELECT 'priority', priority, arm FROM x),
k AS (SELECT l.variable, l.level, a.arm, count(c.variable) AS n FROM (SELECT DISTINCT variable, level FROM c WHERE level IS NOT NULL) l
      CROSS JOIN (SELECT DISTINCT arm FROM c) a LEFT JOIN c ON c.variable = l.variable AND c.level = l.level AND c.arm = a.arm GROUP BY ALL),
s AS (SELECT *, n / sum(n) OVER (PARTITION BY variable, arm) AS share FROM k),
v AS (SELECT 'price' AS variable, arm, price AS v FROM x WHERE price IS NOT NULL
      UNION ALL SELECT 'balance', arm, balance FROM x WHERE balance IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY variable, arm ORDER BY v) AS rn, count(*) OVER (PARTITION BY variable, arm) AS n FROM v),
q AS (SELECT variable, arm, max(n) AS n, {_type2(0.25)} AS p25, {_type2(0.5)} AS median, {_type2(0.75)} AS p75 FROM r GROUP BY ALL)
SELECT variable, level, arm, n, round(share, 8) AS share, NULL::DOUBLE AS median, NULL::DOUBLE AS p25, NULL::DOUBLE AS p75,
       {_percent_text("n", "share")} AS text FROM s
UNION ALL
SELECT variable, NULL, arm, n, NULL, round(median, 6), round(p25, 6), round(p75, 6),
       printf('%.1f (%.1f, %.1f)', {S.half_even("median", 1)}, {S.half_even("p25", 1)}, {S.half_even("p75", 1)}) FROM q""",
)
def baseline_summary_by_group(t: Tables):
    x = left_join(t.orders, t.customer, [("o_custkey", "c_custkey")], na_match=False).select(
        F.col("c_mktsegment").alias("arm"),
        F.when(F.col("o_orderkey") % 11 != 0, F.col("o_totalprice")).alias("price"),
        F.col("c_acctbal").alias("balance"),
        F.when((F.col("o_orderstatus") == "P") & (F.col("c_mktsegment") == "BUILDING"), "only here")
        .otherwise(missing.na_if("o_orderstatus", "P"))
        .alias("status"),
        F.col("o_orderpriority").alias("priority"),
    )
    table = baseline_summary(x, "arm", ["price", "balance"], ["status", "priority"])
    rounded = {"share": F.round("share", 8), **{c: F.round(c, 6) for c in ("median", "p25", "p75")}}
    return table.withColumns(rounded)


@query(
    "share_within_group",
    f"""
WITH g AS (SELECT user_id % 20 AS study, event_type, count(DISTINCT user_id) AS n FROM events GROUP BY ALL),
s AS (SELECT *, CAST(sum(n) OVER (PARTITION BY study) AS BIGINT) AS total_n FROM g),
r AS (SELECT study, CAST(row_number() OVER (ORDER BY total_n, study) AS INTEGER) AS group_rank FROM (SELECT DISTINCT study, total_n FROM s))
SELECT s.study, event_type, n, total_n, round(n / total_n, 8) AS prop, group_rank FROM s JOIN r USING (study)""",
)
def share_within_group(t: Tables):
    counts = t.events.groupBy((F.col("user_id") % 20).alias("study"), "event_type").agg(A.n_distinct("user_id").alias("n"))
    return share_within(counts, ["study"]).withColumn("prop", F.round("prop", 8))


@query(
    "two_stage_count",
    f"""
SELECT n_rows, count(*) AS n_users FROM (SELECT user_id, count(*) AS n_rows FROM events WHERE value > 50 GROUP BY user_id)
GROUP BY n_rows ORDER BY n_users DESC, n_rows""",
)
def two_stage_count(t: Tables):
    per_user = t.events.filter("value > 50").groupBy("user_id").agg(A.n_rows().alias("n_rows"))
    return sorted_report(per_user.groupBy("n_rows").agg(A.n_rows().alias("n_users")), ["n_users"], ["n_rows"])
