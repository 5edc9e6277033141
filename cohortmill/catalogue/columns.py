"""Column work: recoding, missing values, text, numbers, bands, arrays."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortmill.catalogue import Tables, query
from cohortmill.catalogue import sqltext as S
from cohortmill.functions import bands, missing, recode, text
from cohortmill.operators.aggregates import n_rows

LADDER_SQL = """
SELECT o_orderkey,
       CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '1-URGENT' THEN NULL
            WHEN o_orderstatus = 'P' THEN 'PENDING'
            WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'EXPEDITED'
            WHEN o_orderstatus = 'F' AND o_totalprice > 250000 THEN 'LARGE DONE'
            ELSE o_orderstatus END AS order_class,
       CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '1-URGENT' THEN 'held'
            WHEN o_orderstatus = 'P' THEN 'pending'
            WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'expedited'
            WHEN o_orderstatus = 'F' AND o_totalprice > 250000 THEN 'large'
            ELSE 'default' END AS rule
FROM orders"""


@query("recode_case_ladder", LADDER_SQL)
def recode_case_ladder(t: Tables):
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    rules = [
        recode.Rule("held", (status == "P") & (priority == "1-URGENT"), F.lit(None).cast("string")),
        recode.Rule("pending", status == "P", "PENDING"),
        recode.Rule("expedited", priority.isin("1-URGENT", "2-HIGH"), "EXPEDITED"),
        recode.Rule("large", (status == "F") & (F.col("o_totalprice") > 250000), "LARGE DONE"),
    ]
    return t.orders.select(
        "o_orderkey",
        recode.first_match(rules, default=status).alias("order_class"),
        recode.first_match_name(rules).alias("rule"),
    )


TYPE_GROUPS = {"Compact": ["SMALL", "ECONOMY"], "Regular": ["STANDARD", "MEDIUM"], "Big": ["LARGE"]}
TYPE_NAMES = recode.invert_groups(TYPE_GROUPS)


@query(
    "recode_lookup_passthrough",
    f"""
SELECT p_partkey, {S.case_map("p_type", TYPE_NAMES, "p_type")} AS kept,
       {S.case_map("p_type", TYPE_NAMES)} AS strict,
       {S.case_map("nullif(p_type, 'SMALL')", TYPE_NAMES, "'Unclassified'")} AS with_default
FROM part""",
)
def recode_lookup_passthrough(t: Tables):
    return t.part.select(
        "p_partkey",
        recode.lookup_or_keep("p_type", TYPE_NAMES).alias("kept"),
        recode.lookup("p_type", TYPE_NAMES).alias("strict"),
        recode.lookup(missing.na_if("p_type", "SMALL"), TYPE_NAMES, default="Unclassified").alias("with_default"),
    )


@query(
    "if_else_null_condition",
    """
SELECT flag, count(*) AS n FROM (
  SELECT CASE WHEN v < 250000 THEN '< 250k' WHEN NOT v < 250000 THEN '≥ 250k' END AS flag
  FROM (SELECT CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS v FROM orders)) GROUP BY flag""",
)
def if_else_null_condition(t: Tables):
    value = F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice"))
    return t.orders.groupBy(missing.if_else(value < 250000, "< 250k", "≥ 250k").alias("flag")).agg(n_rows().alias("n"))


@query(
    "null_normalise_fill",
    """
SELECT c_custkey, nullif(c_mktsegment, 'MACHINERY') AS segment,
       coalesce(nullif(c_mktsegment, 'MACHINERY'), 'No data') AS filled,
       nullif(trim(regexp_replace(CASE WHEN c_nationkey < 5 THEN '  ' ELSE ' ' || c_name || '  x ' END,
              '\\s+', ' ', 'g')), '') AS squished,
       coalesce(nullif(c_mktsegment, 'MACHINERY'), c_name) AS preferred,
       CASE WHEN c_nationkey = 0 THEN '' ELSE CAST(c_nationkey AS VARCHAR) END AS blank_zero
FROM customer""",
)
def null_normalise_fill(t: Tables):
    segment = missing.na_if("c_mktsegment", "MACHINERY")
    spaced = F.when(F.col("c_nationkey") < 5, "  ").otherwise(F.concat(F.lit(" "), "c_name", F.lit("  x ")))
    return t.customer.select(
        "c_custkey",
        segment.alias("segment"),
        missing.replace_na(segment, "No data").alias("filled"),
        missing.na_if(text.squish(spaced), "").alias("squished"),
        missing.prefer(segment, "c_name").alias("preferred"),
        missing.blank_when_zero("c_nationkey").alias("blank_zero"),
    )


@query(
    "regex_class_ladder",
    f"""
WITH x AS (SELECT p_partkey, {S.normal_label("'  ' || replace(p_name, ' ', CASE p_size % 3 WHEN 0 THEN ' – ' WHEN 1 THEN '  ' ELSE '-' END)")} AS label FROM part)
SELECT p_partkey, label,
       CASE WHEN label = 'RED WIDGET' THEN 'Red widget, exact'
            WHEN regexp_matches(label, 'RED\\s*-?\\s*WIDGET') THEN 'Red widget'
            WHEN regexp_matches(label, 'SMALL|LARGE') AND regexp_matches(label, 'BOLT') THEN 'Sized bolt'
            WHEN regexp_matches(label, 'BOLT|ROD') THEN 'Metal' END AS part_class
FROM x""",
)
def regex_class_ladder(t: Tables):
    gap = F.when(F.col("p_size") % 3 == 0, " – ").when(F.col("p_size") % 3 == 1, "  ").otherwise("-")
    raw = F.concat(F.lit("  "), F.replace("p_name", F.lit(" "), gap))
    label = F.col("label")
    rules = [
        recode.Rule("exact", label == "RED WIDGET", "Red widget, exact"),
        recode.Rule("red", text.contains(label, r"RED\s*-?\s*WIDGET"), "Red widget"),
        recode.Rule("sized", text.contains(label, "SMALL", "LARGE") & text.contains(label, "BOLT"), "Sized bolt"),
        recode.Rule("metal", text.contains(label, "BOLT", "ROD"), "Metal"),
    ]
    return t.part.select("p_partkey", text.normalise_label(raw).alias("label")).withColumn(
        "part_class", recode.first_match(rules)
    )


@query(
    "title_case",
    """
WITH x AS (SELECT event_id, upper(event_type) || CASE event_id % 3 WHEN 0 THEN ' FOLLOW-UP' WHEN 1 THEN ' to 3rd DAY'
                  ELSE ' PATIENT''S visit' END AS label FROM events)
SELECT event_id, array_to_string(list_transform(regexp_extract_all(label,
         '([\\p{L}\\p{M}\\p{N}_]+(?:[''’.:][\\p{L}\\p{M}\\p{N}_]+)*|[^\\p{L}\\p{M}\\p{N}_]+)', 1),
         lambda p: upper(p[1]) || lower(p[2:])), '') AS title
FROM x""",
)
def title_case(t: Tables):
    ending = (
        F.when(F.col("event_id") % 3 == 0, " FOLLOW-UP").when(F.col("event_id") % 3 == 1, " to 3rd DAY")
    ).otherwise(" PATIENT'S visit")
    return t.events.select(
        "event_id", text.title_case(F.concat(F.upper("event_type"), ending)).alias("title")
    )


CORE, PARTNER = ["red", "blue", "hot"], ["bolt", "gear", "rod"]


@query(
    "array_components_class",
    f"""
WITH x AS (SELECT p_partkey, CASE WHEN p_size > 45 THEN [CAST(NULL AS VARCHAR)] ELSE string_split(p_name, ' ') END AS words
           FROM part),
y AS (SELECT p_partkey, words, len(list_filter(words, lambda w: w IS NOT NULL)) = 0 AS none,
             len(list_filter(words, lambda w: {S.in_list("w", CORE)})) > 0 AS core,
             len(list_filter(words, lambda w: {S.in_list("w", PARTNER)})) > 0 AS partner FROM x)
SELECT p_partkey, CAST(len(words) AS INTEGER) AS n_words,
       CASE WHEN none THEN 'Unknown' WHEN core AND partner THEN 'Both' ELSE 'Not both' END AS word_class
FROM y""",
)
def array_components_class(t: Tables):
    words = F.when(F.col("p_size") > 45, F.array(F.lit(None).cast("string"))).otherwise(F.split("p_name", " "))
    rules = [
        recode.Rule("none", recode.all_missing("words"), "Unknown"),
        recode.Rule("both", recode.any_in("words", CORE) & recode.any_in("words", PARTNER), "Both"),
    ]
    return t.part.select("p_partkey", words.alias("words")).select(
        "p_partkey", F.size("words").alias("n_words"), recode.first_match(rules, "Not both").alias("word_class")
    )


@query(
    "composite_keys",
    """
WITH x AS (SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') AS seg FROM customer)
SELECT c_custkey, coalesce(seg, 'NA') || ' ' || CAST(c_custkey AS VARCHAR) AS pasted,
       coalesce(seg, 'NA') || CAST(c_custkey AS VARCHAR) AS pasted0,
       seg || CAST(c_custkey AS VARCHAR) AS joined, seg || '/' || CAST(c_custkey AS VARCHAR) AS joined_sep
FROM x""",
)
def composite_keys(t: Tables):
    x = t.customer.select("c_custkey", missing.na_if("c_mktsegment", "BUILDING").alias("seg"))
    return x.select(
        "c_custkey",
        missing.paste("seg", "c_custkey").alias("pasted"),
        missing.paste0("seg", "c_custkey").alias("pasted0"),
        missing.str_c("seg", "c_custkey").alias("joined"),
        missing.str_c("seg", "c_custkey", sep="/").alias("joined_sep"),
    )


RAW_NUMBER = ["12", " 12 ", "1e2", "1d", "NA", "", "abc", "-0.5", "7.", "NaN"]


@query(
    "numeric_coercion",
    f"""
WITH x AS (SELECT event_id, {S.pick(RAW_NUMBER, "event_id % 11")} AS raw, value FROM events),
y AS (SELECT raw, {S.number("raw")} AS num, value FROM x)
SELECT raw, num, count(*) AS n, count(num) AS n_parsed, round(avg(value + num), 4) AS mean_sum FROM y GROUP BY raw, num""",
)
def numeric_coercion(t: Tables):
    raw = F.try_element_at(F.array(*[F.lit(v) for v in RAW_NUMBER]), (F.col("event_id") % 11 + 1).cast("int"))
    rows = t.events.select(raw.alias("raw"), "value").withColumn("num", missing.as_number("raw"))
    return rows.groupBy("raw", "num").agg(
        n_rows().alias("n"),
        F.count("num").alias("n_parsed"),
        F.round(F.avg(F.col("value") + F.col("num")), 4).alias("mean_sum"),
    )


@query(
    "clean_names_project",
    """
SELECT s_suppkey AS supplier_id, s_name AS supplier_name, s_acctbal AS acct_bal_percent,
       'SUPPLIER' AS origin, s_acctbal + 1 AS balance_plus, (s_acctbal + 1) * 2 AS balance_twice
FROM supplier""",
)
def clean_names_project(t: Tables):
    raw = t.supplier.withColumnsRenamed(
        {"s_suppkey": "Supplier ID", "s_name": "SupplierName", "s_acctbal": "acctBal %"}
    )
    return (
        text.clean_names(raw.drop("s_nationkey"))
        .withColumn("origin", F.lit("SUPPLIER"))
        .withColumn("balance_plus", F.col("acct_bal_percent") + 1)
        .withColumn("balance_twice", F.col("balance_plus") * 2)
    )


@query(
    "day_rebase_bands",
    f"""
WITH x AS (SELECT event_id, CAST((date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) * 2 + 1)
                  + CASE WHEN event_id % 20 = 0 THEN 0.5 ELSE 0 END AS DOUBLE) AS day FROM events)
SELECT event_id, day, CAST({S.case_bands("day", bands.WEEK_BANDS)} AS INTEGER) AS week,
       {S.case_bands("day", bands.FOLLOW_UP_BANDS)} AS follow_up,
       {S.band_rank("day", bands.FOLLOW_UP_BANDS)} AS follow_up_rank
FROM x""",
)
def day_rebase_bands(t: Tables):
    first = F.datediff(F.to_date("ts"), F.lit("2024-01-01")) * 2
    day = (first + 1 + F.when(F.col("event_id") % 20 == 0, 0.5).otherwise(0.0)).cast("double")
    return t.events.select("event_id", day.alias("day")).select(
        "event_id",
        "day",
        bands.nominal_week("day").alias("week"),
        bands.band_label("day", bands.FOLLOW_UP_BANDS).alias("follow_up"),
        bands.band_rank("day", bands.FOLLOW_UP_BANDS).alias("follow_up_rank"),
    )


@query(
    "value_bands_ranked",
    f"""
WITH x AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' AND o_orderkey % 5 = 0 THEN NULL
                  WHEN o_orderkey % 7 = 0 THEN 0 ELSE o_totalprice * 3 END AS density,
                  CAST(o_custkey % 60 AS DOUBLE) AS age FROM orders)
SELECT o_orderkey, {S.case_bands("density", bands.DENSITY_BANDS)} AS density_band,
       {S.band_rank("density", bands.DENSITY_BANDS)} AS density_rank,
       replace({S.case_bands("density", bands.DENSITY_BANDS)}, '500,000-499,999', '500,000-999,999') AS corrected,
       {S.case_bands("age", bands.AGE_BANDS)} AS age_group, {S.band_rank("age", bands.AGE_BANDS)} AS age_rank,
       CASE WHEN age < 5 THEN '<5y' ELSE '5y >' END AS age_5,
       CASE WHEN density = 0 THEN '0 ~ Negative' WHEN density > 0 THEN '≥1 ~ Positive'
            ELSE 'No data/Not measured' END AS detected
FROM x""",
)
def value_bands_ranked(t: Tables):
    status, key = F.col("o_orderstatus"), F.col("o_orderkey")
    density = F.when((status == "P") & (key % 5 == 0), None).when(key % 7 == 0, 0.0).otherwise(F.col("o_totalprice") * 3)
    x = t.orders.select("o_orderkey", density.alias("density"), (F.col("o_custkey") % 60).cast("double").alias("age"))
    return x.select(
        "o_orderkey",
        bands.density_band("density").alias("density_band"),
        bands.band_rank("density", bands.DENSITY_BANDS).alias("density_rank"),
        bands.density_band("density", corrected=True).alias("corrected"),
        bands.band_label("age", bands.AGE_BANDS).alias("age_group"),
        bands.band_rank("age", bands.AGE_BANDS).alias("age_rank"),
        missing.if_else(F.col("age") < 5, "<5y", "5y >").alias("age_5"),
        bands.detection_status("density").alias("detected"),
    )
