"""Reading, staging and writing, as round trips over the shared tables.

The files go to a fresh folder under the session's shared folder.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Observation, functions as F

from cohortmill.catalogue import Tables, query
from cohortmill.sources.files import coercion_report, export, normalise_domain, read_latin1, read_lookup, read_table, shared_folder, stage, write_csv


def _folder(t: Tables) -> str:
    return f"{shared_folder(t.spark)}/catalogue-{uuid.uuid4().hex}"


@query(
    "csv_latin1_roundtrip",
    """
SELECT c_custkey AS id, CASE WHEN c_nationkey % 5 = 0 THEN NULL ELSE 'Côte ' || c_name || ' é' END AS name,
       CASE WHEN c_nationkey % 7 = 0 THEN NULL ELSE c_acctbal END AS balance, c_mktsegment AS segment FROM customer""",
)
def csv_latin1_roundtrip(t: Tables):
    nation = F.col("c_nationkey")
    rows = t.customer.select(
        F.col("c_custkey").alias("id"),
        F.when(nation % 5 != 0, F.concat(F.lit("Côte "), "c_name", F.lit(" é"))).alias("name"),
        F.when(nation % 7 != 0, F.col("c_acctbal")).alias("balance"),
        F.col("c_mktsegment").alias("segment"),
    )
    folder = _folder(t)
    write_csv(rows, folder, "ISO-8859-1")
    return read_latin1(t.spark, folder, "id long, name string, balance double, segment string")


@query(
    "csv_missing_policies",
    """
SELECT p_partkey AS id, CASE WHEN p_size % 4 = 0 THEN NULL WHEN p_size % 4 = 1 THEN '' ELSE p_name END AS kept,
       CASE WHEN p_size % 4 < 2 THEN NULL ELSE p_name END AS nulled FROM part""",
)
def csv_missing_policies(t: Tables):
    size = F.col("p_size") % 4
    rows = t.part.select(F.col("p_partkey").alias("id"), F.when(size == 1, "").when(size > 1, F.col("p_name")).alias("text"))
    folder = _folder(t)
    write_csv(rows, folder)
    schema = "id long, text string"
    kept = read_table(t.spark, folder, schema, na_policy="na_only").withColumnRenamed("text", "kept")
    nulled = read_table(t.spark, folder, schema, na_policy="na_and_empty").withColumnRenamed("text", "nulled")
    return kept.join(nulled, "id")


@query(
    "csv_by_name",
    "SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance FROM customer",
)
def csv_by_name(t: Tables):
    """Two files with their columns in different orders, one of them with a column nobody declares."""
    rows = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), "c_mktsegment")
    one, two = _folder(t), _folder(t)
    write_csv(rows.filter("id % 2 = 0").select("balance", "id", "name"), one)
    write_csv(rows.filter("id % 2 = 1").select("c_mktsegment", "name", "id", "balance"), two)
    return read_table(t.spark, [one, two], "id long, name string, balance double")


QUOTED = r"""concat('"', doc_id, '", \\ "" ', text, '\\')"""


@query("csv_quoted_text", r"""SELECT doc_id AS id, concat('"', doc_id, '", \ "" ', text, '\') AS body, lang FROM documents""")
def csv_quoted_text(t: Tables):
    """Quotes, commas, backslashes and line breaks come back as they were."""
    rows = t.documents.select(F.col("doc_id").alias("id"), F.expr(QUOTED).alias("body"), "lang")
    folder = _folder(t)
    write_csv(rows, folder)
    return read_table(t.spark, folder, "id long, body string, lang string", multiline=True)


@query(
    "analysis_extract",
    "SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus FROM orders WHERE o_orderstatus <> 'P' AND o_totalprice > 100000",
)
def analysis_extract(t: Tables):
    rows = t.orders.filter("o_orderstatus <> 'P' AND o_totalprice > 100000")
    staged = stage(rows.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus"), _folder(t))
    folder = _folder(t)
    export(staged, folder)
    return t.spark.read.parquet(folder)


@query(
    "domain_normalised",
    "SELECT CAST(l_suppkey AS VARCHAR) AS studyid, CAST(l_orderkey AS VARCHAR) AS usubjid, l_linenumber AS seq, l_quantity AS vsstresn FROM lineitem",
)
def domain_normalised(t: Tables):
    raw = t.lineitem.select(
        F.col("l_suppkey").cast("string").alias("STUDYID"),
        F.col("l_orderkey").cast("string").alias("USUBJID"),
        F.lit("VS").alias("DOMAIN"),
        F.col("l_linenumber").alias("VSSEQ"),
        F.col("l_quantity").alias("VSSTRESN"),
    )
    return normalise_domain(raw, "VS")


@query(
    "lookup_table",
    "SELECT DISTINCT CAST(c_nationkey AS VARCHAR) AS study_id, nullif(c_mktsegment, 'BUILDING') AS country_name FROM customer",
)
def lookup_table(t: Tables):
    segment = F.nullif("c_mktsegment", F.lit("BUILDING"))
    rows = t.customer.select(F.col("c_nationkey").cast("string").alias("StudyID"), segment.alias("Country name")).distinct()
    folder = _folder(t)
    write_csv(rows, folder)
    return read_lookup(t.spark, folder, "StudyID string, `Country name` string")


@query(
    "coercion_report",
    """
SELECT field, (SELECT count(*) FROM customer) AS n_rows, n_rejected FROM (
    SELECT 'balance' AS field, count(*) FILTER (WHERE c_custkey % 7 = 0 AND c_custkey % 3 <> 0) AS n_rejected FROM customer
    UNION ALL SELECT 'nation', count(*) FILTER (WHERE c_custkey % 11 = 0) FROM customer
    UNION ALL SELECT NULL, 0)""",
)
def coercion_report_query(t: Tables):
    """Words in number columns, counted while the file is read; NA and empty text are missing and not lost."""
    key = F.col("c_custkey")
    balance = F.when(key % 3 == 0, F.lit(None)).when(key % 7 == 0, "not done").otherwise(F.col("c_acctbal").cast("string"))
    nation = F.when(key % 11 == 0, "12,5").when(key % 5 == 0, "").otherwise(F.col("c_nationkey").cast("string"))
    folder = _folder(t)
    write_csv(t.customer.select(key.alias("id"), balance.alias("balance"), nation.alias("nation")), folder)
    rejected = Observation()
    stage(read_table(t.spark, folder, "id long, balance double, nation int", rejected=rejected), _folder(t))
    return coercion_report(t.spark, rejected).filter("field IS NULL OR field <> 'id'")
