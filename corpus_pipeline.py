"""A training corpus from raw documents: each stage reads what the one before has written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortmill.llm.decontaminate import decontaminate
from cohortmill.llm.linededup import dedup_lines
from cohortmill.llm.mixing import Targets, mix_sources
from cohortmill.llm.quality import keep_good
from cohortmill.llm.queries import LANGS, MIX_TOPICS, SOURCES, table
from cohortmill.llm.simhash import drop_near_duplicates
from cohortmill.llm.staging import new_folder


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return keep_good(docs, train_rows=8_000)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten documents or more go from every document; n_chars follows the text."""
    out = dedup_lines(docs, min_docs=10, min_chars=1).select(*docs.columns)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return drop_near_duplicates(docs, size=3, bits=2)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"), size=5, share=0.8)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str, sources: Targets = SOURCES, langs: Targets = LANGS, topics: Targets = MIX_TOPICS) -> DataFrame:
    """A sample of the documents whose tokens meet the target shares; ``copies`` says how often a document is in it.

    Sources, languages and topics without a target keep their share of the tokens.
    """
    return mix_sources(docs, sources, langs, topics, rounds=50, seed=42).where("copies > 0")


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("simhash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("source mixing", mixing),
]
#: Learned weights and SimHash have no SQL form; tests compare each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written in the shared folder before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        folder = new_folder(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return docs
