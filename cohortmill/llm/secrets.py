"""Secret scans with DataFrame functions alone: pattern spans, then who owns the values found."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortmill.llm.staging import stage

#: Kinds in the order in which spans are listed, each with its pattern and the least length of its value.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE = [("assign", ASSIGN, 6), ("access", "AKIA[A-Z0-9]+", 20), ("hex", "[0-9a-f]{24,}", 24)]
KINDS = ["assign", "access", "hex", "live", "example"]


def matches(text: Column, rank: int, kind: str, pattern: str) -> Column:
    """The leftmost matches that do not overlap, as an array of structs, each with the length of the text before it.

    The texts between matches come from a split; start positions are running sums over both, taken after the array is exploded.
    """
    hit = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.filter(F.arrays_zip(F.split(text, pattern, -1).alias("gap"), hit.alias("hit")), lambda x: x["hit"].isNotNull())

    def entry(x: Column, i: Column) -> Column:
        value = F.regexp_extract(x["hit"], pattern, 2) if kind == "assign" else x["hit"]
        return F.struct(F.lit(rank).alias("rank"), i.alias("turn"), F.length(x["gap"]).alias("gap"), F.length(x["hit"]).alias("size"), value.alias("value"))

    none = F.array().cast("array<struct<rank:int,turn:int,gap:int,size:int,value:string>>")
    return F.when(text.rlike(pattern), F.transform(pairs, entry)).otherwise(none)


def base_spans(docs: DataFrame, id: str, text: str, owner: str) -> DataFrame:
    """(k1, k2, owner, rank, start, end, value) of every base span. k1 and k2 are hashes of id and text; repeated rows count once."""
    own = docs.select(F.xxhash64(F.col(id)).alias("k1"), F.xxhash64(F.col(text)).alias("k2"), F.col(owner).cast("string").alias("owner"), F.col(text).alias("text"))
    found = F.concat(*[matches(F.col("text"), k, *kind[:2]) for k, kind in enumerate(BASE)])
    hits = own.select("k1", "k2", "owner", F.explode(found).alias("x")).select("k1", "k2", "owner", "x.*")
    once = hits.groupBy("k1", "k2", "rank", "turn").agg(F.min("owner").alias("owner"), F.first("gap").alias("gap"), F.first("size").alias("size"), F.first("value").alias("value"))
    so_far = Window.partitionBy("k1", "k2", "rank").orderBy("turn")
    placed = once.withColumn("end", F.sum(F.col("gap").cast("long") + F.col("size")).over(so_far)).withColumn("start", F.col("end") - F.col("size"))
    least = F.element_at(F.array(*[F.lit(n) for _, _, n in BASE]), F.col("rank") + 1)
    return placed.where(F.length("value") >= least).select("k1", "k2", "owner", "rank", "start", "end", "value")


def ownership(spans: DataFrame) -> DataFrame:
    """(value_hash, repositories, owners): in how many distinct documents and of how many distinct owners a value is found.

    Counted in steps, each with partial sums before its shuffle, so a value that a third of all rows hold does not meet in one task.
    """
    of_owner = spans.groupBy("value_hash", "owner", "k1", "k2").agg(F.lit(1).alias("one")).groupBy("value_hash", "owner").agg(F.count(F.lit(1)).alias("n"))
    return of_owner.groupBy("value_hash").agg(F.sum("n").alias("repositories"), F.count("owner").alias("owners"))


def spread(value: Column) -> Column:
    """How evenly a value uses its characters: their entropy over the most that so many characters, or 16, can have."""
    n = F.length(value).cast("double")
    times = F.transform(F.array_distinct(F.split(value, "")), lambda c: (F.length(value) - F.length(F.replace(value, c, F.lit("")))).cast("double"))
    bits = F.log2(n) - F.aggregate(F.array_sort(times), F.lit(0.0), lambda a, k: a + k * F.log2(k)) / n
    return F.round(bits / F.log2(F.least(n, F.lit(16.0))), 6)


def listed(spans: Column) -> Column:
    """kind:start:end, in order of start and then of kind, joined by commas."""
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.sort_array(spans), lambda x: F.concat_ws(":", F.get(name, x["rank"]), x["start"], x["end"])), ",")


def scan_secrets(docs: DataFrame, id: str = "doc_id", text: str = "text", owner: str = "source", min_owners: int = 3, min_repositories: int = 20, most_repositories: int = 5, min_spread: float = 0.65) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example) for each row of ``docs``.

    A document is a repository. A base value found with at least ``min_owners`` owners, or in at least ``min_repositories`` distinct
    repositories whoever owns them, is a widely copied example. One found in at most ``most_repositories``, with one owner or none known,
    whose characters are spread like those of a secret, is a live-looking credential of its owner. Both add a span over the value (once where several base
    spans hold the same value); other values add none. NULL texts are empty; a row without spans has zero counts and empty text in
    spans; a NULL owner counts as no owner; repeated rows get equal results and count once; an empty table gives an empty result.
    Only the three columns named are read.
    """
    spans = stage(base_spans(docs, id, text, owner).withColumn("value_hash", F.sha2("value", 256)).withColumn("random", spread(F.col("value")) >= min_spread).withColumn("from", F.col("end") - F.length("value")).drop("value"), "spans")
    example = (F.col("owners") >= min_owners) | (F.col("repositories") >= min_repositories)
    own = (F.col("owners") <= 1) & (F.col("repositories") <= most_repositories)
    known = spans.join(ownership(spans).select("value_hash", example.alias("example"), own.alias("own")), "value_hash")
    extra = known.where("example OR (own AND random)").select("k1", "k2", F.when(F.col("example"), F.lit(4)).otherwise(F.lit(3)).alias("rank"), F.col("from").alias("start"), "end").distinct()
    every = known.select("k1", "k2", "rank", "start", "end").unionByName(extra)
    entry = F.struct("start", "rank", "end")

    def count(rank: int) -> Column:
        return F.count_if(F.col("rank") == rank)

    per_text = every.groupBy("k1", "k2").agg(
        *[count(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)],
        F.collect_list(F.when(F.col("rank") < len(BASE), entry)).alias("base"),
        F.collect_list(entry).alias("every"),
    ).select("k1", "k2", *[f"n_{k}" for k in KINDS], listed(F.col("base")).alias("base_spans"), listed(F.col("every")).alias("spans"))
    rows = docs.select(F.col(id).alias("doc_id"), F.xxhash64(F.col(id)).alias("k1"), F.xxhash64(F.col(text)).alias("k2"))
    met = rows.join(per_text, ["k1", "k2"], "left")
    number = {k: F.coalesce(F.col(f"n_{k}"), F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS}
    text_of = {c: F.coalesce(F.col(c), F.lit("")) for c in ("base_spans", "spans")}
    return met.select("doc_id", *[number[k] for k in KINDS[:3]], F.sha2(text_of["base_spans"], 256).alias("base_sha256"), text_of["spans"].alias("spans"), number["live"], number["example"])
