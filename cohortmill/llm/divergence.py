"""How the sources of a language differ in their words: all pairs of sources, and the words that mark each source.

A word's score depends only on how often its group and its language use it. So words are first counted by these two
numbers: scores are worked out and ranked per such cell, with the number of words in it, and only the cells that reach the
ranks asked for are opened up into words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortmill.llm.staging import stage
from cohortmill.llm.words import BASE, U, blocks, mix

#: A term is a run of letters A to Z and of characters beyond ASCII.
BETWEEN = np.ones(256, bool)
BETWEEN[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
ONE = 1_000_000_000
#: Rows of counts that a task gathers before it sums them up, and counts that a task compares at a time.
MOST_ROWS = 2_000_000
MOST_CELLS = 250_000
#: Sources compared with all others in one task.
PANEL = 512

COUNTS = "lang string, source string, term string, n long, n_docs long"


def _block_counts(rows: pa.RecordBatch, words) -> pa.Table:
    """(lang, source, term, n, n_docs) of a block of texts."""
    lang, source = (pc.dictionary_encode(rows.column(k).fill_null("")) for k in (0, 1))
    group = lang.indices.to_numpy(zero_copy_only=False).astype(np.int64) * max(1, len(source.dictionary)) + source.indices.to_numpy(zero_copy_only=False)
    text, hashes = words.text_of, words.hashes()
    _, first, n = np.unique(mix(hashes + (text + 1).astype(U) * BASE), return_index=True, return_counts=True)
    of = group[text[first]]
    _, one, cell = np.unique(mix(hashes[first] + (of + 1).astype(U) * BASE), return_index=True, return_inverse=True)
    at = text[first[one]]
    columns = [rows.column(0).fill_null("").take(pa.array(at)), rows.column(1).fill_null("").take(pa.array(at)), words.strings(first[one])]
    return pa.table([*columns, np.bincount(cell, n, len(one)).astype(np.int64), np.bincount(cell, minlength=len(one))], names=["lang", "source", "term", "n", "n_docs"])


def _summed(tables: list[pa.Table]) -> Iterator[pa.RecordBatch]:
    keys = ["lang", "source", "term"]
    out = pa.concat_tables(tables).group_by(keys).aggregate([("n", "sum"), ("n_docs", "sum")])
    yield from out.rename_columns({"n_sum": "n", "n_docs_sum": "n_docs"}).select([*keys, "n", "n_docs"]).to_batches(max_chunksize=100_000)


def term_counts(docs: DataFrame, text: str, lang: str, source: str) -> DataFrame:
    """(lang, source, term, n, n_docs) summed within each task; the same words come from other tasks too."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered: list[pa.Table] = []
        for rows, words in blocks(batches, "text", space=BETWEEN, lower=True):
            if len(words):
                gathered.append(_block_counts(rows, words))
            if sum(t.num_rows for t in gathered) > MOST_ROWS:
                yield from _summed(gathered)
                gathered = []
        if gathered:
            yield from _summed(gathered)

    named = docs.select(F.col(lang).cast("string").alias("lang"), F.col(source).cast("string").alias("source"), F.col(text).alias("text"))
    return named.mapInArrow(counted, COUNTS)


def kept_terms(docs: DataFrame, text: str, lang: str, source: str, min_docs: int) -> DataFrame:
    """(lang, term, lang_n, uses) of the terms in at least ``min_docs`` documents of the language, staged.

    ``uses`` has the count of each source that uses the term. The counts move once, to the task of their language and term.
    """
    dealt = term_counts(docs, text, lang, source).repartition("lang", "term")
    per_source = dealt.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("n_docs").alias("n_docs"))
    per_term = per_source.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("n_docs").alias("n_docs"), F.collect_list(F.struct("source", "n")).alias("uses"))
    return stage(per_term.where(F.col("n_docs") >= min_docs).drop("n_docs"), "terms")


def group_totals(docs: DataFrame, terms: DataFrame, lang: str, source: str) -> DataFrame:
    """(lang, source, n_terms, lang_total, total) of every group of documents, staged; a group without terms has zeros."""
    named = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(to) for c, to in ((lang, "lang"), (source, "source"))]).distinct()
    per_lang = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("n_terms"), F.sum("lang_n").alias("lang_total"))
    per_group = opened(terms).groupBy("lang", "source").agg(F.sum("n").alias("total"))
    met = named.join(per_lang, "lang", "left").join(per_group, ["lang", "source"], "left")
    return stage(met.na.fill(0, ["n_terms", "lang_total", "total"]), "groups")


def opened(terms: DataFrame) -> DataFrame:
    """A row per (lang, source, term) with its two counts."""
    return terms.select("lang", "term", "lang_n", F.explode("uses").alias("use")).select("lang", "use.source", "term", "lang_n", "use.n")


def share(n: Column, total: Column, n_terms: Column) -> Column:
    """The smoothed share of a count, in billionths, exact however large the count."""
    part = F.lit(ONE).cast("decimal(10,0)") * (n + 2).cast("decimal(20,0)")
    return F.lit(1) + F.call_function("div", part, (total + 2 * n_terms).cast("decimal(20,0)"))


def marking_terms(terms: DataFrame, groups: DataFrame, top: int) -> DataFrame:
    """(lang, source, item, value, rank): the terms that a source uses more than its language does, by how far apart the shares are.

    Scores are per cell of (group count, language count). Cells of one score are taken together, and the best ``top`` scores of a
    group hold its best ``top`` terms; the scores before which ``top`` terms stand already are left out, and the rest is opened up.
    """
    by = ["lang", "source"]
    cell = [*by, "n", "lang_n"]
    sizes = opened(terms).groupBy(*cell).agg(F.count(F.lit(1)).alias("size"))
    p, q = share(F.col("n"), F.col("total"), F.col("n_terms")), share(F.col("lang_n"), F.col("lang_total"), F.col("n_terms"))
    told = sizes.join(groups, by).select(*cell, "size", p.alias("p"), q.alias("q")).where("p > q")
    scored = stage(told.select(*cell, "size", F.expr("(p - q) * (p - q) div (p + q)").alias("value")), "cells")
    best = Window.partitionBy(*by).orderBy(F.col("value").desc())
    values = scored.groupBy(*by, "value").agg(F.sum("size").alias("size")).withColumn("place", F.row_number().over(best)).where(F.col("place") <= top)
    before = F.coalesce(F.sum("size").over(best.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    reached = values.withColumn("before", before).where(F.col("before") < top).select(*by, "value")
    chosen = scored.join(reached, [*by, "value"]).select(*cell, "value")
    found = opened(terms).join(chosen, cell).select(*by, F.col("term").alias("item"), "value")
    return found.withColumn("rank", F.row_number().over(best.orderBy(F.col("value").desc(), "item"))).where(F.col("rank") <= top)


def _shares(n: np.ndarray, total: np.ndarray) -> np.ndarray:
    """``share`` of many counts: a long division by thousands, so that nothing overflows."""
    out, rest = np.divmod(n + 2, total)
    for _ in range(3):
        digits, rest = np.divmod(rest * 1000, total)
        out = out * 1000 + digits
    return out + 1


def _compare(key: tuple, terms: pa.Table, groups: pa.Table) -> pa.Table:
    """(lang, a, b, value) of the sources of one panel with all later ones, over one block of a language's terms."""
    groups = groups.sort_by("source")
    names = groups["source"].combine_chunks()
    whole = groups["total"].to_numpy() + 2 * groups["n_terms"].to_numpy()
    uses = terms["uses"].combine_chunks()
    uses = uses if isinstance(uses, pa.Array) else pa.concat_arrays(uses.chunks)
    of = pc.list_parent_indices(uses).to_numpy()
    flat = uses.flatten()
    who = pc.index_in(flat.field("source"), names).to_numpy(zero_copy_only=False)
    n = flat.field("n").to_numpy(zero_copy_only=False)
    first = key[2].as_py() * PANEL
    panel = range(first, min(first + PANEL, len(names)))
    total = np.zeros((len(panel), len(names)), np.int64)
    step = max(1, MOST_CELLS // max(1, len(names)))
    for at in range(0, terms.num_rows, step):
        rows = slice(*np.searchsorted(of, [at, at + step]))
        counts = np.zeros((min(step, terms.num_rows - at), len(names)), np.int64)
        counts[of[rows] - at, who[rows]] = n[rows]
        p = _shares(counts, whole)
        for k, a in enumerate(panel):
            own, other = p[:, a : a + 1], p[:, a + 1 :]
            total[k, a + 1 :] += ((own - other) ** 2 // (own + other)).sum(0)
    a, b = np.nonzero(np.arange(len(names))[None, :] > np.asarray(panel)[:, None])
    return pa.table([pa.array([key[0].as_py()] * len(a), pa.string()), names.take(pa.array(a + first)), names.take(pa.array(b)), total[a, b]], names=["lang", "a", "b", "value"])


def source_pairs(terms: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value, rank): for each source the other sources of its language, by how far apart their words are.

    A language's terms are dealt into blocks by hash and its sources into panels. A block meets the language's groups once per panel
    and is compared there as a matrix of shares; the blocks' sums are added up.
    """
    size = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("n_sources"), F.max("n_terms").alias("v"))
    plan = size.select("lang", (F.lit(1) + F.expr(f"v * n_sources div {MOST_CELLS}")).alias("n_blocks"), F.sequence(F.lit(0), F.expr(f"cast((n_sources - 1) div {PANEL} as int)")).alias("panels"))
    dealt = terms.join(plan, "lang").select("lang", F.expr("pmod(xxhash64(term), n_blocks)").alias("block"), F.explode("panels").alias("panel"), "uses")
    met = groups.join(plan, "lang").select("lang", "source", "n_terms", "total", F.explode(F.expr("sequence(0L, n_blocks - 1)")).alias("block"), "panels")
    met = met.select("lang", "block", F.explode("panels").alias("panel"), "source", "n_terms", "total")
    key = ["lang", "block", "panel"]
    parts = dealt.groupBy(*key).cogroup(met.groupBy(*key)).applyInArrow(_compare, "lang string, a string, b string, value long")
    sums = parts.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = sums.select("lang", "value", F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("x")).select("lang", "x.*", "value")
    return both.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")))


def source_divergence(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", min_docs: int = 10, top: int = 10) -> DataFrame:
    """(lang, source, part, item, value, rank) of every group of documents with one lang and source.

    Terms are runs of letters A to Z and of characters beyond ASCII, A-Z in lower case. A language keeps the terms found in at least
    ``min_docs`` of its documents; each group of documents and each language gives every kept term a smoothed share in billionths,
    and (p - q)^2 / (p + q), rounded down, says how far two shares are apart. Part ``pair`` has each other source of the language,
    by the sum over all kept terms; part ``term`` the ``top`` terms that the group uses with a larger share than its language. Equal
    values are in order of the item's bytes. A NULL text, lang or source is empty text, and that is a lang or source of its own;
    empty texts have no terms; a language without kept terms has pairs with value 0; a lone source has no pairs. Each row is a
    document: repeated rows count again. An empty table gives an empty result. Only the three columns named are read.
    """
    terms = kept_terms(docs, text, lang, source, min_docs)
    groups = group_totals(docs, terms, lang, source)
    out = ["lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank")]
    pairs, marks = source_pairs(terms, groups), marking_terms(terms, groups, top)
    return pairs.withColumn("part", F.lit("pair")).select(*out).unionByName(marks.withColumn("part", F.lit("term")).select(*out))
