"""Importance resampling: documents drawn by how much more their hashed word runs belong to a target corpus.

Newlines separate words, so they cut a text into lines. A line that many texts share is one row with its number of
occurrences: its runs are hashed once, counted that many times, and its weight is worked out once. Runs that reach over a
newline belong to no line and are counted text by text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortmill.llm.crc import crc32, joined
from cohortmill.llm.staging import stage
from cohortmill.llm.words import Words, blocks
from cohortmill.operators.ranges import number_rows

BUCKETS = 10_000
#: A word is a run of digits, letters A to Z and characters beyond ASCII.
HAS_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
BETWEEN = np.ones(256, bool)
BETWEEN[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
SPACE_CRC = crc32(np.frombuffer(b" ", np.uint8), np.array([0]), np.array([1]))[0]


def run_buckets(words: Words, of: np.ndarray, apart: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the runs of one to three words that stay in one ``of``, by ``of``, and how many each has.

    ``of`` numbers the texts of the words in order. With ``apart``, which numbers their lines, only runs over several lines.
    """
    n = len(words)
    starts = []
    for more in range(3):
        i = np.arange(max(0, n - more))
        same = of[i] == of[i + more]
        starts.append(i[same if apart is None else same & (apart[i] != apart[i + more])])
    used = np.zeros(n + 2, bool)
    for more, at in enumerate(starts):
        for k in range(more + 1):
            used[at + k] = True
    at = np.flatnonzero(used[:n])
    place = np.cumsum(used) - 1
    start, end = words.start[at], words.end[at]
    crc, size = crc32(words.data, start, end), end - start
    spaced = joined(np.full(len(at), SPACE_CRC, np.uint32), crc, size)
    runs = [crc[place[starts[0]]]]
    for more in (1, 2):
        i = place[starts[more]]
        run = crc[i]
        for k in range(1, more + 1):
            run = joined(run, spaced[i + k], size[i + k] + 1)
        runs.append(run)
    owner = np.concatenate([of[i] for i in starts])
    order = np.argsort(owner, kind="stable")
    return (np.concatenate(runs)[order] % np.uint32(BUCKETS)).astype(np.uint16), owner[order]


def as_binary(buckets: np.ndarray, owner: np.ndarray, n: int) -> pa.Array:
    """The buckets of each of ``n`` owners as bytes."""
    ends = (np.searchsorted(owner, np.arange(n + 1)) * 2).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(buckets.astype("<u2").tobytes())])


def of_binary(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of all rows one after the other, and where each row's begin (with the end of the last)."""
    _, offsets, data = column.buffers()
    kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    offsets = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return np.frombuffer(data[offsets[0] : offsets[-1]].tobytes(), "<u2"), (offsets - offsets[0]) // 2


def _lines(text: Column) -> Column:
    """The lines of a text that hold a word."""
    return F.filter(F.split(text, "\n", -1), lambda line: line.rlike(HAS_WORD))


def _line_hash(line: Column) -> list[Column]:
    return [F.xxhash64(line).alias("h1"), F.xxhash64(F.lit("second"), line).alias("h2")]


def distinct_lines(texts: DataFrame, text: str) -> DataFrame:
    """(h1, h2, n, buckets) of each distinct line with a word: its hashes, its occurrences and its runs, staged."""
    lines = texts.select(F.explode(_lines(F.col(text))).alias("line")).groupBy("line").agg(F.count(F.lit(1)).alias("n"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, words in blocks(batches, "line", space=BETWEEN, lower=True):
            found = as_binary(*run_buckets(words, words.text_of), rows.num_rows)
            yield pa.RecordBatch.from_arrays([rows.column(k) for k in range(3)] + [found], names=["h1", "h2", "n", "buckets"])

    return stage(lines.select(*_line_hash(F.col("line")), "n", "line").mapInArrow(hashed, "h1 long, h2 long, n long, buckets binary"), "lines", "zstd")


def texts_across(texts: DataFrame, id: str, text: str) -> DataFrame:
    """(doc_id, k1, k2, n_words, n_features, buckets) of each text, staged; buckets has the runs over several lines."""
    own = texts.select(F.col(id).alias("doc_id"), *_row_key(id, text), F.col(text).alias("text"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, words in blocks(batches, "text", space=BETWEEN, lower=True):
            n = words.counts
            line = np.searchsorted(np.flatnonzero(words.data == 10), words.start)
            found = as_binary(*run_buckets(words, words.text_of, line), rows.num_rows)
            features = n + np.maximum(n - 1, 0) + np.maximum(n - 2, 0)
            yield pa.RecordBatch.from_arrays([rows.column(k) for k in range(3)] + [pa.array(n, pa.int64()), pa.array(features, pa.int64()), found], names=["doc_id", "k1", "k2", "n_words", "n_features", "buckets"])

    kind = own.schema["doc_id"].dataType.simpleString()
    return stage(own.mapInArrow(hashed, f"doc_id {kind}, k1 long, k2 long, n_words long, n_features long, buckets binary"), "texts")


def _row_key(id: str, text: str) -> list[Column]:
    return [F.xxhash64(F.col(id)).alias("k1"), F.xxhash64(F.col(text)).alias("k2")]


def bucket_counts(runs: DataFrame) -> DataFrame:
    """(bucket, count) over (n, buckets): each task sends as many rows as there are buckets at most."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for rows in batches:
            found, at = of_binary(rows.column(1))
            times = np.repeat(rows.column(0).to_numpy(zero_copy_only=False), np.diff(at))
            total += np.bincount(found, times, BUCKETS).astype(np.int64)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some])], names=["bucket", "count"])

    return runs.select("n", "buckets").mapInArrow(counted, "bucket int, count long").groupBy("bucket").agg(F.sum("count").alias("count"))


def bucket_gains(corpus: DataFrame, target: DataFrame) -> np.ndarray:
    """The gain of each bucket from the (bucket, count) of both sides, in thousandths of a nat."""

    def counts(df: DataFrame) -> np.ndarray:
        rows, out = df.toArrow(), np.zeros(BUCKETS, np.float64)  # a row per bucket at most
        out[rows["bucket"].to_numpy()] = rows["count"].to_numpy()
        return out

    s, t = counts(corpus), counts(target)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + BUCKETS) / ((s + 1) * (t.sum() + BUCKETS)))).astype(np.int64)


def weighed(runs: DataFrame, gains: np.ndarray, *names: str) -> DataFrame:
    """The named columns and ``weight``, the sum of the gains of the row's runs."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            found, at = of_binary(rows.column(len(names)))
            total = np.concatenate([[0], np.cumsum(gains[found])])
            yield pa.RecordBatch.from_arrays([*rows.columns[: len(names)], pa.array(total[at[1:]] - total[at[:-1]], pa.int64())], names=[*names, "weight"])

    kinds = ", ".join(f"{n} {runs.schema[n].dataType.simpleString()}" for n in names)
    return runs.select(*names, "buckets").mapInArrow(summed, f"{kinds}, weight long")


def noise(id: Column, seed: int) -> Column:
    """Gumbel noise in thousandths that the seed and the id determine."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def rank_by_importance(docs: DataFrame, target: DataFrame, id: str = "doc_id", text: str = "text", target_text: str = "text", percent: int = 5, min_words: int = 20, seed: int = 42) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of each row of ``docs``.

    A text's features are its runs of one to three words (runs of digits, letters and characters beyond ASCII, A-Z in lower case),
    hashed into 10,000 buckets. A bucket's gain is the logarithm, in thousandths, of how much more frequent it is in ``target``
    than in ``docs``; weight is the sum of a text's gains, and score adds Gumbel noise by a hash of seed and id. Of the N rows with
    ``min_words`` words the floor(percent * N / 100) highest scores are drawn, ties to the smaller id; rank numbers them, and is
    NULL for all other rows. NULL and empty texts have no features and weight 0; a NULL id counts as empty text and comes before
    others in ties; repeated rows count again and get equal scores, and ranks next to each other. Empty tables on either side
    have zero counts; an empty ``docs`` gives an empty result. Only the columns named are read.
    """
    lines, texts = distinct_lines(docs, text), texts_across(docs, id, text)
    once = F.lit(1).cast("long").alias("n")
    asked = target.select(F.lit(None).cast("string").alias("id"), F.col(target_text).alias("text"))
    every = lines.select("n", "buckets").unionByName(texts.select(once, "buckets"))
    wanted = distinct_lines(asked, "text").select("n", "buckets").unionByName(texts_across(asked, "id", "text").select(once, "buckets"))
    gains = bucket_gains(bucket_counts(every), bucket_counts(wanted))

    places = docs.select(*_row_key(id, text), F.explode(_lines(F.col(text))).alias("line")).select("k1", "k2", *_line_hash(F.col("line")))
    of_lines = places.join(weighed(lines, gains, "h1", "h2"), ["h1", "h2"]).select("k1", "k2", "weight", F.lit(0).alias("rows"))
    own = weighed(texts, gains, "doc_id", "k1", "k2", "n_words", "n_features")
    # equal rows have equal keys: each has its share of what all of them have
    totals = of_lines.unionByName(own.select("k1", "k2", "weight", F.lit(1).alias("rows"))).groupBy("k1", "k2").agg(F.expr("sum(weight) div sum(rows)").alias("weight"))
    scored = stage(own.drop("weight").join(totals, ["k1", "k2"]).select("doc_id", "n_words", "n_features", "weight", (F.col("weight") + noise(F.col("doc_id"), seed)).alias("score")), "scored")

    able = scored.where(F.col("n_words") >= min_words)
    most = able.count() * percent // 100
    drawn = number_rows(able, [F.col("score").desc(), F.col("doc_id").asc_nulls_first()], "rank").withColumn("rank", F.when(F.col("rank") <= most, F.col("rank")))
    return drawn.unionByName(scored.where(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long")))


def importance_resample(docs: DataFrame, target: DataFrame, id: str = "doc_id", text: str = "text", target_text: str = "text", percent: int = 5, min_words: int = 20, seed: int = 42) -> DataFrame:
    """The rows of ``docs`` that ``rank_by_importance`` draws, with all their columns, for ids that do not repeat.

    Only the ids drawn meet the texts. A row whose id is NULL is not returned.
    """
    ranked = rank_by_importance(docs, target, id, text, target_text, percent, min_words, seed)
    return docs.join(ranked.where("rank IS NOT NULL").select(F.col("doc_id").alias(id)), id, "left_semi")
