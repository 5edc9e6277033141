"""Quality classifier from weak labels: heuristics vote, EM rates the voters, and the posterior labels train a hashed linear scorer."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortmill.llm.rules import repeated, statistic, text_counts
from cohortmill.llm.staging import stage
from cohortmill.llm.words import U, Words, blocks, mix, run_hashes

ABSTAIN, GOOD, BAD = 0, 1, 2

#: Labellers that vote bad or not at all: the statistic, and the value above which they do.
AGAINST = {
    "symbols": ("symbols_per_word", 0.2),
    "capitals": ("upper_per_char", 0.5),
    "bars": ("bars_per_word", 0.15),
    "bangs": ("bangs_per_word", 0.3),
    "repeated windows": ("repeat_words_per_word", 0.5),
    "stutter": ("same_as_before_per_word", 0.15),
    "repeated lines": ("dup_lines_per_line", 0.4),
    "digits": ("digits_per_char", 0.3),
    "long words": ("chars_per_word", 25.0),
}
#: Labellers that vote good or not at all: the statistics, each with the value that none may pass.
FOR = {
    "clean": {"symbols_per_word": 0.02, "bars_per_word": 0.01, "digits_per_char": 0.05, "upper_per_char": 0.15, "bangs_per_word": 0.05, "repeat_words_per_word": 0.05, "same_as_before_per_word": 0.03, "dup_lines_per_line": 0.05},
    "regular": {"chars_per_word": 12.0, "symbols_per_word": 0.05, "bangs_per_word": 0.1, "upper_per_char": 0.3, "same_as_before_per_word": 0.1, "repeat_words_per_word": 0.2},
}
LABELLERS = [*AGAINST, *FOR]


def votes() -> Column:
    """All votes of a row of text counts, as the digits of one number to base 3; NULL for a text without words."""
    total = F.lit(0).cast("long")
    for name, above in AGAINST.values():
        total = total * 3 + F.when(statistic(name) > above, BAD).otherwise(ABSTAIN)
    for bounds in FOR.values():
        holds = F.lit(True)
        for name, most in bounds.items():
            holds = holds & (statistic(name) <= most)
        total = total * 3 + F.when(holds, GOOD).otherwise(ABSTAIN)
    return F.when(F.col("n_words") > 0, total)


@dataclass
class VoteModel:
    """Chances of each vote of each labeller for good and for bad texts, and the share of good ones."""

    good: float
    chances: np.ndarray  # class (good, bad) x labeller x vote

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """The chance that a text with these votes is good."""
        j = np.arange(patterns.shape[1])
        log = [np.log(p) + np.log(self.chances[k][j, patterns]).sum(axis=1) for k, p in enumerate((self.good, 1 - self.good))]
        return 1 / (1 + np.exp(np.clip(log[1] - log[0], -500, 500)))

    def accuracy(self) -> np.ndarray:
        """For each labeller the chance that a vote it casts is right."""
        prior = np.array([self.good, 1 - self.good])[:, None]
        right = prior[0] * self.chances[0][:, GOOD] + prior[1] * self.chances[1][:, BAD]
        return right / np.maximum((prior * (1 - self.chances[:, :, ABSTAIN])).sum(axis=0), 1e-12)


def digits(codes: np.ndarray, n: int) -> np.ndarray:
    return codes[:, None] // 3 ** np.arange(n - 1, -1, -1) % 3


def fit_votes(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100, smooth: float = 1.0) -> VoteModel:
    """Expectation-maximisation over distinct vote patterns and how many texts have each, from a majority vote."""
    bad, good = (patterns == BAD).sum(axis=1), (patterns == GOOD).sum(axis=1)
    q = np.where(bad > 0, 0.1, np.where(good > 0, 0.9, 0.5))
    model = None
    for _ in range(rounds):
        weight = np.stack([q, 1 - q]) * counts
        share = (weight[0].sum() + smooth) / (counts.sum() + 2 * smooth)
        seen = np.stack([weight @ (patterns == v) for v in (ABSTAIN, GOOD, BAD)], axis=2) + smooth
        model = VoteModel(float(share), seen / seen.sum(axis=2, keepdims=True))
        new = model.posterior(patterns)
        if np.abs(new - q).max() < 1e-9:
            break
        q = new
    return model


# ---- hashed features ----

KIND = np.array([97 if b >= 128 or 97 <= b <= 122 else 65 if 65 <= b <= 90 else 48 if 48 <= b <= 57 else b for b in range(256)], np.uint8)


def features(words: Words, buckets: int) -> np.ndarray:
    """For each word the buckets (a row per feature kind) of its shape, its and the next shape, and whether words or runs come again.

    A shape is the word with each run of small letters, capitals, digits or one other sign written as one sign.
    """
    if not len(words):
        return np.zeros((3, 0), np.int64)
    kind = KIND[words.data]
    turn = np.ones(len(kind), bool)
    turn[1:] = kind[1:] != kind[:-1]
    turn[words.start] = True
    place = np.concatenate([[0], np.cumsum(turn)])
    shapes = Words.__new__(Words)
    shapes.data, shapes.start, shapes.end = kind[turn], place[words.start], place[words.end]
    shape, hashes, text = shapes.hashes(), words.hashes(), words.text_of
    following = np.zeros(len(shape), U)
    following[:-1] = np.where(text[1:] == text[:-1], shape[1:], U(0))
    same = np.zeros(len(shape), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (text[1:] == text[:-1])
    again = np.zeros(len(shape), bool)
    at = words.runs(5)
    again[at] = repeated(text[at], run_hashes(hashes, 5)[at])
    size = np.minimum(np.log2(words.end - words.start), 7).astype(U)
    out = [shape, mix(shape + U(3) * mix(following)), mix(U(0xA5A5) + U(2) * same.astype(U) + again.astype(U) + U(16) * size)]
    return np.stack([(h % U(buckets)).astype(np.int64) for h in out])


@dataclass
class Scorer:
    """Weights of the buckets, for shares of a text's words, and a constant."""

    weights: np.ndarray
    bias: float

    def scores(self, words: Words) -> np.ndarray:
        """The chance that each text is good; 0 for a text without words."""
        total = np.concatenate([[0.0], np.cumsum(self.weights[features(words, len(self.weights))].sum(axis=0))])
        n = words.counts
        with np.errstate(over="ignore"):
            return np.where(n > 0, 1 / (1 + np.exp(-(self.bias + (total[words.first[1:]] - total[words.first[:-1]]) / np.maximum(n, 1)))), 0.0)


def train(index: np.ndarray, value: np.ndarray, begin: np.ndarray, target: np.ndarray, buckets: int, rounds: int = 300, rate: float = 0.5, ridge: float = 1e-5) -> Scorer:
    """Logistic regression on soft targets: whole-batch steps with a rate per weight (Adagrad)."""
    row = np.repeat(np.arange(len(target)), np.diff(begin))
    w, bias = np.zeros(buckets), 0.0
    seen, seen_bias = np.full(buckets, 1e-12), 1e-12
    n = max(1, len(target))
    for _ in range(rounds):
        error = (1 / (1 + np.exp(-np.clip(bias + np.bincount(row, value * w[index], len(target)), -500, 500))) - target) / n
        step = np.bincount(index, value * error[row], buckets) + ridge * w / n
        seen += step * step
        seen_bias += error.sum() ** 2
        w -= rate * step / np.sqrt(seen)
        bias -= rate * error.sum() / np.sqrt(seen_bias)
    return Scorer(w, float(bias))


def fit_quality(docs: DataFrame, id: str = "doc_id", text: str = "text", train_rows: int = 8_000, buckets: int = 4096) -> tuple[Scorer, VoteModel]:
    """Rate the labellers on all rows, then train the scorer on about ``train_rows`` of them, drawn by a hash of the id and text.

    The labellers' votes are counted by pattern, at most 2 to their number, so what EM sees does not grow with the table.
    """
    own = docs.select(F.struct(F.xxhash64(F.col(id)).alias("k1"), F.xxhash64(F.col(text)).alias("k2")).alias("key"), F.col(text).alias("text"))
    counted = stage(text_counts(own, "key", "text").select(F.col("doc_id").alias("key"), votes().alias("votes")).where("votes IS NOT NULL"), "votes")
    table = counted.groupBy("votes").agg(F.count(F.lit(1)).alias("n")).collect()
    if not table:
        return Scorer(np.zeros(buckets), 0.0), VoteModel(0.5, np.full((2, len(LABELLERS), 3), 1 / 3))
    codes = np.array([r["votes"] for r in table], np.int64)
    n = np.array([r["n"] for r in table], float)
    model = fit_votes(digits(codes, len(LABELLERS)), n)
    chance = model.posterior(digits(codes, len(LABELLERS)))

    scale = 1 << 40
    mark = F.pmod(F.xxhash64("k1", "k2", F.lit("train")), F.lit(scale)) < int(scale * min(1.0, train_rows / n.sum()))
    drawn = own.select("key.*", "text").where(mark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, words in blocks(batches, "text"):
            found = features(words, buckets)
            keys, counts = np.unique(np.tile(words.text_of * buckets, (len(found), 1)) + found, return_counts=True)
            edges = np.searchsorted(keys, np.arange(len(words.first)) * buckets).astype(np.int32)
            share = counts / np.maximum(words.counts, 1)[keys // buckets]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(edges, pa.array(keys % buckets, pa.int32())), pa.ListArray.from_arrays(edges, pa.array(share, pa.float32()))], ["k1", "k2", "index", "value"])

    rows = drawn.mapInArrow(run, "k1 long, k2 long, index array<int>, value array<float>")
    labelled = counted.select("key.*", "votes").where(mark).distinct()
    sample = rows.join(labelled, ["k1", "k2"]).select("k1", "k2", "index", "value", "votes").toArrow().sort_by([("k1", "ascending"), ("k2", "ascending")])
    of = dict(zip(codes.tolist(), chance.tolist(), strict=True))
    target = np.array([of[v] for v in sample["votes"].to_pylist()])
    index, value = (np.concatenate([np.zeros(0), *(x.values.to_numpy(zero_copy_only=False) for x in [sample[c].combine_chunks()])]) for c in ("index", "value"))
    sizes = sample["index"].combine_chunks().value_lengths().to_numpy(zero_copy_only=False) if len(sample) else np.zeros(0, np.int64)
    return train(index.astype(np.int64), value, np.concatenate([[0], np.cumsum(sizes)]), target, buckets), model


def score_quality(docs: DataFrame, id: str = "doc_id", text: str = "text", threshold: float = 0.5, **options) -> DataFrame:
    """(doc_id, score, kept) for each row of ``docs``: the chance that the text is good, and whether it reaches ``threshold``.

    NULL and empty texts score 0. Repeated rows score alike; an empty table gives an empty result. Only the id and text are read.
    """
    scorer, _ = fit_quality(docs, id, text, **options)
    own = docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, words in blocks(batches, "text"):
            score = scorer.scores(words)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array(score >= threshold)], ["doc_id", "score", "kept"])

    return own.mapInArrow(run, own.select("doc_id").schema.add("score", "double").add("kept", "boolean"))


def keep_good(docs: DataFrame, id: str = "doc_id", text: str = "text", threshold: float = 0.5, **options) -> DataFrame:
    """The rows of ``docs`` whose text scores ``threshold`` or more, with all their columns as they are, in one pass and no shuffle."""
    scorer, _ = fit_quality(docs, id, text, **options)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, words in blocks(batches, text):
            yield batch.filter(pa.array(scorer.scores(words) >= threshold))

    return docs.mapInArrow(run, docs.schema)
