"""Toxicity by a subsequence string kernel: a support vector machine over Nyström landmarks, trained on spans of labelled texts.

A string is a span of one to three words; an end and a start sign between two words stand for the space. Two strings are alike as
far as they share subsequences of four signs, each worth less the more signs lie between, up to three. So a word with
signs put in or left out, or split by a space, stays close to the word itself, and a phrase is known as one string. The machine is linear in the kernel values with the landmarks, and
these are sums over subsequences; so the trained machine is one weight per subsequence, and scoring is a sum along the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortmill.llm.decontaminate import LETTER, lower
from cohortmill.llm.staging import stage
from cohortmill.llm.words import Words, blocks, text_bytes

SIZE, REACH, DECAY = 4, 7, 0.6
BUCKET_BITS = 20
BUCKETS = 1 << BUCKET_BITS
SPAN = 3
#: Longer spans do not train the machine; they are scored.
MOST_BYTES = 128
STEPS = [(0, *rest) for rest in combinations(range(1, REACH), SIZE - 1)]


def bucket_of(code: np.ndarray) -> np.ndarray:
    """The bucket of four signs in 32 bits."""
    return (code * np.uint32(0x9E3779B1)) >> np.uint32(32 - BUCKET_BITS)


@dataclass
class Strings:
    """Words reduced to their small letters between a start and an end sign, with the number of the text of each."""

    data: np.ndarray
    begin: np.ndarray
    text: np.ndarray

    def terms(self) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
        """For each shape of a subsequence: where it begins, its bucket, and its worth."""
        n = len(self.data)
        last = np.repeat(self.begin[1:], np.diff(self.begin))
        data = self.data.astype(np.uint32)
        for step in STEPS:
            reach = step[-1]
            if n <= reach:
                continue
            at = np.flatnonzero(np.arange(n - reach) + reach < last[: n - reach])
            code = data[at]
            for k in step[1:]:
                code = (code << np.uint32(8)) | data[at + k]
            yield at, bucket_of(code).astype(np.int64), DECAY ** (reach + 1 - SIZE)

    def norms(self) -> np.ndarray:
        """The length of each string's vector of subsequences, if none comes twice."""
        return norms_of(np.diff(self.begin))

    def sums(self, weights: np.ndarray) -> np.ndarray:
        """For each string the weights of its subsequences, over its norm."""
        return self.span_sums(weights, [(self.begin[:-1], self.begin[1:])])[0]

    def span_sums(self, weights: np.ndarray, spans: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
        """The same for any parts of ``data``, given by where they begin and end. Each subsequence is looked up once for all parts."""
        totals = [np.zeros(len(begin)) for begin, _ in spans]
        n = len(self.data)
        signs = [self.data.astype(np.uint32) << np.uint32(8 * k) for k in range(SIZE)]
        for reach in range(SIZE - 1, min(REACH, n)):
            m = n - reach
            value = np.zeros(m)
            ends = signs[3][:m] | signs[0][reach:]
            for a in range(1, reach - 1):
                start = ends | signs[2][a : a + m]
                for b in range(a + 1, reach):
                    value += weights[bucket_of(start | signs[1][b : b + m])]
            so_far = np.concatenate([[0.0], np.cumsum(value)]) * DECAY ** (reach + 1 - SIZE)
            for total, (begin, end) in zip(totals, spans, strict=True):
                first = np.minimum(begin, m)
                total += so_far[np.maximum(end - reach, first)] - so_far[first]
        return [total / norms_of(end - begin) for total, (begin, end) in zip(totals, spans, strict=True)]

    def spans(self, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where each run of ``size`` strings of one text begins and ends, and its text."""
        n = len(self.text) - size + 1
        at = np.flatnonzero(self.text[: max(0, n)] == self.text[size - 1 :]) if n > 0 else np.zeros(0, np.int64)
        return self.begin[at], self.begin[at + size], self.text[at]


def norms_of(size: np.ndarray) -> np.ndarray:
    total = np.zeros(len(size))
    for step in STEPS:
        total += np.maximum(size - step[-1], 0) * DECAY ** (2 * (step[-1] + 1 - SIZE))
    return np.sqrt(np.maximum(total, 1e-9))


def strings(words: Words) -> Strings:
    """The words of a block as strings; words of one letter in a row are taken together, so spaced-out words are one."""
    low = lower(words.data)
    letter = LETTER[words.data]
    count = np.concatenate([[0], np.cumsum(letter)])
    size = count[words.end] - count[words.start]
    text = words.text_of
    keep = np.flatnonzero(size > 0)
    size, text = size[keep], text[keep]
    joins = np.zeros(len(keep), bool)
    joins[1:] = (size[1:] == 1) & (size[:-1] == 1) & (text[1:] == text[:-1])
    head = np.flatnonzero(~joins)
    total = np.add.reduceat(size, head) if len(head) else np.zeros(0, np.int64)
    begin = np.concatenate([[0], np.cumsum(total + 2)])
    data = np.zeros(begin[-1], np.uint8)
    inside = np.ones(begin[-1], bool)
    inside[begin[:-1]] = inside[begin[1:] - 1] = False
    solid = np.zeros(len(words.data) + 1, np.int8)
    np.add.at(solid, words.start, 1)
    np.add.at(solid, words.end, -1)
    data[inside] = low[letter & (np.cumsum(solid[:-1]) > 0)]
    data[begin[:-1]], data[begin[1:] - 1] = 1, 2
    return Strings(data, begin, text[head])


def span_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(toxic, apart, word): the distinct spans of each text of (toxic, apart, text) as text, without those of one or more than MOST_BYTES bytes."""
    for batch, words in blocks(batches, "text"):
        found = strings(words)
        flat = found.data.copy()
        flat[flat == 2] = 32  # between two words stands their end, and then the start of the next
        for size in range(1, SPAN + 1):
            begin, end, text = found.spans(size)
            some = np.flatnonzero((end - begin > 3) & (end - begin <= MOST_BYTES))
            spans = {(int(text[k]), flat[begin[k] + 1 : end[k] - 1].tobytes().replace(b"\x01", b"")) for k in some}
            rows = sorted(spans)
            if rows:
                of = pa.array([t for t, _ in rows])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(of), batch.column(1).take(of), pa.array([s.decode("utf-8", "replace") for _, s in rows], pa.string())], ["toxic", "apart", "word"])


def as_strings(texts: list[str]) -> Strings:
    """One string per text, with all its words."""
    found = strings(Words(*text_bytes(pa.array(texts, pa.string()))))
    heads = np.flatnonzero(np.diff(found.text, prepend=-1))
    return Strings(found.data, np.append(found.begin[heads], found.begin[-1]), found.text[heads])


@dataclass
class Machine:
    """Weights of the subsequences and a constant: a string's margin is positive if it is like insults."""

    weights: np.ndarray
    bias: float

    def margins(self, found: Strings) -> np.ndarray:
        return found.sums(self.weights) + self.bias


def kernel(found: Strings, columns: np.ndarray, landmarks: np.ndarray, chunk: int = 20_000) -> np.ndarray:
    """Kernel of strings with landmarks, whose vectors are rows over the buckets ``columns``."""
    owner = np.repeat(np.arange(len(found.begin) - 1), np.diff(found.begin))
    out = np.zeros((len(found.begin) - 1, len(landmarks)), np.float32)
    for at, bucket, worth in found.terms():
        place = np.minimum(np.searchsorted(columns, bucket), len(columns) - 1)
        hit = np.flatnonzero(columns[place] == bucket)
        for k in range(0, len(hit), chunk):
            part = hit[k : k + chunk]
            rows = owner[at[part]]
            heads = np.flatnonzero(np.diff(rows, prepend=-1))
            out[rows[heads]] += worth * np.add.reduceat(landmarks[:, place[part]].T, heads, axis=0)
    return out / found.norms()[:, None].astype(np.float32)


def fit_machine(words: list[str], toxic: np.ndarray, clean: np.ndarray, n_landmarks: int = 300, balance: float = 3.0, rounds: int = 400, ridge: float = 1e-4) -> Machine:
    """A linear machine on Nyström features of the words, each counted as toxic and clean as often as texts of either kind hold it.

    Half the landmarks are the words that tell toxic texts best, half the most common others. Squared hinge loss, whole-batch steps.
    """
    order = np.argsort(-(np.log((toxic + 0.5) / (clean + 0.5)) * np.sqrt(toxic)), kind="stable")
    common = np.argsort(-(toxic + clean), kind="stable")
    chosen = list(dict.fromkeys([*order[: n_landmarks // 2].tolist(), *common.tolist()]))[:n_landmarks]
    marks = as_strings([words[k] for k in chosen])
    owner = np.repeat(np.arange(len(chosen)), np.diff(marks.begin))
    entries = [(owner[at], bucket, np.full(len(at), worth)) for at, bucket, worth in marks.terms()]
    rows, buckets, worth = (np.concatenate([e[k] for e in entries]) for k in range(3))
    columns = np.unique(buckets)
    vectors = np.zeros((len(chosen), len(columns)), np.float32)
    np.add.at(vectors, (rows, np.searchsorted(columns, buckets)), worth)
    vectors /= marks.norms()[:, None].astype(np.float32)
    values, axes = np.linalg.eigh((vectors @ vectors.T).astype(np.float64))
    whiten = axes / np.sqrt(np.maximum(values, 1e-6)) @ axes.T
    x = kernel(as_strings(words), columns, vectors) @ whiten
    w, bias = np.zeros(x.shape[1]), 0.0
    seen, seen_bias = np.full(x.shape[1], 1e-12), 1e-12
    up, down = toxic / max(1.0, toxic.sum()), balance * clean / max(1.0, clean.sum())
    for _ in range(rounds):
        f = x @ w + bias
        slope = -2 * up * np.maximum(0, 1 - f) + 2 * down * np.maximum(0, 1 + f)
        step, shift = x.T @ slope + ridge * w, slope.sum()
        seen += step * step
        seen_bias += shift * shift
        w -= 0.5 * step / np.sqrt(seen)
        bias -= 0.5 * shift / np.sqrt(seen_bias)
    weights = np.zeros(BUCKETS)
    weights[columns] = (whiten @ w) @ vectors
    return Machine(weights, float(bias))


def pooled(machine: Machine, words: Words) -> np.ndarray:
    """What a text's words, and its spans of more words, say together (a row per text): of either the highest margin, how many are positive
    and by how much, and their share."""
    found = strings(words)
    n = len(words.first) - 1
    spans = [found.spans(size) for size in range(1, SPAN + 1)]
    margins = [x + machine.bias for x in found.span_sums(machine.weights, [x[:2] for x in spans])]
    out = []
    for text, margin in ((spans[0][2], margins[0]), (np.concatenate([x[2] for x in spans[1:]]), np.concatenate(margins[1:]))):
        top = np.full(n, -2.0)
        np.maximum.at(top, text, margin)
        count = np.bincount(text, margin > 0, n)
        total = np.bincount(text, np.maximum(margin, 0), n)
        size = np.maximum(np.bincount(text, minlength=n), 1)
        out += [top, np.log1p(count), np.log1p(total), np.log1p(1000 * total / size)]
    return np.stack(out, axis=1)


@dataclass
class ToxicityModel:
    machine: Machine
    weights: np.ndarray  # of the pooled features, and a constant

    def scores(self, words: Words) -> np.ndarray:
        x = pooled(self.machine, words)
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -500, 500)))


def calibrate(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 50, ridge: float = 1e-3) -> np.ndarray:
    """Logistic regression by Newton steps."""
    design = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(design.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -500, 500)))
        slope = design.T @ (weight * (p - y)) + ridge * w
        curve = (design * (weight * p * (1 - p))[:, None]).T @ design + ridge * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def held_out(id: Column) -> Column:
    return F.coalesce(F.crc32(id.cast("string")) % 5 == 0, F.lit(False))


def fit_toxicity(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", train_rows: int = 4_000, train_words: int = 20_000, n_landmarks: int = 300) -> ToxicityModel:
    """Learn from at most ``train_rows`` labelled rows outside the held-out fifth, half of each class if there are enough.

    The spans of one to three words of those rows are counted in Spark, cut as they are when texts are scored; ``train_words`` of them go
    to the machine, half those that tell toxic texts best and half the most common others. The last regression is fitted to the pooled
    margins that a machine trained on three quarters of the rows has on the last quarter, by a hash of the id (on all
    rows if those are not of both kinds). Conflicting labels of one id count by majority, a tie as clean.
    """
    vote = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg((F.avg("toxic") > 0.5).alias("toxic")).where(~held_out(F.col("doc_id")))
    turn = vote.withColumn("turn", F.xxhash64("doc_id"))
    ids = turn.where("toxic").orderBy("turn", "doc_id").limit(train_rows // 2).unionByName(turn.where("NOT toxic").orderBy("turn", "doc_id").limit(train_rows // 2)).select("doc_id", "toxic")
    own = docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text"))
    # a quarter of the texts calibrates a machine that was trained on the others
    part = (F.pmod(F.xxhash64("doc_id", F.lit("calibrate")), F.lit(4)) == 0).alias("apart")
    sample = stage(own.join(F.broadcast(ids), "doc_id").select("toxic", part, "text"), "toxicity-sample")
    found = sample.select("toxic", "apart", "text").mapInArrow(span_rows, "toxic boolean, apart boolean, word string")
    toxic, apart = F.col("toxic"), F.col("apart")
    counts = found.groupBy("word").agg(F.count_if(toxic).alias("toxic"), F.count_if(~toxic).alias("clean"), F.count_if(toxic & ~apart).alias("part_toxic"), F.count_if(~toxic & ~apart).alias("part_clean"))
    counts = stage(counts.where("toxic + clean > 1 OR word NOT LIKE '% %'"), "toxicity-strings")
    evidence = F.log((F.col("toxic") + 0.5) / (F.col("clean") + 0.5)) * F.sqrt("toxic")
    telling = counts.orderBy(evidence.desc(), "word").limit(train_words // 2)
    common = counts.orderBy(F.desc(F.col("toxic") + F.col("clean")), "word").limit(train_words)
    table = list({r["word"]: r for r in [*telling.collect(), *common.collect()]}.values())[:train_words]
    if not any(r["toxic"] for r in table) or not any(r["clean"] for r in table):
        return ToxicityModel(Machine(np.zeros(BUCKETS), -1.0), np.append(np.zeros(8), -1.0))

    def trained(toxic: str, clean: str) -> Machine:
        known = [r for r in table if r[toxic] + r[clean]]
        return fit_machine([r["word"] for r in known], *(np.array([r[c] for r in known], float) for c in (toxic, clean)), n_landmarks)

    whole = trained("toxic", "clean")
    split = any(r["part_toxic"] for r in table) and any(r["part_clean"] for r in table)
    machine = trained("part_toxic", "part_clean") if split else whole

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, words in blocks(batches, "text"):
            x = pooled(machine, words)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c) for c in x.T)], ["toxic", "apart", *"abcdefgh"])

    rows = sample.mapInArrow(run, "toxic boolean, apart boolean, " + ", ".join(f"{c} double" for c in "abcdefgh")).orderBy(*"abcdefgh", "toxic").collect()
    if split and {r["toxic"] for r in rows if r["apart"]} == {True, False}:
        rows = [r for r in rows if r["apart"]]
    x, y = np.array([r[2:] for r in rows], float), np.array([r[0] for r in rows], float)
    return ToxicityModel(whole, calibrate(x, y, np.ones(len(y))))


def score_toxicity(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of ``docs``: the chance that the text is toxic, from the text alone.

    NULL and empty texts get the score of a text without words. Rows with a NULL id are not held out, and teach nothing. Repeated rows
    score alike; without labels of both kinds no text is called toxic, and every score is the same; an empty table gives an empty result.
    """
    model = fit_toxicity(docs, labels, id, text, **options)
    own = docs.select(F.col(id).alias("doc_id"), held_out(F.col(id)).alias("held_out"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, words in blocks(batches, "text"):
            score = model.scores(words)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return own.mapInArrow(run, own.select("doc_id", "held_out").schema.add("score", "double").add("predicted", "integer"))
