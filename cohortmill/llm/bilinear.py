"""A log-bilinear language model over units of words: learnt by noise-contrastive estimation, scored with exact norms.

Each frequent word is a unit, all other words share a unit with those of the same ending, and the end of a text is a unit. A
context is the two units before; its vector is the sum of their vectors by place, and a unit's score is the product of its own
vector with that, plus its bias. The norms of all contexts are worked out at once by matrix products. Within a unit, words have
their share of the unit's smoothed counts over the whole training corpus.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortmill.llm.staging import stage
from cohortmill.llm.words import BASE, U, Words, blocks, mix

#: Weight of an occurrence that each known word, and one unknown word, has besides its own.
PRIOR = 0.1
MOST_ROWS = 2_000_000
#: Learning: texts are taken in blocks, the tokens of a block in random order, and in batches of which each has its own noise.
BATCH, NOISE, WIDTH, RATE = 512, 32, 16, 0.1
#: Contexts whose norm is worked out in one matrix product.
NORM_ROWS = 256


@dataclass
class Units:
    """``hashes`` of the words that are units of their own, sorted; ``n`` of all units: the end, these words, the endings."""

    hashes: np.ndarray
    n_endings: int

    @property
    def n(self) -> int:
        return 1 + len(self.hashes) + self.n_endings

    def of(self, words: Words, hashes: np.ndarray, endings: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.hashes, hashes)
        own = np.zeros(len(hashes), bool)
        if len(self.hashes):
            at = np.minimum(at, len(self.hashes) - 1)
            own = self.hashes[at] == hashes
        return np.where(own, 1 + at, 1 + len(self.hashes) + endings).astype(np.int32)


def endings_of(words: Words, n: int) -> np.ndarray:
    """For each word a number below ``n`` that its last three bytes determine."""
    code, size = np.zeros(len(words), U), words.end - words.start
    for k in range(3):
        byte = words.data[np.maximum(words.end - 1 - k, 0)] if len(words.data) else np.zeros(len(words), np.uint8)
        code = code * U(257) + np.where(size > k, byte.astype(U) + U(1), U(0))
    return (mix(code * BASE) % U(n)).astype(np.int32)


def in_context(words: Words, units: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(unit, unit before, unit two before, text) of all tokens of a block, the end of each text among them.

    Before a text stands ``start``.
    """
    n_texts = len(words.first) - 1
    at = np.arange(n_texts)
    now = np.zeros(len(units) + n_texts, np.int32)
    now[np.arange(len(units)) + words.text_of] = units
    begin = words.first[:-1] + at
    before, earlier = np.full(len(now), start, np.int32), np.full(len(now), start, np.int32)
    before[1:], earlier[2:] = now[:-1], now[:-2]
    before[begin] = start
    earlier[begin] = start
    earlier[np.minimum(begin + 1, len(now) - 1)] = start
    return now, before, earlier, np.repeat(at, words.counts + 1)


class Bilinear:
    """Vectors of units as the first and second unit before and as the unit told, and the units' biases, in one array."""

    def __init__(self, n: int, width: int = WIDTH, values: np.ndarray | None = None):
        self.n, self.width = n, width
        self.values = np.zeros(self.size(n, width), np.float32) if values is None else values.astype(np.float32)
        cut = np.cumsum([(n + 1) * width, (n + 1) * width, n * width])
        self.first, self.second, self.told = (x.reshape(-1, width) for x in np.split(self.values, cut)[:3])
        self.bias = self.values[cut[2] :]

    @staticmethod
    def size(n: int, width: int) -> int:
        return 2 * (n + 1) * width + n * width + n

    @classmethod
    def begun(cls, share: np.ndarray, seed: int, width: int = WIDTH) -> Bilinear:
        """Small random vectors, and the logarithm of each unit's share as its bias."""
        out = cls(len(share), width)
        out.values[:] = np.random.default_rng(seed).normal(0, 0.1, len(out.values))
        out.bias[:] = np.log(share)
        return out

    def learn(self, now: np.ndarray, before: np.ndarray, earlier: np.ndarray, noise: np.ndarray, share: np.ndarray, spread: np.ndarray) -> None:
        """One step: tell the tokens of a batch from ``noise`` units drawn by ``share``. ``spread`` sums the squared gradients."""
        step = Bilinear(self.n, self.width)
        context = self.first[before] + self.second[earlier]
        chance = np.log(len(noise) * share).astype(np.float32)
        true = 1 / (1 + np.exp(np.clip((context * self.told[now]).sum(1) + self.bias[now] - chance[now], -30, 30)))
        other = self.told[noise]
        false = -1 / (1 + np.exp(-np.clip(context @ other.T + (self.bias[noise] - chance[noise]), -30, 30)))
        pull = true[:, None] * self.told[now] + false @ other
        _add(step.first, before, pull)
        _add(step.second, earlier, pull)
        _add(step.told, now, true[:, None] * context)
        np.add.at(step.told, noise, false.T @ context)
        step.bias += np.bincount(now, true, self.n).astype(np.float32)
        np.add.at(step.bias, noise, false.sum(0))
        spread += step.values**2
        self.values += RATE * step.values / (np.sqrt(spread) + 1e-6)

    def norms(self, earlier: int) -> np.ndarray:
        """The logarithm of the sum over all units, for each unit before and the unit ``earlier`` before that."""
        out = np.empty(self.n + 1)
        for at in range(0, self.n + 1, NORM_ROWS):
            score = (self.first[at : at + NORM_ROWS] + self.second[earlier]) @ self.told.T + self.bias
            most = score.max(1)
            out[at : at + NORM_ROWS] = most + np.log(np.exp(score - most[:, None]).sum(1, dtype=np.float64))
        return out


def _add(out: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
    """Add each row at its place; places repeat."""
    order = np.argsort(at, kind="stable")
    placed = at[order]
    begin = np.flatnonzero(np.concatenate([[True], placed[1:] != placed[:-1]]))
    out[placed[begin]] += np.add.reduceat(rows[order], begin)


def held_out(id: Column) -> Column:
    """Rows that nothing is learnt from."""
    return F.crc32(F.coalesce(id.cast("string"), F.lit("")).cast("binary")) % 10 == 0


def word_counts(texts: DataFrame, n_endings: int) -> DataFrame:
    """(word, ending, n) over all texts, staged: the hash of each distinct word, the number of its ending, its occurrences."""

    def summed(parts: list[tuple]) -> tuple:
        word, ending, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        word, first, place = np.unique(word, return_index=True, return_inverse=True)
        return word, ending[first], np.bincount(place, n, len(word)).astype(np.int64)

    def rows(parts: list[tuple]) -> pa.RecordBatch:
        word, ending, n = summed(parts)
        return pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(ending), pa.array(n)], names=["word", "ending", "n"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered: list[tuple] = []
        for _, words in blocks(batches, "text", lower=True):
            if len(words):
                gathered.append(summed([(words.hashes(), endings_of(words, n_endings), np.ones(len(words), np.int64))]))
            if sum(len(x[0]) for x in gathered) > MOST_ROWS:
                yield rows(gathered)
                gathered = []
        if gathered:
            yield rows(gathered)

    found = texts.select("text").mapInArrow(counted, "word long, ending int, n long")
    return stage(found.groupBy("word", "ending").agg(F.sum("n").alias("n")), "word-counts")


@dataclass
class Corpus:
    """What the whole training corpus says about words: totals, unit sizes, and counts of the words that are looked up at once."""

    tokens: int
    distinct: int
    n_texts: int
    units: Units
    unit_n: np.ndarray
    unit_words: np.ndarray
    words: np.ndarray
    counts: np.ndarray

    @property
    def share(self) -> np.ndarray:
        return (self.unit_n + PRIOR) / (self.unit_n + PRIOR).sum()

    @property
    def base(self) -> float:
        """What the base score divides by, as a logarithm."""
        return math.log10(self.tokens + PRIOR * (self.distinct + 1))

    @property
    def within(self) -> np.ndarray:
        """What a word's count is divided by within its unit, as a logarithm."""
        return np.log10(self.unit_n + PRIOR * (self.unit_words + 1))


def corpus_of(counts: DataFrame, n_texts: int, n_words: int, n_endings: int, n_known: int) -> Corpus:
    """Only totals, ``n_endings`` sums, the ``n_words`` most frequent words and up to ``n_known`` others come to the driver.

    These others are all words from a count on that at most ``n_known`` words reach. The count is found from the sizes of classes of
    counts (eight to a doubling), so no task orders the words.
    """
    own = counts.orderBy(F.col("n").desc(), "word").limit(n_words).toArrow().to_pandas()
    size = F.floor(8 * F.log2("n")).cast("int")
    classes = counts.groupBy(size.alias("size")).agg(F.count(F.lit(1)).alias("words")).toArrow().to_pandas().sort_values("size", ascending=False)
    reached = classes["size"][classes["words"].cumsum() <= n_known]
    least = int(reached.min()) if len(reached) else 1 << 30
    known = counts.where(size >= least).toArrow().to_pandas()
    known = pd.concat([own, known]).drop_duplicates("word")
    per_ending = counts.groupBy("ending").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("words")).toArrow().to_pandas()
    tokens, distinct = int(per_ending["n"].sum()) + n_texts, int(per_ending["words"].sum()) + (n_texts > 0)
    n, words = np.zeros(n_endings, np.int64), np.zeros(n_endings, np.int64)
    n[per_ending["ending"]], words[per_ending["ending"]] = per_ending["n"], per_ending["words"]
    np.subtract.at(n, own["ending"].to_numpy(), own["n"].to_numpy())
    np.subtract.at(words, own["ending"].to_numpy(), 1)
    hashes, order = (lambda h: (h, np.argsort(h)))(own["word"].to_numpy().view(U))
    every = known["word"].to_numpy().view(U)
    by = np.argsort(every)
    return Corpus(
        tokens, distinct, n_texts, Units(hashes[order], n_endings), np.concatenate([[n_texts], own["n"].to_numpy()[order], n]).astype(np.int64),
        np.concatenate([np.ones(1 + len(own), np.int64), words]), every[by], known["n"].to_numpy()[by],
    )


def trained(texts: DataFrame, corpus: Corpus, model: Bilinear, seed: int) -> Bilinear:
    """The model after every task has learnt from its texts, each from ``model`` on: the mean over tasks, by tokens."""
    units, share, start, width = corpus.units, corpus.share, model.values, model.width

    def learnt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, spread, tokens = Bilinear(units.n, width, start.copy()), np.full(len(start), 1e-2, np.float32), 0
        random = np.random.default_rng([seed, TaskContext.get().partitionId()])
        limits = np.cumsum(share)
        for _, words in blocks(batches, "text", lower=True):
            told = units.of(words, words.hashes(), endings_of(words, units.n_endings))
            now, before, earlier, _ = in_context(words, told, units.n)
            order = random.permutation(len(now))
            tokens += len(now)
            for at in range(0, len(now), BATCH):
                i = order[at : at + BATCH]
                noise = np.minimum(np.searchsorted(limits, random.random(NOISE), "right"), units.n - 1)
                own.learn(now[i], before[i], earlier[i], noise, share, spread)
        if tokens:
            yield pa.RecordBatch.from_arrays([pa.array([tokens], pa.int64()), pa.array([own.values], pa.list_(pa.float32()))], names=["tokens", "values"])

    each = texts.select("text").mapInArrow(learnt, "tokens long, values array<float>")
    mean = each.select("tokens", F.posexplode("values").alias("at", "value")).groupBy("at").agg((F.sum(F.col("value") * F.col("tokens")) / F.sum("tokens")).alias("value"))
    rows = mean.toArrow()  # as many as the model has numbers
    if not rows.num_rows:
        return model
    values = np.empty(len(start), np.float32)
    values[rows["at"].to_numpy()] = rows["value"].to_numpy()
    return Bilinear(units.n, width, values)


def all_norms(docs: DataFrame, model: Bilinear) -> np.ndarray:
    """[unit before, unit before that] of all contexts; tasks share the work."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([model.norms(k)], pa.list_(pa.float64()))], names=["earlier", "norms"])

    found = docs.sparkSession.range(model.n + 1).mapInArrow(rows, "earlier long, norms array<double>").toArrow()
    out = np.empty((model.n + 1, model.n + 1), np.float32)
    out[:, found["earlier"].to_numpy()] = np.stack(found["norms"].to_numpy()).T
    return out


def text_scores(texts: DataFrame, corpus: Corpus, model: Bilinear, norms: np.ndarray, kind: str) -> DataFrame:
    """(row, id, n_tokens, n_known, base, score, rare, times) of each text, staged.

    ``rare`` are the hashes of the words that the corpus may know but the driver does not; their counts are still to be added.
    """
    units, within, base_of = corpus.units, corpus.within, corpus.base
    n_own = len(units.hashes)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = model.first @ model.told.T, model.second @ model.told.T
        for rows, words in blocks(batches, "text", lower=True):
            hashes = words.hashes()
            told = units.of(words, hashes, endings_of(words, units.n_endings))
            now, before, earlier, text = in_context(words, told, units.n)
            n = rows.num_rows
            chance = (first[before, now] + second[earlier, now] + model.bias[now] - norms[before, earlier]) / np.log(10)
            at = np.minimum(np.searchsorted(corpus.words, hashes), max(0, len(corpus.words) - 1))
            known = corpus.words[at] == hashes if len(corpus.words) else np.zeros(len(words), bool)
            of = words.text_of
            count = np.log10(np.where(known, corpus.counts[at] if len(corpus.words) else 0, 0) + PRIOR)
            shared = told > n_own
            score = np.bincount(text, chance, n) + np.bincount(of, np.where(shared, np.where(known, count, 0) - within[told], 0), n)
            end = math.log10(corpus.n_texts + PRIOR)
            base = np.bincount(of, np.where(known, count, 0), n) + end - base_of * (words.counts + 1)
            n_known = np.bincount(of, known, n).astype(np.int64) + (corpus.n_texts > 0)
            rest = np.flatnonzero(~known)
            order = rest[np.lexsort((hashes[rest], of[rest]))]
            new = np.ones(len(order), bool)
            new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (of[order][1:] != of[order][:-1])
            begin = np.flatnonzero(new)
            times = np.diff(np.append(begin, len(order))).astype(np.int32)
            ends = np.searchsorted(of[order[begin]], np.arange(n + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x)) for x in (hashes[order[begin]].view(np.int64), times)]
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(words.counts + 1, pa.int64()), pa.array(n_known), pa.array(base), pa.array(score), *lists], names=["row", "id", "n_tokens", "n_known", "base", "score", "rare", "times"])

    return stage(texts.select("row", "id", "text").mapInArrow(scored, f"row long, id {kind}, n_tokens long, n_known long, base double, score double, rare array<long>, times array<int>"), "scores")


def score_texts(docs: DataFrame, id: str = "doc_id", text: str = "text", n_words: int = 512, n_endings: int = 255, n_known: int = 200_000, rounds: int = 2, seed: int = 42) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row of ``docs``.

    Tokens are words with A-Z in lower case, and one end. All rows whose id has a CRC-32 that ten does not divide are learnt from: words
    are counted over all of them, and the model learns from each of them in one of ``rounds`` passes, in which every task learns from
    its own texts and the mean goes on. ``base_score`` adds up the logarithms of smoothed shares of the words, ``score`` those of
    the model: the chance of the unit after the two before it, times the word's share of its unit. Both go by tens and are of the
    whole text. The counts of up to ``n_known`` of the most frequent words go to all tasks; texts meet those of all other words in a join.
    A NULL or empty text is its end alone; a NULL id counts as empty text and is held out; repeated rows are learnt from again and get
    equal scores. Without rows to learn from, every word is unknown. An empty table gives an empty result. Only the two columns
    named are read.
    """
    kind = docs.schema[id].dataType.simpleString()
    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id).alias("id"), F.col(text).alias("text"))
    learnt = texts.where(~held_out(F.col("id")))
    counts = word_counts(learnt, n_endings)
    corpus = corpus_of(counts, learnt.count(), n_words, n_endings, n_known)
    model = Bilinear.begun(corpus.share, seed)
    turn = F.pmod(F.xxhash64(F.col("id"), F.lit(seed)), F.lit(rounds))
    for k in range(rounds):
        model = trained(learnt.where(turn == k), corpus, model, seed + k)
    found = text_scores(texts, corpus, model, all_norms(docs, model), kind)
    rare = found.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("word"), "x.times")
    met = rare.join(counts.select("word", "n"), "word", "left")
    more = met.groupBy("row").agg(F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + PRIOR)).alias("more"), F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("also"))
    both, zero = found.join(more, "row", "left"), F.lit(0)
    return both.select(
        F.col("id").alias("doc_id"), held_out(F.col("id")).alias("held_out"), "n_tokens", (F.col("n_known") + F.coalesce("also", zero)).alias("n_known"), F.lit(corpus.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"), (F.col("score") + F.coalesce("more", F.lit(0.0))).alias("score"),
    )
