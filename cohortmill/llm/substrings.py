"""Substring deduplication: suffix automata of reference shards, against which documents stream for matching statistics.

An automaton for every shard against every document would cost documents times shards, so a document streams past those shards alone
that can match. Of every window of ``size`` words the smallest hash of its ``gram``-word runs is its anchor; equal windows have equal
anchors, so a window whose anchor occurs once is left alone. The hashes of the rest tell which windows come again and where each
comes first. First occurrences make up the reference, in shards by document. What may repeat them streams past the automaton of
their shard, which decides on the words themselves.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortmill.llm.staging import stage
from cohortmill.llm.words import U, Words, blocks, mix, run_hashes

LAST = (1 << 63) - 1


def window_anchors(hashes: np.ndarray, size: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """For each word the place and hash of the anchor of the window that begins there, as if all words were one text."""
    grams = run_hashes(hashes, gram)
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, U)
    value, place, width, wide = grams, np.arange(len(grams)), 1, size - gram + 1
    while width < wide:
        step = min(width, wide - width)
        left, right = value[:-step], value[step:]
        first = left <= right
        place = np.where(first, place[:-step], place[step:])
        value = np.where(first, left, right)
        width += step
    return place[:n], value[:n]


def sequence_hashes(hashes: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """Two hashes of the word sequence of each text."""
    out = []
    for salt in (U(0x632BE59BD9B4E019), U(0x2545F4914F6CDD1D)):
        place = np.arange(len(hashes)) - np.repeat(first[:-1], np.diff(first))
        total = np.concatenate([np.zeros(1, U), np.cumsum(mix(mix(hashes ^ salt) + place.astype(U) * salt))])
        out.append(mix(total[first[1:]] - total[first[:-1]]).view(np.int64))
    return out


def profiles(docs: DataFrame) -> DataFrame:
    """(d, t, n, h1, h2, sha) of each row: number of words, hashes of their sequence, SHA-256 of the words joined by spaces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, words in blocks(batches, "text"):
            joined, begin = words.joined()
            raw = joined.tobytes()
            edges = begin[words.first]
            sha = [hashlib.sha256(raw[a : max(a, b - 1)]).hexdigest() for a, b in zip(edges, edges[1:], strict=False)]
            h = sequence_hashes(words.hashes(), words.first)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(words.counts, pa.int64()), pa.array(h[0]), pa.array(h[1]), pa.array(sha, pa.string())], ["d", "t", "n", "h1", "h2", "sha"])

    return docs.mapInArrow(run, "d long, t long, n long, h1 long, h2 long, sha string")


def anchors(docs: DataFrame, size: int, gram: int) -> DataFrame:
    """(anchor) of each place in a text that is the anchor of a window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, words in blocks(batches, "text"):
            at = words.runs(size)
            place, value = window_anchors(words.hashes(), size, gram)
            _, one = np.unique(place[at], return_index=True)
            yield pa.RecordBatch.from_arrays([pa.array(value[at][one].view(np.int64))], ["anchor"])

    return docs.select("text").mapInArrow(run, "anchor long")


class Sieve:
    """A Bloom filter of two bits per hash. It lets every hash pass that was put in, and few others while it is sparsely filled.

    It has 16 bits or more per hash, up to 2 to the power of ``most`` in all (256 MB); beyond that more of the others pass, which costs time alone.
    """

    BLOCK = 20

    def __init__(self, hashes: DataFrame, most: int = 31):
        """Filled from a column of longs: each block of bits is put together in Spark."""
        n = hashes.count()
        self.power = min(most, max(self.BLOCK, (16 * n - 1).bit_length() if n else 0))
        name, power, block = hashes.columns[0], self.power, self.BLOCK

        def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                bits = np.concatenate(Sieve.bits(batch.column(0).to_numpy(zero_copy_only=False).view(U), power))
                yield pa.RecordBatch.from_arrays([pa.array((bits >> block).astype(np.int32)), pa.array((bits & ((1 << block) - 1)).astype(np.int32))], ["block", "bit"])

        def filled(part: pd.DataFrame) -> pd.DataFrame:
            bits = np.zeros(1 << block, bool)
            bits[part["bit"].to_numpy()] = True
            return pd.DataFrame({"block": part["block"].iloc[:1], "bits": [np.packbits(bits, bitorder="little").tobytes()]})

        rows = hashes.select(name).mapInArrow(places, "block int, bit int").distinct().groupBy("block").applyInPandas(filled, "block int, bits binary")
        self.table = np.zeros(1 << (self.power - 3), np.uint8)
        for row in rows.toLocalIterator():
            at = row["block"] << (block - 3)
            self.table[at : at + (1 << (block - 3))] = np.frombuffer(row["bits"], np.uint8)

    @staticmethod
    def bits(hashes: np.ndarray, power: int) -> list[np.ndarray]:
        return [(mix(hashes ^ salt) >> U(64 - power)).astype(np.int64) for salt in (U(0x8CB92BA72F3D8DD7), U(0x3C79AC492BA7B653))]

    def passes(self, hashes: np.ndarray) -> np.ndarray:
        out = np.ones(len(hashes), bool)
        for bit in self.bits(hashes, self.power):
            out &= (self.table[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1
        return out


def windows(docs: DataFrame, sieve: Sieve, size: int, gram: int) -> DataFrame:
    """(w, d, t, start): the hash and place of each window whose anchor the sieve lets pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, words in blocks(batches, "text"):
            hashes, at = words.hashes(), words.runs(size)
            _, value = window_anchors(hashes, size, gram)
            at = at[sieve.passes(value[at])]
            text = words.text_of[at] if len(at) else at
            w = run_hashes(hashes, size)
            d, t = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(w[at].view(np.int64)), pa.array(d[text]), pa.array(t[text]), pa.array((at - words.first[text]).astype(np.int32))], ["w", "d", "t", "start"])

    return docs.select("d", "t", "text").mapInArrow(run, "w long, d long, t long, start int")


def pieces(texts: DataFrame, size: int, most: int = 1 << 13) -> DataFrame:
    """(shard, d, t, start, words): what the windows at ``places`` (shard, start) cover, one piece for each run of one shard.

    A piece has at most ``most`` windows; the next one begins with the next window, so no window is lost.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, words in blocks(batches, "text"):
            hashes = words.hashes().view(np.int64)
            column = batch.column(3)
            edge = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
            shard, start = (column.values.field(k).to_numpy(zero_copy_only=False)[edge[0] : edge[-1]] for k in (0, 1))
            text = np.repeat(np.arange(len(column)), np.diff(edge))
            order = np.lexsort((start, shard, text))
            text, shard, start = text[order], shard[order], start[order]
            new = np.ones(len(text), bool)
            new[1:] = (text[1:] != text[:-1]) | (shard[1:] != shard[:-1]) | (start[1:] > start[:-1] + size)
            head = np.flatnonzero(new)
            run_at = np.arange(len(text)) - np.repeat(head, np.diff(np.append(head, len(text))))
            head = np.flatnonzero(run_at % most == 0)
            tail = np.append(head[1:], len(text)) - 1
            length = (start[tail] + size - start[head]) if len(text) else np.zeros(0, np.int64)
            begin = np.concatenate([[0], np.cumsum(length)]).astype(np.int64)
            first = words.first[text[head]] + start[head]
            index = np.repeat(first - begin[:-1], length) + np.arange(begin[-1])
            lists = pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), pa.array(hashes[index]))
            owner = pa.array(text[head])
            yield pa.RecordBatch.from_arrays([pa.array(shard[head].astype(np.int32)), batch.column(0).take(owner), batch.column(1).take(owner), pa.array(start[head].astype(np.int32)), lists], ["shard", "d", "t", "start", "words"])

    return texts.select("d", "t", "text", "places").mapInArrow(run, "shard int, d long, t long, start int, words array<long>")


class Automaton:
    """The suffix automaton of a token list: per state its transitions, suffix link, longest length and first end."""

    def __init__(self, tokens: list[int]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.first = [-1], [0], [-1]
        last = 0
        for i, token in enumerate(tokens):
            last = self._extend(last, token, i)

    def _state(self, moves: dict[int, int], link: int, length: int, first: int) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        self.first.append(first)
        return len(self.link) - 1

    def _extend(self, last: int, token: int, end: int) -> int:
        new = self._state({}, 0, self.length[last] + 1, end)
        at = last
        while at >= 0 and token not in self.next[at]:
            self.next[at][token] = new
            at = self.link[at]
        if at >= 0:
            goal = self.next[at][token]
            if self.length[goal] != self.length[at] + 1:
                twin = self._state(dict(self.next[goal]), self.link[goal], self.length[at] + 1, self.first[goal])
                while at >= 0 and self.next[at].get(token) == goal:
                    self.next[at][token] = twin
                    at = self.link[at]
                self.link[goal] = twin
                goal = twin
            self.link[new] = goal
        return new

    def first_ends(self, tokens: list[int], size: int) -> Iterator[tuple[int, int]]:
        """(end in ``tokens``, first end in the reference) for each end at which the longest match has ``size`` tokens or more."""
        state = matched = 0
        for i, token in enumerate(tokens):
            while state and token not in self.next[state]:
                state = self.link[state]
                matched = self.length[state]
            if token not in self.next[state]:
                continue
            state = self.next[state][token]
            matched += 1
            if matched >= size:
                while self.length[self.link[state]] >= size:
                    state = self.link[state]
                    matched = self.length[state]
                yield i, self.first[state]


def match_shard(reference: pd.DataFrame, queries: pd.DataFrame, size: int) -> pd.DataFrame:
    """Maximal spans (d, t, start, end) of the queries made of windows that the reference has earlier."""
    out: list[tuple[int, int, int, int]] = []
    if len(reference) and len(queries):
        reference = reference.sort_values(["d", "t", "start"], kind="stable")
        tokens: list[int] = []
        begin = []
        for k, words in enumerate(reference["words"]):
            begin.append(len(tokens))
            tokens += words.tolist()
            tokens.append(-k - 1 - (1 << 64))  # an end that equals no word
        where = list(zip(reference["d"].tolist(), reference["t"].tolist(), reference["start"].tolist(), strict=True))
        automaton = Automaton(tokens)
        for d, t, start, words in zip(queries["d"].tolist(), queries["t"].tolist(), queries["start"].tolist(), queries["words"], strict=True):
            low = high = -1
            for end, first in automaton.first_ends(words.tolist(), size):
                passage = bisect_right(begin, first) - 1
                rd, rt, rstart = where[passage]
                from_ = end - size + 1
                if (rd, rt, rstart + first - begin[passage] - size + 1) < (d, t, start + from_):
                    if from_ > high:
                        if high > low:
                            out.append((d, t, start + low, start + high))
                        low = from_
                    high = end + 1
            if high > low:
                out.append((d, t, start + low, start + high))
    return pd.DataFrame(out, columns=["d", "t", "start", "end"])


def repeated_spans(texts: DataFrame, size: int, task_words: int) -> DataFrame:
    """(d, t, spans) of the texts that hold windows found earlier. ``places`` lists the windows of a text that come first, with
    the own shard and ``first``, and those that come again, with the shard of the first."""
    given = pieces(texts.withColumn("places", F.expr("transform(filter(places, p -> p.first), p -> struct(p.shard, p.start))")), size)
    asked = pieces(texts.withColumn("places", F.expr("transform(filter(places, p -> NOT p.first), p -> struct(p.shard, p.start))")), size)
    # a shard that many passages visit is given to several tasks, each with its own copy of the automaton
    visits = texts.select(F.explode("places").alias("p")).where("NOT p.first").groupBy(F.col("p.shard").alias("shard")).agg((F.count(F.lit(1)) / F.lit(task_words)).cast("int").alias("more"))
    visits = stage(visits, "visits")
    asked = asked.join(visits, "shard").withColumn("part", F.pmod(F.xxhash64("d", "t", "start"), F.col("more") + 1).cast("int")).drop("more")
    given = given.join(visits, "shard").withColumn("part", F.explode(F.sequence(F.lit(0), "more"))).drop("more")
    found = given.groupBy("shard", "part").cogroup(asked.groupBy("shard", "part")).applyInPandas(lambda a, b: match_shard(a, b, size), "d long, t long, start int, end int")
    return found.groupBy("d", "t").agg(F.collect_list(F.struct("start", "end")).alias("spans"))


def without_spans(texts: DataFrame) -> DataFrame:
    """(d, t, removed, kept) of texts with ``spans`` of words to take out; kept words are joined by one space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, words in blocks(batches, "text"):
            joined, begin = words.joined()
            raw = joined.tobytes()
            removed, kept = [], []
            for k, spans in enumerate(batch.column(3).to_pylist()):
                a, b = int(words.first[k]), int(words.first[k + 1])
                stays = np.ones(b - a, bool)
                for span in spans:
                    stays[span["start"] : span["end"]] = False
                rows = np.flatnonzero(stays) + a
                kept.append(" ".join(raw[begin[i] : begin[i + 1] - 1].decode() for i in rows))
                removed.append(b - a - len(rows))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], ["d", "t", "removed", "kept"])

    return texts.select("d", "t", "text", "spans").mapInArrow(run, "d long, t long, removed long, kept string")


def _met(big: DataFrame, keys: DataFrame, how: str, most_rows: int) -> DataFrame:
    """``big`` joined with staged keys, broadcast up to ``most_rows``."""
    return big.join(F.broadcast(keys) if keys.count() <= most_rows else keys, ["d", "t"], how)


def dedup_substrings(docs: DataFrame, id: str = "doc_id", text: str = "text", size: int = 20, gram: int = 6, shard_windows: int = 30_000, task_words: int = 300_000, most_rows: int = 1_000_000) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) per row: words go that a window of ``size`` words covers whose sequence starts earlier.

    Earlier is a smaller id, or a smaller start in the same text; windows are judged on the input. Rows with a NULL id come after all
    others; rows that share an id come in the order of a hash of their texts, and equal rows are one document and get equal results.
    NULL, empty and short texts lose nothing. A text whose word sequence an earlier one has goes as a whole without being matched
    word by word. An empty table gives an empty result. Only ``id`` (a whole number) and ``text`` are read. Lists of up to
    ``most_rows`` texts to look at, or to leave out, are broadcast; longer ones are met by a shuffle.
    """
    own = docs.select(F.coalesce(F.col(id).cast("long"), F.lit(LAST)).alias("d"), F.xxhash64(F.col(text)).alias("t"), F.col(text).alias("text"))
    profile = stage(profiles(own), "profiles")
    # the hash of the text tells rows of one id apart; where ids are unique it need not travel
    total = profile.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("d").alias("ids")).first()
    if total["rows"] == total["ids"]:
        own, profile = (x.withColumn("t", F.lit(0).cast("long")) for x in (own, profile))
    # the first text of each word sequence stands for all
    first = profile.groupBy("h1", "h2", "n").agg(F.min(F.struct("d", "t")).alias("lead")).select("lead.*", F.lit(True).alias("leads"))
    rows = stage(profile.drop("h1", "h2").join(first, ["d", "t"], "left").withColumn("leads", F.col("leads").isNotNull()), "rows")
    copies = stage(rows.where("NOT leads").select("d", "t").distinct(), "copies")
    leads = _met(own, copies, "left_anti", most_rows)

    again = stage(anchors(leads, size, gram).groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor"), "anchors")
    sieve = Sieve(again)
    place = F.struct("d", "t", "start")
    firsts = windows(leads, sieve, size, gram).groupBy("w").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("at")).where("n > 1").select("w", "at")
    firsts = stage(firsts, "firsts")
    shards = firsts.count() // shard_windows + 1
    shard = F.pmod(F.xxhash64("at.d", "at.t"), F.lit(shards)).cast("int").alias("shard")
    later = windows(leads, sieve, size, gram).join(firsts, "w").where(place != F.col("at")).select("d", "t", "start", shard, F.lit(False).alias("first"))
    every = later.unionByName(firsts.select("at.d", "at.t", "at.start", shard, F.lit(True).alias("first")))
    places = stage(every.groupBy("d", "t").agg(F.collect_list(F.struct("shard", "start", "first")).alias("places")), "places")
    touched = _met(leads, places.select("d", "t"), "left_semi", most_rows).join(places, ["d", "t"])
    texts = stage(touched if total["rows"] == total["ids"] else touched.dropDuplicates(["d", "t"]), "texts")

    spans = repeated_spans(texts, size, task_words)
    changed = without_spans(texts.drop("places").join(spans, ["d", "t"])).select("d", "t", "removed", F.sha2("kept", 256).alias("kept"))
    met = rows.join(changed, ["d", "t"], "left")
    whole = ~F.col("leads") & (F.col("n") >= size)
    removed = F.when(whole, F.col("n")).otherwise(F.coalesce("removed", F.lit(0)))
    sha = F.when(whole, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept", "sha"))
    doc_id = F.when(F.col("d") != LAST, F.col("d")).alias("doc_id")
    return met.select(doc_id, F.col("n").alias("n_words"), removed.alias("n_removed"), sha.alias("kept_sha256"))
