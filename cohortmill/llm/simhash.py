"""Near duplicates by SimHash: pigeonhole blocks of fingerprints, joined block by block, then checked bit by bit."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortmill.llm.links import components
from cohortmill.llm.staging import fresh, stage
from cohortmill.llm.words import U, ascii_lower, blocks, xxh64

BITS = 64


def simhash(data: np.ndarray, begin: np.ndarray, first: np.ndarray, size: int) -> np.ndarray:
    """Fingerprint of each text from its words joined by spaces: a bit is set if over half the shingle hashes have it."""
    counts = np.diff(first)
    n = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    base = np.concatenate([[0], np.cumsum(n)])
    out = np.zeros(len(counts), U)
    if not base[-1]:
        return out
    at = np.repeat(first[:-1] - base[:-1], n) + np.arange(base[-1])
    last = np.minimum(at + size, np.repeat(first[1:], n))
    h = xxh64(data, begin[at], begin[last] - 1)
    full = np.flatnonzero(n)
    half = n[full].astype(U)
    low = U(0xFFFFFFFF)
    for bit in range(32):  # two counters of 32 bits in one number: of this bit and of the one 32 above
        both = np.add.reduceat((h >> U(bit)) & U(0x0000000100000001), base[full])
        out[full] |= ((both & low) * U(2) > half).astype(U) << U(bit)
        out[full] |= ((both >> U(32)) * U(2) > half).astype(U) << U(bit + 32)
    return out


def fingerprints(docs: DataFrame, text: str = "text", size: int = 3, name: str = "fingerprint") -> DataFrame:
    """``docs`` without ``text``, with the SimHash of its lower-cased word shingles as a long in column ``name``.

    Fewer words than ``size``: the whole sequence is the one shingle. No words or a NULL text: zero.
    """
    keep = [c for c in docs.columns if c != text]
    fields = [f for f in docs.schema if f.name != text]
    schema = docs.select(*[f"`{c}`" for c in keep]).schema.add(name, "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, words in blocks(batches, text):
            joined, begin = words.joined(ascii_lower(words.data))
            prints = simhash(joined, begin, words.first, size)
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(f.name)) for f in fields), pa.array(prints.view(np.int64))], [*keep, name])

    return docs.mapInArrow(run, schema)


def block_masks(bits: int, blocks: int) -> list[int]:
    """Masks that leave ``bits`` of ``blocks`` equal parts of a fingerprint free: prints that differ in that many bits agree under one of them."""
    edges = [BITS * k // blocks for k in range(blocks + 1)]
    parts = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]
    masks = [sum(x) for x in combinations(parts, blocks - bits)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def under_masks(prints: DataFrame, masks: list[int]) -> DataFrame:
    """A row (mask, block, print) for each print and mask."""
    return prints.select("print", F.explode(F.array(*[F.lit(m).cast("long") for m in masks])).alias("mask")).select("mask", F.col("print").bitwiseAND(F.col("mask")).alias("block"), "print")


def forest(group: np.ndarray, prints: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that span what the pairs with at most ``bits`` differing bits in a group connect. Equal groups lie together."""
    left, right = [], []
    for gap in range(1, len(group)):
        same = group[gap:] == group[:-gap]
        if not same.any():
            break
        near = np.flatnonzero(same & (np.bitwise_count(prints[gap:] ^ prints[:-gap]) <= bits))
        left.append(near)
        right.append(near + gap)
    root = np.arange(len(group))
    if left:
        a, b = np.concatenate(left), np.concatenate(right)
        while True:  # the smallest number reaches all members of a tree
            low = np.minimum(root[a], root[b])
            new = root.copy()
            np.minimum.at(new, root[a], low)
            np.minimum.at(new, root[b], low)
            new = new[new]
            if (new == root).all():
                break
            root = new
    member = np.flatnonzero(root != np.arange(len(group)))
    return prints[member], prints[root[member]]


def leaf_links(keys: DataFrame, bits: int) -> DataFrame:
    """Spanning links (a, b) of the blocks in ``keys``, which hold a bounded number of prints each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = [np.zeros(0, np.int64)] * 3
        for batch in batches:
            now = [np.concatenate([r, batch.column(k).to_numpy(zero_copy_only=False)]) for k, r in enumerate(rest)]
            last = np.flatnonzero((now[0] != now[0][-1]) | (now[1] != now[1][-1])) if len(now[0]) else np.zeros(0, np.int64)
            cut = int(last[-1]) + 1 if len(last) else 0
            rest = [x[cut:] for x in now]
            yield linked([x[:cut] for x in now])
        yield linked(rest)

    def linked(part: list[np.ndarray]) -> pa.RecordBatch:
        mask, block, prints = part
        new = np.concatenate([np.zeros(min(1, len(mask)), bool), (mask[1:] != mask[:-1]) | (block[1:] != block[:-1])])
        a, b = forest(np.cumsum(new), prints.view(U), bits)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    return keys.repartition("mask", "block").sortWithinPartitions("mask", "block", "print").mapInArrow(run, "a long, b long")


def near_links(prints: DataFrame, bits: int = 2, leaf: int = 256) -> DataFrame:
    """Links (a, b) that connect whatever distinct ``prints`` (column print) with at most ``bits`` differing bits connect.

    A first division into ``bits`` + 2 blocks needs few rows per print. A block that more than ``leaf`` prints share is divided
    again into blocks of four bits, of which ``bits`` stay free: these hold at most 16 to the power of ``bits`` prints, so no group
    is unbounded and no pair is lost.
    """
    coarse = under_masks(prints, block_masks(bits, bits + 2))
    sizes = coarse.groupBy("mask", "block").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = stage(coarse.join(sizes, ["mask", "block"]), "blocks")
    small = shared.where(F.col("n") <= leaf).select("mask", "block", "print")
    crowded = shared.where(F.col("n") > leaf).select("print").distinct()
    return leaf_links(small.unionByName(under_masks(crowded, block_masks(bits, BITS // 4))), bits)


def members(docs: DataFrame, id: str, text: str, size: int, bits: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, t, print) of each row, staged, with t a hash of the text; and (print, root) of each distinct print."""
    own = docs.select(F.col(id).alias("doc_id"), F.xxhash64(F.col(text)).alias("t"), F.col(text).alias("text"))
    prints = stage(fingerprints(own, "text", size, "print"), "prints")
    distinct = prints.select("print").distinct()
    reach = components(near_links(distinct, bits))
    return prints, stage(distinct.join(reach, "print", "left").select("print", F.coalesce("root", "print").alias("root")), "roots")


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", size: int = 3, bits: int = 2) -> DataFrame:
    """One row per row of ``docs``: its id, fingerprint (16 hex digits) and component_id, the smallest id reachable over links.

    Texts link if their fingerprints differ in at most ``bits`` bits. NULL and empty texts have fingerprint zero and link like any
    other. Repeated rows each get their row, in the same component. A NULL id names no component unless all its ids are NULL.
    An empty table gives an empty result. Only the columns ``id`` and ``text`` are read, so others may have any name.
    """
    prints, roots = members(docs, id, text, size, bits)
    # the smallest id of a print before it meets the root: copies of one text never gather in a task
    lowest = prints.groupBy("print").agg(F.min("doc_id").alias("low")).join(roots, "print")
    named = lowest.join(lowest.groupBy("root").agg(F.min("low").alias("component_id")), "root").select("print", "component_id")
    return prints.join(stage(named, "named"), "print").select("doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", size: int = 3, bits: int = 2, most_rows: int = 500_000) -> DataFrame:
    """One row of ``docs`` per component: the one with the smallest id (NULL last), of equal ids the one with the smallest hash of its text.

    Of rows equal in id and text one stays. Up to ``most_rows`` keys of rows to drop are broadcast; more are met by a shuffle. All
    columns of ``docs`` stay as they are.
    """
    prints, roots = members(docs, id, text, size, bits)
    own = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t")
    lowest = prints.groupBy("print").agg(F.min(own).alias("low")).join(roots, "print")
    lead = lowest.join(lowest.groupBy("root").agg(F.min("low").alias("lead")), "root").select("print", "lead")
    rows = prints.join(stage(lead, "leads"), "print").select("doc_id", "t", (own == F.col("lead")).alias("stays"))
    k1, k2 = fresh(docs, "row_key_1", "row_key_2")
    keyed = docs.withColumns({k1: F.xxhash64(F.col(id)), k2: F.xxhash64(F.col(text))})
    gone = stage(rows.where("NOT stays").select(F.xxhash64("doc_id").alias(k1), F.col("t").alias(k2)).distinct(), "gone")
    left = keyed.join(F.broadcast(gone) if gone.count() <= most_rows else gone, [k1, k2], "left_anti")
    kept = rows.where("stays").agg(F.count(F.lit(1)), F.count_distinct(F.struct("doc_id", "t"))).first()
    return (left if kept[0] == kept[1] else left.dropDuplicates([k1, k2])).drop(k1, k2)
