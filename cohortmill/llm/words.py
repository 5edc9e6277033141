"""Words of a block of texts as arrays: where they begin and end, and hashes of them and of runs of them.

A word is a run of bytes other than space, tab, newline, vertical tab, form feed and carriage return. All work is on
whole arrays; a block holds a few MB of text, or one text if that is longer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 2 << 20
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
U = np.uint64


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, one after the other, and where each begins (with the end of the last). NULL is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    if not len(column) or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(batches: Iterator[pa.RecordBatch], text: str, most: int = BLOCK_BYTES, space: np.ndarray = SPACE, lower: bool = False) -> Iterator[tuple[pa.RecordBatch, Words]]:
    """Parts of the batches with at most ``most`` bytes of text, or one row, each with its words (A-Z in lower case if ``lower``)."""
    for batch in batches:
        data, offsets = text_bytes(batch.column(batch.schema.get_field_index(text)))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
            part = data[offsets[at] : offsets[to]]
            yield batch.slice(at, to - at), Words(ascii_lower(part) if lower else part, offsets[at : to + 1] - offsets[at], space)
            at = to


class Words:
    """``start`` and ``end`` of each word in ``data``, and ``first``: the number of the first word of each text.

    ``space`` says of each byte whether it separates words.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE):
        self.data, self.offsets = data, offsets
        solid = np.zeros(len(data) + 2, bool)
        solid[1:-1] = ~space[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        self.start = np.flatnonzero(solid[1:-1] & (~solid[:-2] | edge[:-1]))
        self.end = np.flatnonzero(solid[1:-1] & (~solid[2:] | edge[1:])) + 1
        self.first = np.searchsorted(self.start, offsets)

    def __len__(self) -> int:
        return len(self.start)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def text_of(self) -> np.ndarray:
        """For each word the number of its text."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def hashes(self, data: np.ndarray | None = None) -> np.ndarray:
        """A 64-bit hash of each word (of the same places in ``data`` if given)."""
        data = self.data if data is None else data
        if not len(self):
            return np.zeros(0, U)
        up, down = powers(len(data) + 1)
        total = np.zeros(len(data) + 1, U)
        np.cumsum((data.astype(U) + U(1)) * up[: len(data)], out=total[1:])
        return mix((total[self.end] - total[self.start]) * down[self.start] + (self.end - self.start).astype(U))

    def runs(self, size: int) -> np.ndarray:
        """Numbers of the words at which a run of ``size`` words of one text begins."""
        if len(self) < size:
            return np.zeros(0, np.int64)
        text = self.text_of
        return np.flatnonzero(text[: len(self) - size + 1] == text[size - 1 :])

    def strings(self, at: np.ndarray) -> pa.Array:
        """The words of the given numbers as text."""
        size = self.end[at] - self.start[at]
        begin = np.concatenate([[0], np.cumsum(size)])
        source = np.repeat(self.start[at] - begin[:-1], size) + np.arange(begin[-1])
        return pa.Array.from_buffers(pa.string(), len(at), [None, pa.py_buffer(begin.astype(np.int32).tobytes()), pa.py_buffer(self.data[source].tobytes())])

    def joined(self, data: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All words, each followed by one space, and where each begins there (with the end of the last)."""
        data = self.data if data is None else data
        size = self.end - self.start + 1
        begin = np.concatenate([[0], np.cumsum(size)])
        source = np.repeat(self.start - begin[:-1], size) + np.arange(begin[-1])
        out = data[np.minimum(source, max(0, len(data) - 1))] if len(data) else np.zeros(0, np.uint8)
        out[begin[1:] - 1] = 32
        return out, begin


_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE to the powers 0 to n - 1 and the inverses of these, modulo 2^64."""
    if not _powers or len(_powers[0]) < n:
        _powers[:] = [np.cumprod(np.concatenate([np.ones(1, U), np.full(n - 1, b, U)])) for b in (BASE, BASE_INVERSE)]
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (the last step of SplitMix64)."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def run_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of the ``size`` words from each word on; the last ``size`` - 1 words have none."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, U)
    total = np.zeros(n, U)
    for k in range(size):
        total = total * BASE + words[k : n + k]
    return mix(total)


def ascii_lower(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case, all other bytes as they are."""
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data).astype(np.uint8)


_P = [U(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)]


def _turn(x: np.ndarray, by: int) -> np.ndarray:
    return (x << U(by)) | (x >> U(64 - by))


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _turn(acc + lane * _P[1], 31) * _P[0]


def xxh64(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of the bytes of ``data`` from each ``start`` to its ``end``."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eights = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
    fours = np.ndarray((len(padded) - 3,), "<u4", padded, strides=(1,))
    at, size = start.astype(np.int64).copy(), (end - start).astype(np.int64)
    with np.errstate(over="ignore"):
        h = np.full(len(at), U(seed) + _P[4], U)
        long = np.flatnonzero(size >= 32)
        if len(long):
            first = (U(seed) + _P[0] + _P[1], U(seed) + _P[1], U(seed), U(seed) - _P[0])
            acc = [np.full(len(long), x, U) for x in first]
            live = np.arange(len(long))
            while len(live):
                here = at[long[live]]
                for k in range(4):
                    acc[k][live] = _round(acc[k][live], eights[here + 8 * k])
                at[long[live]] += 32
                live = live[end[long[live]] - at[long[live]] >= 32]
            whole = _turn(acc[0], 1) + _turn(acc[1], 7) + _turn(acc[2], 12) + _turn(acc[3], 18)
            for a in acc:
                whole = (whole ^ _round(np.zeros(len(a), U), a)) * _P[0] + _P[3]
            h[long] = whole
        h += size.astype(U)
        for _ in range(3):
            live = np.flatnonzero(end - at >= 8)
            if len(live):
                h[live] = _turn(h[live] ^ _round(np.zeros(len(live), U), eights[at[live]]), 27) * _P[0] + _P[3]
                at[live] += 8
        live = np.flatnonzero(end - at >= 4)
        if len(live):
            h[live] = _turn(h[live] ^ (fours[at[live]].astype(U) * _P[0]), 23) * _P[1] + _P[2]
            at[live] += 4
        for _ in range(3):
            live = np.flatnonzero(end - at >= 1)
            if len(live):
                h[live] = _turn(h[live] ^ (padded[at[live]].astype(U) * _P[4]), 11) * _P[0]
                at[live] += 1
        h = (h ^ (h >> U(33))) * _P[1]
        h = (h ^ (h >> U(29))) * _P[2]
        return h ^ (h >> U(32))
