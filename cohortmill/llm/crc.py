"""CRC-32 of many runs of bytes at once, and of runs put together from parts whose CRC-32 is known."""

from __future__ import annotations

import zlib

import numpy as np

#: Fixed value: the polynomial of CRC-32, lowest bit first.
POLYNOMIAL = np.uint32(0xEDB88320)
LONG = 64


def _byte_steps() -> np.ndarray:
    """What each byte becomes when eight zero bits are taken in."""
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & np.uint32(1), (out >> np.uint32(1)) ^ POLYNOMIAL, out >> np.uint32(1))
    return out


STEP = _byte_steps()


def _zero_bytes() -> np.ndarray:
    """[n, place, byte]: what a byte at one of the four places becomes when n zero bytes are taken in."""
    out = np.zeros((LONG + 2, 4, 256), np.uint32)
    out[0] = np.arange(256, dtype=np.uint32) << (8 * np.arange(4, dtype=np.uint32))[:, None]
    for n in range(1, LONG + 2):
        out[n] = (out[n - 1] >> np.uint32(8)) ^ STEP[out[n - 1] & np.uint32(255)]
    return out


ZEROS = _zero_bytes().reshape(-1)


def crc32(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 of ``data`` from each ``start`` to its ``end``."""
    size = end - start
    order = np.argsort(-np.minimum(size, LONG + 1).astype(np.int8), kind="stable")
    at, sizes = start[order], size[order]
    some = int(np.searchsorted(-sizes, -LONG))  # those before are long
    at, sizes = at[some:], sizes[some:]
    h = np.full(len(at), 0xFFFFFFFF, np.uint32)
    for k in range(int(sizes[0]) if len(sizes) else 0):
        n = int(np.searchsorted(-sizes, -k))
        h[:n] = (h[:n] >> np.uint32(8)) ^ STEP[(h[:n] ^ data[at[:n] + k]) & np.uint32(255)]
    out = np.empty(len(size), np.uint32)
    out[order[some:]] = ~h
    for i in order[:some]:
        out[i] = zlib.crc32(data[start[i] : end[i]].tobytes())
    return out


def joined(first: np.ndarray, second: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC-32 of two runs one after the other, from the CRC-32 of each and the bytes of the second."""
    first, size = first.copy(), size.copy()
    while len(far := np.flatnonzero(size > LONG + 1)):
        first[far] = _grown(first[far], np.full(len(far), LONG + 1))
        size[far] -= LONG + 1
    return _grown(first, size) ^ second


def _grown(crc: np.ndarray, by: np.ndarray) -> np.ndarray:
    at = by * 1024
    byte = np.uint32(255)
    out = ZEROS[at + (crc & byte)]
    for place in (1, 2, 3):
        out ^= ZEROS[at + 256 * place + ((crc >> np.uint32(8 * place)) & byte)]
    return out
