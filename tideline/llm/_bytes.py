"""Texts as bytes in numpy: tokens, their hashes, and hashes of runs of tokens."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: Odd, so that it has an inverse modulo 2**64.
BASE = U(0x9E3779B97F4A7C15)
BACK = U(pow(int(BASE), -1, 1 << 64))
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: ASCII letters and all bytes of longer characters.
LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = LETTER[128:] = True
VALUE = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads each bit over all."""
    x = x ^ (x >> U(32))
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE and its inverse to the powers 0 to n, modulo 2**64."""
    if not _powers or len(_powers[0]) <= n:
        n = max(n, 1 << 20)
        _powers[:] = [np.concatenate([np.ones(1, U), np.full(n, b, U)]).cumprod(dtype=U) for b in (BASE, BACK)]
    return _powers[0], _powers[1]


class Bytes:
    """Prefix hashes over ``data``; ``hash(start, end)`` gives 64 bits for each slice."""

    def __init__(self, data: np.ndarray):
        self.up, self.down = powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, U)
        np.cumsum(VALUE[data] * self.up[: len(data)], out=self.sums[1:], dtype=U)

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(U))


def spans(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each run of True."""
    edge = np.diff(np.concatenate([[0], inside.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def tokens(buffer: np.ndarray, offsets: np.ndarray, within: np.ndarray, lower: bool = True) -> tuple[Bytes, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of bytes for which ``within`` holds, never across texts.

    buffer holds the texts one after another with a zero byte behind each, offsets their starts. Returns the hashes, starts and ends of the runs and, for each text, the number of its first run (one more at the end).
    """
    data = LOWER[buffer] if lower else buffer
    inside = within[buffer]
    inside[offsets[1:] - 1] = False
    start, end = spans(inside)
    return Bytes(data), start, end, np.searchsorted(start, offsets)


def packed(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of the texts, a zero byte behind each, and their offsets (one more at the end); null counts as empty."""
    parts = [(t.as_buffer() if t.is_valid else b"") for t in texts]
    sizes = np.fromiter((len(p) + 1 for p in parts), np.int64, len(parts))
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    return np.frombuffer(b"\0".join([*map(bytes, parts), b""]), np.uint8), offsets


def blocks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = 2_000_000) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches whose texts have ``limit`` bytes or are one row, with their ``packed`` texts."""
    for batch in batches:
        texts = batch.column(column)
        sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0), np.int64) + 1
        at, ends = 0, np.cumsum(sizes)
        while at < len(sizes):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, "right")))
            part = batch.slice(at, to - at)
            yield part, *packed(part.column(column))
            at = to


def shingles(words: np.ndarray, firsts: np.ndarray, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of each text's runs of ``n`` words, sorted; a shorter text is one run, one without words none.

    words: hashes of all words; firsts: the number of each text's first word (one more at the end). Returns the hashes and where each text's begin (one more at the end).
    """
    counts = np.diff(firsts)
    many = np.maximum(counts - n + 1, (counts > 0).astype(np.int64))
    begins = np.concatenate([[0], np.cumsum(many)])
    at = np.arange(begins[-1]) + np.repeat(firsts[:-1] - begins[:-1], many)
    ends = np.repeat(firsts[1:], many)
    total = np.zeros(len(at), U)
    room = np.concatenate([words, np.zeros(n, U)])
    for j in range(n):
        term = room[at + j] * U(pow(0xA0761D6478BD642F, j + 1, 1 << 64))
        total += np.where(at + j < ends, term, U(0))
    total = mix(total + np.minimum(ends - at, n).astype(U))
    owner = np.repeat(np.arange(len(counts)), many)
    order = np.lexsort((total, owner))
    total, owner = total[order], owner[order]
    new = np.ones(len(total), bool)
    new[1:] = (total[1:] != total[:-1]) | (owner[1:] != owner[:-1])
    total, owner = total[new], owner[new]
    return total, np.searchsorted(owner, np.arange(len(counts) + 1))
