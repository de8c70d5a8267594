"""Words of Arrow text columns as 64-bit hashes, computed over whole batches.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D. The hash of a word is a polynomial
over a fixed table of random numbers, modulo 2^64, followed by a bit mixer; equal words always have
equal hashes, and different words collide with a chance of about 2^-64 a pair.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BASE = 0x9E3779B97F4A7C15
SPAN = 1 << 19  # bytes hashed at once
SLICE = 1 << 21  # bytes of text handled at once


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective bit mixer on 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def tidy(fn):
    """A batch function that hands freed memory back to the system at its end: workers outlive their tasks and share a machine."""

    def run(batches):
        try:
            yield from fn(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only some C libraries have it
            if trim is not None:
                trim(0)

    return run


class Words(NamedTuple):
    """Words of a run of documents: byte ranges in ``data``, hashes, and each document's word range."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    bounds: np.ndarray  # word index at which each document begins, and the total

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def docs(self) -> np.ndarray:
        """The document index of every word."""
        return np.repeat(np.arange(len(self.bounds) - 1), self.counts)


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    plain = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))
    lower = plain.copy()
    lower[65:91] = plain[97:123]
    powers, inverses = np.full(SPAN + 1, BASE, np.uint64), np.full(SPAN + 1, pow(BASE, -1, 1 << 64), np.uint64)
    powers[0] = inverses[0] = 1
    np.cumprod(powers, out=powers)
    np.cumprod(inverses, out=inverses)
    return plain, lower, powers, inverses


@lru_cache(1)
def _blank() -> np.ndarray:
    blank = np.zeros(256, bool)
    blank[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
    return blank


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and document offsets of a text column; null counts as empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]] if len(offsets) else data[:0], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of whole rows with about ``limit`` bytes of text each."""
    if batch.num_rows == 0:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = (np.cumsum(sizes) - sizes) // limit
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [batch.num_rows]])
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield batch.slice(int(a), int(b - a))


def words_of(texts: pa.Array, lower: bool = False, solid: np.ndarray | None = None) -> Words:
    """Find and hash the words of every text; ``lower`` folds A-Z.

    ``solid`` tells for each byte value whether it belongs to words, in place of all but blanks.
    """
    data, offsets = text_buffer(texts)
    n = len(data)
    solid = ~_blank()[data] if solid is None else solid[data]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    first = solid.copy()
    first[1:] &= ~solid[:-1] | cut[1:n]
    last = solid.copy()
    last[:-1] &= ~solid[1:] | cut[1:n]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return Words(data, starts, ends, _hashes(data, starts, ends, lower), np.searchsorted(starts, offsets))


def _hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
    table, powers, inverses = (_tables()[1 if lower else 0], *_tables()[2:])
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        base = starts[at]
        to = int(np.searchsorted(ends, base + SPAN, "right"))
        if to == at:  # one word longer than a span
            total, end = 0, ends[at]
            for k, low in enumerate(range(int(base), int(end), SPAN)):
                block = table[data[low : min(low + SPAN, int(end))]]
                total += int((block * powers[: len(block)]).sum(dtype=np.uint64)) * pow(BASE, k * SPAN, 1 << 64)
            out[at] = total % (1 << 64)
            at += 1
            continue
        sums = np.zeros(ends[to - 1] - base + 1, np.uint64)
        block = table[data[base : ends[to - 1]]]
        np.cumsum(block * powers[: len(block)], out=sums[1:])
        s, e = starts[at:to] - base, ends[at:to] - base
        out[at:to] = (sums[e] - sums[s]) * inverses[s]
        at = to
    return mix(out)


def windows_of(words: Words, size: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words inside one document, and the word index of their starts."""
    h, n = words.hashes, len(words.hashes)
    if n < size:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    factor = np.uint64((BASE * (2 * seed + 3)) % (1 << 64) | 1)
    out = h[: n - size + 1] + np.uint64(seed)
    for j in range(1, size):
        out *= factor
        out += h[j : n - size + 1 + j]
    left = np.repeat(words.bounds[1:], words.counts)[: n - size + 1] - np.arange(n - size + 1)
    at = np.flatnonzero(left >= size)
    return mix(out[at]), at
