"""Vectorised word handling over Arrow string buffers.

A *word* is a maximal run of bytes other than 0x20 and 0x09-0x0D. Texts are
handled in chunks of a few hundred kilobytes, so that the arrays beside the
text stay small whatever the batch; a single long text forms its own chunk.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

CHUNK_BYTES = 1 << 19
_U = np.uint64

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def splitmix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


#: A fixed random 64-bit value for each byte value, the second with A-Z as a-z.
BYTE_VALUES = splitmix(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))
FOLDED_VALUES = BYTE_VALUES.copy()
FOLDED_VALUES[65:91] = BYTE_VALUES[97:123]

_BASE = 0xD6E8FEB86659FD93
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.empty(n, _U)
    out[:1] = 1
    have, step = 1, base % (1 << 64)
    with np.errstate(over="ignore"):
        while have < n:
            more = min(have, n - have)
            out[have : have + more] = out[:more] * _U(step)
            have, step = have + more, step * step % (1 << 64)
    return out


class _Powers:
    """The two power tables, grown when a longer chunk comes along."""

    def __init__(self) -> None:
        self.up = self.down = np.empty(0, _U)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            self.up, self.down = powers(_BASE, n), powers(_BASE_INVERSE, n)
        return self.up, self.down


@dataclass
class Chunk:
    """Some texts of a batch, end to end in ``data``; text i is data[bounds[i]:bounds[i+1]]."""

    first: int
    data: np.ndarray
    bounds: np.ndarray

    def __len__(self) -> int:
        return len(self.bounds) - 1


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Cut a string array (null: empty) into chunks of whole texts of about ``limit`` bytes."""
    arr = texts.cast(pa.large_string()).fill_null("")
    if not len(arr):
        return
    _, offsets, data = arr.buffers()
    at = np.frombuffer(offsets, np.int64)[arr.offset : arr.offset + len(arr) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    i = 0
    while i < len(arr):
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1)
        yield Chunk(i, raw[at[i] : at[j]], at[i : j + 1] - at[i])
        i = j


@dataclass
class Words:
    """Word k of a chunk is data[start[k]:end[k]], in text doc[k]; text i has words first[i]:first[i+1]."""

    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    first: np.ndarray


def words(chunk: Chunk) -> Words:
    inside = ~SPACE[chunk.data]
    if not len(inside):
        none = np.empty(0, np.int64)
        return Words(none, none, none, np.zeros(len(chunk) + 1, np.int64))
    cut = np.zeros(len(inside) + 1, bool)
    cut[chunk.bounds] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | cut[1:-1]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | cut[1:-1]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    first = np.searchsorted(s, chunk.bounds)
    return Words(s, e, np.repeat(np.arange(len(chunk)), np.diff(first)), first)


def word_hashes(chunk: Chunk, w: Words, values: np.ndarray, tables: _Powers) -> np.ndarray:
    """A 64-bit hash of each word: a polynomial in random byte values, mixed."""
    up, down = tables.upto(len(chunk.data) + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(chunk.data) + 1, _U)
        np.cumsum(values[chunk.data] * up[: len(chunk.data)], out=sums[1:])
        return splitmix((sums[w.end] - sums[w.start]) * down[w.start])


def window_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of every run of k neighbouring words (also across texts: mask those)."""
    n = max(0, len(hashes) - k + 1)
    out = np.zeros(n, _U)
    with np.errstate(over="ignore"):
        for j in range(k):
            out = out * _U(0x9FB21C651E98DF25) + hashes[j : j + n]
    return splitmix(out)


def hasher() -> _Powers:
    return _Powers()


def own_names(df: DataFrame, prefix: str) -> None:
    """Refuse a caller's column whose name could meet one of the operator's own."""
    if taken := [c for c in df.columns if c.lower().startswith(prefix)]:
        raise ValueError(f"columns {taken} begin with {prefix}, which the operator's own names do")
