"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

Texts are folded (lower case, runs of ASCII space and punctuation as one space)
and each benchmark item is cut into overlapping windows, the last flush with its
end. A window of w characters with an edit budget of e shares at least
w - q + 1 - q*e q-grams with any region within the budget, and those lie on
neighbouring diagonals. So: every q-gram of a document is looked up in an index
of the benchmark's q-grams, hits are counted by window and overlapping band of
diagonals, bands that reach the bound are regions, and a region is confirmed by
an alignment that never leaves the band. One window within its budget makes a
leak. Bands overlap by the budget, so an alignment within it lies in one of them.

Items of fewer than ``min_chars`` folded characters have no room for edits and
are looked up exactly, as whole words in a row.

The benchmark is a stated query set: its index is broadcast in parts of at most
``part_chars`` characters, with one pass over the documents for each part. Equal
windows and equal short items are held once, with the list of their items.

Defined results: null or empty texts and items match nothing; a short item made
of common words is found wherever these stand in a row; equal items are each
reported; repeated documents are each reported; null ids of documents and items
are carried. Texts are handled whole, in bounded chunks, and no match spans two
texts. Extra columns are not read by ``find_leaks`` and are kept by ``drop_leaks``.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeloom.llm._text import CHUNK_BYTES, chunks, splitmix
from treeloom.plans.sizing import arrow_rows

_U = np.uint64
_BAND = 4  # bands are 16 diagonals wide, and reach over into the next by the edit budget
_BITS = 22
#: Hits counted at a time, and regions aligned at a time.
_HITS, _BATCH = 1 << 21, 4096
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[:0x30] = _FOLD[0x3A:0x41] = _FOLD[0x5B:0x61] = _FOLD[0x7B:0x80] = 32
_FOLD[65:91] = np.arange(97, 123)


def fold(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Folded bytes with a zero byte after each text; the source place of each; the owner text of each."""
    b = _FOLD[data]
    blank = b == 32
    keep = np.ones(len(b), bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    keep[bounds[:-1][np.diff(bounds) > 0]] = True
    at = np.flatnonzero(keep)
    owner = np.searchsorted(bounds, at, "right") - 1
    n = len(bounds) - 1
    out = np.zeros(len(at) + n, np.uint8)
    place = np.zeros(len(at) + n, np.int64)
    to = np.arange(len(at)) + owner
    out[to], place[to] = b[at], at
    own = np.zeros(len(out), np.int64)
    own[to] = owner
    return out, place, own


def grams(x: np.ndarray, q: int) -> np.ndarray:
    """A hash of the q bytes (8 to 16) from each place on."""
    n = len(x) - q + 1
    if n <= 0:
        return np.empty(0, _U)
    v = x.astype(_U)
    v = v[:-1] | v[1:] << _U(8)
    v = v[:-2] | v[2:] << _U(16)
    v = v[:-4] | v[4:] << _U(32)
    with np.errstate(over="ignore"):
        return splitmix(v[:n] * _U(0x9E3779B97F4A7C15) + v[q - 8 : q - 8 + n])


def _keys(x: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """A hash of the ``size`` bytes from each place in ``at``."""
    out = np.full(len(at), size, _U)
    with np.errstate(over="ignore"):
        for j in range(size):
            out = out * _U(0x9FB21C651E98DF25) + x[at + j]
    return splitmix(out)


def build_index(items: list[tuple[int | None, str]], window: int, stride: int, q: int, budget: float, min_chars: int) -> dict:
    """Distinct windows of the items with their sorted q-grams, and the short items by length."""
    owners: dict[bytes, dict[int, None]] = {}
    short: dict[bytes, list[int]] = defaultdict(list)
    for k, (_, text) in enumerate(items):
        raw = np.frombuffer((text or "").lower().encode(), np.uint8)
        s = fold(raw, np.array([0, len(raw)]))[0][:-1].tobytes().strip()
        if len(s) < max(min_chars, q):
            if s:
                short[s].append(k)
            continue
        w = min(window, len(s))
        for a in {*range(0, len(s) - w + 1, stride), len(s) - w}:
            owners.setdefault(s[a : a + w], {})[k] = None
    index = {"ids": [i for i, _ in items], "texts": sorted(owners), "q": q, "short": {}}
    for size in sorted({len(s) for s in short}):
        of = sorted(s for s in short if len(s) == size)
        keys = _keys(np.frombuffer(b"".join(of), np.uint8), np.arange(len(of)) * size, size)
        index["short"][size] = {int(k): [(s, short[s]) for s in np.array(of, object)[keys == k]] for k in np.unique(keys)}
    if not owners:
        return index
    sizes = np.array([len(t) for t in index["texts"]])
    per = [grams(np.frombuffer(t, np.uint8), q) for t in index["texts"]]
    k = np.concatenate(per)
    order = np.argsort(k, kind="stable")
    k = k[order]
    seen = np.zeros(1 << _BITS, bool)
    seen[(k >> _U(64 - _BITS)).astype(np.int64)] = True
    n = sizes - q + 1
    win = np.repeat(np.arange(len(n)), n)[order]
    pos = (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))[order]
    spare = np.maximum(0, np.minimum((budget * sizes).astype(np.int64), (sizes - q) // q))
    return index | {"items": [list(owners[t]) for t in index["texts"]], "sizes": sizes, "spare": spare, "keys": k, "win": win.astype(np.int32), "pos": pos.astype(np.int32), "seen": seen}


_FAR = 1 << 30  # the cost of crossing from one text into another


def align_bands(patterns: np.ndarray, x: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fewest edits of each pattern (a row of bytes) against any part of ``x`` on its diagonals, and that part's start and end.

    Diagonal d holds the cells in which byte i of the pattern meets byte i + d of
    ``x``; pattern k keeps to the ``width`` diagonals from ``first[k]`` on. Zero
    bytes of ``x`` part texts and are never crossed. Ties go to the least start.
    """
    count, size = patterns.shape
    pad = width + size + 1
    text = np.concatenate([np.zeros(pad, np.uint8), x, np.zeros(pad, np.uint8)])
    at = np.clip(first, -pad, len(x))[:, None] + pad + np.arange(width)
    steps = np.arange(width)
    best = np.broadcast_to(steps, (count, width)).copy()  # edits * 2**8 + diagonal of the start
    unit = 1 << 8
    crossed = np.cumsum(np.concatenate([[0], (text == 0) * _FAR + unit]))  # what it costs to pass over the text's bytes
    for i in range(size):
        t = text[at + i]
        cost = np.where(t == patterns[:, i : i + 1], 0, unit) + (t == 0) * _FAR
        new = best + cost  # the two bytes meet
        new[:, :-1] = np.minimum(new[:, :-1], best[:, 1:] + unit)  # a byte of the pattern has no partner
        passed = crossed[at + i + 1]
        best = np.minimum.accumulate(new - passed, axis=1) + passed  # bytes of the text have none
    end = best.argmin(axis=1)
    low = best[np.arange(count), end]
    return low >> 8, first + (low & 255), first + end + size


def _regions(x: np.ndarray, index: dict) -> tuple[np.ndarray, np.ndarray]:
    """(window, first diagonal) of each band with as many shared q-grams as the lemma asks for."""
    q = index["q"]
    g = grams(x, q)
    maybe = np.flatnonzero(index["seen"][(g >> _U(64 - _BITS)).astype(np.int64)])
    lo, hi = np.searchsorted(index["keys"], g[maybe], "left"), np.searchsorted(index["keys"], g[maybe], "right")
    n = hi - lo
    maybe, lo, n = maybe[n > 0], lo[n > 0], n[n > 0]
    codes, counts = np.empty(0, np.int64), np.empty(0, np.int64)
    ends = np.cumsum(n)
    a = 0
    while a < len(n):  # a bounded number of hits at a time, whatever a frequent q-gram has
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + _HITS, "right")))
        m = n[a:b]
        slot = np.repeat(lo[a:b] - (np.cumsum(m) - m), m) + np.arange(m.sum())
        win = index["win"][slot].astype(np.int64)
        diagonal = np.repeat(maybe[a:b], m) - index["pos"][slot] + (1 << 20)
        band = diagonal >> _BAND
        reach = (diagonal & ((1 << _BAND) - 1)) < index["spare"][win]  # it also lies in the band before
        code = np.concatenate([win, win[reach]]) * np.int64(1 << 40) + np.concatenate([band, band[reach] - 1])
        new, times = np.unique(code, return_counts=True)
        if a:
            new, back = np.unique(np.concatenate([codes, new]), return_inverse=True)
            times = np.bincount(back, np.concatenate([counts, times])).astype(np.int64)
        codes, counts, a = new, times, b
    win = codes >> 40
    need = np.maximum(1, index["sizes"][win] - q + 1 - q * index["spare"][win]) if len(win) else counts
    ok = counts >= need
    return win[ok], ((codes[ok] & ((1 << 40) - 1)) << _BAND) - (1 << 20)


def _windows(x: np.ndarray, owner: np.ndarray, index: dict) -> Iterator[tuple[int, int, int, int, int]]:
    """(text, window, start, end, edits) of every confirmed region, each place once."""
    win, first = _regions(x, index)
    done: set[tuple[int, int, int]] = set()
    for size in np.unique(index["sizes"][win]) if len(win) else ():
        of = np.flatnonzero(index["sizes"][win] == size)
        spare = int(index["spare"][win[of[0]]])
        for a in range(0, len(of), _BATCH):
            some = of[a : a + _BATCH]
            patterns = np.frombuffer(b"".join(index["texts"][w] for w in win[some]), np.uint8).reshape(len(some), size)
            edits, start, end = align_bands(patterns, x, first[some], (1 << _BAND) + spare)
            for k in np.flatnonzero((edits <= spare) & (end > start)):
                w, s = int(win[some[k]]), int(start[k])
                doc = int(owner[s])
                if (doc, w, s >> 6) not in done:
                    done.add((doc, w, s >> 6))
                    yield doc, w, s, int(end[k]), int(edits[k])


def _short(x: np.ndarray, index: dict) -> Iterator[tuple[int, int, list[int]]]:
    """(start, end, items) of the short items' places between blanks or ends of texts."""
    gap = (x == 32) | (x == 0)
    begins = np.flatnonzero(~gap & np.concatenate([[True], gap[:-1]]))
    for size, known in index["short"].items():
        at = begins[begins + size < len(x)]
        at = at[gap[at + size] & ~gap[at + size - 1]]
        keys = _keys(x, at, size)
        for k in np.flatnonzero(np.isin(keys, np.array(list(known), _U))):
            s = int(at[k])
            for text, items in known[int(keys[k])]:
                if x[s : s + size].tobytes() == text:
                    yield s, s + size, items


def scan(texts: pa.Array, index: dict) -> Iterator[tuple[int, int | None, int, int, int, int]]:
    """(row, item, first byte, past the last byte, fewest edits, windows found) for each text and leaked item."""
    if not index["texts"] and not index["short"]:
        return
    for c in chunks(pc.utf8_lower(texts.cast(pa.large_string())), CHUNK_BYTES):
        x, place, owner = fold(c.data, c.bounds)
        found: dict[tuple[int, int], list[int]] = defaultdict(lambda: [1 << 60, -1, 1 << 30, 0])

        def note(doc: int, k: int, s: int, t: int, edits: int, found=found, place=place) -> None:
            f = found[doc, k]
            f[:] = min(f[0], int(place[s])), max(f[1], int(place[t - 1]) + 1), min(f[2], edits), f[3] + 1

        for doc, w, s, t, edits in _windows(x, owner, index) if index["texts"] else ():
            for k in index["items"][w]:
                note(doc, k, s, t, edits)
        for s, t, items in _short(x, index):
            for k in items:
                note(int(owner[s]), k, s, t, 0)
        for (doc, k), (s, t, edits, wins) in sorted(found.items()):
            base = int(c.bounds[doc])
            yield c.first + doc, index["ids"][k], s - base, t - base, edits, wins


def _indexes(docs: DataFrame, benchmark: DataFrame, part_chars: int, **how) -> Iterator:
    spark = docs.sparkSession
    total = benchmark.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = max(1, math.ceil(total / part_chars))
    for i in range(parts):
        rows = benchmark.select("item_id", "text")
        if parts > 1:
            rows = rows.where(F.pmod(F.xxhash64("text"), F.lit(parts)) == i)
        got = sorted(map(tuple, rows.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
        yield spark.sparkContext.broadcast(build_index(got, **how))


def find_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = 96, stride: int = 48, q: int = 12, budget: float = 0.055, min_chars: int = 40, part_chars: int = 1_000_000) -> DataFrame:
    """(doc_id, item_id, span_start, span_end, edits, n_windows): spans are bytes of the lower-cased text in UTF-8."""
    arrow_rows(docs.sparkSession)
    out = None
    for held in _indexes(docs, benchmark, part_chars, window=window, stride=stride, q=q, budget=budget, min_chars=min_chars):

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows = list(scan(b.column(1), held.value))
                cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(cols[0], pa.int64())), *(pa.array(c, pa.int64()) for c in cols[1:])], ["doc_id", "item_id", "span_start", "span_end", "edits", "n_windows"])

        part = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text).mapInArrow(run, "doc_id long, item_id long, span_start long, span_end long, edits long, n_windows long")
        out = part if out is None else out.union(part)
    return out


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = 96, stride: int = 48, q: int = 12, budget: float = 0.055, min_chars: int = 40, part_chars: int = 1_000_000) -> DataFrame:
    """The documents in which no item is found, in the same columns; one pass and no shuffle for each part of the benchmark."""
    arrow_rows(docs.sparkSession)
    schema = docs.schema
    place = docs.columns.index(text)
    for held in _indexes(docs, benchmark, part_chars, window=window, stride=stride, q=q, budget=budget, min_chars=min_chars):

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for b in batches:
                keep = np.ones(b.num_rows, bool)
                keep[[r[0] for r in scan(b.column(place), held.value)]] = False
                yield b.filter(pa.array(keep))

        docs = docs.mapInArrow(run, schema)
    return docs
