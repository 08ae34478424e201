"""MinHash near-duplicates: HyperMinHash sketches, banding, verification, components.

Every text becomes the set of its distinct k-word shingles (64-bit hashes). A
sketch splits the hash space into REGISTERS buckets and keeps of each bucket's
smallest hash the number of leading zeros and ten mantissa bits (two bytes).
Empty registers borrow from others by fixed random probing. Bands of compressed
registers are grouped; within a group documents meet *representatives*, never
each other pairwise; a pair goes on if its collision-corrected Jaccard estimate
comes near the threshold, and is confirmed on the full sets. Groups that still
span several components are gathered by their least component and compared in
blocks of bounded size, sketches first, then full sets, across components only:
pairs live inside a task and only found links leave it, at most one for two
components, so that no link between two components is lost and no group's pairs
are ever written out.

At a similarity of 0.8 a pair shares no band with a probability below 5e-7. A
pair whose estimate lies more than SLACK below the threshold is not compared in
full: at 0.8, none of 192,000 simulated pairs of 10 to 100 shingles.

Defined results: words are split at ASCII white space, A-Z is folded. A text of
fewer than k words is one shingle; a text without words, or null, has the empty
set and links with nothing. Equal sets form one class and cost one sketch. Rows
sharing a doc_id are one document: linked if any of its rows is. A null doc_id
links with nothing: component_id is null and kept is true. Extra columns are not
read. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeloom.llm._text import FOLDED_VALUES, chunks, hasher, window_hashes, word_hashes, words
from treeloom.plans.durable import durable
from treeloom.plans.sizing import arrow_batches, arrow_rows, broadcast_if_small

BANDS, ROWS = 48, 6
REGISTERS = BANDS * ROWS
#: Share of the hash's mantissa kept, in bits.
MANTISSA = 10
EMPTY = 0xFFFF
#: How far below the threshold an estimate may lie: over five standard deviations, also of short texts, whose borrowed registers add spread (about 0.029).
SLACK = 0.16
#: Bytes of sketches and sets in a block.
BLOCK_BYTES = 4 << 20
_PROBES = 400
_U = np.uint64


def shingle_sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    out: list[np.ndarray] = []
    tables = hasher()
    for c in chunks(texts):
        w = words(c)
        h = word_hashes(c, w, FOLDED_VALUES, tables)
        win = window_hashes(h, k)
        for i in range(len(c)):
            a, b = w.first[i], w.first[i + 1]
            if b - a >= k:
                out.append(np.unique(win[a : b - k + 1]))
            elif b > a:
                with np.errstate(over="ignore"):  # the sequence as one, apart from any window of k
                    out.append(window_hashes(h[a:b], int(b - a)) ^ _U(0xA5A5A5A5 + b - a))
            else:
                out.append(np.empty(0, _U))
    return out


def _probes() -> np.ndarray:
    """probes[a, j]: where register j looks at its attempt a."""
    return np.random.default_rng(20240229).integers(0, REGISTERS, (_PROBES, REGISTERS), dtype=np.int16)


def compress(low: np.ndarray) -> np.ndarray:
    """Leading zeros and mantissa of 64-bit values, in 16 bits."""
    frac, exp = np.frexp(low.astype(np.float64))
    zeros = np.clip(64 - exp, 0, 63)
    code = (zeros << MANTISSA) | np.floor((frac * 2 - 1) * (1 << MANTISSA)).clip(0, (1 << MANTISSA) - 1).astype(np.int64)
    return np.minimum(code, EMPTY - 1).astype(np.uint16)


def sketches(sets: list[np.ndarray], probes: np.ndarray) -> np.ndarray:
    """One row of REGISTERS codes for each (non-empty) set of sorted hashes."""
    regs = np.full((len(sets), REGISTERS), EMPTY, np.uint16)
    sizes = np.array([len(s) for s in sets], np.int64)
    if not sizes.sum():
        return regs
    flat = np.concatenate(sets)
    doc = np.repeat(np.arange(len(sets)), sizes)
    cell = doc * REGISTERS + (((flat >> _U(32)) * _U(REGISTERS)) >> _U(32)).astype(np.int64)
    lead = np.ones(len(cell), bool)
    lead[1:] = cell[1:] != cell[:-1]  # sets are sorted: a bucket's first hash is its smallest
    with np.errstate(over="ignore"):
        regs.reshape(-1)[cell[lead]] = compress(flat[lead] * _U(REGISTERS))
    todo = np.flatnonzero((regs == EMPTY).any(axis=1) & (sizes > 0))
    own = regs[todo].copy()
    now = own.copy()
    for p in probes:
        if not len(todo):
            break
        now = np.where(now == EMPTY, own[:, p], now)
        done = ~(now == EMPTY).any(axis=1)
        regs[todo[done]] = now[done]
        todo, own, now = todo[~done], own[~done], now[~done]
    for i, row, seen in zip(todo, now, own, strict=True):  # hardly ever: the next register to the right
        have = np.flatnonzero(seen != EMPTY)
        gaps = np.flatnonzero(row == EMPTY)
        row[gaps] = seen[have[np.searchsorted(have, gaps) % len(have)]]
        regs[i] = row
    return regs


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard estimates of sketch rows, corrected for codes that agree by chance.

    Two different minima of sets of n and m share a code with probability about
    0.7213 * 2**-MANTISSA * n*m / (n+m)**2.
    """
    chance = 0.7213 / (1 << MANTISSA) * (n * m) / np.maximum(1.0, (n + m) ** 2)
    return ((a == b).mean(axis=1) - chance) / (1 - chance)


def fingerprints(docs: DataFrame, k: int, text: str = "text") -> DataFrame:
    """doc_id, n_shingles, digest (of the set; null if empty) and sketch."""
    arrow_rows(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probes = _probes()
        for b in batches:
            sets = shingle_sets(b.column(1), k)
            regs = sketches(sets, probes)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                    pa.array([r.tobytes() if len(s) else None for r, s in zip(regs, sets, strict=True)], pa.binary()),
                ],
                ["doc_id", "n_shingles", "digest", "sketch"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col(text)).mapInArrow(run, "doc_id long, n_shingles long, digest binary, sketch binary")


def _bands(classes: DataFrame) -> DataFrame:
    """(bucket, id): one row for each band of a class."""
    width = 2 * ROWS
    bucket = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda j: F.xxhash64(j, F.substring(F.col("sketch"), j * width + 1, F.lit(width))))
    return classes.select(F.explode(bucket).alias("bucket"), F.col("doc_id").alias("id"))


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, label) for every node of ``edges`` (a, b): label is its component's smallest id.

    Labels fall by the least label of all neighbours, then by the label's own
    label, until nothing changes: a number of rounds logarithmic in the longest
    path for the star-shaped groups that banding makes. Each round is a join and
    a map-side combined minimum, cut off in the shared folder.
    """
    both = durable(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    labels = durable(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("id")).alias("label")))
    while True:
        low = both.join(labels, both.b == labels.id).groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(low, labels.id == low.a, "left").select("id", "label", F.least("label", F.coalesce("near", "label")).alias("new"))
        step = durable(step)
        up = step.select(F.col("id").alias("up"), F.col("new").alias("up_label"))
        jumped = durable(step.join(up, step.new == up.up, "left").select("id", "label", F.least("new", F.coalesce("up_label", "new")).alias("new")))
        labels = jumped.select("id", F.col("new").alias("label"))
        if jumped.where("new <> label").isEmpty():
            return labels


def _score(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs whose estimate comes within SLACK of the threshold."""
    side = classes.select(F.col("doc_id").alias("id"), "n_shingles", "sketch")
    ids = durable(pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct())
    side = side.join(broadcast_if_small(ids), "id", "left_semi")
    x = pairs.join(side.select(F.col("id").alias("a"), F.col("n_shingles").alias("n"), F.col("sketch").alias("s")), "a")
    # sizes alone bound the similarity from above
    y = x.join(side.select(F.col("id").alias("b"), F.col("n_shingles").alias("m"), F.col("sketch").alias("t")), "b").where(100 * F.least("n", "m") >= percent * F.greatest("n", "m"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            if len(p):
                s, t = (np.frombuffer(b"".join(p[c]), np.uint16).reshape(len(p), REGISTERS) for c in ("s", "t"))
                p = p[estimate(s, t, p["n"].to_numpy(float), p["m"].to_numpy(float)) >= percent / 100 - SLACK]
            yield p[["a", "b"]]

    return y.select("a", "b", "n", "m", "s", "t").mapInPandas(run, "a long, b long").distinct()


def _sets(ids: DataFrame, docs: DataFrame, k: int, text: str) -> DataFrame:
    """(doc_id, items, sketch) of the documents in ``ids`` alone, shingled anew, so that no others' sets are moved."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probes = _probes()
        for b in batches:
            found = shingle_sets(b.column(1), k)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([x.tobytes() for x in xs], pa.binary()) for xs in (found, sketches(found, probes)))], ["doc_id", "items", "sketch"])

    full = docs.select(F.col("doc_id").cast("long"), F.col(text)).join(broadcast_if_small(ids), "doc_id", "left_semi").mapInArrow(sets, "doc_id long, items binary, sketch binary").where("length(items) > 0")
    return durable(full.dropDuplicates())


def _similar(s: bytes, t: bytes, percent: int) -> bool:
    """100 * intersection >= percent * union, of sorted sets."""
    u = np.concatenate([np.frombuffer(s, _U), np.frombuffer(t, _U)])
    u.sort(kind="stable")  # merges the two sorted runs
    both = int((u[1:] == u[:-1]).sum())
    return 100 * both >= percent * (len(u) - both)


def _verify(pairs: DataFrame, docs: DataFrame, k: int, percent: int, text: str) -> DataFrame:
    """The pairs with 100 * intersection >= percent * union, counted on full sets."""
    ids = durable(pairs.select(F.col("a").alias("doc_id")).union(pairs.select(F.col("b").alias("doc_id"))).distinct())
    full = _sets(ids, docs, k, text)
    x = pairs.join(full.select(F.col("doc_id").alias("a"), F.col("items").alias("s")), "a")
    y = x.join(full.select(F.col("doc_id").alias("b"), F.col("items").alias("t")), "b")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            ok = [_similar(x, y, percent) for x, y in zip(p["s"], p["t"], strict=True)]
            yield p.loc[np.array(ok, bool), ["a", "b"]]

    return y.select("a", "b", "s", "t").mapInPandas(run, "a long, b long").distinct()


def _compare(left: list[dict], right: list[dict], percent: int, parents: dict[int, int]) -> Iterator[tuple[int, int]]:
    """Links between the components of two blocks, one for two components at most."""

    def top(v: int) -> int:
        while (p := parents.setdefault(v, v)) != v:
            parents[v] = parents.setdefault(p, p)
            v = parents[v]
        return v

    codes = np.frombuffer(b"".join(r["sketch"] for r in right), np.uint16).reshape(-1, REGISTERS)
    size = np.array([len(r["items"]) / 8 for r in right])
    label = np.array([r["label"] for r in right])
    for x in left:
        n = len(x["items"]) / 8
        near = np.flatnonzero((label != x["label"]) & (100 * np.minimum(size, n) >= percent * np.maximum(size, n)))
        if not len(near):
            continue
        e = estimate(codes[near], np.frombuffer(x["sketch"], np.uint16)[None], size[near], n)
        for i in near[np.flatnonzero(e >= percent / 100 - SLACK)]:
            y = right[i]
            a, b = top(int(x["label"])), top(int(y["label"]))
            if a != b and _similar(x["items"], y["items"], percent):
                parents[max(a, b)] = min(a, b)
                yield int(x["id"]), int(y["id"])


def _across(members: DataFrame, labels: DataFrame, docs: DataFrame, k: int, percent: int, text: str) -> DataFrame:
    """(a, b): links between components that share a bucket, found in blocks.

    The buckets of one least component form a group, whose documents are dealt to
    blocks of at most BLOCK_BYTES; those of the least component itself, often
    nearly all, form blocks of their own, which need not meet each other.
    """
    named = durable(members.select("bucket", "id").join(labels, "id", "left").select("bucket", "id", F.coalesce("label", "id").alias("label")))
    wide = durable(named.groupBy("bucket").agg(F.min("label").alias("least"), F.max("label").alias("most")).where("least < most").select("bucket", "least"))
    rows = durable(named.join(wide, "bucket").select("least", "id", "label").distinct())
    ids = durable(rows.select(F.col("id").alias("doc_id")).distinct())
    full = _sets(ids, docs, k, text).withColumnRenamed("doc_id", "id")
    rows = rows.join(full.select("id", F.length("items").alias("size")), "id").withColumn("own", F.col("label") == F.col("least"))
    rows = durable(rows)
    parts = durable(rows.groupBy("least", "own").agg(F.ceil(F.sum(F.col("size") + 2 * REGISTERS) / BLOCK_BYTES).alias("parts")))
    cells = rows.join(parts, ["least", "own"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))
    cells = durable(cells.select("least", "own", "part", "label", "id")).join(full, "id")
    blocks = durable(cells.groupBy("least", "own", "part").agg(F.collect_list(F.struct("id", "label", "sketch", "items")).alias("rows")))
    other = blocks.select("least", F.col("own").alias("own2"), F.col("part").alias("part2"), F.col("rows").alias("rows2"))
    tiles = blocks.where("NOT own").join(other, "least").where("own2 OR part2 >= part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                found = list(_compare(b.column(0)[i].as_py(), b.column(1)[i].as_py(), percent, {}))
                yield pa.RecordBatch.from_arrays([pa.array([p[j] for p in found], pa.int64()) for j in (0, 1)], ["a", "b"])

    with arrow_batches(docs.sparkSession, 4):  # two blocks in a row
        return durable(tiles.select("rows", "rows2").mapInArrow(run, "a long, b long"))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, text: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles, component_id and kept (doc_id is the component's smallest)."""
    prints = durable(fingerprints(docs, k, text))
    # classes of equal sets: the smallest doc_id stands for all
    reps = durable(prints.where("digest IS NOT NULL AND doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("rep")))
    member = durable(prints.drop("sketch").join(reps, "digest", "left"))
    classes = prints.join(reps.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi").where("sketch IS NOT NULL")
    classes = durable(classes.select("doc_id", "n_shingles", "sketch"))

    groups = durable(_bands(classes).groupBy("bucket").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most"))
    members = durable(_bands(classes).join(groups, "bucket"))  # singletons, most of the rows, end here
    pairs = durable(members.where("id <> least").select(F.col("least").alias("a"), F.col("id").alias("b")).distinct())
    links = durable(_verify(durable(_score(pairs, classes, percent)), docs, k, percent, text))
    labels = connected_components(links)
    more = _across(members, labels, docs, k, percent, text)
    if not more.isEmpty():
        # components as nodes: what was linked before stays linked
        seen = labels.select(F.col("id").alias("a"), F.col("label").alias("b"))
        labels = connected_components(seen.union(more))
    out = member.join(labels, member.rep == labels.id, "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("label", "rep", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
