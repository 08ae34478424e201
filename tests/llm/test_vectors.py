"""Centroid clustering and vector codes against plain loops over Python integers."""

import hashlib
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from treeloom.llm import _vectors, centroids, queries, vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int"


def _square(a, b):
    return sum((x - y) ** 2 for x, y in zip(a, b, strict=True))


def _nearest(v, books):
    apart = [_square(v, c) for c in books]
    at = min(range(len(books)), key=lambda i: (apart[i], i))
    return at, apart[at]


def _lloyd(points, books, rounds):
    for _ in range(rounds):
        got = [[p for p in points if _nearest(p, books)[0] == i] for i in range(len(books))]
        books = [[sum(x) // len(g) for x in zip(*g, strict=True)] if g else old for g, old in zip(got, books, strict=True)]
    return books


def _kept(rows, dims=None):
    return [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1]) and dims in (None, len(r[1]))]


def _ints(v, scale):
    return [math.floor(scale * x) for x in v]


@pytest.fixture(scope="module")
def odd_rows():
    """Few distinct vectors of 16 small components (many ties and copies), and every kind of broken row."""
    rng = random.Random(11)
    grid = [[rng.choice([-0.5, -0.25, 0.0, 0.25, 0.26]) for _ in range(16)] for _ in range(60)]
    rows = [(rng.randrange(-50, 400), rng.choice(grid), rng.choice([None, 0, 1])) for _ in range(500)]
    rows += [(rng.randrange(1000), [float(np.float32(rng.gauss(0, 0.3))) for _ in range(16)], 2) for _ in range(200)]
    rows += [(None, grid[0], None), (None, grid[1], 3), ((1 << 60) + 1, grid[2], 1)]
    broken = [(7001, None, 0), (7002, [], 0), (7003, [None] * 16, 0), (7004, [0.1] * 15 + [None], 1), (7005, [float("nan")] * 16, 1), (7006, [float("inf")] + [0.0] * 15, 1), (7007, [-float("inf")] + [0.0] * 15, 1)]
    return rows + broken, broken


def test_clustering_by_brute_force(spark, odd_rows):
    rows, _ = odd_rows
    rows = rows + [(7008, [0.1] * 8, 1)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    got = centroids.cluster(df, k=9, rounds=3, dims=16, scale=64.0, salt="1").collect()
    kept = [(i, _ints(v, 64)) for i, v, _ in _kept(rows, 16)]
    first = sorted(((hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in kept))[:9]
    books = _lloyd([v for _, v in kept], [v for _, v in first], 3)
    near = [(i, *_nearest(v, books)) for i, v in kept]
    per = {c: sum(d for _, k, d in near if k == c) for c in range(9)}
    want = [(i, c, d, per[c], sum(per.values()), tuple(books[c])) for i, c, d in near]
    assert sorted(((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, tuple(r.centroid)) for r in got), key=repr) == sorted(want, key=repr)


def test_codes_by_brute_force(spark, odd_rows):
    rows, _ = odd_rows
    rows = rows + [(7009, [0.1] * 12, 5), (7010, [0.1] * 7, 5)]  # of other lengths: no code
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    books = vector_codes.fit(df, parts=4, k=10, rounds=4, scale=16.0)
    kept = [(i, _ints(v, 16), lab) for i, v, lab in _kept(rows, 16)]
    first = sorted(_kept(rows, 16), key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:10]
    cut = lambda v, p: v[4 * p : 4 * p + 4]
    want_books = [_lloyd([cut(v, p) for _, v, _ in kept], [cut(_ints(v, 16), p) for _, v, _ in first], 4) for p in range(4)]
    assert books.tolist() == want_books
    got = vector_codes.encode(df, books, scale=16.0).collect()
    want = []
    for i, v, lab in kept:
        near = [_nearest(cut(v, p), want_books[p]) for p in range(4)]
        want.append((i, lab, "".join(f"{k:02x}" for k, _ in near), sum(d for _, d in near)))
    want += [(7009, 5, None, None), (7010, 5, None, None), (7002, 0, None, None)]
    assert sorted(((r.vec_id, r.label, r._vc_code, r._vc_error) for r in got), key=repr) == sorted(want, key=repr)


def test_vectors_at_the_edges(spark, odd_rows):
    _, broken = odd_rows
    for rows in ([], broken[:1] + broken[2:]):
        df = spark.createDataFrame(rows, SCHEMA)
        assert centroids.cluster(df, k=3, dims=16).count() == 0
        books = vector_codes.fit(df, parts=4, k=3, rounds=2)
        assert books.size == 0 and vector_codes.encode(df, books).count() == 0
    few = spark.createDataFrame([(1, [1.0, 2.0], None), (2, [1.0, 2.0], None)], SCHEMA)
    assert [(r.cluster, r.distance) for r in centroids.cluster(few, k=16, dims=2).collect()] == [(0, 0), (0, 0)]  # equal centroids: the lower number
    assert {(r._vc_code, r._vc_error) for r in vector_codes.encode(few, vector_codes.fit(few, parts=2)).collect()} == {("0000", 0)}
    huge = spark.createDataFrame([(1, [3e38, -3e38]), (2, [0.0, 0.0])], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.distance for r in centroids.assign(huge, np.zeros((1, 2), np.int64)).collect()}
    assert got == {1: 2 * _vectors.reach(2) ** 2, 2: 0}
    with pytest.raises(ValueError):
        vector_codes.encode(few.withColumn("_VC_x", F.lit(1)), np.zeros((1, 1, 2), np.int64))
    clash = few.withColumns({"id": F.lit("x"), "vector": F.lit("y"), "cluster": F.lit(9), "part": F.lit(1), "n": F.lit(1), "sums": F.lit(1)})
    assert {r.cluster for r in centroids.cluster(clash, k=2, dims=2).collect()} == {0}
    carried = vector_codes.encode(clash.withColumn("big", F.lit((1 << 60) + 1)), vector_codes.fit(clash, parts=2)).first()
    assert carried.big == (1 << 60) + 1 and carried.id == "x" and carried.cluster == 9 and carried.label is None


def test_screened_products_are_exact():
    """Hostile numbers for float32: near ties far from zero, entries apart by one, equal entries."""
    rng = np.random.default_rng(5)
    base = rng.integers(-(1 << 26), 1 << 26, (1, 8))
    entries = np.concatenate([base + rng.integers(-1, 2, (30, 8)), base, base])
    points = np.concatenate([base + rng.integers(-2, 3, (500, 8)), rng.integers(-(1 << 26), 1 << 26, (500, 8))])
    at, apart = vector_codes.nearest(points, entries)
    for p, i, d in zip(points.tolist(), at, apart, strict=True):
        assert (i, d) == _nearest(p, entries.tolist())
    naive = (np.square(entries).sum(1) - 2 * (points.astype(np.float32) @ entries.astype(np.float32).T).astype(np.float64)).argmin(1)
    assert (naive != at).any()  # the screen alone would have erred


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 6), st.integers(1, 9), st.integers(0, 27), st.integers(0, 2**32 - 1))
def test_screens_keep_the_nearest(d, k, bits, seed):
    rng = np.random.default_rng(seed)
    points, entries = rng.integers(-(1 << bits), (1 << bits) + 1, (20, d)), rng.integers(-(1 << bits), (1 << bits) + 1, (k, d))
    kept = vector_codes.candidates(points, entries)
    for row, p in zip(kept, points.tolist(), strict=True):
        assert row[_nearest(p, entries.tolist())[0]]


def test_most_entries_are_screened_out():
    rng = np.random.default_rng(7)
    points, entries = np.floor(4096 * rng.normal(0, 0.12, (4000, 8))).astype(np.int64), np.floor(4096 * rng.normal(0, 0.12, (16, 8))).astype(np.int64)
    assert vector_codes.candidates(points, entries).sum() < 1.01 * len(points)


def test_vector_queries(spark):
    """The registered queries over the smallest table by plain loops."""
    d = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{d}/embeddings.parquet").collect()]
    kept = {i: _ints(v, 64) for i, v, _ in _kept(rows, 64)}
    first = sorted(kept, key=lambda i: hashlib.sha256(f"1:{i}".encode()).hexdigest())[:16]
    books = _lloyd(list(kept.values()), [kept[i] for i in first], 3)
    near = {i: _nearest(v, books) for i, v in kept.items()}
    got = {r.vec_id: r for r in queries.op11_centroids(spark, d).collect()}
    assert {i: (r.cluster, r.distance) for i, r in got.items()} == near
    assert all(r.centroid_sha256 == hashlib.sha256(",".join(map(str, books[r.cluster])).encode()).hexdigest() for r in got.values())
    assert all(r.cluster_inertia == sum(x for c, x in near.values() if c == r.cluster) and r.inertia == sum(x for _, x in near.values()) for r in got.values())
    codes = queries.op12_vector_codes(spark, d).collect()
    assert len(codes) == len(rows) and len({r.codebooks_sha256 for r in codes}) == 1
    labels = {i: lab for i, _, lab in rows}
    total = {}
    for r in codes:
        total[labels[r.vec_id]] = total.get(labels[r.vec_id], 0) + r.error
    assert all(len(r.code) == 16 and r.label_error == total[labels[r.vec_id]] for r in codes)
