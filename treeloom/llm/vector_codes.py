"""Vector code compression: product codes, each part's nearest entry found by a screened matrix product.

A vector is cut into equal parts, and a part is written as the number of the
nearest entry of its position's codebook. Comparing a part with all entries is
one float32 matrix product, whose result is off by no more than a known bound:
an inner product of ``d`` terms, summed in any order with its inputs rounded,
differs from the true one by at most g * |x| * |c|, where g = (d + 2) u / (1 -
(d + 2) u) and u = 2**-24. So each squared distance lies in an interval. Every
entry whose interval reaches below the smallest upper end is computed again in
int64, and among those the lowest index of the least distance wins: the result
is exact whatever the order of the sums, and only near ties cost integer work.

Codebooks are fitted by rounds of the same assignment. A task hands on one sum
for each entry, the sums merge through a groupBy, and as many numbers as the
codebooks have components reach the driver.

Defined results: rows whose vector is null or holds null, NaN or infinity are
left out. Components become floor(scale * x), held to ``_vectors.reach`` on
either side so that errors fit a long. The codebooks have the length of the
kept vector of least id (null ids last, then by vector) that can be cut into
``parts`` equal parts; a vector of another length stays, with null code and
null error. Fewer vectors than ``k`` make as many entries, equal entries keep
their numbers (the lower one gets the parts), an unused entry stays. Repeated
rows and ids count each time; an empty table gives no rows. Other columns are
carried through; names that begin with ``_vc_`` are refused with a ValueError.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treeloom.llm import _vectors
from treeloom.llm._text import own_names

#: Rounding units of float32 and float64.
_U32, _U64 = 2.0**-24, 2.0**-53
#: Rows that are compared at a time, which bounds the matrices beside them.
CHUNK_ROWS = 2048


def candidates(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Whether an entry (column) may be the nearest of a point (row): integer matrices of equal width."""
    d = points.shape[1]
    x, c = points.astype(np.float64), entries.astype(np.float64)
    products = (points.astype(np.float32) @ entries.astype(np.float32).T).astype(np.float64)
    square = np.square(entries).sum(axis=1).astype(np.float64)
    score = square - 2 * products  # the squared distance less that of the point itself
    bound = (d + 2) * _U32 / (1 - (d + 2) * _U32)
    # the second term covers the roundings of this float64 arithmetic, the last factor those of the bound itself
    slack = (2 * bound * np.outer(np.sqrt(np.square(x).sum(axis=1)), np.sqrt(np.square(c).sum(axis=1))) + 8 * _U64 * (square + 2 * np.abs(products))) * (1 + 2.0**-20)
    return score - slack <= (score + slack).min(axis=1, keepdims=True)


def nearest(points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each point the index of its nearest entry, the lowest on ties, and the exact squared distance."""
    if not points.size:
        return np.zeros(len(points), np.int64), np.zeros(len(points), np.int64)
    r, j = np.nonzero(candidates(points, entries))
    exact = np.full((len(points), len(entries)), np.iinfo(np.int64).max)
    exact[r, j] = np.square(points[r] - entries[j]).sum(axis=1)
    at = exact.argmin(axis=1)
    return at, exact[np.arange(len(at)), at]


def _matrix(column: pa.Array, scale: float, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows have a vector, and those rows' integers."""
    have = np.asarray(column.is_valid())
    return have, _vectors.integers(np.asarray(column.flatten()).reshape(int(have.sum()), dims), scale)


def _chunks(points: np.ndarray) -> Iterator[slice]:
    return (slice(i, i + CHUNK_ROWS) for i in range(0, len(points), CHUNK_ROWS))


def _usable(vectors: DataFrame, vector: str, dims: int) -> DataFrame:
    """Kept rows with ``_vc_vector``, null where the length is another."""
    v = F.col(vector)
    return vectors.where(_vectors.sound(v)).withColumn("_vc_vector", F.when(F.size(v) == dims, v.cast("array<double>")))


def fit(vectors: DataFrame, parts: int = 8, k: int = 16, rounds: int = 6, scale: float = 4096.0, id: str = "vec_id", vector: str = "embedding") -> np.ndarray:
    """The codebooks after ``rounds`` rounds over all vectors: integers by part, entry and position within the part."""
    if not 0 < k <= 256:
        raise ValueError("a code has two hex digits: k is 1 to 256")
    v = F.col(vector)
    kept = vectors.where(_vectors.sound(v)).select(F.col(id).alias("id"), v.cast("array<double>").alias("vector"))
    order = [F.col("id").asc_nulls_last(), F.col("vector")]
    head = kept.where(F.size("vector") % parts == 0).orderBy(*order).limit(1).collect()
    if not head:
        return np.zeros((parts, 0, 0), np.int64)
    dims = len(head[0].vector)
    rows = kept.where(F.size("vector") == dims)
    first = np.array([r.vector for r in rows.orderBy(*order).limit(k).collect()], np.float64).reshape(-1, dims)
    books = _vectors.integers(first, scale).reshape(len(first), parts, dims // parts).transpose(1, 0, 2)
    for _ in range(rounds):
        held = vectors.sparkSession.sparkContext.broadcast(books)

        def sums(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            books = held.value
            n, total = np.zeros(books.shape[:2], np.int64), np.zeros(books.shape, np.int64)
            for b in batches:
                _, points = _matrix(b.column(0), scale, dims)
                for rows in _chunks(points):
                    for p, part in enumerate(np.split(points[rows], parts, axis=1)):
                        at, _ = nearest(part, books[p])
                        n[p] += np.bincount(at, minlength=n.shape[1])
                        np.add.at(total[p], at, part)
            p, e = np.nonzero(n)  # none where a task had no rows
            yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(n[p, e]), pa.array(total[p, e].tolist(), pa.list_(pa.int64()))], ["part", "entry", "n", "sums"])

        found = _vectors.merged(rows.select("vector").mapInArrow(sums, _vectors.SUMS))
        held.unpersist()
        books = books.copy()
        for (p, e), (n, total) in found.items():
            books[p, e] = [x // n for x in total]
    return books


def encode(vectors: DataFrame, books: np.ndarray, scale: float = 4096.0, vector: str = "embedding") -> DataFrame:
    """Kept rows with _vc_code (an index for each part, two hex digits) and _vc_error (squared distances, summed over parts)."""
    own_names(vectors, "_vc_")
    parts, _, width = books.shape
    dims = parts * width
    schema = T.StructType([*vectors.schema, T.StructField("_vc_code", T.StringType()), T.StructField("_vc_error", T.LongType())])
    if not books.shape[1]:
        return vectors.where(_vectors.sound(F.col(vector))).withColumns({"_vc_code": F.lit(None).cast("string"), "_vc_error": F.lit(None).cast("long")})
    held = vectors.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            have, points = _matrix(b.column(b.num_columns - 1), scale, dims)
            codes, errors = np.zeros((len(points), parts), np.uint8), np.zeros(len(points), np.int64)
            for rows in _chunks(points):
                for p, part in enumerate(np.split(points[rows], parts, axis=1)):
                    codes[rows, p], apart = nearest(part, held.value[p])
                    errors[rows] += apart
            text, error = np.full(len(have), None, object), np.zeros(len(have), np.int64)
            text[have], error[have] = [c.tobytes().hex() for c in codes], errors
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(text, pa.string()), pa.array(error, mask=~have)], [*b.schema.names[:-1], "_vc_code", "_vc_error"])

    return _usable(vectors, vector, dims).mapInArrow(run, schema)
