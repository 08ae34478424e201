"""Vectors of numbers as integers: which rows count, their matrix inside a task, sums over all tasks."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a task tells of its rows: for each entry of each part, how many rows it got and their sum.
SUMS = "part int, entry int, n long, sums array<long>"
_LONGEST = (1 << 63) - 1


def sound(vector: Column, dims: int | None = None) -> Column:
    """Whether a vector holds neither null nor NaN nor infinity (and has ``dims`` components)."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce(fine if dims is None else fine & (F.size(vector) == dims), F.lit(False))


def reach(dims: int) -> int:
    """The largest integer of a component for which every squared distance of ``dims`` components fits 63 bits."""
    return math.isqrt((1 << 60) // max(1, dims))


def integers(x: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x) of a matrix of doubles, held to ``reach`` on either side."""
    most = reach(x.shape[1])
    with np.errstate(over="ignore"):
        return np.clip(np.floor(x * scale), -most, most).astype(np.int64)


def merged(partials: DataFrame) -> dict[tuple[int, int], tuple[int, list[int]]]:
    """(part, entry) -> (rows, sums by component), added up over all tasks; as many rows as the entries have components."""
    each = partials.select("part", "entry", "n", F.posexplode("sums").alias("at", "x"))
    total = each.groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum(F.col("x").cast("decimal(20,0)")).alias("x"))
    out: dict[tuple[int, int], tuple[int, list[int]]] = {}
    for r in sorted(total.collect()):
        out.setdefault((r.part, r.entry), (r.n, []))[1].append(int(r.x))
    return out


def added(x: Column | str) -> Column:
    """The sum of a column of longs, exact, and held to the largest long."""
    return F.least(F.sum((F.col(x) if isinstance(x, str) else x).cast("decimal(20,0)")), F.lit(_LONGEST).cast("decimal(38,0)")).cast("long")
