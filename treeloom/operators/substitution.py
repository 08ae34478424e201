"""How often bases change into each other (X7, X13): counts for all clades in one aggregate, exchange rates from them."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASES = "ACGT"
PAIRS = [a + b for a, b in combinations(BASES, 2)]
#: Shapes of the gamma distribution of rates that are told apart: beyond, all sites have one rate.
SHAPES = (0.05, 50.0)


def substitution_counts(rows: DataFrame, by: str = "clade_id", seq: str = "seq") -> DataFrame:
    """(by, AA, CC, GG, TT, AC, ..., GT, sites, changes, changes2) of aligned sequences.

    For each pair of bases the number of pairs of rows, over all sites, of which
    one has the one and the other the other: products of a site's base counts, so
    that no two rows meet. ``changes`` and ``changes2`` sum the least number of
    changes of a site, its bases less one, and its square. Letters that are no
    base do not count.
    """
    chars = rows.select(by, F.posexplode(F.split(F.upper(seq), "")).alias("pos", "ch")).where(F.col("ch").isin(*BASES))
    site = chars.groupBy(by, "pos").agg(*[F.count_if(F.col("ch") == b).alias(f"n{b}") for b in BASES])
    n = lambda b: F.col(f"n{b}")
    least = sum((n(b) > 0).cast("long") for b in BASES) - 1
    same = [F.sum(F.expr(f"n{b} * (n{b} - 1) div 2")).alias(b + b) for b in BASES]
    other = [F.sum(n(p[0]) * n(p[1])).alias(p) for p in PAIRS]
    return site.groupBy(by).agg(*same, *other, F.count("*").alias("sites"), F.sum(least).alias("changes"), F.sum(least * least).alias("changes2"))


def exchange_rates(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(base frequencies, rates of PAIRS) from one clade's AA, CC, GG, TT, AC, ... counts.

    The share of pairs of rows with bases a and b is a reversible matrix of
    transition probabilities over some time; its logarithm is the rate matrix up
    to that time, multiple changes of a site included. Rates are scaled so that
    one change a site is expected in a unit of time. A pair never seen counts
    half.
    """
    f = np.diag(counts[:4]).astype(float)
    for k, (i, j) in enumerate(combinations(range(4), 2)):
        f[i, j] = f[j, i] = max(counts[4 + k], 0.5) / 2
    f[np.diag_indices(4)] = np.maximum(f.diagonal(), 1.0)
    f /= f.sum()
    freq = f.sum(axis=1)
    root = np.sqrt(freq)
    values, vectors = np.linalg.eigh(f / np.outer(root, root))
    rate = (vectors * np.log(np.maximum(values, 1e-3))) @ vectors.T / np.outer(root, root)  # symmetric: Q[a, b] / freq[b]
    rates = np.array([max(rate[i, j], 1e-6) for i, j in combinations(range(4), 2)])
    pace = 2 * sum(freq[i] * freq[j] * r for (i, j), r in zip(combinations(range(4), 2), rates, strict=True))
    return freq, rates / pace


def gamma_shape(sites: float, changes: float, changes2: float) -> float:
    """The shape of gamma rates from the first two moments of the sites' bases less one.

    Under gamma rates a site's changes are negative binomial. Each change leads
    to one of three further bases, so that the mean tells g1, the chance that a
    given one is not met, and the second moment g2, that a given two are not;
    for each shape g1 fixes the mean number of changes, and so g2, which falls
    from g1 to g1**2 as the shape grows. The shape that fits g2 is found by
    halving.
    """
    g1 = 1 - changes / sites / 3
    g2 = (changes2 - changes) / sites / 6 - 1 + 2 * g1
    if not 0 < g1 < 1:
        return SHAPES[1]
    low, high = np.log(SHAPES)
    for _ in range(60):
        mid = (low + high) / 2
        a = np.exp(mid)
        # the logarithm of (1 + 2 (g1**(-1/a) - 1))**-a, without a large power
        log = np.log(g1) - a * np.log(2 - g1 ** (1 / a))
        low, high = (mid, high) if log > np.log(max(g2, 1e-300)) else (low, mid)
    return float(np.exp((low + high) / 2))


def estimates(rows: DataFrame, by: str = "clade_id", seq: str = "seq") -> DataFrame:
    """(by, model): base frequencies, exchange rates of PAIRS and gamma shape of each clade, from its aligned rows."""
    names = [b + b for b in BASES] + PAIRS

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in pdf.itertuples(index=False):
            freq, rates = exchange_rates(np.array([getattr(r, n) for n in names], float))
            out.append([*freq.tolist(), *rates.tolist(), gamma_shape(r.sites, r.changes, r.changes2)])
        return pd.DataFrame({by: pdf[by], "model": out})

    counts = substitution_counts(rows, by, seq)
    return counts.mapInPandas(lambda it: map(run, it), f"{by} {counts.schema[by].dataType.simpleString()}, model array<double>")
