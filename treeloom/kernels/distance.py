"""Evolutionary distances and neighbour joining."""

from __future__ import annotations

import numpy as np

from treeloom.kernels.parsimony import state_sets
from treeloom.kernels.tree import Tree, from_links

_PURINE = np.uint8(1 | 4)  # A and G


def pairwise(seqs: list[str], model: str = "K2P") -> np.ndarray:
    """Distances over sites where both are A, C, G or T; saturated pairs get 5."""
    s = state_sets(seqs)
    known = np.isin(s, [1, 2, 4, 8])
    n = len(seqs)
    out = np.zeros((n, n))
    for i in range(n):
        both = known[i] & known
        size = np.maximum(1, both.sum(axis=1))
        apart = both & (s[i] != s)
        kind = ((s[i] & _PURINE) > 0) == ((s & _PURINE) > 0)
        p, q = (apart & kind).sum(axis=1) / size, (apart & ~kind).sum(axis=1) / size
        with np.errstate(divide="ignore", invalid="ignore"):
            d = -0.5 * np.log(1 - 2 * p - q) - 0.25 * np.log(1 - 2 * q) if model == "K2P" else -0.75 * np.log(1 - 4 / 3 * (p + q))
        out[i] = np.where(np.isfinite(d), d, 5.0)
    return np.maximum(0, (out + out.T) / 2)


def neighbor_joining(names: list[str], d: np.ndarray) -> Tree:
    """The neighbour-joining tree, rooted at the taxon ``root`` (X2). Ties go to the first pair."""
    links: dict[int, dict[int, float]] = {i: {} for i in range(len(names))}
    live = list(range(len(names)))
    d = d.astype(float).copy()

    def join(a: int, b: int, x: float) -> None:
        links[a][b] = links[b][a] = max(0.0, float(x))

    while len(live) > 3:
        m = len(live)
        r = d.sum(axis=1)
        q = (m - 2) * d - r[:, None] - r[None, :]
        np.fill_diagonal(q, np.inf)
        i, j = divmod(int(q.argmin()), m)
        i, j = min(i, j), max(i, j)
        new = len(links)
        links[new] = {}
        x = 0.5 * d[i, j] + (r[i] - r[j]) / (2 * (m - 2))
        join(new, live[i], x)
        join(new, live[j], d[i, j] - x)
        to = 0.5 * (d[i] + d[j] - d[i, j])
        keep = [k for k in range(m) if k not in (i, j)]
        d = np.block([[d[np.ix_(keep, keep)], to[keep][:, None]], [to[keep][None, :], np.zeros((1, 1))]])
        live = [live[k] for k in keep] + [new]
    if len(live) == 3:
        new = len(links)
        links[new] = {}
        for k in range(3):
            a, b = (x for x in range(3) if x != k)
            join(new, live[k], 0.5 * (d[k, a] + d[k, b] - d[a, b]))
    else:
        join(live[0], live[1], d[0, 1])
    return from_links(links, dict(enumerate(names)))
