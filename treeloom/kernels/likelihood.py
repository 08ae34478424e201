"""Likelihood of DNA on a tree: scores of attaching a query to each edge, and tree search by interchange.

The substitution model has base frequencies (equal ones are Jukes-Cantor, others
Felsenstein 1981), exchange rates where they were estimated (general time
reversible) and rate categories, whose likelihoods are averaged by site.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from treeloom.kernels.parsimony import state_sets
from treeloom.kernels.tree import Tree

#: Pendant lengths tried for a query.
PENDANT = (0.0005, 0.005, 0.02, 0.05, 0.1, 0.3)


@dataclass(frozen=True)
class Substitution:
    """Base frequencies (A, C, G, T), relative rates of equal weight and, if they differ, the exchange rates AC, AG, AT, CG, CT, GT."""

    freq: np.ndarray
    rates: tuple[float, ...] = (1.0,)
    exchange: np.ndarray | None = None

    @property
    def pace(self) -> float:
        """What makes a branch of length 1 one expected change a site."""
        return 1 / (1 - float((self.freq**2).sum()))

    def _modes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Eigenvalues of the rate matrix, and what leads into their modes and back."""
        q = np.zeros((4, 4))
        q[np.triu_indices(4, 1)] = self.exchange
        q = (q + q.T) * self.freq
        q -= np.diag(q.sum(axis=1))
        q /= -(self.freq * q.diagonal()).sum()
        root = np.sqrt(self.freq)
        values, vectors = np.linalg.eigh(root[:, None] * q / root)
        return values, root[:, None] * vectors, (vectors / root[:, None]).T

    def along(self, partial: np.ndarray, t: np.ndarray | float) -> np.ndarray:
        """Partial likelihoods (..., 4) after a branch of length t."""
        if self.exchange is not None:
            values, into, back = self._modes()
            return np.maximum((partial @ into * np.exp(values * np.maximum(t, 1e-6))) @ back, 0)
        e = np.exp(-self.pace * np.maximum(t, 1e-6))
        return e * partial + (1 - e) * (partial * self.freq).sum(axis=-1, keepdims=True)


JC = Substitution(np.full(4, 0.25))


def gamma_rates(n: int = 4, shape: float = 1.0) -> tuple[float, ...]:
    """Mean rates of the n equal shares of a gamma distribution of mean 1, by a sum over a fine grid of x**power."""
    power = min(shape, 1.0)  # an even grid of x**shape takes the peak at 0 out of small shapes
    u = np.linspace(0, (40 / shape + 10) ** power, 200_001)
    x = ((u[1:] + u[:-1]) / 2) ** (1 / power)
    log = (shape - power) * np.log(x) - shape * x
    weight = np.exp(log - log.max())
    weight /= weight.sum()
    share = np.minimum((np.cumsum(weight) * n).astype(int), n - 1)
    means = np.bincount(share, weight * x, n) * n
    return tuple((means / means.mean()).tolist())


def substitution(name: str, seqs: list[str], model: list[float] | None = None) -> Substitution:
    """The model ``name`` with the base frequencies of ``seqs`` (X7); a base that is missing counts once.

    ``model``: what ``operators.substitution.estimates`` found for the clade;
    without it, GTR has equal exchange rates and +G a shape of 1.
    """
    if name == "JC":
        return JC
    shape = 1.0
    if model is not None and name.startswith("GTR"):
        freq, exchange, shape = np.array(model[:4]), np.array(model[4:10]), model[10]
    else:
        codes = np.frombuffer("".join(seqs).upper().encode(), np.uint8)
        freq, exchange = np.array([max(1, int((codes == c).sum())) for c in b"ACGT"], float), None
    return Substitution(freq / freq.sum(), gamma_rates(4, shape) if name.endswith("+G") else (1.0,), exchange)


def tips(sets: np.ndarray) -> np.ndarray:
    """0/1 partials (rows, sites, 4) of bit sets."""
    return ((sets[..., None] >> np.arange(4)) & 1).astype(float)


def _scaled(x: np.ndarray, log: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    top = np.maximum(x.max(axis=-1, keepdims=True), 1e-300)
    return x / top, log + np.log(top[..., 0])


def partials(tree: Tree, leaf: dict[str, np.ndarray], root: np.ndarray, model: Substitution = JC, rate: float = 1.0):
    """(below, above) with their site logs: at each node's lower end from below, and at its upper end from the rest."""
    kids, order = tree.children(), tree.preorder()
    sites = len(root)
    below, lb = np.ones((len(tree), sites, 4)), np.zeros((len(tree), sites))
    above, la = np.ones_like(below), np.zeros_like(lb)
    for v in reversed(order):
        if not kids[v]:
            below[v] = leaf[tree.name[v]]
        for w in kids[v]:
            below[v], lb[v] = _scaled(below[v] * model.along(below[w], rate * tree.length[w]), lb[v] + lb[w])
    above[order[0]] = root
    for v in order:
        for w in kids[v]:
            x, log = model.along(above[v], rate * tree.length[v]), la[v]
            for s in kids[v]:
                if s != w:
                    x, log = x * model.along(below[s], rate * tree.length[s]), log + lb[s]
            above[w], la[w] = _scaled(x, log)
    return below, lb, above, la


def _mean(logs: list[np.ndarray]) -> np.ndarray:
    """log of the mean of the categories' likelihoods."""
    if len(logs) == 1:
        return logs[0]
    top = np.max(logs, axis=0)
    return top + np.log(np.mean([np.exp(x - top) for x in logs], axis=0))


def log_likelihood(tree: Tree, leaf: dict[str, np.ndarray], root: np.ndarray, model: Substitution = JC) -> float:
    top, logs = tree.preorder()[0], []
    for rate in model.rates:
        below, lb, _, _ = partials(tree, leaf, root, model, rate)
        logs.append(np.log((model.along(below[top], rate * tree.length[top]) * root * model.freq).sum(axis=-1)) + lb[top])
    return float(_mean(logs).sum())


def attachment_table(tree: Tree, leaf: dict[str, np.ndarray], root: np.ndarray, model: Substitution = JC) -> np.ndarray:
    """log likelihood (pendant length, edge, site, state) of a query's site; state 4 is unknown.

    A query's score on an edge is the sum over its sites, so that many queries
    are scored from one table.
    """
    logs = []
    for rate in model.rates:
        below, lb, above, la = partials(tree, leaf, root, model, rate)
        half = rate * np.array(tree.length)[:, None, None] / 2
        mid = model.along(below, half) * model.along(above, half)
        log = (lb + la)[..., None]
        out = np.empty((len(PENDANT), *mid.shape[:2], 5))
        for k, t in enumerate(PENDANT):
            out[k, ..., :4] = np.log(np.maximum(model.along(mid, rate * t) * model.freq, 1e-300)) + log
        out[..., 4] = (np.log(np.maximum((mid * model.freq).sum(-1), 1e-300)) + lb + la)[None]
        logs.append(out)
    return _mean(logs)


def interchange(tree: Tree, names: list[str], seqs: list[str], root_seq: str, model: Substitution = JC, rounds: int = 3) -> Tree:
    """Nearest-neighbour interchange under the likelihood, from ``tree`` (X3: an approximation of a full search)."""
    sets = state_sets([*seqs, root_seq])
    leaf = dict(zip(names, tips(sets[:-1]), strict=True))
    root = tips(sets[-1])
    best = log_likelihood(tree, leaf, root, model)
    for _ in range(rounds):
        changed = False
        for v in range(1, len(tree)):
            kids = tree.children()
            if not kids[v] or tree.parent[v] < 0:
                continue
            beside = [w for w in kids[tree.parent[v]] if w != v]
            for w in kids[v]:
                for s in beside:
                    trial = Tree(list(tree.parent), list(tree.name), list(tree.length))
                    trial.parent[w], trial.parent[s] = tree.parent[v], v
                    got = log_likelihood(trial, leaf, root, model)
                    if got > best + 1e-6:
                        tree, best, changed = trial, got, True
                        break
                else:
                    continue
                break
        if not changed:
            break
    return tree.renumbered()
