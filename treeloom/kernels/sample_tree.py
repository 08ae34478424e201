"""Per-clade kernels: build a sample's tree, score queries on its edges, cut it."""

from __future__ import annotations

import hashlib
from collections import Counter
from dataclasses import dataclass

import numpy as np

from treeloom.config import LineageConfig
from treeloom.kernels import align, distance, likelihood, parsimony
from treeloom.kernels.tree import Tree, from_links, induced, parse_newick
from treeloom.operators.encode import FLOOR


def edit_vocabulary(rows: list[list[str]], total: int) -> list[str]:
    """Edits in more than FLOOR of the rows but not in all, sorted (A4)."""
    n = Counter(e for r in rows for e in r)
    return sorted(e for e, c in n.items() if c / total > FLOOR and c < total)


def encode_edits(edits: list[str], vocab: list[str]) -> str:
    """Pseudo-DNA (P3): present T or A, absent C or G, in the first and the second half of the vocabulary."""
    have, half = set(edits), len(vocab) // 2 + 1
    return "".join(("T" if e in have else "C") if i < half else ("A" if e in have else "G") for i, e in enumerate(vocab))


def _rooted(newick: str) -> Tree:
    """A builder's Newick, rooted at the taxon ``root``."""
    t = parse_newick(newick)
    links: dict[int, dict[int, float]] = {v: {} for v in range(len(t))}
    for v, p in enumerate(t.parent):
        if p >= 0:
            links[v][p] = links[p][v] = t.length[v]
    top = t.parent.index(-1)
    if len(links[top]) == 2:  # a root of two is no node of the unrooted tree
        a, b = links.pop(top)
        links[a].pop(top), links[b].pop(top)
        links[a][b] = links[b][a] = t.length[a] + t.length[b]
    return from_links(links, {v: n for v, n in enumerate(t.name) if v in links and len(links[v]) == 1 and n})


def build_tree(names: list[str], seqs: list[str], root: str, config: LineageConfig, model: list[float] | None = None) -> Tree:
    """The sample's tree without its outgroup (X1-X5); ``model``: the clade's estimates, if there are any."""
    if config.builder is not None:
        return _rooted(config.builder(["root", *names], [root, *seqs]))
    sets = parsimony.state_sets([*seqs, root])
    leaf = dict(zip(names, sets[:-1], strict=True))
    if config.method == "mp" or len(names) < 3:
        return parsimony.stepwise(names, sets[:-1], sets[-1])
    tree = distance.neighbor_joining([*names, "root"], distance.pairwise([*seqs, root]))
    if config.method == "ml":
        tree = likelihood.interchange(parsimony.with_lengths(tree, leaf, sets[-1]), names, seqs, root, likelihood.substitution(config.substitution(), [*seqs, root], model))
    return tree if config.method == "nj" else parsimony.with_lengths(tree, leaf, sets[-1])


@dataclass
class Model:
    """A sample tree with its aligned sequences; ``vocab`` in edit mode."""

    tree: Tree
    names: list[str]
    seqs: list[str]
    root: str
    vocab: list[str] | None
    estimates: list[float] | None = None

    @classmethod
    def of_row(cls, row) -> Model:
        listed = lambda x: list(x) if x is not None else None
        return cls(Tree([int(p) for p in row["parent"]], [n or None for n in row["label"]], [float(x) for x in row["length"]]), listed(row["names"]), listed(row["seqs"]), row["root"], listed(row["vocab"]), listed(row["model"]))

    def tables(self, placement: str, substitution: str = "JC") -> list[np.ndarray]:
        """Score tables (sites, states, edges): a query's score on an edge sums its states' entries, in the best of them."""
        sets = parsimony.state_sets([*self.seqs, self.root])
        leaf = dict(zip(self.names, sets[:-1], strict=True))
        if placement == "MP":
            below, above = parsimony.edge_states(self.tree, leaf, sets[-1])
            edge = parsimony.meet(below, above)
            miss = np.zeros((*edge.shape, 5), np.float32)
            for k in range(4):
                miss[..., k] = (edge & np.uint8(1 << k)) == 0
            return [np.ascontiguousarray(-miss.transpose(1, 2, 0))]
        tips = {n: likelihood.tips(s) for n, s in leaf.items()}
        out = likelihood.attachment_table(self.tree, tips, likelihood.tips(sets[-1]), likelihood.substitution(substitution, [*self.seqs, self.root], self.estimates))
        return [np.ascontiguousarray(t.transpose(1, 2, 0)) for t in out]


_STATE = np.full(256, 4, np.int64)
for _k, _c in enumerate(b"ACGT"):
    _STATE[_c] = _STATE[_c + 32] = _k


class Placer:
    """Places queries of one clade; keeps its score tables."""

    def __init__(self, model: Model, config: LineageConfig, clade: int, seed: int) -> None:
        self.model, self.config, self.clade, self.seed = model, config, clade, seed
        self.tables = model.tables(config.placement, config.substitution())
        self.columns = align.profile(model.seqs + [model.root]) if config.unaligned else None
        self.above = [self._path(v) for v in range(len(model.tree))]

    def _path(self, v: int) -> list[int]:
        out = []
        while v >= 0:
            out.append(v)
            v = self.model.tree.parent[v]
        return out

    def aligned(self, seq: str) -> str:
        return align.to_profile(seq, self.columns)

    def lca(self, edges: list[int]) -> int:
        """The lowest common node; the top is the root edge."""
        common = set(self.above[edges[0]]).intersection(*(self.above[e] for e in edges[1:]))
        return max(common, key=lambda v: len(self.above[v]))

    def scores(self, seqs: list[str]) -> np.ndarray:
        sites = len(self.model.root)
        codes = _STATE[np.frombuffer("".join(seqs).encode(), np.uint8).reshape(len(seqs), sites)]
        out = None
        for table in self.tables:  # gathered site by site: a matrix product would start threads of its own in every worker
            total = np.zeros((len(seqs), table.shape[2]), table.dtype)
            for s in range(sites):
                total += table[s][codes[:, s]]
            out = total if out is None else np.maximum(out, total, out=out)
        return out

    def best(self, names: list[str], seqs: list[str]) -> list[int]:
        """The edge of each query."""
        out: list[int] = []
        k = self.config.careful
        for a in range(0, len(seqs), 128):
            s = self.scores(seqs[a : a + 128])
            if self.config.placement == "ML":
                if k == 1:
                    out += [int(e) for e in s.argmax(axis=1)]
                else:
                    out += [self.lca([int(e) for e in np.argsort(-row, kind="stable")[:k]]) for row in s]
                continue
            for name, row in zip(names[a : a + 128], s, strict=True):
                ties = np.flatnonzero(row == row.max())
                if len(ties) == 1:
                    out.append(int(ties[0]))
                elif k > 1:
                    out.append(self.lca([int(e) for e in ties]))
                else:
                    out.append(int(min(ties, key=lambda e: hashlib.md5(f"{self.seed}|{self.clade}|{name}|{e}".encode()).hexdigest())))
        return out


def child_id(clade: int, turn: int, edge: int) -> int:
    """A child clade's id: a 63-bit digest of where it was cut, the same at every run."""
    return int.from_bytes(hashlib.blake2b(f"{clade}|{turn}|{edge}".encode(), digest_size=8).digest(), "big") >> 1


def cut(tree: Tree, counts: dict[int, int], limit: int) -> tuple[dict[int, int], dict[int, int], list[int]]:
    """(owner of each edge below a cut, what each cut owns, empty leaves) (T4); edge 0 is the root edge and owned by none."""
    kids = tree.children()
    owner: dict[int, int] = {}
    owned: dict[int, int] = {}
    empty: list[int] = []
    todo = [(w, 2) for w in reversed(kids[0])]
    while todo:
        v, depth = todo.pop()
        if counts.get(v, 0) == 0 and depth < limit:
            if kids[v]:
                todo += [(w, depth + 1) for w in reversed(kids[v])]
            else:
                empty.append(v)
            continue
        below = [v]
        owned[v] = 0
        while below:
            w = below.pop()
            owner[w] = v
            owned[v] += counts.get(w, 0)
            below += kids[w]
    return owner, owned, empty


def upper_tree(tree: Tree, owned: dict[int, int], clade: int, turn: int) -> list[tuple[str, str | None, float]]:
    """(node, parent, length) of the part above the cuts, without empty tips; tips carry their child clade's node."""
    kids = tree.children()
    top = Tree()
    at: dict[int, int] = {}
    todo = [0]
    while todo:
        v = todo.pop()
        at[v] = top.add(at[tree.parent[v]] if v else -1, f"c{child_id(clade, turn, v)}" if v in owned else (f"c{clade}.{v}" if v else f"c{clade}"), tree.length[v])
        if v not in owned:
            todo += reversed(kids[v])
    keep = {f"c{child_id(clade, turn, v)}" for v, n in owned.items() if n}
    small = induced(top, keep)
    return [(n, small.name[p] if p >= 0 else None, x) for n, p, x in zip(small.name, small.parent, small.length, strict=True)]
