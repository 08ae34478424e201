"""Fitch parsimony on state bit sets: stepwise addition, insertion costs, edge lengths."""

from __future__ import annotations

import numpy as np

from treeloom.kernels.tree import Tree

#: State bits; anything else (gaps, N) is every state.
_BITS = np.full(256, 15, np.uint8)
for _k, _c in enumerate(b"ACGT"):
    _BITS[_c] = _BITS[_c + 32] = 1 << _k


def state_sets(seqs: list[str]) -> np.ndarray:
    """Rows of bit sets, one byte for each site."""
    return _BITS[np.frombuffer("".join(seqs).encode(), np.uint8).reshape(len(seqs), -1)]


def meet(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Fitch's rule: the intersection, or the union where that is empty."""
    both = a & b
    return np.where(both == 0, a | b, both)


def edge_states(tree: Tree, leaf: dict[str, np.ndarray], root: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(below, above) for every node: the sets at its lower end from its subtree, and from the rest of the tree."""
    kids, order = tree.children(), tree.preorder()
    below = np.empty((len(tree), len(root)), np.uint8)
    above = np.empty_like(below)
    for v in reversed(order):
        below[v] = leaf[tree.name[v]] if not kids[v] else below[kids[v][0]]
        for w in kids[v][1:]:
            below[v] = meet(below[v], below[w])
    above[order[0]] = root
    for v in order:
        for w in kids[v]:
            s = above[v]
            for x in kids[v]:
                if x != w:
                    s = meet(s, below[x])
            above[w] = s
    return below, above


def length(tree: Tree, leaf: dict[str, np.ndarray], root: np.ndarray) -> int:
    """The tree's parsimony length, the outgroup included."""
    kids = tree.children()
    below: dict[int, np.ndarray] = {}
    steps = 0
    for v in reversed(tree.preorder()):
        if not kids[v]:
            below[v] = leaf[tree.name[v]]
            continue
        s = below[kids[v][0]]
        for w in kids[v][1:]:
            steps += int(((s & below[w]) == 0).sum())
            s = meet(s, below[w])
        below[v] = s
    return steps + int(((below[tree.preorder()[0]] & root) == 0).sum())


def insertion_costs(tree: Tree, leaf: dict[str, np.ndarray], root: np.ndarray, query: np.ndarray) -> np.ndarray:
    """How many steps the tree grows by if ``query`` joins each edge."""
    below, above = edge_states(tree, leaf, root)
    return ((meet(below, above) & query) == 0).sum(axis=1)


def with_lengths(tree: Tree, leaf: dict[str, np.ndarray], root: np.ndarray) -> Tree:
    """Jukes-Cantor lengths from the sites whose sets at an edge's two ends are apart, half a step at least."""
    below, above = edge_states(tree, leaf, root)
    p = np.minimum((((below & above) == 0).sum(axis=1) + 0.5) / max(1, len(root)), 0.7)
    return Tree(list(tree.parent), list(tree.name), list(-0.75 * np.log(1 - 4 / 3 * p)))


def stepwise(names: list[str], sets: np.ndarray, root: np.ndarray) -> Tree:
    """A maximum-parsimony tree: each taxon joins the edge of least cost (the first such), in the order given."""
    leaf = {names[0]: sets[0]}
    tree = Tree([-1], [names[0]], [0.0])
    for name, s in zip(names[1:], sets[1:], strict=True):
        v = int(insertion_costs(tree, leaf, root, s).argmin())
        joint = tree.add(tree.parent[v])
        tree.parent[v] = joint
        leaf[name] = s
        tree.add(joint, name)
        tree = tree.renumbered()
    return with_lengths(tree, leaf, root)
