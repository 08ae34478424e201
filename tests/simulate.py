"""A deterministic simulator of small lineages, for tests, examples and the benchmark."""

from __future__ import annotations

import random


def _evolved(seq: str, rate: float, rng: random.Random, indels: bool) -> str:
    out = []
    for c in seq:
        r = rng.random()
        if r < rate:
            out.append(rng.choice([x for x in "ACGT" if x != c]))
        elif indels and r < rate + 0.0004:
            out.append(c + "".join(rng.choices("ACGT", k=rng.randint(1, 2))))
        elif indels and r < rate + 0.0008:
            continue
        else:
            out.append(c)
    return "".join(out)


def balanced(depth: int, sites: int = 1000, rate: float = 0.02, seed: int = 0, indels: bool = False) -> tuple[list[tuple[str, str]], str]:
    """(records, Newick) of a balanced tree of 2**depth taxa; the first record is the root's."""
    rng = random.Random(seed)
    start = "".join(rng.choices("ACGT", k=sites))
    level = [("t", _evolved(start, rate, rng, indels))]
    for _ in range(depth):
        level = [(n + k, _evolved(s, rate, rng, indels)) for n, s in level for k in "01"]
    newick = {n: n for n, _ in level}
    for d in range(depth, 0, -1):
        newick = {n[:-1]: f"({newick[n[:-1] + '0']},{newick[n[:-1] + '1']})" for n in newick if len(n) == d + 1 and n.endswith("0")}
    return [("root", start), *level], newick["t"] + ";"


def edits(depth: int, each: int = 18, seed: int = 0) -> tuple[list[tuple[str, list[str]]], str]:
    """(taxa with edit lists, Newick): each branch adds its own insertions and deletions, which all below inherit."""
    rng = random.Random(seed)
    fresh = iter(range(10**9))

    def more() -> list[str]:
        return [f"ins{next(fresh)}{rng.choice('ACGT')}" if rng.random() < 0.6 else f"del{next(fresh)}len{rng.randint(1, 9)}" for _ in range(each)]

    level = [("t", more())]
    for _ in range(depth):
        level = [(n + k, e + more()) for n, e in level for k in "01"]
    _, newick = balanced(depth, 1, 0.0, seed)
    return level, newick
