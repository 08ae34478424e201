"""Global alignment of a sequence to a profile of columns."""

from __future__ import annotations

import numpy as np

_CODE = np.full(256, 4, np.int64)
for _k, _c in enumerate(b"ACGT"):
    _CODE[_c] = _CODE[_c + 32] = _k
_LETTERS = "ACGTN"


def profile(rows: list[str]) -> np.ndarray:
    """Column scores (columns, 5) for A, C, G, T and others: shares of the rows' letters, from -1 to 1."""
    codes = _CODE[np.frombuffer("".join(rows).encode(), np.uint8).reshape(len(rows), -1)]
    share = np.stack([(codes == k).mean(axis=0) for k in range(4)], axis=1)
    return np.concatenate([2 * share - share.sum(axis=1, keepdims=True), np.zeros((len(share), 1))], axis=1)


def to_profile(seq: str, columns: np.ndarray, gap: float = 0.9) -> str:
    """``seq`` on the profile's columns (X11): gaps where it has nothing, letters beyond the columns left out."""
    codes = _CODE[np.frombuffer(seq.encode(), np.uint8)]
    n, m = len(columns), len(codes)
    at = np.arange(m + 1)
    row = -gap * at
    back = np.empty((n + 1, m + 1), np.int8)
    back[0] = 2
    for i in range(1, n + 1):
        pair = np.full(m + 1, -np.inf)
        pair[1:] = row[:-1] + columns[i - 1][codes]
        new = np.maximum(pair, row - gap)
        step = np.where(pair >= row - gap, 0, 1).astype(np.int8)
        best = np.maximum.accumulate(new + gap * at) - gap * at
        step[best > new + 1e-12] = 2
        back[i], row = step, best
    out = ["-"] * n
    i, j = n, m
    while i:
        s = back[i, j]
        if s == 0:
            out[i - 1] = _LETTERS[codes[j - 1]]
            i, j = i - 1, j - 1
        elif s == 1:
            i -= 1
        else:
            j -= 1
    return "".join(out)


def align_all(seqs: list[str], center: str) -> list[str]:
    """A star alignment on the columns of ``center``."""
    columns = profile([center])
    return [to_profile(s, columns) for s in seqs]
