"""Quality rules: a learned decision list over text statistics.

Sequential covering in the style of rule induction by incremental reduced-error
pruning: each rule is grown, one threshold condition at a time, on two thirds of
the labelled rows until it covers (almost) only low-quality ones, pruned on the
remaining third, and kept while it is precise there. Covered rows leave, and the
next rule is learned. The ordered rules become one Spark ``CASE`` expression.

Defined results: a null text counts as empty; an empty text has zero for every
statistic and fails the base rule; texts of any length are handled whole, in
bounded chunks; with no labelled rows, or labels of one kind, the list is empty
and only the base rule decides. A null doc_id is carried through. Repeated rows
are judged separately and alike. A document with contradictory labels has none.
Columns of ``docs`` other than the text are carried through, whatever their names;
the operator's own begin with ``prefix``, which no other may begin with.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treeloom.llm._text import BYTE_VALUES, chunks, hasher, window_hashes, word_hashes, words
from treeloom.plans.sizing import arrow_rows

#: The statistics, all long. The first five are those of the base contract.
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_chars_all", "n_upper", "n_letters", "n_exclaim", "n_pipe", "n_lines", "n_long_words", "n_distinct_words")
#: Characters counted as symbols.
SYMBOLS = b"#*$%&|<>"


def _table(members: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(members)] = True
    return out


_SYMBOL, _UPPER = _table(SYMBOLS), _table(bytes(range(65, 91)))
_LETTER = _table(bytes(range(65, 91)) + bytes(range(97, 123)))
_HEAD = np.ones(256, bool)
_HEAD[0x80:0xC0] = False  # continuation bytes do not start a code point


def _sums(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def _repeats(keys: np.ndarray) -> np.ndarray:
    """Which of the keys occur twice or more."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    out = np.zeros(len(keys), bool)
    out[order[1:]] |= same
    out[order[:-1]] |= same
    return out


def _duplicate_lines(data: bytes) -> int:
    """Lines with a word that equal an earlier line of the same text."""
    seen: set[bytes] = set()
    n = 0
    for line in data.split(b"\n"):
        if line in seen:
            n += 1
        elif line and not line.isspace():
            seen.add(line)
    return n


def text_statistics(texts: pa.Array) -> dict[str, np.ndarray]:
    """STATISTICS of each text."""
    parts: dict[str, list[np.ndarray]] = {k: [] for k in STATISTICS}
    tables = hasher()
    for c in chunks(texts):
        w = words(c)
        n = len(c)
        heads = np.zeros(len(c.data) + 1, np.int64)
        np.cumsum(_HEAD[c.data], out=heads[1:])
        lengths = heads[w.end] - heads[w.start]
        per_doc = lambda x: np.bincount(w.doc, x, minlength=n).astype(np.int64)
        raw = c.data.tobytes()
        h = word_hashes(c, w, BYTE_VALUES, tables)
        covered = np.zeros(len(h), bool)
        distinct = np.zeros(n, np.int64)
        three = window_hashes(h, 3)
        for i in range(n):
            a, b = w.first[i], w.first[i + 1]
            if b > a:
                distinct[i] = len(np.unique(h[a:b]))
            if b - a > 3:
                again = np.flatnonzero(_repeats(three[a : b - 2])) + a
                for j in range(3):
                    covered[again + j] = True
        new = {
            "n_words": np.diff(w.first),
            "word_chars": per_doc(lengths),
            "n_symbols": _sums(_SYMBOL[c.data], c.bounds),
            "n_dup_lines": np.array([_duplicate_lines(raw[c.bounds[i] : c.bounds[i + 1]]) for i in range(n)], np.int64),
            "n_repeat_words": per_doc(covered),
            "n_chars_all": heads[c.bounds[1:]] - heads[c.bounds[:-1]],
            "n_upper": _sums(_UPPER[c.data], c.bounds),
            "n_letters": _sums(_LETTER[c.data], c.bounds),
            "n_exclaim": _sums(c.data == 33, c.bounds),
            "n_pipe": _sums(c.data == 124, c.bounds),
            "n_lines": _sums(c.data == 10, c.bounds) + 1,
            "n_long_words": per_doc(lengths > 20),
            "n_distinct_words": distinct,
        }
        for k, v in new.items():
            parts[k].append(v)
    return {k: np.concatenate(v).astype(np.int64) if v else np.empty(0, np.int64) for k, v in parts.items()}


def with_statistics(docs: DataFrame, text: str = "text", prefix: str = "_qr_", keep_text: bool = False) -> DataFrame:
    """``docs`` with the STATISTICS of ``text``; the text itself only if asked for."""
    arrow_rows(docs.sparkSession)
    kept = [c for c in docs.columns if keep_text or c != text]
    names = [prefix + s for s in STATISTICS]
    if clash := [c for c in kept if c.startswith(prefix)]:
        raise ValueError(f"docs has columns {clash}; choose another prefix")
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField(n, T.LongType()) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            stats = text_statistics(b.column(text))
            yield pa.RecordBatch.from_arrays([b.column(c) for c in kept] + [pa.array(stats[s]) for s in STATISTICS], kept + names)

    return docs.select(*dict.fromkeys([*kept, text])).mapInArrow(run, schema)


#: Features by name: a numerator and a denominator among the statistics (None: the plain value).
FEATURES = {
    "words": ("n_words", None),
    "mean_word": ("word_chars", "n_words"),
    "symbol_ratio": ("n_symbols", "n_chars_all"),
    "repeat_ratio": ("n_repeat_words", "n_words"),
    "dup_line_ratio": ("n_dup_lines", "n_lines"),
    "upper_ratio": ("n_upper", "n_letters"),
    "exclaim_ratio": ("n_exclaim", "n_words"),
    "pipe_ratio": ("n_pipe", "n_words"),
    "letter_ratio": ("n_letters", "n_chars_all"),
    "long_ratio": ("n_long_words", "n_words"),
    "distinct_ratio": ("n_distinct_words", "n_words"),
}


def feature_columns(prefix: str = "_qr_") -> dict[str, Column]:
    one = lambda n, d: F.col(prefix + n).cast("double") if d is None else F.col(prefix + n) / F.greatest(F.col(prefix + d), F.lit(1))
    return {k: one(*v) for k, v in FEATURES.items()}


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, x: pd.DataFrame) -> np.ndarray:
        v = x[self.feature].to_numpy()
        return v > self.threshold if self.above else v <= self.threshold

    def column(self, features: dict[str, Column]) -> Column:
        return features[self.feature] > self.threshold if self.above else features[self.feature] <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


def _covers(rule: list[Condition], x: pd.DataFrame) -> np.ndarray:
    hit = np.ones(len(x), bool)
    for c in rule:
        hit &= c.holds(x)
    return hit


def _grow(x: pd.DataFrame, bad: np.ndarray, cuts: int) -> list[Condition]:
    """Conditions by information gain until no clean row is covered."""
    rule: list[Condition] = []
    hit = np.ones(len(x), bool)
    while (hit & ~bad).any() and len(rule) < 4:
        p0, n0 = (hit & bad).sum(), (hit & ~bad).sum()
        best, gain = None, 1e-9
        for f in x.columns:
            v = x[f].to_numpy()
            for t in np.unique(np.quantile(v[hit], np.linspace(0, 1, cuts))):
                for above in (True, False):
                    h = hit & (v > t if above else v <= t)
                    p, n = (h & bad).sum(), (h & ~bad).sum()
                    if p:
                        g = p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0)))
                        if g > gain:
                            best, gain = Condition(f, above, float(t)), g
        if best is None:
            break
        rule.append(best)
        hit &= best.holds(x)
    return rule


def _prune(rule: list[Condition], x: pd.DataFrame, bad: np.ndarray) -> list[Condition]:
    """The shortest leading part of the rule with the best worth on held-back rows."""

    def worth(r: list[Condition]) -> float:
        h = _covers(r, x)
        p, n = (h & bad).sum(), (h & ~bad).sum()
        return (p - n) / max(1, p + n)

    return max((rule[:k] for k in range(1, len(rule) + 1)), key=worth, default=rule)


def _centre(rule: list[Condition], x: pd.DataFrame, bad: np.ndarray) -> list[Condition]:
    """Move each threshold from the clean rows' edge halfway to the bulk of the bad rows, so that a stray symbol in a clean text fires nothing."""
    out = []
    for c in rule:
        v = x[c.feature].to_numpy()[_covers(rule, x) & bad]
        out.append(Condition(c.feature, c.above, float((c.threshold + np.quantile(v, 0.05 if c.above else 0.95)) / 2)) if len(v) else c)
    return out


def learn(x: pd.DataFrame, bad: np.ndarray, min_precision: float = 0.97, min_cover: int = 5, max_rules: int = 16, cuts: int = 48, seed: int = 7) -> list[list[Condition]]:
    """An ordered list of rules, each for low quality. ``x``: FEATURES; ``bad``: label 0."""
    rules: list[list[Condition]] = []
    if not len(x) or bad.all() or not bad.any():
        return rules
    part = np.random.default_rng(seed).permutation(len(x)) % 3
    left = np.ones(len(x), bool)
    for _ in range(max_rules):
        grow, hold = left & (part != 0), left & (part == 0)
        if not (grow & bad).any():
            break
        rule = _prune(_grow(x[grow], bad[grow], cuts), x[hold], bad[hold])
        rule = _centre(rule, x[grow], bad[grow])
        hit = left & _covers(rule, x) if rule else np.zeros(len(x), bool)
        p = (hit & bad).sum()
        if p < min_cover or p < min_precision * hit.sum():
            break
        rules.append(rule)
        left &= ~hit
    return rules


def verdict(rules: list[list[Condition]], prefix: str = "_qr_") -> Column:
    """The list as one ordered conditional: the number (from 1) of the first rule that holds, else 0."""
    features, out = feature_columns(prefix), F.lit(0)
    for i in range(len(rules), 0, -1):
        cond = F.lit(True)
        for c in rules[i - 1]:
            cond = cond & c.column(features)
        out = F.when(cond, F.lit(i)).otherwise(out)
    return out


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = 12_000, text: str = "text", **how) -> list[list[Condition]]:
    """Learn from at most ``sample_rows`` labelled documents (those of smallest hash).

    Only their statistics reach the driver. A missing or null label is
    no label, nor are two that differ.
    """
    picked = (
        labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("_id")).agg(F.min("quality").alias("_quality"), F.max("quality").alias("_most")).where("_quality = _most").drop("_most")
        .orderBy(F.xxhash64(F.lit(11), "_id"), "_id").limit(sample_rows)
    )
    rows = docs.select("doc_id", text).join(F.broadcast(picked), F.col("doc_id") == F.col("_id")).select(F.col("_id").alias("id"), F.col("_quality").alias("quality"), text)
    stats = with_statistics(rows, text, "_s_")
    found = stats.where(~base_failed("_s_")).select("id", "quality", *[c.alias(k) for k, c in feature_columns("_s_").items()]).toPandas()
    found = found.sort_values(["id", *FEATURES]).reset_index(drop=True)  # the same order, and so the same list, at each run
    return learn(found[list(FEATURES)], (found["quality"] == 0).to_numpy(), **how)


def base_failed(prefix: str = "_qr_") -> Column:
    """Under 50 words, or over half of the words in repeated three-word windows."""
    n = F.col(prefix + "n_words")
    return (n < 50) | (100 * F.col(prefix + "n_repeat_words") > 50 * n)


def judge(docs: DataFrame, rules: list[list[Condition]], text: str = "text", keep_text: bool = False, prefix: str = "_qr_") -> DataFrame:
    """``docs`` with statistics, ``base_failed``, ``rule`` (0: none) and ``kept``, each with ``prefix``."""
    out = with_statistics(docs, text, prefix, keep_text)
    return out.withColumns({prefix + "base_failed": base_failed(prefix), prefix + "rule": verdict(rules, prefix)}).withColumn(prefix + "kept", ~F.col(prefix + "base_failed") & (F.col(prefix + "rule") == 0))
