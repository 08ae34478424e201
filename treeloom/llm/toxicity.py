"""Toxicity: a convolutional text classifier over hashed word embeddings.

A word's vector is the sum of hashed embeddings of the word and of two of its
prefixes. Filters of widths one to three run over all words of a text, the
maximum over the whole text is pooled for each filter, and a logistic layer
makes the score. Scoring runs on the executors and never sees language, source,
labels or ids. Thresholds calibrated by language are reported beside the score,
for callers who want a language's own operating point.

Training takes every labelled row outside the held-out fold. Rows are dealt by
the hash of their ids to blocks of about ``BLOCK_ROWS`` rows and ``BLOCK_BYTES``
of text, and a task makes a pass of Adam over the minibatches of one block. The
blocks' weights are averaged in a groupBy, a word's over the blocks that moved
it, and start the next pass; one block alone makes all its passes at once. The
driver holds the weights, never rows. Sums of weights are taken as integers, so
that the order and the number of files change nothing. A fifth of the rows is
not fitted but scored, and the thresholds come from running sums over all of it.

Scoring folds each filter's weights into the embedding table once, so that a
word costs a few table rows and a text of any length is scored whole.

Defined results: a null or empty text has the score of a text without words;
with no labels, or of one kind only, the score is their share of toxic ones (1/2
without any) for every text; a null label is no label, nor are two that differ;
repeated rows score alike; a null doc_id counts as held out; other columns are
not read.
"""

from __future__ import annotations

import copy
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeloom.llm._text import BYTE_VALUES, SPACE, Chunk, chunks, hasher, splitmix, words
from treeloom.operators.ranking import running
from treeloom.plans.durable import durable, measured, stored, tables
from treeloom.plans.sizing import arrow_rows, broadcast_if_small

_U = np.uint64
BUCKETS = 1 << 16
WIDTHS = (1, 2, 3)
PREFIXES = (4, 8)
#: Words of a long text that are worked on at once.
RUN = 1 << 15
#: Labelled rows, and bytes of their texts, that one task learns from.
BLOCK_ROWS, BLOCK_BYTES = 8000, 48_000_000
#: Weights are averaged as multiples of 1 / ONE.
ONE = float(1 << 32)
#: ASCII punctuation and digits part words as well.
_GAP = SPACE.copy()
_GAP[0x21:0x41] = _GAP[0x5B:0x61] = _GAP[0x7B:0x80] = True


def word_ids(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, ids (words x parts), bounds of the texts) by chunk."""
    tables = hasher()
    for c in chunks(pc.utf8_lower(texts.cast(pa.large_string()))):
        c = Chunk(c.first, np.where(_GAP[c.data], np.uint8(32), c.data), c.bounds)
        w = words(c)
        up, down = tables.upto(len(c.data) + 1)
        sums = np.zeros(len(c.data) + 1, _U)
        with np.errstate(over="ignore"):
            np.cumsum(BYTE_VALUES[c.data] * up[: len(c.data)], out=sums[1:])
            parts = []
            for kind, most in enumerate((None, *PREFIXES)):
                end = w.end if most is None else np.minimum(w.end, w.start + most)
                parts.append((splitmix((sums[end] - sums[w.start]) * down[w.start] + _U(kind)) >> _U(48)).astype(np.int32))
        yield c.first, np.stack(parts, axis=1), w.first


@dataclass
class Model:
    """Weights; ``embed``: BUCKETS x dim, ``filters[w]``: w x dim x n, ``bias[w]``: n, ``out``: last layer."""

    embed: np.ndarray
    filters: dict[int, np.ndarray]
    bias: dict[int, np.ndarray]
    out: np.ndarray
    out_bias: float
    constant: float | None = None
    thresholds: dict[str, float] = field(default_factory=dict)

    def folded(self) -> np.ndarray:
        """BUCKETS x (all taps of all filters): what a part of a word adds to each tap."""
        return np.concatenate([self.embed @ self.filters[w][j] for w in WIDTHS for j in range(w)], axis=1).astype(np.float32)

    def margins(self, ids: np.ndarray, bounds: np.ndarray, folded: np.ndarray) -> np.ndarray:
        """The scores' log odds."""
        n = self.out.size // len(WIDTHS)
        pooled = np.zeros((len(bounds) - 1, self.out.size), np.float32)
        for i in range(len(bounds) - 1):  # long texts in runs that overlap by the widest filter
            for a in range(bounds[i], bounds[i + 1], RUN):
                b = min(bounds[i + 1], a + RUN + WIDTHS[-1] - 1)
                own = b - a if b == bounds[i + 1] else RUN  # the overlap's last places lack their later taps here
                taps = folded[ids[a:b, 0]]
                for p in range(1, ids.shape[1]):
                    taps += folded[ids[a:b, p]]
                col = 0
                for k, w in enumerate(WIDTHS):
                    size = b - a
                    z = taps[:, col : col + n].copy()
                    for j in range(1, w):  # past the end there is nothing to add
                        z[: size - j] += taps[j:, col + j * n : col + (j + 1) * n]
                    col += w * n
                    np.maximum(pooled[i, k * n : (k + 1) * n], z[:own].max(axis=0) + self.bias[w], out=pooled[i, k * n : (k + 1) * n])
        return (pooled.astype(np.float64) * self.out).sum(axis=1) + self.out_bias

    def scores(self, ids: np.ndarray, bounds: np.ndarray, folded: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(bounds) - 1, self.constant)
        return 1 / (1 + np.exp(-self.margins(ids, bounds, folded)))

    def dense(self) -> list[np.ndarray]:
        """Every weight but ``embed`` and ``out_bias``."""
        return [*self.filters.values(), *self.bias.values(), self.out]

    def rows(self, moved: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(keys, weights by key): the ``moved`` rows of ``embed`` by their numbers, all other weights from BUCKETS on."""
        dim = self.embed.shape[1]
        rest = np.concatenate([*[p.ravel() for p in self.dense()], [self.out_bias]])
        rest = np.pad(rest, (0, -len(rest) % dim)).reshape(-1, dim)
        return np.concatenate([moved, BUCKETS + np.arange(len(rest))]), np.concatenate([self.embed[moved], rest])

    def take(self, keys: np.ndarray, weights: np.ndarray) -> None:
        """Set the weights that ``rows`` gives."""
        low = keys < BUCKETS
        self.embed[keys[low]] = weights[low]
        rest, at = weights[~low][np.argsort(keys[~low])].ravel(), 0
        for p in self.dense():
            p[...] = rest[at : at + p.size].reshape(p.shape)
            at += p.size
        self.out_bias = float(rest[at])


def blank(rng: np.random.Generator, dim: int = 12, filters: int = 12) -> Model:
    """A model before its first pass."""
    return Model((rng.standard_normal((BUCKETS, dim)) * 0.1).astype(np.float32), {w: (rng.standard_normal((w, dim, filters)) * 0.3 / np.sqrt(w)).astype(np.float32) for w in WIDTHS}, {w: np.zeros(filters, np.float32) for w in WIDTHS}, rng.standard_normal(filters * len(WIDTHS)) * 0.3, 0.0)


def _peaks(model: Model, docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(texts x filters) each filter's highest value in each text, and the word at which it stands; long texts in runs."""
    filters = model.out.size // len(WIDTHS)
    high = np.full((len(docs), model.out.size), -np.inf, np.float32)
    at = np.zeros((len(docs), model.out.size), np.int64)
    taps_of = np.concatenate([model.filters[w][j] for w in WIDTHS for j in range(w)], axis=1)

    def settle(pieces: list[tuple[int, int, np.ndarray]]) -> None:
        ids = np.concatenate([d for *_, d in pieces])
        x = model.embed[ids[:, 0]]
        for p in range(1, ids.shape[1]):
            x += model.embed[ids[:, p]]
        taps, col = x @ taps_of, 0
        sizes = np.array([len(d) for *_, d in pieces])
        start, piece = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(pieces)), sizes)
        for k, w in enumerate(WIDTHS):
            z = taps[:, col : col + filters].copy()
            for j in range(1, w):
                z[:-j] += np.where((piece[j:] == piece[:-j])[:, None], taps[j:, col + j * filters : col + (j + 1) * filters], np.float32(0))
            col += w * filters
            own = slice(k * filters, (k + 1) * filters)
            for (i, a, _), s, n in zip(pieces, start, sizes, strict=True):
                own_words = z[s : s + (n if a + n == len(docs[i]) else RUN)]
                best = own_words.argmax(axis=0)
                value = own_words[best, np.arange(filters)]
                more = value > high[i, own]
                high[i, own] = np.where(more, value, high[i, own])
                at[i, own] = np.where(more, a + best, at[i, own])

    pieces, held = [], 0
    for i, d in enumerate(docs):
        for a in range(0, len(d), RUN):
            part = d[a : a + RUN + WIDTHS[-1] - 1]
            if pieces and held + len(part) > RUN:
                settle(pieces)
                pieces, held = [], 0
            pieces.append((i, a, part))
            held += len(part)
    settle(pieces)
    return high, at


def learn(model: Model, docs: list[np.ndarray], y: np.ndarray, weight: np.ndarray, passes: int, batch: int, rate: float, rng: np.random.Generator) -> np.ndarray:
    """Change ``model`` by ``passes`` passes over texts given as word ids (words x parts); returns the rows of ``embed`` that moved."""
    filters, dim = model.out.size // len(WIDTHS), model.embed.shape[1]
    dense = model.dense()
    state = {id(p): [np.zeros_like(p), np.zeros_like(p)] for p in dense}
    first, second = np.zeros_like(model.embed), np.zeros_like(model.embed)
    bias_state, step, moved = [0.0, 0.0], 0, np.zeros(len(model.embed), bool)
    for _ in range(passes):
        order = rng.permutation(len(docs))
        for s in range(0, len(order), batch):
            pick = order[s : s + batch]
            pick = pick[[len(docs[i]) > 0 for i in pick]]
            if not len(pick):
                continue
            mine = [docs[i] for i in pick]
            high, at = _peaks(model, mine)
            raw = high + np.concatenate([model.bias[w] for w in WIDTHS])
            h = np.maximum(raw, 0)
            drop = (rng.random(h.shape) < 0.8) / 0.8
            p = 1 / (1 + np.exp(-((h * drop) @ model.out + model.out_bias)))
            g = (p - y[pick]) * weight[pick] / len(pick)
            grads = {id(model.out): (h * drop).T @ g}
            gh = np.outer(g, model.out) * drop * (raw > 0)
            ids = np.concatenate(mine)
            sizes = np.array([len(d) for d in mine])
            start = np.cumsum(sizes) - sizes
            rows, vals = [], []
            for k, w in enumerate(WIDTHS):
                own = slice(k * filters, (k + 1) * filters)
                gk = gh[:, own]
                grads[id(model.bias[w])] = gk.sum(axis=0)
                gf = np.zeros_like(model.filters[w])
                for j in range(w):
                    word = at[:, own] + j
                    ok = (word < sizes[:, None]) & (gk != 0)
                    word = np.where(ok, word + start[:, None], 0)
                    d, c = np.nonzero(ok)
                    gf[j] = np.einsum("ncd,nc->dc", model.embed[ids[word]].sum(axis=2), np.where(ok, gk, 0))
                    rows.append(word[d, c])
                    vals.append(model.filters[w][j].T[c] * gk[d, c][:, None])
                grads[id(model.filters[w])] = gf
            step += 1
            fix = rate * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for q in dense:
                m, v = state[id(q)]
                m += 0.1 * (grads[id(q)] - m)
                v += 0.001 * (grads[id(q)] ** 2 - v)
                q -= fix * m / (np.sqrt(v) + 1e-8)
            gb = g.sum()
            bias_state[0] += 0.1 * (gb - bias_state[0])
            bias_state[1] += 0.001 * (gb * gb - bias_state[1])
            model.out_bias -= fix * bias_state[0] / (np.sqrt(bias_state[1]) + 1e-8)
            a, v = np.concatenate(rows), np.concatenate(vals)
            flat = ids[a].reshape(-1)
            by = np.argsort(flat, kind="stable")
            keys, where = np.unique(flat[by], return_index=True)
            ge = np.add.reduceat(np.repeat(v, ids.shape[1], axis=0)[by], where, axis=0) if len(keys) else np.zeros((0, dim))
            first[keys] += 0.1 * (ge - first[keys])
            second[keys] += 0.001 * (ge * ge - second[keys])
            model.embed[keys] -= (fix * first[keys] / (np.sqrt(second[keys]) + 1e-8)).astype(np.float32)
            moved[keys] = True
    return np.flatnonzero(moved)


def _weights(y: np.ndarray, share: float) -> np.ndarray:
    """Toxic and clean rows weigh alike in all."""
    return np.where(y > 0, 0.5 / share, 0.5 / (1 - share))


def fit(docs: list[np.ndarray], toxic: np.ndarray, dim: int = 12, filters: int = 12, epochs: int = 8, steps: int = 200, batch: int = 48, rate: float = 0.01, seed: int = 5) -> Model:
    """Train on one block: ``epochs`` passes, more if they make less than ``steps`` minibatches."""
    rng = np.random.default_rng(seed)
    y = toxic.astype(np.float64)
    model = blank(rng, dim, filters)
    if not len(y) or y.min() == y.max():
        model.constant = float(y.mean()) if len(y) else 0.5
        return model
    learn(model, docs, y, _weights(y, y.mean()), max(epochs, -(-steps * batch // len(docs))), batch, rate, rng)
    return model


def fit_blocks(rows: DataFrame, blocks: int, n: int, share: float, dim: int = 12, filters: int = 12, epochs: int = 8, steps: int = 200, batch: int = 48, rate: float = 0.01, seed: int = 5) -> Model:
    """Train on ``n`` rows (_block, _toxic, _ids), a partition for each of ``blocks``; ``share``: of toxic rows in all."""
    spark = rows.sparkSession
    model = blank(np.random.default_rng(seed), dim, filters)
    passes = max(epochs, -(-steps * batch * blocks // n))
    names = [f"w{i}" for i in range(dim)]
    rounds, each = (1, passes) if blocks == 1 else (passes, 1)
    for turn in range(rounds):
        held = spark.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch], held=held, turn=turn) -> Iterator[pa.RecordBatch]:
            docs, y, block = [], [], 0
            for b in batches:
                block = b.column(0)[0].as_py() if b.num_rows else block
                y += b.column(1).to_pylist()
                docs += [np.frombuffer(x.as_buffer(), np.uint16).reshape(-1, 1 + len(PREFIXES)) for x in b.column(2)]
            if docs:
                mine = copy.deepcopy(held.value)  # the worker's next task starts from it too
                toxic = np.array(y, np.float64)
                moved = learn(mine, docs, toxic, _weights(toxic, share), each, batch, rate, np.random.default_rng([seed, turn, block]))
                keys, weights = mine.rows(moved)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), *[pa.array(np.rint(w * ONE).astype(np.int64)) for w in weights.astype(np.float64).T]], ["key", *names])

        moved = rows.mapInArrow(run, ", ".join(["key int", *[f"{c} long" for c in names]]))
        got = moved.groupBy("key").agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in names]).select("key", *[(F.col(c) / F.col("n") / ONE).alias(c) for c in names]).toArrow()  # one row for each bucket at most
        model.take(got["key"].to_numpy(), np.stack([got[c].to_numpy() for c in names], axis=1))
        held.unpersist()
    return model


def best_cuts(scored: DataFrame) -> DataFrame:
    """(of, n, toxic, cut) from (of, score, toxic): for each ``of`` its rows, and the threshold of highest F1, the highest of equals, halfway to the next score below."""
    every = stored(scored.groupBy("of", "score").agg(F.count("*").alias("n"), F.sum("toxic").alias("toxic")))
    total = stored(every.groupBy("of").agg(F.sum("n").alias("all_n"), F.sum("toxic").alias("all_toxic")))
    ran = running(every, ["of"], [F.desc("score")], sums={"n": F.col("n"), "toxic": F.col("toxic")}).join(broadcast_if_small(total), "of")
    best = stored(ran.groupBy("of", "all_n", "all_toxic").agg(F.max(F.struct((2 * F.col("toxic") / (F.col("n") + F.col("all_toxic"))).alias("f1"), "score"))["score"].alias("top")))
    below = every.join(broadcast_if_small(best), "of").where("score < top").groupBy("of").agg(F.max("score").alias("below"))
    return best.join(below, "of", "left").select("of", F.col("all_n").alias("n"), F.col("all_toxic").alias("toxic"), ((F.col("top") + F.coalesce("below", F.lit(0.0))) / 2).alias("cut"))


def held_out(doc_id: str = "doc_id"):
    """Rows never learned from: crc32 of the id's decimal text is divisible by 5."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def _first(known: DataFrame, docs: DataFrame, text: str, chars: int) -> DataFrame:
    """The rows of ``known`` with ``chars`` characters in all, in the order of their hashes; longer documents are passed over."""
    sizes = docs.select(F.col("doc_id").alias("_id"), F.coalesce(F.length(text), F.lit(0)).alias("n")).join(known, "_id").groupBy("_id").agg(F.sum("n").alias("n")).where(F.col("n") <= chars)
    return known.join(running(sizes, [], [F.xxhash64(F.lit(23), "_id"), "_id"], sums={"n": F.col("n")}).where(F.col("n") <= chars), "_id", "left_semi")


def train(docs: DataFrame, labels: DataFrame, chars: int | None = None, text: str = "text", rows: int = BLOCK_ROWS, **how) -> Model:
    """Fit on every labelled row outside the held-out fold, in blocks of about ``rows`` rows.

    Four fifths of the rows fit the model, and the last fifth moves the score's
    half to the best F1 and calibrates the thresholds by language; if either part
    lacks one kind of label, all rows fit it. A caller who wants less gives
    ``chars``, the characters of all texts to learn from.
    """
    spark = docs.sparkSession
    arrow_rows(spark)
    with tables(spark):
        known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("_id")).agg(F.min("toxic").alias("_toxic"), F.max("toxic").alias("_most"))
        known = known.where("_toxic = _most AND _toxic IN (0, 1)").where(~held_out("_id")).select("_id", F.col("_toxic").cast("int").alias("_toxic"), (F.pmod(F.xxhash64(F.lit(29), "_id"), F.lit(5)) == 0).alias("_back"))
        if chars is not None:
            known = _first(known, docs, text, chars)
        known, seen = measured(known, n=F.count(F.lit(1)))
        known = broadcast_if_small(known, seen["n"])
        sizes = docs.select("doc_id", F.coalesce(F.octet_length(text), F.lit(0)).alias("n")).join(known, F.col("doc_id") == F.col("_id"))
        parts = {r["_back"]: r for r in sizes.groupBy("_back").agg(F.count("*").alias("rows"), F.sum("_toxic").alias("toxic"), F.sum("n").alias("bytes")).collect()}
        both = len(parts) == 2 and all(0 < r.toxic < r["rows"] for r in parts.values())
        used = [parts[False]] if both else list(parts.values())
        n, toxic, size = (sum(r[c] for r in used) for c in ("rows", "toxic", "bytes"))
        if not 0 < toxic < n:
            return fit([], np.full(min(n, 1), toxic / max(n, 1)))
        lang = F.col("lang") if "lang" in docs.columns else F.lit(None)
        chosen = docs.join(known, F.col("doc_id") == F.col("_id")).select("_id", "_toxic", lang.cast("string").alias("_lang"), "_back", F.col(text).alias("_text"))

        def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for at, i, bounds in word_ids(b.column(2)):
                    i = i.astype(np.uint16)
                    ids = [i[a:z].tobytes() for a, z in zip(bounds[:-1], bounds[1:], strict=True)]
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(ids)), b.column(1).slice(at, len(ids)), pa.array(ids, pa.binary())], ["_id", "_toxic", "_ids"])

        blocks = max(1, -(-n // rows), -(-size // BLOCK_BYTES))
        block = F.pmod(F.xxhash64(F.lit(23), "_id"), F.lit(blocks)).cast("int").alias("_block")
        fitted = (chosen.where(~F.col("_back")) if both else chosen).select("_id", "_toxic", "_text").mapInArrow(encode, "_id long, _toxic int, _ids binary")
        # a checkpoint keeps its partitions, so that each pass finds a block in one task without a shuffle
        fitted = durable(fitted.select(block, "_toxic", "_ids", "_id").repartitionById(blocks, F.col("_block")).sortWithinPartitions("_id", "_ids").drop("_id"))
        model = fit_blocks(fitted, blocks, n, toxic / n, **how)
        if both:
            _calibrate(model, chosen.where("_back").select("_lang", "_toxic", "_text"))
    return model


def _calibrate(model: Model, rows: DataFrame) -> None:
    """Move the score's half to the best F1 over all ``rows`` (_lang, _toxic, _text), and set the languages' thresholds."""
    held = rows.sparkSession.sparkContext.broadcast((model, model.folded()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, folded = held.value
        for b in batches:
            s = [model.margins(ids, bounds, folded) for _, ids, bounds in word_ids(b.column(2))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.concatenate(s) if s else np.empty(0))], ["_lang", "_toxic", "_margin"])

    margins = stored(rows.mapInArrow(run, "_lang string, _toxic int, _margin double"))
    scored = lambda of: margins.select(of.alias("of"), (1 / (1 + F.exp(-(F.col("_margin") - shift)))).alias("score"), F.col("_toxic").alias("toxic"))
    shift = 0.0
    cut = best_cuts(scored(F.lit(""))).first()["cut"]
    shift = float(np.log(cut / (1 - cut))) if 0 < cut < 1 else 0.0
    model.out_bias -= shift
    model.thresholds = {r["of"]: r["cut"] for r in best_cuts(scored(F.col("_lang")).where("of <> ''")).collect() if 5 <= r["toxic"] < r["n"]}  # one row for each language


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted (score >= 1/2), threshold (of the row's language) and flagged (score >= threshold)."""
    arrow_rows(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast((model, model.folded()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, folded = held.value
        for b in batches:
            s = [model.scores(ids, bounds, folded) for _, ids, bounds in word_ids(b.column(2))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.concatenate(s) if s else np.empty(0))], ["doc_id", "_tx_lang", "score"])

    lang = (F.col("lang") if "lang" in docs.columns else F.lit(None)).cast("string").alias("_tx_lang")
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), lang, text).mapInArrow(run, "doc_id long, _tx_lang string, score double")
    threshold = F.lit(0.5)
    for k, t in sorted(model.thresholds.items()):
        threshold = F.when(F.col("_tx_lang") == k, F.lit(t)).otherwise(threshold)
    out = out.withColumn("threshold", threshold)
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "threshold", (F.col("score") >= F.col("threshold")).alias("flagged"))


def crc_fold(doc_id: int) -> int:
    """The fold of one id, as in ``held_out``."""
    return zlib.crc32(str(doc_id).encode()) % 5


def auc(s: np.ndarray, y: np.ndarray) -> float:
    """Share of (toxic, clean) pairs in the right order, ties as half."""
    ranks = pd.Series(s).rank().to_numpy()
    n = int(y.sum())
    return float((ranks[y == 1].sum() - n * (n + 1) / 2) / (n * (len(y) - n)))
