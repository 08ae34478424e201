"""Cost-balanced packing of tokenised documents into sequences.

Each partition tokenises its documents and packs them in windows of about
``window_tokens`` tokens, without any shuffle, so that neither a hot source nor
a group of copies meets in one task. A window opens as many sequences as it has
tokens to fill and assigns documents, longest first, to the sequence of lowest
cost among those with room; the cost of a piece of n tokens is n + n*n/balance
(the linear and the attention part). Where no sequence has room for the whole
piece, the one of lowest cost is filled and the rest goes on. What exceeds the
full sequences waits for the next window. At a partition's end the last tokens
form sequences of descending powers of two, which need no padding.

Defined results: a null or empty text is its end token alone; documents longer
than a sequence are cut and every token lies in exactly one piece; equal rows
are packed each; null ids are carried; other columns are not read; an empty
table has no pieces. Sequence numbers hold the partition in the upper bits.
"""

from __future__ import annotations

import json
import re
import sys
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeloom.plans.sizing import arrow_rows

#: The tokenizer's white space, where its normaliser puts one space and its splitter cuts.
_SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: What str.split() cuts at beyond that.
_ODD = ("\x1c", "\x1d", "\x1e", "\x1f")
#: Words and letter runs that a worker remembers; the first ones seen, which are the frequent ones.
_WORDS, _RUNS = 150_000, 300_000
#: Letters that every Unicode version knows as such and that no normal form changes, then marks that form one run.
_SIMPLE = re.compile("([A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+)([.,;:!?#*$%&|]*)")


#: The settings that make a tokenizer one of words in lower case, each closed by its last token.
_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


def by_words(settings: dict) -> bool:
    """Whether a tokenizer's settings are those that WordTokenizer takes apart; any other is asked for whole texts."""
    split = (settings.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    return (
        (settings.get("normalizer") or {}).get("normalizers") == _NORMALIZERS and split[0].get("pattern") == {"Regex": _SPLIT} and split[0].get("behavior") == "Removed" and split[0].get("invert") is True
        and [x.get("type") for x in split[1:]] == ["ByteLevel"] and not split[1].get("add_prefix_space") and (settings.get("model") or {}).get("end_of_word_suffix") == "</w>" and not settings.get("post_processor")
    )


class WordTokenizer:
    """Ids of texts, word by word where the tokenizer never joins across white space (``by_words``).

    A text's ids are those of its words in a row, as little-endian 32-bit
    integers. Frequent words are remembered. Of the others, those of letters and
    closing marks fall into two runs, which the tokenizer splits as well; runs
    are remembered and new ones tokenised many at a time. Any other word goes to
    the tokenizer as it is.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.apart = by_words(json.loads(self.tokenizer.to_str()))
        size = self.tokenizer.get_vocab_size()
        self.closes = np.array([(self.tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(size)])
        self.known: dict[str, bytes] = {}
        self.runs: dict[str, bytes] = {}

    @classmethod
    def shared(cls, path: str) -> WordTokenizer:
        """One for each worker process, whatever the number of its tasks."""
        home = sys.modules.setdefault("_treeloom_tokenizers", types.ModuleType("_treeloom_tokenizers")).__dict__
        if path not in home:
            home[path] = cls(path)
        return home[path]

    def words(self, text: str) -> list[str]:
        if any(c in text for c in _ODD):
            return re.findall(f"[^{_SPACES}]+", text)
        return text.split()

    def _whole(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _tokenised(self, runs: list[str]) -> list[bytes]:
        """Ids of runs, by way of one text: each run's last token closes a word."""
        ids = np.array(self.tokenizer.encode(" ".join(runs), add_special_tokens=False).ids, "<u4")
        ends = np.flatnonzero(self.closes[ids]) + 1
        if len(ends) != len(runs):
            return self._whole(runs)
        return [ids[a:b].tobytes() for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def encode(self, text: str) -> bytes:
        if not self.apart:
            return self._whole([text])[0]
        words, known = self.words(text), self.known
        new = self._resolved(set(words).difference(known))
        known.update(new)
        out = b"".join(map(known.__getitem__, words))
        if len(known) > _WORDS:  # full: the newcomers leave again
            for w in new:
                del known[w]
        return out

    def _resolved(self, words: set[str]) -> dict[str, bytes]:
        """Ids of words that are not remembered."""
        runs, out, pairs, rest = self.runs, {}, [], []
        for w in words:
            if m := _SIMPLE.fullmatch(w):
                pairs.append((w, m[1].lower(), m[2]))
            else:
                rest.append(w)
        fresh = list({r for _, a, b in pairs for r in (a, b)}.difference(runs, ("",)))
        if fresh:
            got = dict(zip(fresh, self._tokenised(fresh), strict=True))
            runs.update(got)
        for w, a, b in pairs:
            out[w] = runs[a] + runs[b] if b else runs[a]
        if fresh and len(runs) > _RUNS:
            for r in fresh:
                del runs[r]
        if rest:
            out.update(zip(rest, self._whole(rest), strict=True))
        return out


class Packer:
    """Packs (key, tokens) of one partition; yields pieces (key, start, ids, doc_tokens, sequence, offset)."""

    def __init__(self, capacity: int, balance: float) -> None:
        self.capacity, self.balance = capacity, balance
        self.waiting: list[tuple] = []  # (key, start, ids, doc_tokens)
        self.tokens = self.sequences = 0

    def add(self, key, ids: bytes) -> None:
        n = len(ids) // 4
        self.waiting.append((key, 0, ids, n))
        self.tokens += n

    def cost(self, n: int) -> float:
        return n + n * n / self.balance

    def flush(self, last: bool) -> Iterator[tuple]:
        sizes = [self.capacity] * (self.tokens // self.capacity)
        if last:
            rest = self.tokens % self.capacity
            sizes += [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]
        if not sizes:
            return
        room = np.array(sizes, np.int64)
        total, cost = room.copy(), np.zeros(len(room))
        left = []
        for key, start, ids, n in sorted(self.waiting, key=lambda p: -len(p[2])):
            at, size = 0, len(ids) // 4
            while at < size:
                need = size - at
                fits = np.where(room >= need, cost, np.inf)
                k = int(fits.argmin())
                if fits[k] == np.inf:
                    fits = np.where(room > 0, cost, np.inf)
                    k = int(fits.argmin())
                    if fits[k] == np.inf:
                        left.append((key, start + at, ids[4 * at :], n))
                        break
                take = min(need, int(room[k]))
                yield key, start + at, ids[4 * at : 4 * (at + take)], n, self.sequences + k, int(total[k] - room[k])
                room[k] -= take
                cost[k] += self.cost(take)
                at += take
        self.sequences += len(sizes)
        self.waiting, self.tokens = left, sum(len(p[2]) // 4 for p in left)


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 1, window_tokens: int = 1 << 19, balance: float = 1024.0, text: str = "text") -> DataFrame:
    """(doc_id, start, length, token_ids, doc_tokens, sequence_id, offset); token_ids: little-endian unsigned 32-bit."""
    arrow_rows(docs.sparkSession)
    names = ["doc_id", "start", "length", "token_ids", "doc_tokens", "sequence_id", "offset"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 40
        encode = WordTokenizer.shared(tokenizer_path).encode
        end = np.array([end_id], "<u4").tobytes()
        packer = Packer(capacity, balance)

        def out(last: bool) -> Iterator[pa.RecordBatch]:
            rows = [(k, s, len(i) // 4, i, n, base + q, o) for k, s, i, n, q, o in packer.flush(last)]
            for a in range(0, len(rows), 1024):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[a : a + 1024], strict=True), types, strict=True)], names)

        for b in batches:
            for key, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                packer.add(key, encode(t or "") + end)
                if packer.tokens >= window_tokens:
                    yield from out(False)
        yield from out(True)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text).mapInArrow(run, "doc_id long, start long, length long, token_ids binary, doc_tokens long, sequence_id long, offset long")
