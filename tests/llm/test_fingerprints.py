"""Spot signatures against plain Python over words."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from treeloom.llm import fingerprints, queries

ANCHORS = {w for words in fingerprints.ANCHORS.values() for w in words.split()}


def _signatures(text):
    words = [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]
    found, content = set(), [i for i, w in enumerate(words) if w not in ANCHORS]
    for i, j in zip(content, content[1:], strict=False):
        if i and words[i - 1] in ANCHORS:
            found.add(" ".join([words[i - 1], words[i], words[j]]))
    if not found and words:
        found = {" ".join(words)}
    return sorted(hashlib.md5(s.encode()).hexdigest()[:16] for s in found)


def _like(a, b, least=0.05):
    if a == b:
        return 1.0
    a, b = set(a), set(b)
    x = len(a & b) / len(a | b)
    return x if x >= least else 0.0


def _expected(rows):
    """doc -> (n, edited digest, fingerprint, edited fingerprint, likeness of both) for distinct ids."""
    down = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = {}
    for (i, text), (_, after) in zip(down, down[1:] + down[:1], strict=True):
        text, after = text or "", after or ""
        k = len(text) // 3
        edited = text[: len(text) - k] + after[:k]
        own, other, following = _signatures(text), _signatures(edited), _signatures(after)
        out[i] = (len(text), hashlib.sha256(edited.encode()).hexdigest(), "".join(own), "".join(other), _like(own, other), _like(own, following))
    return out


def _got(df):
    cols = ["_sp_n", F.sha2("_sp_edited", 256), F.array_join("_sp_signatures", ""), F.array_join("_sp_edited_signatures", ""), F.round("_sp_near_edited", 12), F.round("_sp_near_next", 12)]
    return sorted(map(tuple, df.select("doc_id", *cols).collect()), key=repr)


ROWS = [
    (5, "The cat sat on the mat and the dog of the house is in a garden"), (3, None), (9, ""), (-4, "of the and"), (12, "no"), (100, "ÜBER den Wolken muß die Freiheit wohl grenzenlos sein, sagt man in der Stadt"),
    (7, "Plain words only here 🙂 emoji 🙂🙂"), (8, "The cat sat on the mat and the dog of the house is in a garden"), (None, "la casa de los espíritus y el amor en los tiempos"), (50, "the cat sat"), (51, "  \n\t — … "), (60, "l'été de la ville, le chat d'or " * 40),
]


@pytest.mark.parametrize("rows", [1, 4, 100])
def test_fingerprints_by_brute_force(spark, make_docs, monkeypatch, rows):
    """Whatever the size of the blocks."""
    monkeypatch.setattr(fingerprints, "BLOCK_ROWS", rows)
    got = _got(fingerprints.compare_with_edits(make_docs(ROWS).repartition(5)))
    want = [(i, n, h, a, b, round(x, 12), round(y, 12)) for i, (n, h, a, b, x, y) in _expected(ROWS).items()]
    assert got == sorted(want, key=repr)


def test_query_by_brute_force(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, pytest.approx(r.near_edited), pytest.approx(r.near_next)) for r in queries.op13_spot_fingerprints(spark, d).collect()}
    assert got == _expected(rows)
    near = [r[4] for r in _expected(rows).values() if r[0] > 300]
    far = [r[5] for r in _expected(rows).values() if r[0] > 300]
    assert sorted(near)[len(near) // 10] > 0.3 and sorted(far)[len(far) // 2] < 0.05


def test_copies_ties_and_small_tables(spark, make_docs, monkeypatch):
    monkeypatch.setattr(fingerprints, "BLOCK_ROWS", 2)
    assert fingerprints.compare_with_edits(make_docs([]).limit(0)).count() == 0
    one = fingerprints.compare_with_edits(make_docs([(1, "the cat sat on the mat")])).first()
    assert one._sp_near_next == 1.0 and one._sp_edited == "the cat sat on the " [:15] + "the cat"
    # an id that holds most rows is spread over blocks, and each row has one successor
    same = [(1, f"the text number {i} of the many") for i in range(300)] + [(1, "the copy of a text")] * 50 + [(0, "the end of it all"), (2, "the start of it all")]
    out = fingerprints.following(make_docs(same).select("doc_id", "text").repartition(3)).collect()
    assert len(out) == len(same)
    assert sorted(r._sp_next.text for r in out) == sorted(t for _, t in same)
    after = {r.text: r._sp_next for r in out if r.doc_id != 1}
    assert after["the end of it all"].doc_id == 2 and after["the start of it all"].doc_id == 1
    assert [r.doc_id for r in out if r._sp_next.doc_id == 0] == [1]
    empty = _got(fingerprints.compare_with_edits(make_docs([(i, None if i % 2 else "") for i in range(40)])))
    assert {r[1:] for r in empty} == {(0, hashlib.sha256(b"").hexdigest(), "", "", 1.0, 1.0)}


def test_own_names_and_carried_columns(spark, make_docs):
    docs = make_docs(ROWS).withColumns({"words": F.lit(1), "spots": F.lit("x"), "edited": F.lit(2)})
    out = fingerprints.compare_with_edits(docs)
    assert set(docs.columns) <= set(out.columns) and out.where("words = 1 AND spots = 'x' AND edited = 2").count() == len(ROWS)
    assert fingerprints.fingerprint(docs).where("_sp_fingerprint IS NULL").isEmpty()
    for f in (fingerprints.fingerprint, fingerprints.compare_with_edits):
        with pytest.raises(ValueError):
            f(docs.withColumn("_SP_words", F.lit(1)))


def test_pruning_settles_pairs_by_size_alone(spark):
    """Two partitions apart no pair can reach the floor, and a pair that reaches it is exact."""
    sets = [[str(i) for i in range(a, a + n)] for a in (0, 3) for n in (0, 1, 2, 5, 9, 30, 200)]
    pairs = spark.createDataFrame([(a, b) for a in sets for b in sets], "a array<string>, b array<string>")
    for floor in (0.05, 0.3, 0.8):
        got = pairs.select("a", "b", fingerprints.likeness(F.col("a"), F.col("b"), floor).alias("x"), F.abs(fingerprints.partition_of(F.col("a"), floor) - fingerprints.partition_of(F.col("b"), floor)).alias("apart"))
        for r in got.collect():
            exact = 1.0 if r.a == r.b else len(set(r.a) & set(r.b)) / len(set(r.a) | set(r.b))
            assert r.x == pytest.approx(exact if exact >= floor else 0.0)
            assert r.apart <= 1 or exact < floor


def test_long_texts(spark, make_docs):
    text = "the long way of a text " * 40_000 + "the end of all"
    out = fingerprints.compare_with_edits(make_docs([(2, text), (1, "the next text of all")])).where("doc_id = 2").first()
    assert out._sp_n == len(text) and len(out._sp_signatures) == len(_signatures(text))
