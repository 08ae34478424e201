"""The registered queries on the smallest tables, and the pipeline against brute force."""

import glob
import html
import os
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest

from test_llm_operators import _fewest, components, plain_statistics
from pyspark.sql import functions as F

from treeloom.llm import html_extract, quality_rules, queries, stages, toxicity

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    df = queries.queries()[name](spark, SF)
    cur = con.execute(queries.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    at = [names.index(c) for c in df.columns]
    key = lambda r: tuple(repr(x) for x in r)
    assert sorted(map(key, df.collect())) == sorted(key([r[i] for i in at]) for r in cur.fetchall())


def _documents(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def test_near_dedup_query(spark):
    want = components([(i, r.text) for i, r in _documents(spark).items()], 2)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op3_near_dedup(spark, SF).collect()} == want


def _fold(t):
    return re.sub(r"[\x00-\x2f:-@\[-`{-\x7f]+", " ", t.lower())


def _leaks(spark, texts):
    """{(document, item): fewest edits} of windows within their budget, each compared with the whole document."""
    out = {}
    folded = {i: _fold(t).encode() for i, t in texts.items()}
    grams = {i: {t[j : j + 12] for j in range(len(t) - 11)} for i, t in folded.items()}
    for item in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        b = _fold(item.text).strip().encode()
        assert len(b) >= 40
        w = min(96, len(b))
        spare = min(int(0.055 * w), (w - 12) // 12)
        for a in {*range(0, len(b) - w + 1, 48), len(b) - w}:
            part = b[a : a + w]
            own = {part[j : j + 12] for j in range(w - 11)}
            for i, t in folded.items():
                if own & grams[i]:  # a part within the budget shares one at least
                    edits = _fewest(part, t)
                    if edits <= spare:
                        out[i, item.item_id] = min(edits, out.get((i, item.item_id), edits))
    return out


def test_decontamination_query(spark):
    want = _leaks(spark, {i: r.text for i, r in _documents(spark).items()})
    got = {(r.doc_id, r.item_id): r.edits for r in queries.op4_decontaminate(spark, SF).collect()}
    assert want and got == want


def test_sharding_query(spark):
    docs, rows = _documents(spark), queries.op7_sharding(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    for r in rows:
        data = (docs[r.doc_id].text or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(data) + 1, zlib.crc32(data), "rows", None)
    counts = Counter(r.shard for r in rows)
    assert set(counts) == set(range(16)) and max(counts.values()) - min(counts.values()) <= 1
    for s in range(16):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(counts[s]))
    order = {r.doc_id: k for k, r in enumerate(sorted(rows, key=lambda r: (r.shard, r.slot)))}
    for source, n in Counter(d.source for d in docs.values()).items():  # the k-th of a source stands at its share of the whole order
        at = sorted(order[i] for i, d in docs.items() if d.source == source)
        assert all(abs(x - (k + 0.5) * len(docs) / n) <= 21 for k, x in enumerate(at))


def test_toxicity_query(spark):
    docs, labels = _documents(spark), {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = {r.doc_id: r for r in queries.op9_toxicity(spark, SF).collect()}
    assert sorted(rows) == sorted(docs)
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.5) for i, r in rows.items())
    known = [i for i in labels if i in rows]
    s, y = np.array([rows[i].score for i in known]), np.array([labels[i] for i in known])
    assert 0 < y.sum() < len(y) and toxicity.auc(s, y) > 0.9


_BLOCK = "p|h[1-6]|ul|ol|li|div|article|section|blockquote|table|tr|td|th|pre|hr|dl|dt|dd"


def _article(page):
    """The article's blocks by pattern, for pages that have one and no clutter in it."""
    inside = re.search(r"<article[^>]*>(.*?)(</article>|<footer|$)", page, re.S)[1]
    inside = re.sub(r"<!--.*?-->", "", inside, flags=re.S)
    blocks = re.split(rf"</?(?:{_BLOCK})\b[^>]*>", inside)
    texts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"<br\b[^>]*>", " ", x))).split()) for x in blocks]
    return "\n".join(x for x in texts if x)


def test_extraction_query(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = {r.page_id: r for r in queries.op10_html_extract(spark, SF).collect()}
    assert sorted(rows) == sorted(pages)
    for i, r in rows.items():
        assert (r.url, r.n_chars) == (pages[i].url, len(r.text))
        assert r.text == _article(pages[i].html)


def test_extraction_query_depends_on_its_method(spark, monkeypatch):
    """On the given pages: every line instead of the clusters' region changes all results, a constant ratio most."""
    pages = [r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    want = [html_extract.main_text(x) for x in pages]
    changed = lambda: sum(html_extract.main_text(x) != w for x, w in zip(pages, want, strict=True))
    with monkeypatch.context() as m:
        m.setattr(html_extract, "select", lambda lines: lines)
        assert changed() == len(pages)
    with monkeypatch.context() as m:
        m.setattr(html_extract, "smoothed", lambda ratios, sigma: np.ones(len(ratios)))
        assert changed() > len(pages) / 2


def test_statistics_query(spark):
    docs = _documents(spark)
    for r in queries.op8_quality_rules(spark, SF).collect():
        want = plain_statistics(docs[r.doc_id].text)
        assert [r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words] == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.base_failed and r.kept)


def test_held_out_rows_of_a_larger_table(spark):
    """The list is not judged by rows that it learned from."""
    folder = SF.replace("0.001", "0.01")
    labels = {r.doc_id: r for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    rules = quality_rules.train(docs, spark.read.parquet(f"{folder}/labels.parquet").where(~toxicity.held_out()))
    rows = [r for r in quality_rules.judge(docs.where(toxicity.held_out()), rules).collect() if r.doc_id in labels and not r._qr_base_failed]
    good = [r for r in rows if labels[r.doc_id].quality == 1]
    bad = [r for r in rows if labels[r.doc_id].quality == 0]
    assert good and bad
    assert sum(r._qr_kept for r in good) >= 0.95 * len(good) and sum(r._qr_kept for r in bad) <= 0.2 * len(bad)


def test_pipeline_against_brute_force(spark):
    docs = _documents(spark)
    source = spark.read.parquet(f"{SF}/documents.parquet")
    # stage 1, with the learned list applied by hand
    rules = quality_rules.train(source, spark.read.parquet(f"{SF}/labels.parquet"))
    kept = {r.doc_id for r in quality_rules.judge(source, rules).where("_qr_kept").collect()}
    base = {i: plain_statistics(r.text) for i, r in docs.items()}
    assert not any(base[i][0] < 50 or 100 * base[i][4] > 50 * base[i][0] for i in kept)
    # stage 2
    texts = {i: docs[i].text for i in kept}
    pages = Counter(docs[i].source for i in texts)
    count = Counter((docs[i].source, x) for i, t in texts.items() for x in {y.strip(" \t\r\v\f") for y in t.split("\n")} if x)
    gone = {k for k, n in count.items() if n >= 2 and n > 0.05 * pages[k[0]]}
    texts = {i: "\n".join(x for x in t.split("\n") if (docs[i].source, x.strip(" \t\r\v\f")) not in gone) for i, t in texts.items()}
    # stage 3
    found = components(list(texts.items()), 5)
    texts = {i: t for i, t in texts.items() if found[i][1] == i}
    # stage 4
    leaked = {d for d, _ in _leaks(spark, texts)}
    texts = {i: t for i, t in texts.items() if i not in leaked}
    # stage 5
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {i: len(tok.encode(t, add_special_tokens=False).ids) + 1 for i, t in texts.items()}
    rows = stages.run(spark, SF).collect()
    got = defaultdict(int)
    for r in rows:
        got[r.doc_id] += r.length
    assert dict(got) == want
    assert [n for n, _ in stages.STAGES] == ["quality", "lines", "near_duplicates", "decontaminated", "packed"]
    ends = defaultdict(int)
    for r in rows:
        ends[r.sequence_id] = max(ends[r.sequence_id], r.offset + r.length)
    assert np.sum(list(ends.values())) == sum(want.values())


ODD = [(None, "a null id"), (7, "twice the same row"), (7, "twice the same row"), (7, "another text"), (8, None), (9, ""), (10, " \n\t"), (11, "w " * 200_000), (12, "x" * 1_000_000)]


@pytest.mark.parametrize("name, stage", stages.STAGES)
def test_stages_on_odd_tables(spark, make_docs, name, stage):
    long = " ".join(f"word{i % 997} runs{i % 89}" for i in range(40_000))
    docs = make_docs([*ODD, (13, long)]).withColumns({"kept": F.lit("MINE"), "n_words": F.lit(1), "component_id": F.lit(2), "start": F.lit(3), "_qr_kept": F.lit(4)})
    rows = stage(spark, docs, SF).collect()
    ids = Counter(r.doc_id for r in rows)
    if name == "packed":
        assert set(ids) == {i for i, _ in ODD} | {13}
        assert sum(r.length for r in rows if r.doc_id in (8, 9, 10)) == 3
    else:
        assert {tuple(r.asDict()) for r in rows} == {("doc_id", "text", "lang", "source", "n_chars")}
        want = {"quality": {13: 1}, "lines": {None: 1, 7: 3, 8: 1, 9: 1, 10: 1, 11: 1, 12: 1, 13: 1}}
        want |= {"near_duplicates": want["lines"], "decontaminated": want["lines"]}
        assert ids == want[name]
    assert stage(spark, docs.limit(0), SF).count() == 0
