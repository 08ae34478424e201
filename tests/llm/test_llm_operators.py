import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from treeloom.llm import decontaminate, html_extract, license_scan, line_dedup, near_dedup, packing, quality_rules, sharding, toxicity, url_filter
from treeloom.operators import ranking

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
VOCAB = [f"w{i}" for i in range(4000)]


def prose(rng, n):
    return " ".join(rng.choices(VOCAB, k=n))


def edited(rng, text, n):
    w = text.split()
    for i in rng.sample(range(len(w)), n):
        w[i] = rng.choice(VOCAB)
    return " ".join(w)


# -- op1 -----------------------------------------------------------------------------

RULES = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}
URLS = [
    "http://A.Example.com/en/712?x=1", "https://example.com/en/8", "https://notexample.com/en/7", "http://x.example.net/de/81#top", "http://example.net/de/9", "//no.scheme.com/en/", "", None,
    "http://com/en/", "http://org", "http://a.b.org/es/", "ftp://user@EXAMPLE.COM/en/7", "http://example.com?q=/en/7", "http://listed.io/a/?utm_source=f", "https://LISTED.io/a", "http://other.io/a", "x://y://z.com/en/",
]


def judged(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    host, path = rest[:cut].lower(), rest[cut:].split("?")[0].split("#")[0]
    best = None
    for k in RULES:
        rh, rp = k.split("/", 1)
        if (host == rh or host.endswith("." + rh)) and path.startswith("/" + rp) and (best is None or len(k) > len(best)):
            best = k
    return host, path, best


@pytest.mark.parametrize("shapes", [4096, 0])
def test_url_filter(spark, shapes, monkeypatch):
    monkeypatch.setattr(url_filter, "SHAPES", shapes)
    pages = spark.createDataFrame([(i, u, "extra") for i, u in enumerate(URLS * 2)], "page_id long, url string, rule string")
    rules = spark.createDataFrame([(k.split("/", 1)[0], "/" + k.split("/", 1)[1], v) for k, v in RULES.items()], "host string, path string, verdict string")
    listed = spark.createDataFrame([("http://listed.io/a",), ("http://listed.io/a",), (None,)], "url string")
    got = url_filter.filter_urls(pages, rules, listed).collect()
    assert len(got) == len(URLS) * 2
    for r in got:
        host, path, rule = judged(r.url)
        assert (r._uf_host, r._uf_path, r._uf_rule) == (host, path, rule)
        assert r._uf_verdict == (RULES[rule] if rule else "block" if host == "listed.io" else "allow")
        assert r.rule == "extra"
    long = spark.createDataFrame([(1, "http://example.com/en/7" + "x" * 3000)], "page_id long, url string")
    assert [r._uf_rule for r in url_filter.filter_urls(long, rules, listed).collect()] == ["example.com/en/7"]
    none = url_filter.filter_urls(pages, rules.limit(0), listed.limit(0))
    assert {r._uf_verdict for r in none.collect()} == {"allow"}
    assert url_filter.filter_urls(pages.limit(0), rules, listed).count() == 0


# -- op2 -----------------------------------------------------------------------------


def test_license_scan(spark, make_docs):
    mit = license_scan.TEXTS["MIT"][0]
    rows = [(1, "Copyright (c) 2020 Someone\n" + mit), (2, mit.upper().replace(",", " ,")), (3, "prose\nReleased under the MIT Licence!\nmore"), (4, None), (5, ""), (6, "the license of nothing"), (7, mit + " more")]
    got = {r.doc_id: r for r in license_scan.scan_licenses(make_docs(rows), license_scan.known_licenses(spark)).collect()}
    assert [got[i]._ls_license for i in range(1, 8)] == ["MIT", "MIT", None, None, None, None, None]
    assert (got[3]._ls_notice, got[3]._ls_notices) == ("MIT", 1)
    assert got[4]._ls_digest is None and got[5]._ls_digest is not None
    assert got[6]._ls_notices == 0
    assert license_scan.scan_licenses(make_docs(rows).limit(0), license_scan.known_licenses(spark)).count() == 0


@pytest.mark.parametrize("short", [True, False])
def test_license_lines_without_the_word(spark, make_docs, monkeypatch, short):
    monkeypatch.setattr(license_scan, "LIST_ROWS", 5_000 if short else 0)
    isc = license_scan.TEXTS["ISC"][0]
    known = license_scan.known_licenses(spark).union(spark.createDataFrame([("PD", "This work is in the public domain.")], "license_id string, text string"))
    rows = [(1, "prose\n" + isc + "\nmore"), (2, "a\nthis work is in the PUBLIC domain\n\n" + isc), (2, "a\nthis work is in the PUBLIC domain\n\n" + isc), (3, "prose\n \nmore"), (4, None)]
    got = sorted((r.doc_id, r._ls_notice, r._ls_notices) for r in license_scan.scan_licenses(make_docs(rows), known).collect())
    assert got == [(1, "ISC", 1), (2, "ISC", 2), (2, "ISC", 2), (3, None, 0), (4, None, 0)]


def test_whole_licenses(spark, make_docs):
    mit, isc, bsd = license_scan.TEXTS["MIT"][0], license_scan.TEXTS["ISC"][0], license_scan.TEXTS["BSD-3-Clause"][0]
    rows = [(1, "MIT License\n\nCopyright (c) 2020 Someone\n\n" + mit), (2, "ISC License\n\n" + isc), (3, "BSD 3-Clause License\n\nCopyright (c) 2020, A\nAll rights reserved.\n\n" + bsd)]
    whole = ["Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC0-1.0", "BSD-2-Clause"]
    rows += [(4 + i, license_scan.TEXTS[k][0].upper()) for i, k in enumerate(whole)]
    got = {r.doc_id: r._ls_license for r in license_scan.scan_licenses(make_docs(rows), license_scan.known_licenses(spark)).collect()}
    assert [got[i] for i in sorted(got)] == ["MIT", "ISC", "BSD-3-Clause", *whole]


def test_license_texts_of_other_scripts(spark, make_docs):
    mit = license_scan.TEXTS["MIT"][0]
    russian, chinese = "Это обычная статья о погоде и о реках. ", "这是一篇关于天气和河流的文章。"
    rows = [(1, russian), (2, chinese), (3, "Released under the MIT License.\n" + russian), (4, "Released under the MIT License. " + chinese), (5, "MIT License\n\nCopyright (c) 2021 X\n\n" + mit)]
    rows += [(6, russian * 20_000 + "\nReleased under the MIT License.\n"), (6, russian * 20_000 + "\nReleased under the MIT License.\n"), (7, "!?")]
    docs = make_docs(rows).withColumns({"license_id": F.lit("mine"), "digest": F.lit(1)})
    out = license_scan.scan_licenses(docs, license_scan.known_licenses(spark))
    got = {r.doc_id: r for r in out.collect()}
    assert [got[i]._ls_license for i in range(1, 8)] == [None, None, None, None, "MIT", None, None]
    assert [got[i]._ls_notice for i in range(1, 7)] == [None, None, "MIT", None, "MIT", "MIT"]
    assert len({got[i]._ls_digest for i in (1, 2, 7)}) == 3 and got[1].license_id == "mine"
    assert out.count() == len(rows)


# -- op3 -----------------------------------------------------------------------------


def components(rows, k, percent=80):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets.setdefault(i, set(zip(*(w[j:] for j in range(k)), strict=False)) if len(w) >= k else {tuple(w)} if w else set())
    top = {i: i for i in sets}
    ids = sorted(sets)

    def find(v):
        while top[v] != v:
            v = top[v]
        return v

    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                top[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_near_duplicates_with_a_low_estimate(make_docs):
    w = "w814834 w849322 w614630 w98507 w185580 w44064 w336777 w961897 w994677 w2289 w844306".split()
    rows = [(1, " ".join(w[:10])), (2, " ".join(w[:9] + w[10:]))]  # 8 of 10 two-word shingles; their sketches say 0.687
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(make_docs(rows), k=2, percent=80).collect()}
    assert got == components(rows, 2) == {1: (9, 1), 2: (9, 1)}


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates_match_brute_force(make_docs, k):
    rng = random.Random(k)
    rows, i = [], 0
    for size in (6, 12, 40, 150, 600):
        base = prose(rng, size)
        for _ in range(14):
            rows.append((i, edited(rng, base, rng.randint(0, max(1, size // 14)))))
            i += 1
    for size in (1, 2, 3, 5, 8):  # short ones, and exact copies
        t = prose(rng, size)
        rows += [(i, t), (i + 1, t.upper()), (i + 2, t + "  "), (i + 3, prose(rng, size))]
        i += 4
    rows += [(i, None), (i + 1, ""), (i + 2, " \n\t"), (i + 3, prose(rng, 30_000))]
    want = components(rows, k)
    got = near_dedup.near_duplicates(make_docs(rows), k=k).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_duplicates_of_odd_tables(make_docs):
    rows = [(None, "a b c d"), (7, "a b c d"), (7, "a b c d"), (9, "A b  c d"), (3, "\xa0 x")]
    got = near_dedup.near_duplicates(make_docs(rows).withColumn("label", F.lit("x")), k=2).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in got) == [(0, 0, True), (3, 3, True), (7, 7, True), (7, 7, True), (9, 7, False)]
    assert near_dedup.near_duplicates(make_docs(rows).limit(0)).count() == 0


def test_sketch_estimates():
    rng = np.random.default_rng(0)
    probes = near_dedup._probes()
    for n in (5, 80, 3000):
        base = np.unique(rng.integers(0, 1 << 63, 2 * n, dtype=np.uint64))
        a, b = base[: int(1.8 * n)], base[int(0.2 * n) :]
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        s = near_dedup.sketches([np.sort(a), np.sort(b)], probes)
        assert (s != near_dedup.EMPTY).all()
        assert abs(near_dedup.estimate(s[:1], s[1:], np.array([len(a)]), np.array([len(b)]))[0] - true) < 0.13


# -- op4 -----------------------------------------------------------------------------


def test_decontamination(spark, make_docs):
    rng = random.Random(4)
    items = [(i, prose(rng, 50)) for i in range(6)] + [(6, "too short"), (7, None), (None, prose(rng, 50))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    typo = list(items[2][1])
    for p in range(40, len(typo), 80):
        typo[p] = "#"
    rows = [
        (0, prose(rng, 300)), (1, prose(rng, 50) + " " + items[1][1] + " " + prose(rng, 50)), (2, "x\n" + "".join(typo).upper().replace("#", "q") + "\ny"), (3, prose(rng, 5000) + items[3][1]), (4, None), (5, ""),
        (6, items[4][1][:40]), (7, items[5][1].replace(" ", " ,\n ")), (8, "too short"), (9, items[8][1]), (1, items[1][1]),
    ]
    docs = make_docs(rows)
    got = decontaminate.find_leaks(docs, bench).collect()
    order = lambda rows: sorted(((r.doc_id, -1 if r.item_id is None else r.item_id) for r in rows))
    assert order(got) == [(1, 1), (1, 1), (2, 2), (3, 3), (7, 5), (8, 6), (9, -1)]
    parts = decontaminate.find_leaks(docs, bench, part_chars=300).collect()
    assert order(parts) == order(got)
    r = next(r for r in got if r.doc_id == 3)
    assert rows[3][1].encode()[r.span_start : r.span_end].decode() == items[3][1]
    kept = decontaminate.drop_leaks(docs.withColumn("edits", F.lit(1)), bench)
    assert sorted(r.doc_id for r in kept.collect()) == [0, 4, 5, 6]
    assert kept.columns == [*docs.columns, "edits"]
    assert decontaminate.find_leaks(docs.limit(0), bench).count() == decontaminate.find_leaks(docs, bench.limit(0)).count() == 0


def test_short_items_are_whole_words(spark, make_docs):
    bench = spark.createDataFrame([(1, "To be, or"), (2, "to be or"), (3, "x"), (4, " ")], "item_id long, text string")
    rows = [(1, "well, to be; OR not"), (2, "to be orange"), (3, "into be or"), (4, "to be or"), (5, "x"), (6, "xx x-ray"), (7, "to be"), (8, "or to be")]
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(make_docs(rows), bench).collect()}
    assert got == {(1, 1), (1, 2), (4, 1), (4, 2), (5, 3), (6, 3)}


def _changed(rng, text, n):
    for _ in range(n):
        p = rng.randrange(len(text))
        text = rng.choice([text[:p] + "q" + text[p + 1 :], text[:p] + text[p + 1 :], text[:p] + "q" + text[p:]])
    return text


def _fewest(pattern, text):
    """Edits of ``pattern`` against any part of ``text``, in bytes, over the whole rectangle."""
    pattern, text = (x.encode() if isinstance(x, str) else x for x in (pattern, text))
    t = np.frombuffer(text, np.uint8)
    j = np.arange(len(t) + 1)
    row = np.zeros(len(t) + 1, np.int64)
    for i, c in enumerate(pattern, 1):
        new = row + 1
        new[1:] = np.minimum(new[1:], row[:-1] + (t != c))
        new[0] = i
        row = np.minimum.accumulate(new - j) + j
    return int(row.min())


def test_leaks_with_edits_against_brute_force(spark, make_docs):
    rng = random.Random(14)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    items = [text(n) for n in (9, 18, 30, 45)]
    items.append(items[3][100:260] + " " + text(10))  # shares windows with another
    rows = []
    for item in items:
        for n in range(10):
            at = rng.randrange(max(1, len(item) - 96))
            rows.append((len(rows), text(rng.randint(0, 12)) + " " + _changed(rng, item[at : at + rng.randint(60, 220)], n) + " " + text(rng.randint(0, 12))))
    half = items[2]
    rows += [(len(rows), text(5) + " " + half[:48]), (len(rows) + 1, half[48:96] + " " + text(5))]  # no match spans two texts
    want = {}
    for i, t in rows:
        for k, item in enumerate(items):
            w = min(96, len(item))
            edits = [_fewest(item[a : a + w], t) for a in {*range(0, len(item) - w + 1, 48), len(item) - w}]
            if min(edits) <= min(int(0.055 * w), (w - 12) // 12):
                want[i, k] = min(edits)
    assert {0, 1, 2, 3, 4, 5} <= set(want.values())
    got = decontaminate.find_leaks(make_docs(rows).coalesce(1), spark.createDataFrame(list(enumerate(items)), "item_id long, text string"))
    assert {(r.doc_id, r.item_id): r.edits for r in got.collect()} == want


def test_alignment_against_plain_edit_distance():
    rng = random.Random(1)
    for _ in range(40):
        p = "".join(rng.choices("ab", k=rng.randint(1, 8)))
        t = "".join(rng.choices("ab", k=rng.randint(1, 12)))
        best = min(_distance(p, t[i:j]) for i in range(len(t) + 1) for j in range(i, len(t) + 1))
        width = len(p) + len(t) + 1  # a band of all diagonals
        edits, start, end = decontaminate.align_bands(np.frombuffer(p.encode(), np.uint8)[None], np.frombuffer(t.encode(), np.uint8), np.array([-len(p)]), width)
        assert edits[0] == best == _distance(p, t[max(0, start[0]) : max(0, end[0])])


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


# -- op5 -----------------------------------------------------------------------------


def test_line_dedup(make_docs):
    rows = [(i, f"Menu \nown line {i}\n\n footer", "en", "a") for i in range(10)]
    rows += [(i, "Menu\nunique" if i < 102 else f"page {i}", "en", "b") for i in range(100, 150)]  # 2 of 50 pages
    rows += [(i, "Menu\nunique" if i < 203 else f"page {i}", "en", "d") for i in range(200, 250)]  # 3 of 50 pages
    rows += [(i, "copied page\nMenu" if i < 60 else f"page {i}", "en", "c") for i in range(40, 61)]  # 20 of 21 pages, copies all
    rows += [(70, None, "en", "a"), (71, "", "en", None), (72, "Menu", "en", "a"), (72, "Menu", "en", "a"), (73, "Menu\n" + "x" * 3_000_000 + "\nend", "en", "a")]
    docs = make_docs(rows).withColumns({"line": F.lit(1), "_key": F.lit(2)})
    got = line_dedup.dedup_lines(docs).collect()
    text = {r.doc_id: r.text for r in got}
    assert len(got) == len(rows)
    assert text[0] == "own line 0\n" and text[72] == "" and text[70] is None and text[71] == ""
    assert text[100] == "Menu\nunique" and text[200] == "" and text[40] == "" and text[60] == "page 60"
    assert text[73] == "x" * 3_000_000 + "\nend"
    assert {(r._ld_lines, r._ld_dropped) for r in got if r.doc_id < 10} == {(4, 2)}
    assert line_dedup.dedup_lines(make_docs(rows).limit(0)).count() == 0


def test_line_dedup_against_brute_force_on_small_sites(make_docs):
    rng = random.Random(5)
    rows, i = [], 0
    for n in (1, 2, 3, 5, 10, 20, 50, 100):
        for _ in range(n):
            rows.append((i, "\n".join(rng.choice([f"l{rng.randrange(12)}", f"own {i} {j}"]) for j in range(4)), "en", f"http://H{n}.example/p"))
            i += 1
    pages, count = {}, {}
    for _, t, _, s in rows:
        pages[s] = pages.get(s, 0) + 1
        for x in set(t.split("\n")):
            count[s, x] = count.get((s, x), 0) + 1
    want = {d: "\n".join(x for x in t.split("\n") if not (count[s, x] >= 2 and count[s, x] > 0.05 * pages[s])) for d, t, _, s in rows}
    got = line_dedup.dedup_lines(make_docs(rows), site=url_filter.host_of(F.col("source")))
    assert {r.doc_id: r.text for r in got.collect()} == want


# -- op6 -----------------------------------------------------------------------------


def test_packing(make_docs):
    from tokenizers import Tokenizer

    rng = random.Random(6)
    rows = [(i, prose(rng, rng.choice([0, 1, 20, 300, 2500]))) for i in range(60)] + [(100, None), (101, "a <|endoftext|> b\x1cc\xa0d é É İ"), (None, "same"), (100, "twice")]
    got = packing.pack(make_docs(rows).repartition(3), TOKENIZER, window_tokens=20_000).collect()
    tok = Tokenizer.from_file(TOKENIZER)
    want = sorted((i or -1, tuple(tok.encode(t or "", add_special_tokens=False).ids + [1])) for i, t in rows)
    docs = {}
    for r in got:
        docs.setdefault((r.doc_id or -1, r.doc_tokens), []).append(r)
    back = sorted((k[0], tuple(np.frombuffer(b"".join(r.token_ids for r in sorted(v, key=lambda r: r.start)), "<u4").tolist())) for k, v in docs.items())
    assert back == want
    seqs = {}
    for r in got:
        assert r.length == len(r.token_ids) // 4 > 0
        seqs.setdefault(r.sequence_id, []).append(r)
    for v in seqs.values():
        v.sort(key=lambda r: r.offset)
        assert [r.offset for r in v] == list(np.cumsum([0, *[r.length for r in v]])[:-1])
        n = sum(r.length for r in v)
        assert n <= 2048 and n & (n - 1) == 0  # full, or a power of two at a partition's end
    assert packing.pack(make_docs(rows).limit(0), TOKENIZER).count() == 0


def test_packing_of_long_texts_and_other_tokenizers(make_docs, tmp_path):
    import json

    from tokenizers import Tokenizer

    rng = random.Random(66)
    rows = [(1, prose(rng, 60_000)), (2, "Two Words"), (3, prose(rng, 9))]
    settings = json.loads(Tokenizer.from_file(TOKENIZER).to_str())
    settings["normalizer"] = {"type": "NFC"}  # case counts
    other = tmp_path / "cased.json"
    other.write_text(json.dumps(settings))
    for path in (TOKENIZER, str(other)):
        tok = Tokenizer.from_file(path)
        assert packing.by_words(json.loads(tok.to_str())) == (path == TOKENIZER)
        got = packing.pack(make_docs(rows).withColumns({"start": F.lit(1), "token_ids": F.lit("x")}).coalesce(1), path, window_tokens=10_000).collect()
        for i, t in rows:
            mine = sorted((r for r in got if r.doc_id == i), key=lambda r: r.start)
            assert np.frombuffer(b"".join(r.token_ids for r in mine), "<u4").tolist() == [*tok.encode(t, add_special_tokens=False).ids, 1]
            assert [r.start for r in mine] == list(np.cumsum([0, *[r.length for r in mine]])[:-1])


def test_packing_balances_cost():
    p = packing.Packer(2048, 1024.0)
    rng = random.Random(0)
    for i in range(800):
        p.add(i, b"\0" * 4 * rng.choice([30, 100, 400, 1500]))
    cost = {}
    for _, _, ids, _, s, _ in p.flush(False):
        cost[s] = cost.get(s, 0) + p.cost(len(ids) // 4)
    assert max(cost.values()) < 1.5 * np.median(list(cost.values()))


# -- op7 -----------------------------------------------------------------------------


def test_sharding(make_docs, tmp_path, spark):
    rows = [(i, "t", "en", "big" if i % 3 else ("small" if i % 2 else None)) for i in range(1000)] + [(5, "t", "en", "big"), (None, None, "en", "big")]
    got = sharding.assign_shards(make_docs(rows), shards=16).collect()
    sizes = [0] * 16
    for r in got:
        sizes[r._sh_shard] += 1
    assert max(sizes) - min(sizes) <= 1 and sum(sizes) == len(rows)
    for s in range(16):
        assert sorted(r._sh_slot for r in got if r._sh_shard == s) == list(range(sizes[s]))
        n = sum(r.source == "big" for r in got if r._sh_shard == s)
        assert abs(n - sizes[s] * 668 / 1002) <= 3
    few = sharding.assign_shards(make_docs(rows[:3])).collect()
    assert len({r._sh_shard for r in few}) == 3
    assert sharding.assign_shards(make_docs(rows).limit(0)).count() == 0
    sharding.write_shards(sharding.assign_shards(make_docs(rows[:64]), shards=4), str(tmp_path / "s"), parts=2)
    assert {r.shard: r["count"] for r in spark.read.parquet(str(tmp_path / "s")).groupBy("shard").count().collect()} == dict.fromkeys(range(4), 16)


def test_sharding_of_a_key_that_fills_a_bucket(make_docs, monkeypatch):
    monkeypatch.setattr(sharding, "HOT_ROWS", 64)
    monkeypatch.setattr(sharding, "BUCKET_ROWS", 1)
    rows = [(None, None if i % 2 else "", "en", "big") for i in range(700)] + [(7, "same", "en", "big")] * 300 + [(i, "t", "en", "small") for i in range(1000)]
    got = sharding.assign_shards(make_docs(rows).withColumns({"shard": F.lit("x"), "hash": F.lit(1)}), shards=16).collect()
    assert sorted(r._sh_rank for r in got) == list(range(2000)) and got[0].shard == "x"
    for s in range(16):
        mine = [r for r in got if r._sh_shard == s]
        assert len(mine) == 125 and sorted(r._sh_slot for r in mine) == list(range(125))
        assert abs(sum(r.source == "big" for r in mine) - 62.5) <= 2


# -- op8 -----------------------------------------------------------------------------


def plain_statistics(text):
    w = text.encode().split()
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    hit = {i + j for i, x in enumerate(windows) if windows.count(x) > 1 for j in range(3)}
    seen, dup = set(), 0
    for line in text.encode().split(b"\n"):
        if line.split():
            dup += line in seen
            seen.add(line)
    return [len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in text), dup, len(hit)]


def test_statistics_match_a_plain_count():
    rng = random.Random(8)
    texts = ["".join(rng.choices("ab é\n\t #|\xa0ß", k=rng.randint(0, 60))) for _ in range(300)] + ["", "a b a b a b", "x\nx\n\n\nx", "one", "日本 語 " * 5]
    got = quality_rules.text_statistics(pa.array([*texts, None]))
    names = quality_rules.STATISTICS[:5]
    for i, t in enumerate([*texts, ""]):
        assert [int(got[n][i]) for n in names] == plain_statistics(t), repr(t)


def test_quality_rules(spark, make_docs):
    rng = random.Random(9)
    rows = [(i, prose(rng, 80) if i % 4 else " ".join(w + "###" for w in prose(rng, 80).split())) for i in range(240)]
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(240)] + [(None, 1), (999, 0), (3, None)], "doc_id long, quality int")
    docs = make_docs(rows)
    rules = quality_rules.train(docs, labels)
    assert rules and rules == quality_rules.train(docs.repartition(7), labels)
    more = make_docs([*rows, (300, None), (301, ""), (302, "short"), (303, "a b c " * 30), (304, prose(rng, 60) + " #"), (None, prose(rng, 20_000))])
    got = {r.doc_id: r for r in quality_rules.judge(more, rules).collect()}
    assert all(got[i]._qr_kept == bool(i % 4) for i in range(240))
    assert [got[i]._qr_kept for i in (300, 301, 302, 303, 304, None)] == [False, False, False, False, True, True]
    assert quality_rules.train(docs, labels.limit(0)) == []
    odd = quality_rules.judge(more.withColumns({"n_words": F.lit(1), "kept": F.lit("MINE"), "rule": F.lit(0)}), rules)
    assert {r.kept for r in odd.collect()} == {"MINE"} and odd.where("_qr_kept").count() == sum(r._qr_kept for r in got.values())
    with pytest.raises(ValueError, match="prefix"):
        quality_rules.judge(more.withColumn("_qr_x", F.lit(1)), rules)
    twice = labels.union(spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(0, 240, 2)], "doc_id long, quality int"))
    assert quality_rules.train(docs, twice) == quality_rules.train(docs.repartition(3), twice.repartition(5))


def test_the_verdict_is_that_of_the_list(make_docs):
    conditions = [[quality_rules.Condition("symbol_ratio", True, 0.02), quality_rules.Condition("words", False, 70.0)], [quality_rules.Condition("upper_ratio", True, 0.3)]]
    rng = random.Random(19)
    rows = [(i, " ".join(w.upper() if i % 3 == 0 else w for w in prose(rng, rng.randint(55, 90)).split()) + " #" * (i % 20)) for i in range(120)]
    for r in quality_rules.judge(make_docs(rows), conditions).collect():
        n, _, symbols, _, repeated = plain_statistics(rows[r.doc_id][1])
        text = rows[r.doc_id][1]
        letters = [c for c in text if c.isascii() and c.isalpha()]
        first = 1 if symbols / len(text) > 0.02 and n <= 70 else 2 if sum(c.isupper() for c in letters) / len(letters) > 0.3 else 0
        assert (r._qr_rule, r._qr_kept) == (first, first == 0 and n >= 50 and 100 * repeated <= 50 * n)


# -- op9 -----------------------------------------------------------------------------


def test_toxicity(spark, make_docs):
    rng = random.Random(10)
    bad = ["foul", "vile", "nasty"]
    rows = [(i, prose(rng, 60) + (" " + " ".join(rng.choices(bad, k=2)) + " " if i % 3 == 0 else " ") + prose(rng, 60)) for i in range(600)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(600)], "doc_id long, toxic int")
    docs = make_docs(rows)
    model = toxicity.train(docs, labels)
    extra = [(1000, None), (1001, ""), (1002, prose(rng, 40_000) + " foul vile nasty"), (1003, prose(rng, 30)), (None, "x"), (1003, prose(rng, 30))]
    got = {r.doc_id: r for r in toxicity.score(make_docs(rows + extra), model).collect()}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held_out == (i in set(held)) for i in range(600))
    assert toxicity.auc(np.array([got[i].score for i in held]), np.array([int(i % 3 == 0) for i in held])) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    assert got[1002].predicted == 1 and got[1003].predicted == 0 and got[1000].score == got[1001].score
    # the same text scores alike whatever stands in the other columns
    a = toxicity.score(make_docs([(1, rows[0][1], "de", "x"), (2, rows[0][1], None, None)]), model).collect()
    assert a[0].score == a[1].score
    none = toxicity.train(docs, labels.limit(0))
    assert {r.score for r in toxicity.score(docs, none).collect()} == {0.5}
    assert toxicity.score(docs.limit(0), model).count() == 0


def _convolved(model, ids):
    """The score by a convolution over the whole text at once."""
    x = model.embed[ids].sum(axis=1).astype(np.float64)
    pooled = []
    for w in toxicity.WIDTHS:
        z = np.zeros((len(x), model.filters[w].shape[2]))
        for j in range(w):
            z[: len(x) - j] += x[j:] @ model.filters[w][j]
        pooled.append(z.max(axis=0) + model.bias[w])
    return 1 / (1 + np.exp(-(np.maximum(np.concatenate(pooled), 0) @ model.out + model.out_bias)))


def test_scores_of_long_texts_against_a_plain_convolution():
    rng = np.random.default_rng(3)
    docs = [rng.integers(0, toxicity.BUCKETS, (40, 3)).astype(np.int32) for _ in range(60)]
    model = toxicity.fit(docs, np.arange(60) % 2, epochs=2)
    model.out *= 40  # so that a changed maximum shows
    for n in (32_767, 32_768, 32_769, 32_770, 33_000, 70_000):
        ids = rng.integers(0, toxicity.BUCKETS, (n, 3)).astype(np.int32)
        got = model.scores(ids, np.array([0, n]), model.folded())[0]
        assert abs(got - _convolved(model, ids)) < 1e-3


def test_few_labels_are_fitted_long_enough():
    rng = np.random.default_rng(8)
    vocab = rng.integers(0, toxicity.BUCKETS, (300, 3)).astype(np.int32)
    docs = [vocab[rng.integers(1, 300, 40)] for _ in range(400)]
    y = (np.arange(400) % 5 == 0).astype(np.int64)
    for i in np.flatnonzero(y):
        docs[i][rng.integers(40)] = vocab[0]
    loss = {}
    for steps in (0, 200):
        model = toxicity.fit(docs[:200], y[:200], steps=steps)
        s = model.scores(np.concatenate(docs[200:]), np.arange(201) * 40, model.folded())
        assert toxicity.auc(s, y[200:]) > 0.99
        loss[steps] = -np.log(np.where(y[200:] == 1, s, 1 - s)).mean()
    assert loss[200] < loss[0] / 2


def test_toxicity_sample_is_bounded_and_settled(spark, make_docs):
    rng = random.Random(20)
    rows = [(i, prose(rng, 30) + (" foul vile" if i % 2 else "")) for i in range(200)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(i, 1 - i % 2) for i in range(0, 50)], "doc_id long, toxic int")
    docs = make_docs([*rows, (3, "twice"), (61, prose(rng, 30_000))])
    a = toxicity.train(docs, labels, chars=20_000, epochs=2)
    b = toxicity.train(docs.repartition(5), labels.repartition(3), chars=20_000, epochs=2)
    assert np.array_equal(a.out, b.out) and np.array_equal(a.embed, b.embed)
    assert toxicity.train(docs, labels, chars=0).constant == 0.5


def test_toxicity_learns_from_every_label(spark, make_docs):
    """A word of the toxic rows of largest hash counts, in one block and in many."""
    rng = random.Random(30)
    ids = [r.id for r in spark.range(3300).select("id", F.xxhash64(F.lit(23), "id").alias("h")).orderBy("h").collect()]
    rows = [(i, prose(rng, 8) + (" foul " if k < 3000 else " gruesome ") + prose(rng, 8)) for k, i in enumerate(ids)]
    rows += [(i, prose(rng, 17)) for i in range(3300, 6600)]
    docs, labels = make_docs(rows), spark.range(6600).selectExpr("id AS doc_id", "int(id < 3300) AS toxic")
    asked = make_docs([(i, prose(rng, 8) + word + prose(rng, 8)) for i, word in enumerate([" foul ", " gruesome ", " "] * 20)])
    for size in (8000, 700):
        got = {r.doc_id: r.predicted for r in toxicity.score(asked, toxicity.train(docs, labels, rows=size)).collect()}
        assert sum(got[i] == int(i % 3 < 2) for i in range(60)) >= 57


def test_toxicity_blocks_do_not_depend_on_files(spark, make_docs):
    rng = random.Random(31)
    docs = make_docs([(i, prose(rng, 20) + (" foul" if i % 3 == 0 else ""), "en" if i % 2 else "de") for i in range(400)])
    labels = spark.range(400).selectExpr("id AS doc_id", "int(id % 3 = 0) AS toxic")
    a = toxicity.train(docs, labels, rows=60, steps=0)
    b = toxicity.train(docs.repartition(7), labels.repartition(3), rows=60, steps=0)
    assert np.array_equal(a.out, b.out) and np.array_equal(a.embed, b.embed) and a.out_bias == b.out_bias
    assert a.thresholds == b.thresholds and set(a.thresholds) == {"de", "en"}


def test_cuts_against_every_threshold(spark):
    rng = random.Random(32)
    rows = [(of, rng.randrange(12) / 16, rng.randrange(2)) for of in "ab" for _ in range(40)]
    got = {r["of"]: r for r in toxicity.best_cuts(spark.createDataFrame(rows, "of string, score double, toxic int")).collect()}
    for of in "ab":
        mine = [(s, t) for o, s, t in rows if o == of]
        f1 = lambda cut: 2 * sum(t for s, t in mine if s >= cut) / (sum(s >= cut for s, _ in mine) + sum(t for _, t in mine))  # noqa: B023, E731
        top = max({s for s, _ in mine}, key=lambda s: (f1(s), s))
        below = max((s for s, _ in mine if s < top), default=0)
        assert (got[of]["n"], got[of]["toxic"], got[of]["cut"]) == (40, sum(t for _, t in mine), (top + below) / 2)


def test_cuts_of_more_scores_than_a_window_takes(spark, monkeypatch):
    rng = random.Random(33)
    rows = [(of, rng.random(), rng.randrange(2)) for of, n in (("", 300), ("en", 80), ("de", 10)) for _ in range(n)]
    scored = spark.createDataFrame(rows, "of string, score double, toxic int")
    want = sorted(toxicity.best_cuts(scored).collect())
    monkeypatch.setattr(ranking, "WINDOW_ROWS", 50)
    assert sorted(toxicity.best_cuts(scored).collect()) == want and len(want) == 3


def test_long_texts_are_learned_in_runs(monkeypatch):
    rng = np.random.default_rng(9)
    docs = [rng.integers(0, toxicity.BUCKETS, (n, 3)).astype(np.int32) for n in (1, 2, 63, 64, 65, 66, 200, 7)]
    model = toxicity.blank(rng)
    whole = toxicity._peaks(model, docs)
    monkeypatch.setattr(toxicity, "RUN", 64)
    runs = toxicity._peaks(model, docs)
    assert np.allclose(whole[0], runs[0], atol=1e-5) and (whole[1] == runs[1]).mean() > 0.99


# -- op10 ----------------------------------------------------------------------------

PAGE = """<html><head><title>T</title><script>x("<p>no</p>")</script></head><body class="no-sidebar"><header>Site</header><nav><a href=x>Home</a></nav>
<div class="cookie-banner">We use cookies, a long notice that no one reads but that goes on and on.</div>{main}
<section id="comments"><p>A reader has a lot to say here, in a paragraph that is as long as any other one on the page.</p></section>
<form><label>Mail</label></form><aside>More</aside><footer>&copy; x</footer></body></html>"""
BODY = "<h1>The  title &amp;\n more</h1><p>First paragraph with a <b>fair</b> number of words, that goes on for a while<br>to be text.<p>Short.<ul><li>one<li>two</ul>"
TEXT = "The title & more\nFirst paragraph with a fair number of words, that goes on for a while to be text.\nShort.\none\ntwo"


@pytest.mark.parametrize("wrap", ["<article>{}</article>", "<main>{}</main>", '<div id="x1"><div>{}</div></div>', "<div>{}</div>", "<article>{}"])
def test_html_extraction(wrap):
    assert html_extract.main_text(PAGE.format(main=wrap.format(BODY))) == TEXT


LONG = [" ".join(f"{w}{i}" for i in range(90)) for w in ("alpha", "beta", "gamma")]
BODY_DIV = "<div id=text><h1>Title</h1>" + "".join(f"<p>{x}</p>" for x in LONG) + "</div>"
BODY_TEXT = "\n".join(["Title", *LONG])
CLUTTER = "<div><p><b>1</b><i>2</i><b>3</b><i>4</i><b>5</b></p><p><b>6</b><i>7</i><b>8</b><i>9</i></p><p><b>a</b><i>b</i><b>c</b></p></div>"


@pytest.mark.parametrize("page", [
    "<article><h2>Other story</h2><p>A teaser of one line.</p></article>" + BODY_DIV,  # a teaser does not hide the text
    BODY_DIV + "<article><h2>Other story</h2><p>A teaser of one line.</p></article>",
    "<div>Unmarked line</div><article>" + BODY_DIV + "</article><div>Unmarked line</div>",
    "<div>Unmarked line</div><article><h1>Title</h1><div>" + "".join(f"<p>{x}</p>" for x in LONG) + "</div></article>",
])
def test_html_ratio_decides_with_articles(page):
    assert html_extract.main_text(f"<html><body>{page}</body></html>") == BODY_TEXT


def test_html_nothing_of_an_article_is_lost():
    """Lines rich in tags, short parts beside long ones, a second article, and names that only sound like clutter."""
    tagged = "\n".join(["12345", "6789", "abc"])
    assert html_extract.main_text(f"<article>{BODY_DIV}{CLUTTER}</article>") == f"{BODY_TEXT}\n{tagged}"
    names = '<h2 id="search-algorithms">Search</h2><section class="related work"><p>Work of others.</p></section><p class="social history">A history.</p><div class="dialog"><p>Who goes there?</p></div>'
    assert html_extract.main_text(f'<article><p>{LONG[0]}</p>{names}<div class="ad-slot top">Buy</div><div id="comments">Me too</div></article>') == "\n".join([LONG[0], "Search", "Work of others.", "A history.", "Who goes there?"])
    parts = "<div>" + "".join(f"<p>{x}</p>" for x in LONG * 2) + f"</div><p>Between.</p><div><p>{LONG[0]}</p></div>"
    want = "\n".join([*LONG * 2, "Between.", LONG[0]])
    menu = "<nav><ul><li><a href=a>Home</a><li><a href=b>About us</a></ul></nav>"
    for page in (f"<article>{parts}</article>", f"<body>{menu}<div>{parts}</div></body>", f"<body>{menu}{parts}</body>"):
        assert html_extract.main_text(page) == want
    assert html_extract.main_text(f"<main><article>{BODY_DIV}</article><article><p>A short second article.</p></article></main>") == f"{BODY_TEXT}\nA short second article."


def test_html_menus_are_kept_out_by_their_ratio():
    menu = "<nav>" + "".join(f"<a href={i}>Item {i}</a><br>" for i in range(3)) + "<ul>" + "".join(f"<li><a href={i}>Topic number {i}</a>" for i in range(12)) + "</ul></nav>"
    page = f"<body>{menu}<div><p>A short text.</p><p>It has two lines.</p></div></body>"
    assert html_extract.main_text(page) == "A short text.\nIt has two lines."


def test_html_linked_line_inside_the_text():
    line = '<p>See <a href=x>the long title of a source that the text names</a>.</p>'
    page = f"<article><p>{LONG[0]}</p>{line}<p>{LONG[1]}</p>" + "<p><a href=x>More stories</a></p>" * 9 + "</article>"
    assert html_extract.main_text(page) == "\n".join([LONG[0], "See the long title of a source that the text names.", LONG[1]])


def test_html_outcome_depends_on_the_ratio(monkeypatch):
    menu = "<nav><ul>" + "".join(f"<li><a href={i}>Topic number {i}</a>" for i in range(12)) + "</ul></nav>"
    pages = [f"<div>{CLUTTER}{BODY_DIV}</div>", f"<body>{menu}{BODY_DIV}</body>", "<article><h2>Other story</h2><p>A teaser of one line.</p></article>" + BODY_DIV]
    want = [html_extract.main_text(p) for p in pages]
    monkeypatch.setattr(html_extract, "smoothed", lambda ratios, sigma: np.ones(len(ratios)))
    assert all(html_extract.main_text(p) != w for p, w in zip(pages, want, strict=True))


def test_html_of_a_very_long_page():
    body = [f"paragraph {i} with some words of its own, as long as a line" for i in range(30_000)]
    assert html_extract.main_text("<nav><a href=x>x</a></nav><div>" + "".join(f"<p>{x}</p>" for x in body) + "</div>") == "\n".join(body)


def test_html_of_odd_pages(spark):
    rows = [(1, None), (2, ""), (3, "plain &lt;text&gt;"), (4, "<p>a<p>b</div></div>c"), (5, "<nav>menu<article><p>kept"), (6, "<p>x &#xD800; y"), (6, "<p>x &#xD800; y"), (7, "<div>" * 3000 + "deep")]
    got = html_extract.extract(spark.createDataFrame([(i, "u", h, 1) for i, h in rows], "page_id long, url string, html string, text int"))
    text = {r.page_id: r._hx_text for r in got.collect()}
    assert (text[1], text[2], text[3], text[4], text[5], text[7]) == ("", "", "plain <text>", "a\nb\nc", "kept", "deep")
    assert got.columns == ["page_id", "url", "text", "_hx_text"] and got.count() == len(rows)


@pytest.mark.parametrize("columns", range(60, 121, 6))
def test_whole_licences_at_any_width(spark, make_docs, columns):
    """Every known whole licence, its paragraphs filled anew: what stands at a line's start is no notice for that."""
    import textwrap

    rows, want = [], []
    for name, texts in license_scan.TEXTS.items():
        for text in texts:
            paragraphs = re.split(r"\n[ \t]*\n", text)
            rows.append((len(rows), "\n\n".join(textwrap.fill(" ".join(p.split()), columns, break_long_words=False, break_on_hyphens=False) for p in paragraphs)))
            want.append(name)
            if name in ("MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause"):  # under notices of the holder's own
                rows.append((len(rows), f"Copyright (c) 2019-2024 Jane Doe\n(c) 2011 Someone Else\nAll rights reserved.\n\n{rows[-1][1]}"))
                want.append(name)
    got = {r.doc_id: r._ls_license for r in license_scan.scan_licenses(make_docs(rows), license_scan.known_licenses(spark)).collect()}
    assert [got[i] for i in range(len(rows))] == want


def test_sentences_about_copyright_are_no_notices(spark, make_docs):
    rows = [
        (1, "Copyrighted songs were played all night.\nCopyright law is the subject of this essay.\nReleased under the MIT License."),
        (2, "Copyrighted songs were played all night."),
        (3, "Copyright 2020 Jane Doe\nReleased under the MIT License."),
        (4, "Copyright by Jane Doe\n© the authors\nCopyright © 1999\nCopyright (C) ACME\nCopyright [yyyy] [name]\nAll rights reserved.\nReleased under the MIT License."),
        (5, "copyright notice, this list\nCOPYRIGHT HOLDERS BE LIABLE\n(c) You must retain\nReleased under the MIT License."),
        (6, "Copyright Law is dull.\nReleased under the MIT License."),
    ]
    got = {r.doc_id: r for r in license_scan.scan_licenses(make_docs(rows), license_scan.known_licenses(spark)).collect()}
    assert [got[i]._ls_license for i in range(1, 7)] == [None, None, "MIT", "MIT", None, None]
    assert [got[i]._ls_notice for i in range(1, 7)] == ["MIT", None, "MIT", "MIT", "MIT", "MIT"]
    assert got[2]._ls_digest != license_scan.scan_licenses(make_docs([(9, "")]), license_scan.known_licenses(spark)).first()._ls_digest


def test_own_names_are_refused(spark, make_docs):
    docs = make_docs([(1, "a")]).withColumns({"url": F.lit("http://a"), "html": F.lit("<p>a")})
    known, rules = license_scan.known_licenses(spark), spark.createDataFrame([("a", "/", "block")], "host string, path string, verdict string")
    calls = {
        "_uf_rule": lambda d: url_filter.filter_urls(d, rules, d.select("url")), "_ls_lined": lambda d: license_scan.scan_licenses(d, known), "_ld_left": line_dedup.dedup_lines,
        "_sh_rank": sharding.assign_shards, "_hx_text": html_extract.extract,
    }
    for name, call in calls.items():
        call(docs.withColumn("x" + name, F.lit(1)))
        for clash in (name, name.upper()):
            with pytest.raises(ValueError):
                call(docs.withColumn(clash, F.lit(1)))
