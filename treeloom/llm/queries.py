"""The subpackage's registered queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeloom.llm import centroids, decontaminate, fingerprints, html_extract, license_scan, line_dedup, near_dedup, packing, quality_rules, sharding, stages, toxicity, url_filter, vector_codes
from treeloom.llm._vectors import added
from treeloom.plans.durable import stored
from treeloom.plans.sizing import broadcast_if_small

#: Fixed values: (host, path, verdict).
URL_RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page by the rules above and a list: the URLs that came with a feed's utm_source mark."""
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    listed = pages.where(F.col("url").contains("utm_source=")).select("url")
    out = url_filter.filter_urls(pages, rules, listed)
    return out.select("page_id", F.col("_uf_host").alias("host"), F.col("_uf_path").alias("path"), F.col("_uf_rule").alias("rule"), F.col("_uf_verdict").alias("verdict"))


OP1_SQL = r"""
WITH p AS (
  SELECT page_id, url, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages
), q AS (
  SELECT page_id, url,
    translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
    array_to_string(list_sort(list_filter(string_split(regexp_extract(rest, '^[^?#]*\?([^#]*)', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[^=]*|ref)(=|$)'))), '&') AS args
  FROM p
), c AS (
  SELECT page_id, url, coalesce(host, '') AS host, coalesce(path, '') AS path, rtrim(host || path, '/') || CASE WHEN args <> '' THEN '?' || args ELSE '' END AS canon FROM q
), rules(rhost, rpath, action) AS (
  VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')
), best AS (
  SELECT u.url, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(action, length(rhost || rpath)) AS action
  FROM (SELECT DISTINCT url, host, path FROM c) u JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY u.url
), listed AS (SELECT DISTINCT canon FROM c WHERE contains(url, 'utm_source=') AND host <> '')
SELECT c.page_id, c.host, c.path, best.rule AS rule, coalesce(best.action, CASE WHEN listed.canon IS NOT NULL AND c.host <> '' THEN 'block' ELSE 'allow' END) AS verdict
FROM c LEFT JOIN best ON c.url = best.url LEFT JOIN listed ON c.canon = listed.canon
"""


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against the known licences and notices."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = license_scan.scan_licenses(docs, license_scan.known_licenses(spark))
    return out.select("doc_id", F.col("_ls_digest").alias("digest"), F.col("_ls_license").alias("license_id"), F.col("_ls_notice").alias("notice_id"), F.col("_ls_notices").alias("n_notices"))


def _op2_sql() -> str:
    """Its own wording: notices are found line by line, by their first two words; then letters, marks and digits are left."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    notice = """(regexp_matches(x, '^[ \\t]*(?i:copyright)[ \\t:]*((?i:\\(c\\))|©|[12][0-9][0-9][0-9]|[<{]|\\[)')
      OR (regexp_matches(x, '^[ \\t]*(?i:copyright)[ \\t]+((?i:by)[ \\t]+)?\\p{Lu}')
        AND regexp_extract(lower(x), '^[ \\t]*copyright[ \\t]+(by[ \\t]+)?([\\pL\\pN_]+)', 2) NOT IN ('notice', 'notices', 'holder', 'holders', 'owner', 'owners', 'law', 'laws', 'license', 'licenses', 'licence', 'licences', 'act', 'acts', 'protection', 'and', 'or', 'in', 'of', 'to', 'the', 'is', 'are'))
      OR regexp_matches(x, '^[ \\t]*(?i:\\(c\\))[ \\t]*[12][0-9][0-9][0-9]') OR regexp_matches(x, '^[ \\t]*©') OR regexp_matches(x, '^[ \\t]*(?i:all rights reserved)[^\\pL]*$'))"""

    def form(x: str) -> str:
        out = f"lower({x})"
        for a, b in license_scan.SPELLINGS:
            out = f"replace({out}, {quote(a)}, {quote(b)})"
        return f"trim(regexp_replace({out}, '[^\\pL\\pM\\pN]+', ' ', 'g'))"

    def forms(bare: bool) -> str:
        lines = f"list_filter(string_split(text, chr(10)), lambda x: NOT {notice})" if bare else "string_split(text, chr(10))"
        return f"list_filter(list_transform({lines}, lambda x: {form('x')}), lambda x: x <> '')"

    def whole(bare: bool | str) -> str:
        out = f"array_to_string({bare if isinstance(bare, str) else forms(bare)}, ' ')"
        for a, b in license_scan.PHRASES:
            out = f"replace({out}, {quote(a)}, {quote(b)})"
        return f"sha256({out})"

    known = ", ".join(f"({quote(k)}, {quote(t)})" for table in (license_scan.NOTICES, license_scan.TEXTS) for k, ts in table.items() for t in ts)
    return f"""
WITH known(id, text) AS (VALUES {known}),
lists AS (SELECT key, min(id) AS id FROM (SELECT id, {whole(True)} AS key FROM known UNION ALL SELECT id, {whole(False)} FROM known) GROUP BY key),
d AS (SELECT doc_id, {forms(True)} AS forms, {forms(False)} AS noted FROM documents),
found AS (SELECT doc_id, min(lists.id) AS notice_id, count(*) AS n FROM (SELECT doc_id, sha256(unnest(forms)) AS key FROM d) f JOIN lists ON f.key = lists.key GROUP BY doc_id)
SELECT w.doc_id, w.digest, coalesce(a.id, b.id) AS license_id, found.notice_id AS notice_id, CAST(coalesce(found.n, 0) AS BIGINT) AS n_notices
FROM (SELECT doc_id, {whole('forms')} AS digest, {whole('noted')} AS full_digest FROM d) w LEFT JOIN lists a ON w.digest = a.key LEFT JOIN lists b ON w.full_digest = b.key LEFT JOIN found ON w.doc_id = found.doc_id
"""


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose two-word shingles have a similarity of 0.8 or more."""
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"), k=2, percent=80)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document and benchmark item found in it."""
    return decontaminate.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its source's boilerplate lines."""
    out = line_dedup.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return out.select("doc_id", "text", F.col("_ld_lines").alias("n_lines"), F.col("_ld_dropped").alias("n_dropped"))


OP5_SQL = r"""
WITH d AS (SELECT doc_id, source, text, list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13) || chr(11) || chr(12))) AS keys FROM documents),
total AS (SELECT source, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY source),
counts AS (SELECT source, line, count(*) AS pages FROM (SELECT source, unnest(list_distinct(keys)) AS line FROM d WHERE text IS NOT NULL) WHERE line <> '' GROUP BY source, line),
gone AS (SELECT c.source, list(c.line) AS lines FROM counts c JOIN total t ON c.source IS NOT DISTINCT FROM t.source WHERE pages >= 2 AND pages > 0.05 * n GROUP BY c.source),
kept AS (
  SELECT doc_id, text, keys, CASE WHEN gone.lines IS NULL THEN string_split(text, chr(10)) ELSE list_filter(string_split(text, chr(10)), lambda x: NOT list_contains(gone.lines, trim(x, ' ' || chr(9) || chr(13) || chr(11) || chr(12)))) END AS rest
  FROM d LEFT JOIN gone ON d.source IS NOT DISTINCT FROM gone.source
)
SELECT doc_id, CASE WHEN text IS NULL THEN NULL ELSE coalesce(array_to_string(rest, chr(10)), '') END AS text, CAST(coalesce(len(keys), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(keys) - len(rest), 0) AS BIGINT) AS n_dropped FROM kept
"""


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens in sequences of 2048."""
    out = packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), capacity=2048, end_id=1)
    return out.select("doc_id", "start", "length", F.crc32("token_ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in one of 16 shards of equal row counts and the corpus' mixture of sources."""
    docs = _table(spark, sf_dir, "documents")
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    rows = docs.select("doc_id", "source", size.alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"))
    out = sharding.assign_shards(rows, shards=16)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("_sh_shard").alias("shard"), F.col("_sh_slot").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's statistics and the verdict of a list learned from the labels."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = quality_rules.train(docs, _table(spark, sf_dir, "labels"))
    out = quality_rules.judge(docs, rules)
    return out.select("doc_id", *[F.col(f"_qr_{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")])


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score by a classifier fitted outside the held-out fold."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return toxicity.score(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))


def op10_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's main text."""
    out = html_extract.extract(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", F.col("_hx_text").alias("text"), F.length("_hx_text").cast("long").alias("n_chars"))


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's cluster among 16 after three rounds."""
    out = centroids.cluster(_table(spark, sf_dir, "embeddings"), k=16, rounds=3, dims=64, scale=64.0, salt="1")
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", F.sha2(F.array_join("centroid", ","), 256).alias("centroid_sha256"))


#: Each component's sum over a group, divided and rounded down, in the order of components.
_MEAN = "list(CAST(floor(s / n) AS BIGINT) ORDER BY pos)"
_APART = "CAST(list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT)"


def _op11_sql(rounds: int = 3) -> str:
    parts = [
        """kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)""",
        "c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS cluster, v AS c FROM kept ORDER BY sha256('1:' || vec_id) LIMIT 16)",
    ]
    for i in range(rounds + 1):
        parts.append(f"d{i} AS MATERIALIZED (SELECT r, min({{'d': {_APART}, 'k': cluster}}) AS m FROM kept, c{i} GROUP BY r)")
        if i < rounds:
            parts.append(f"s{i} AS (SELECT m.k AS cluster, pos, sum(v[pos]) AS s, count(*) AS n FROM kept JOIN d{i} USING (r), (SELECT unnest(range(1, 65)) AS pos) GROUP BY ALL)")
            parts.append(f"c{i + 1} AS MATERIALIZED (SELECT o.cluster, coalesce(g.c, o.c) AS c FROM c{i} o LEFT JOIN (SELECT cluster, {_MEAN} AS c FROM s{i} GROUP BY cluster) g USING (cluster))")
    return f"""WITH {", ".join(parts)}
SELECT vec_id, CAST(m.k AS INTEGER) AS cluster, m.d AS distance, CAST(sum(m.d) OVER (PARTITION BY m.k) AS BIGINT) AS cluster_inertia, CAST(sum(m.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM kept JOIN d{rounds} USING (r) JOIN c{rounds} ON m.k = cluster"""


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's code of eight bytes, its error and its label's."""
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    books = vector_codes.fit(vectors, parts=8, k=16, rounds=6, scale=4096.0)
    out = stored(vector_codes.encode(vectors, books, scale=4096.0).drop("embedding"))
    per = stored(out.groupBy(F.col("label").alias("_of")).agg(added("_vc_error").alias("label_error")))
    digest = F.sha2(F.lit(",".join(str(x) for x in books.ravel().tolist())), 256)
    both = out.join(broadcast_if_small(per), F.col("label").eqNullSafe(F.col("_of")))
    return both.select("vec_id", F.col("_vc_code").alias("code"), F.col("_vc_error").alias("error"), "label_error", digest.alias("codebooks_sha256"))


def _op12_sql(rounds: int = 6) -> str:
    parts = [
        """kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding))""",
        "cut AS MATERIALIZED (SELECT r, vec_id, part, list_slice(x, part * (len(x) // 8) + 1, (part + 1) * (len(x) // 8)) AS v FROM kept, (SELECT unnest(range(8)) AS part))",
        "b0 AS MATERIALIZED (SELECT part, e AS entry, v AS c FROM cut JOIN (SELECT r, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept ORDER BY vec_id LIMIT 16) USING (r))",
    ]
    for i in range(rounds + 1):
        parts.append(f"d{i} AS MATERIALIZED (SELECT r, part, min({{'d': {_APART}, 'k': entry}}) AS m FROM cut JOIN b{i} USING (part) GROUP BY r, part)")
        if i < rounds:
            parts.append(f"s{i} AS (SELECT part, m.k AS entry, pos, sum(v[pos]) AS s, count(*) AS n FROM cut JOIN d{i} USING (r, part), (SELECT unnest(range(1, 9)) AS pos) GROUP BY ALL)")
            parts.append(f"b{i + 1} AS MATERIALIZED (SELECT o.part, o.entry, coalesce(g.c, o.c) AS c FROM b{i} o LEFT JOIN (SELECT part, entry, {_MEAN} AS c FROM s{i} GROUP BY part, entry) g USING (part, entry))")
    return f"""WITH {", ".join(parts)},
books AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS h FROM b{rounds}),
codes AS (SELECT r, string_agg(printf('%02x', m.k), '' ORDER BY part) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM d{rounds} GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM kept JOIN codes USING (r), books"""


def op13_spot_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint, and how like it is to that of its edited text and of the next document."""
    out = fingerprints.compare_with_edits(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    text = fingerprints.text_of
    return out.select(
        "doc_id", F.col("_sp_n").alias("n_chars"), F.sha2("_sp_edited", 256).alias("edited_sha256"), text(F.col("_sp_signatures")).alias("fingerprint"), text(F.col("_sp_edited_signatures")).alias("edited_fingerprint"),
        F.col("_sp_near_edited").alias("near_edited"), F.col("_sp_near_next").alias("near_next"),
    )


def _op13_sql() -> str:
    """Words as rows: a spot is a content word after an anchor, its chain goes on to the next content word."""
    anchors = ", ".join(f"'{w}'" for w in sorted({w for words in fingerprints.ANCHORS.values() for w in words.split()}))
    like = "CASE WHEN a = b THEN 1.0 WHEN len(list_intersect(a, b)) >= 0.05 * (len(a) + len(b) - len(list_intersect(a, b))) THEN len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))) ELSE 0.0 END"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
o AS (SELECT *, coalesce(lead(text) OVER w, first_value(text) OVER w) AS following, coalesce(lead(doc_id) OVER w, first_value(doc_id) OVER w) AS next_id FROM d WINDOW w AS (ORDER BY doc_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
e AS (SELECT *, substr(text, 1, length(text) - length(text) // 3) || substr(following, 1, length(text) // 3) AS edited FROM o),
t AS (SELECT doc_id, 0 AS k, text FROM e UNION ALL SELECT doc_id, 1, edited FROM e),
w AS (SELECT doc_id, k, list_filter(regexp_split_to_array(lower(text), '[^\\pL\\pM\\pN]+'), lambda x: x <> '') AS ws FROM t),
u AS (SELECT doc_id, k, unnest(ws) AS x, unnest(range(len(ws))) AS pos FROM w),
f AS (SELECT *, x IN ({anchors}) AS anchor, lag(x) OVER (PARTITION BY doc_id, k ORDER BY pos) AS before FROM u),
c AS (SELECT *, lead(x) OVER (PARTITION BY doc_id, k ORDER BY pos) AS after FROM f WHERE NOT anchor),
s AS (SELECT doc_id, k, list_sort(list(DISTINCT substr(md5(before || ' ' || x || ' ' || after), 1, 16))) AS sig FROM c WHERE before IN ({anchors}) AND after IS NOT NULL GROUP BY doc_id, k),
g AS (SELECT doc_id, k, coalesce(sig, CASE WHEN len(ws) = 0 THEN [] ELSE [substr(md5(array_to_string(ws, ' ')), 1, 16)] END) AS sig FROM w LEFT JOIN s USING (doc_id, k)),
p AS (SELECT e.doc_id, length(text) AS n_chars, sha256(edited) AS edited_sha256, own.sig AS a, ed.sig AS b, nx.sig AS c FROM e JOIN g own ON own.doc_id = e.doc_id AND own.k = 0 JOIN g ed ON ed.doc_id = e.doc_id AND ed.k = 1 JOIN g nx ON nx.doc_id = e.next_id AND nx.k = 0)
SELECT doc_id, CAST(n_chars AS BIGINT) AS n_chars, edited_sha256, array_to_string(a, '') AS fingerprint, array_to_string(b, '') AS edited_fingerprint, CAST({like} AS DOUBLE) AS near_edited, CAST({like.replace("a = b", "a = c").replace("(a, b)", "(a, c)").replace("len(b)", "len(c)")} AS DOUBLE) AS near_next FROM p
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_url_filter, op2_license_scan, op3_near_dedup, op4_decontaminate, op5_line_dedup, op6_packing, op7_sharding, op8_quality_rules, op9_toxicity, op10_html_extract, op11_centroids, op12_vector_codes, op13_spot_fingerprints)
    return {f.__name__: f for f in own} | {"pipeline": stages.run}


def oracle_sql() -> dict[str, str]:
    out = {"op1_url_filter": OP1_SQL, "op2_license_scan": _op2_sql(), "op5_line_dedup": OP5_SQL, "op11_centroids": _op11_sql(), "op12_vector_codes": _op12_sql(), "op13_spot_fingerprints": _op13_sql()}
    return out | ({"pipeline": stages.ORACLE_SQL} if stages.ORACLE_SQL else {})
