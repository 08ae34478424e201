"""URL filter: a blocked Bloom filter in front of an exact hash join.

The list holds canonical URLs (a whole page) and rules (a host with all of its
subdomains, and the start of a path). Each entry is one key; a page has a few
candidate keys, its canonical URL and its host's endings with its path's starts
of the list's own shapes. The keys' Bloom filter (blocks of 256 bits, eight bits
a key, all in one block) is asked first, so that pages without a hit, nearly
all, meet no join. Possible hits go to an exact join on the key, which removes
the filter's false positives, and the longest rule wins over shorter ones and
over a listed URL.

DataFrame functions only. The filter is an aggregate (bit_or by block); it is
broadcast behind a check of its size and joined by block beyond that. Distinct
URLs are judged once, so that an URL that many pages share is joined once.

Defined results: a null url, or one without "://", has an empty host and path,
matches no rule and is allowed. Longest is by the rule's whole length (host and
path), then by host, then by name; a url listed twice, or a rule given twice
with the same verdict, counts once, and a rule given with both verdicts blocks.
An empty list allows everything. Repeated pages are judged alike. Other columns
are carried through; names that begin with ``_uf_`` are refused with a ValueError.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeloom.llm._text import own_names
from treeloom.plans.durable import durable
from treeloom.plans.sizing import broadcast_if_small

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bits of the filter for each key; four 64-bit words form a block.
BITS_A_KEY, WORDS = 16, 4
#: Blocks (40 bytes each) that may be broadcast: 40 MB.
BLOCK_ROWS = 1_000_000
#: Rows of the list that may be broadcast to the exact join.
LIST_ROWS = 200_000
#: Distinct rule shapes up to which candidates are generated by shape.
SHAPES = 4096


def _rest(url: Column) -> Column:
    """What follows the first "://" (null without one)."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), "^([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Host and path without a closing slash, and the query without utm_* and ref, sorted; no scheme, no fragment."""
    query = F.regexp_extract(F.coalesce(_rest(url), F.lit("")), r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_join(F.sort_array(F.filter(F.split(query, "&"), lambda x: (x != "") & ~x.rlike("^(utm_[^=]*|ref)(=|$)"))), "&")
    return F.concat(F.rtrim(F.concat(host_of(url), path_of(url)), F.lit("/")), F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""))


def _entries(rules: DataFrame, urls: DataFrame) -> DataFrame:
    """(key, rule, verdict, rank, labels, start): one row for each key; only rules have a rank of 1 and more."""
    rule = F.concat("host", "path")
    r = rules.where("host <> '' AND path IS NOT NULL").select(F.concat(F.lit("r:"), rule).alias("key"), rule.alias("rule"), "verdict", F.length(rule).alias("rank"), F.size(F.split("host", r"\.")).alias("labels"), F.length("path").alias("start"))
    u = urls.where("url IS NOT NULL").select(F.concat(F.lit("u:"), canonical(F.col("url"))).alias("key"), F.lit(None).cast("string").alias("rule"), F.lit("block").alias("verdict"), F.lit(0).alias("rank"), F.lit(0).alias("labels"), F.lit(0).alias("start"))
    return r.union(u).groupBy("key").agg(*[F.max(c).alias(c) for c in ("rule", "verdict", "rank", "labels", "start")])


def _words(key: Column) -> Column:
    """The four words of a key's mask: two bits in each, from its second hash."""
    h = F.xxhash64(F.lit(1), key)
    one = lambda j: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * j).bitwiseAND(63).cast("int"))
    return F.array(*[one(2 * w).bitwiseOR(one(2 * w + 1)) for w in range(WORDS)])


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(0), key), F.lit(blocks))


def bloom(keys: DataFrame, blocks: int) -> DataFrame:
    """(_uf_block, _uf_bits): the filter of ``keys`` (key); absent blocks are all zero."""
    at = keys.select(_block(F.col("key"), blocks).alias("_uf_block"), _words(F.col("key")).alias("w"))
    return at.groupBy("_uf_block").agg(F.array(*[F.bit_or(F.col("w")[w]) for w in range(WORDS)]).alias("_uf_bits"))


def _candidates(url: Column, shapes: list[tuple[int, int]] | None) -> Column:
    """Every key under which the list could hold ``url``."""
    labels, path = F.split(host_of(url), r"\."), path_of(url)
    ending = lambda n: F.array_join(F.slice(labels, F.greatest(F.size(labels) - n + 1, F.lit(1)), F.greatest(F.least(F.size(labels), n), F.lit(0))), ".")
    if shapes is None:  # every ending with every start
        rules = F.flatten(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: F.transform(F.sequence(F.lit(0), F.length(path)), lambda m: F.concat(F.lit("r:"), ending(n), F.substring(path, F.lit(1), m)))))
    else:
        one = lambda n, m: F.when((F.size(labels) >= n) & (F.length(path) >= m), F.concat(F.lit("r:"), ending(F.lit(n)), F.substring(path, 1, m)))
        rules = F.array_compact(F.array(*[one(n, m) for n, m in shapes])) if shapes else F.array().cast("array<string>")
    return F.when(host_of(url) != "", F.array_append(rules, F.concat(F.lit("u:"), canonical(url)))).otherwise(F.array().cast("array<string>"))


def filter_urls(pages: DataFrame, rules: DataFrame, urls: DataFrame, url: str = "url") -> DataFrame:
    """``pages`` with _uf_host, _uf_path, _uf_rule and _uf_verdict.

    ``rules``: (host, path, verdict), ``verdict`` allow or block; ``urls``: (url),
    pages to block. A url without a rule is blocked if listed, else allowed.
    """
    own_names(pages, "_uf_")
    entries = durable(_entries(rules, urls))
    n = entries.count()
    pairs = entries.where("rank > 0").select("labels", "start").distinct().orderBy("start", "labels").limit(SHAPES + 1).collect()
    shapes = [(r.labels, r.start) for r in pairs] if len(pairs) <= SHAPES else None
    blocks = max(1, math.ceil(n * BITS_A_KEY / (64 * WORDS)))
    bits = durable(bloom(entries.select("key"), blocks))

    distinct = pages.where(F.col(url).isNotNull()).select(F.col(url).alias("_uf_url")).distinct()
    asked = distinct.select("_uf_url", F.explode(_candidates(F.col("_uf_url"), shapes)).alias("_uf_key")).withColumn("_uf_at", _block(F.col("_uf_key"), blocks))
    met = asked.join(broadcast_if_small(bits, limit=BLOCK_ROWS), asked["_uf_at"] == bits["_uf_block"])
    mask = _words(F.col("_uf_key"))
    possible = met.where(F.forall(F.zip_with("_uf_bits", mask, lambda have, want: have.bitwiseAND(want) == want), lambda x: x)).select("_uf_url", "_uf_key")
    exact = possible.join(broadcast_if_small(entries, n, LIST_ROWS), possible["_uf_key"] == entries["key"])
    best = exact.groupBy("_uf_url").agg(F.max(F.struct("rank", F.length(F.split("rule", "/")[0]).alias("host"), "rule", "verdict")).alias("_uf_best"))
    best = durable(best.select("_uf_url", F.col("_uf_best.rule").alias("_uf_rule"), F.col("_uf_best.verdict").alias("_uf_verdict")))
    out = pages.join(broadcast_if_small(best, limit=LIST_ROWS), F.col(url) == best["_uf_url"], "left")
    u = F.col(url)
    return out.select(*[F.col(c) for c in pages.columns], host_of(u).alias("_uf_host"), path_of(u).alias("_uf_path"), "_uf_rule", F.coalesce("_uf_verdict", F.lit("allow")).alias("_uf_verdict"))
