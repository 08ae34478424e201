"""Site-relative line dedup: lines that stand on too many of a site's pages go.

For every site the pages that contain a line (at least once, compared without
white space at its ends) are divided by the site's pages; lines above ``ratio``
are boilerplate and are dropped there, and only there. Every row is a page, a
copied one too. The ratio means that a line which stands on more than one page
in twenty belongs to the site, not to its pages; below it, a site of twenty
pages would lose lines that repeat nowhere. For the same reason a line on a
single page is never boilerplate (``min_pages``): on sites of under twenty pages
the ratio alone says nothing about it.

Built from DataFrame functions alone. Lines travel as 16-byte digests, counted
map-side first, so that a line of a hot site moves as one count for each task. A
site has at most (lines per page / ratio) boilerplate lines, so that its list is
one small row, broadcast behind a count, else joined by site.

Defined results: a null text stays null and is no page; a null site is a site
of its own; blank lines are never dropped; a text of boilerplate only becomes
empty, and its row stays; repeated rows are treated alike; other columns are
carried through; names that begin with ``_ld_`` are refused with a ValueError.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeloom.llm._text import own_names
from treeloom.plans.durable import durable
from treeloom.plans.sizing import broadcast_if_small

_BLANK = " \t\r\v\f"
#: Rows of the boilerplate table (24 bytes each) that may be broadcast.
LIST_ROWS = 500_000


def _site(site: Column | str) -> Column:
    return F.col(site) if isinstance(site, str) else site


def _key(line: Column) -> Column:
    return F.unhex(F.md5(F.btrim(line, F.lit(_BLANK))))


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def boilerplate(docs: DataFrame, site: Column | str = "source", text: str = "text", ratio: float = 0.05, min_pages: int = 2) -> DataFrame:
    """(_ld_site, _ld_key, _ld_pages, _ld_total) of every line to drop."""
    pages = docs.where(F.col(text).isNotNull()).select(_site(site).alias("_ld_site"), F.col(text).alias("_ld_text"))
    total = pages.groupBy("_ld_site").agg(F.count("*").alias("_ld_total"))
    keys = F.array_distinct(F.transform(F.filter(_lines(F.col("_ld_text")), lambda x: F.btrim(x, F.lit(_BLANK)) != ""), _key))
    counts = pages.select("_ld_site", F.explode(keys).alias("_ld_key")).groupBy("_ld_site", "_ld_key").agg(F.count("*").alias("_ld_pages")).where(F.col("_ld_pages") >= min_pages)
    total = total.select(F.col("_ld_site").alias("_ld_of"), "_ld_total")
    return counts.join(broadcast_if_small(total, limit=LIST_ROWS), F.col("_ld_site").eqNullSafe(F.col("_ld_of"))).where(F.col("_ld_pages") > ratio * F.col("_ld_total")).drop("_ld_of")


def dedup_lines(docs: DataFrame, site: Column | str = "source", text: str = "text", ratio: float = 0.05, min_pages: int = 2) -> DataFrame:
    """``docs`` with the boilerplate lines gone from ``text``, plus ``_ld_lines`` and ``_ld_dropped`` (long).

    ``site``: a column or an expression, as ``url_filter.host_of(F.col("url"))``.
    """
    own_names(docs, "_ld_")
    found = durable(boilerplate(docs, site, text, ratio, min_pages))
    lists = found.groupBy(F.col("_ld_site").alias("_ld_of")).agg(F.collect_list("_ld_key").alias("_ld_drop"))
    lists = F.broadcast(lists) if found.count() <= LIST_ROWS else durable(lists)
    out = docs.join(lists, _site(site).eqNullSafe(F.col("_ld_of")), "left")
    lines = _lines(F.col(text))
    left = F.when(F.col("_ld_drop").isNull(), lines).otherwise(F.filter(lines, lambda x: ~F.array_contains("_ld_drop", _key(x))))
    out = out.withColumn("_ld_left", left)
    return out.select(
        *[F.array_join("_ld_left", "\n").alias(text) if c == text else F.col(c) for c in docs.columns],
        F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("_ld_lines"), F.coalesce(F.size(lines) - F.size("_ld_left"), F.lit(0)).cast("long").alias("_ld_dropped"),
    )
