"""Document fingerprints by spot signatures.

A spot is a common word (an anchor) right before a content word; its signature
is the anchor and the chain of CHAIN content words that follow it, common words
between them passed over. Prose has many such spots, while menus, lists and
other trimmings have few. A text's fingerprint is the set of its signatures,
written as sorted digests of 16 hex digits each, so that likeness can be told
from two fingerprints alone. Two sets are compared by Jaccard similarity, which
is at most the ratio of their sizes: sets are put into partitions by the
logarithm of their size, and a pair whose partitions or sizes cannot meet
``at_least`` is settled without looking at a single signature.

``following`` pairs each document with the next one in descending order of ids.
Rows are dealt to blocks cut at quantiles of the id, each block with a copy of
the first row of the block after it, so that texts are shuffled once and no
task holds more than blocks. A block has BLOCK_ROWS rows or, from MAX_BLOCKS
blocks on, that share of the table; rows of one id that fill several blocks are
spread over them by a hash of their text.

DataFrame functions only.

Defined results: a null text counts as empty; an empty text, or one without a
letter or digit, has the empty fingerprint. A text without a whole chain has one
signature, that of all its words. Equal texts have equal fingerprints; equal
fingerprints have likeness 1, empty ones too; likeness under ``at_least`` is 0,
and from there on exact. A null id comes last; rows of equal ids follow each
other in an order that their texts give, and equal rows are interchangeable. A
single row is followed by itself, an empty table has no rows. Other columns are
carried through; names that begin with ``_sp_`` are refused with a ValueError.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from treeloom.llm._text import own_names

#: Common words before which a spot begins, by language; all lists hold for all texts.
ANCHORS = {
    "en": "a about after all also an and are as at be been but by can did do for from had has have he her his if in into is it its more no not of on one or she so than that the their them then there they this to was we were what when which who will with would you",
    "de": "als am auch auf aus bei bis das dass dem den der des die durch ein eine einem einen einer er es für hat ich im ist mit nach nicht noch nur oder sich sie sind über um und uns von vor war werden wie wir wird zu zum zur",
    "fr": "au aux avec ce ces cette dans de des du elle en est et il je la le les leur lui mais ne nous on ou par pas plus pour qu que qui sa se ses son sont sur un une vous",
    "es": "al como con del desde donde el ella en entre era esta este fue ha hasta la las lo los más muy no o para pero por que se ser sin sobre son su sus también un una y ya",
}
#: Content words of a chain.
CHAIN = 2
#: Rows of a block, and the number of blocks up to which blocks are added rather than grown.
BLOCK_ROWS, MAX_BLOCKS = 16, 16_384


def _before_content() -> str:
    """A pattern for a blank that no anchor follows."""
    by_letter: dict[str, list[str]] = {}
    for word in sorted({w for words in ANCHORS.values() for w in words.split()}):
        by_letter.setdefault(word[0], []).append(word[1:])
    return " (?!(?:" + "|".join(f"{a}(?:{'|'.join(rest)})" for a, rest in by_letter.items()) + ")(?: |$))"


def with_signatures(docs: DataFrame, text: str, out: str) -> DataFrame:
    """``docs`` with ``out``: the sorted distinct signatures of ``text``."""
    # "^" stands before the first content word, so that every piece is a content word and the anchors after it
    words = F.btrim(F.regexp_replace(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{M}\p{N}]+", " "))
    cut = docs.withColumn("_sp_words", words).withColumn("_sp_spots", F.split(F.concat(F.lit("^ "), F.col("_sp_words")), _before_content()))
    spots = F.col("_sp_spots")

    def signature(piece: Column, k: Column) -> Column:
        chain = [F.substring_index(F.get(spots, k + j), " ", 1) for j in range(1, CHAIN + 1)]
        whole = (F.instr(piece, " ") > 0) & (k + CHAIN < F.size(spots))
        return F.when(whole, F.substring(F.md5(F.concat_ws(" ", F.substring_index(piece, " ", -1), *chain)), 1, 16))

    found = cut.withColumn("_sp_found", F.array_compact(F.transform(spots, signature)))
    alone = F.when(F.col("_sp_words") == "", F.array().cast("array<string>")).otherwise(F.array(F.substring(F.md5("_sp_words"), 1, 16)))
    chosen = F.when(F.size("_sp_found") > 0, F.sort_array(F.array_distinct("_sp_found"))).otherwise(alone)
    return found.withColumn(out, chosen).drop("_sp_words", "_sp_spots", "_sp_found")


def text_of(signatures: Column) -> Column:
    """The fingerprint as a string."""
    return F.array_join(signatures, "")


def fingerprint(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with _sp_signatures and _sp_fingerprint."""
    own_names(docs, "_sp_")
    return with_signatures(docs, text, "_sp_signatures").withColumn("_sp_fingerprint", text_of(F.col("_sp_signatures")))


def partition_of(signatures: Column, at_least: float) -> Column:
    """The partition of a set by its size: sets two partitions apart have a likeness under ``at_least``."""
    return F.floor(F.log(F.greatest(F.size(signatures), F.lit(1))) / -math.log(at_least))


def likeness(a: Column, b: Column, at_least: float) -> Column:
    """The Jaccard similarity of two sets of signatures, 0 where it is under ``at_least``."""
    less, more = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    common = F.size(F.array_intersect(a, b))
    exact = common / (less + more - common)
    far = (F.abs(partition_of(a, at_least) - partition_of(b, at_least)) > 1) | (less < F.lit(at_least) * more)
    return F.when(a == b, 1.0).when(far | (less == 0), 0.0).otherwise(F.when(exact >= at_least, exact).otherwise(0.0))


def _places(cuts: list[int], key: Column) -> tuple[Column, Column]:
    """How many of the sorted ``cuts`` lie under ``key``, and how many equal it, each by binary search."""
    steps = F.expr(f"array({', '.join(str(1 << i) for i in reversed(range(len(cuts).bit_length())))})")
    held = F.expr(f"array({', '.join(f'{c}L' if c > -(1 << 63) else 'bigint(-9223372036854775808)' for c in cuts)})")

    def count(fits) -> Column:
        return F.aggregate(steps, F.lit(0), lambda at, step: F.when((at + step <= len(cuts)) & fits(F.get(held, at + step - 1)), at + step).otherwise(at))

    under = count(lambda c: c < key)
    return under, count(lambda c: c <= key) - under


def following(docs: DataFrame, id: str = "doc_id", text: str = "text", out: str = "_sp_next", add=None) -> DataFrame:
    """``docs`` with ``out``, the next row in descending order of ``id`` as a struct; the first row follows the last.

    ``add``: a function of the table that adds columns once rows are dealt out;
    the struct holds them as well.
    """
    own_names(docs, "_sp_")
    add = add or (lambda df: df)
    rows = docs.withColumn("_sp_key", F.coalesce(F.col(id).cast("long"), F.lit(-(1 << 63))))
    blocks = max(1, min(MAX_BLOCKS, rows.count() // BLOCK_ROWS))
    share, place = F.lit(0.0), F.lit(0)
    if blocks > 1:
        points = ", ".join(f"{i / blocks!r}D" for i in range(1, blocks))
        cuts = sorted(rows.agg(F.expr(f"percentile_approx(_sp_key, array({points}), {max(10_000, 8 * blocks)})").alias("x")).first().x)  # under MAX_BLOCKS numbers
        under, equal = _places(cuts, F.col("_sp_key"))
        if len(set(cuts)) < len(cuts):  # an id fills several blocks
            share = F.pmod(F.xxhash64(F.col(text)), F.lit(1 << 20)) / (1 << 20)
            place = under + F.floor(share * (equal + 1))
        else:
            place = under
    rows = rows.withColumn("_sp_share", share).withColumn("_sp_block", place.cast("int"))
    # the first row of each block, at most MAX_BLOCKS small ones, also ends the block before it
    heads = sorted(tuple(r) for r in rows.groupBy("_sp_block").agg(F.max(F.struct("_sp_key", "_sp_share")).alias("m")).select("_sp_block", "m.*").collect())
    ends = [(key, s, heads[(i + 1) % len(heads)][0]) for i, (_, key, s) in enumerate(heads)]
    ends = F.broadcast(docs.sparkSession.createDataFrame(ends, "_sp_k long, _sp_s double, _sp_before int"))
    met = rows.join(ends, (F.col("_sp_key") == F.col("_sp_k")) & (F.col("_sp_share") == F.col("_sp_s")))
    last = Window.partitionBy("_sp_before").orderBy(F.col(text).desc_nulls_last())  # rows of one id and share
    met = met.withColumn("_sp_nth", F.row_number().over(last)).where("_sp_nth = 1").drop("_sp_nth", "_sp_k", "_sp_s", "_sp_block").withColumnRenamed("_sp_before", "_sp_block")
    dealt = rows.withColumn("_sp_end", F.lit(False)).unionByName(met.withColumn("_sp_end", F.lit(True)))
    dealt = add(dealt.repartition("_sp_block"))
    down = Window.partitionBy("_sp_block").orderBy("_sp_end", F.col("_sp_key").desc(), F.col("_sp_share").desc(), F.col(text).desc_nulls_last())
    hidden = {"_sp_key", "_sp_share", "_sp_block", "_sp_end"}
    names = [c for c in dealt.columns if c not in hidden]
    out_rows = dealt.withColumn(out, F.lead(F.struct(*names)).over(down)).where(~F.col("_sp_end"))
    return out_rows.drop(*hidden)


def with_edit(docs: DataFrame, text: str = "text", following: str = "_sp_next") -> DataFrame:
    """``docs`` with _sp_n and _sp_edited: the last third of each text gives way to the start of the next one's."""
    own, other = F.coalesce(F.col(text), F.lit("")), F.coalesce(F.col(following)[text], F.lit(""))
    n = F.length(own)
    third = F.floor(n / 3).cast("int")
    return docs.withColumns({"_sp_n": n.cast("long"), "_sp_edited": F.concat(F.substring(own, F.lit(1), n - third), F.substring(other, F.lit(1), third))})


def compare_with_edits(docs: DataFrame, id: str = "doc_id", text: str = "text", at_least: float = 0.05) -> DataFrame:
    """How a fingerprint bears a change of a third of its text, and how near unrelated neighbours come.

    ``docs`` with _sp_n, _sp_edited, _sp_signatures, _sp_edited_signatures,
    _sp_near_edited and _sp_near_next.
    """
    both = following(docs, id, text, add=lambda df: with_signatures(df, text, "_sp_signatures"))
    both = with_signatures(with_edit(both, text), "_sp_edited", "_sp_edited_signatures")
    own = F.col("_sp_signatures")
    both = both.withColumns({"_sp_near_edited": likeness(own, F.col("_sp_edited_signatures"), at_least), "_sp_near_next": likeness(own, F.col("_sp_next")["_sp_signatures"], at_least)})
    return both.drop("_sp_next")
