"""Edit vocabularies, pseudo-DNA encoding and alignment columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeloom.operators.ranking import ranked
from treeloom.plans.durable import stored
from treeloom.plans.sizing import broadcast_if_small


#: Fixed value: an edit in no more than this share of the taxa gets no site.
FLOOR = 0.001


def vocabulary(rows: DataFrame, total: int | Column, by: list[str] | None = None, edit: str = "edit", floor: float = FLOOR) -> DataFrame:
    """(by, edit, cnt) of the edits worth a site (A4), from one row for each occurrence.

    Kept are those in more than ``floor`` of ``total`` taxa but not in all;
    an edit repeated within a taxon counts each time.
    """
    of = F.lit(total) if isinstance(total, int) else total
    return rows.groupBy(*(by or []), edit).agg(F.count("*").alias("cnt")).where((F.col("cnt") / of > floor) & (F.col("cnt") < of))


def _cells(edit: Column, depth: int, width: int) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(i), edit), F.lit(width)).cast("int") for i in range(depth)]


def sketch(rows: DataFrame, edit: str, depth: int, width: int) -> DataFrame:
    """(line, cell, cnt): a count-min sketch of the edits, at most ``depth * width`` rows, combined map-side."""
    cells = F.array(*[F.struct(F.lit(i).alias("line"), c.alias("cell")) for i, c in enumerate(_cells(F.col(edit), depth, width))])
    return rows.select(F.explode(cells).alias("x")).groupBy("x.line", "x.cell").agg(F.count("*").alias("cnt"))


def possible_edits(rows: DataFrame, total: int, edit: str = "edit", floor: float = FLOOR, depth: int = 4, cells: int = 1 << 20) -> DataFrame:
    """``rows`` without the edits that cannot be in more than ``floor`` of ``total`` taxa.

    An edit's count is at most that of each of its cells in a count-min sketch,
    so a cell at or under the floor rules all its edits out. The cells above it
    are few, at most the occurrences over the floor, and are broadcast line by
    line. A sketch has as many cells as hold the chance of a busy cell low, up to
    ``cells``; whatever their number, no edit that counts is lost.
    """
    n = rows.count()
    width = 1024
    while width < cells and width < 8 * n / max(1.0, floor * total):
        width *= 2
    full = stored(sketch(rows, edit, depth, width).where(F.col("cnt") / total > floor).select("line", "cell"))
    out = rows
    for i, cell in enumerate(_cells(F.col(edit), depth, width)):
        line = full.where(F.col("line") == i).select(F.col("cell").alias("_cell"))
        out = out.join(broadcast_if_small(line, limit=cells), cell == F.col("_cell"), "left_semi")
    return out


def vocabulary_of_many(rows: DataFrame, total: int, edit: str = "edit", floor: float = FLOOR) -> DataFrame:
    """``vocabulary`` (A4) where most of very many distinct edits are rare: only possible ones are shuffled and counted."""
    return vocabulary(possible_edits(rows, total, edit, floor), total, edit=edit, floor=floor)


def encode(rows: DataFrame, vocab: DataFrame, name: str = "name", edit: str = "edit") -> DataFrame:
    """(name, seq): pseudo-DNA over a sorted vocabulary (P3), from one row for each occurrence.

    Sites of the vocabulary's first half are T (present) or C, the others A or G.
    The vocabulary is numbered and joined, so that a taxon costs its own edits;
    the sites between them are written as runs.
    """
    sites = stored(ranked(vocab.select(edit).distinct(), [], [edit], "_site"))
    size = sites.count()
    half = size // 2 + 1
    have = rows.select(name, edit).join(broadcast_if_small(sites, size), edit, "left").groupBy(name).agg(F.sort_array(F.collect_set("_site")).alias("_have"))

    def run(a: Column, b: Column) -> Column:
        """The letters of absent edits from site a up to b."""
        zero = F.lit(0).cast("long")
        c = F.greatest(F.least(b, F.lit(half)) - a, zero)
        return F.concat(F.repeat(F.lit("C"), c.cast("int")), F.repeat(F.lit("G"), F.greatest(b - a - c, zero).cast("int")))

    after = lambda k: F.coalesce(F.get("_have", k - 1) + 1, F.lit(0).cast("long"))
    parts = F.transform("_have", lambda x, k: F.concat(run(after(k), x), F.when(x < half, "T").otherwise("A")))
    return have.select(name, F.concat(F.array_join(parts, ""), run(after(F.size("_have")), F.lit(size).cast("long"))).alias("seq"))


def gap_fractions(df: DataFrame, seq: str, gap: str = "-") -> DataFrame:
    """(pos, gap_fraction) of every column from 0 (A10)."""
    chars = df.select(F.posexplode(F.split(F.col(seq), "")).alias("pos", "ch")).where("ch <> ''")
    return chars.groupBy("pos").agg(F.avg((F.col("ch") == gap).cast("double")).alias("gap_fraction"))


def select_columns(df: DataFrame, keep: DataFrame, seq: str) -> DataFrame:
    """``seq`` on the columns (pos) in ``keep`` (P6): their list, no longer than a sequence, goes to every task."""
    one = keep.agg(F.sort_array(F.collect_list("pos")).alias("_keep")).select("_keep", F.lit(1).alias("_one"))
    return df.withColumn("_one", F.lit(1)).join(F.broadcast(one), "_one").withColumn(seq, F.array_join(F.transform("_keep", lambda i: F.substring(F.col(seq), i + 1, F.lit(1))), "")).drop("_one", "_keep")
