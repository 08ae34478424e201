"""Column expressions over names, sequences and counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rename_back(name: Column) -> Column:
    """``s0`` is the root again."""
    return F.when(name == "s0", F.lit("root")).otherwise(name)


def depth_limit(n: Column, threshold: int) -> Column:
    """max(floor(log2(n / threshold)) + 2, 2)."""
    return F.greatest(F.floor(F.log2(n / threshold)) + 2, F.lit(2)).cast("int")


def normalize_gaps(seq: Column, to: str = "-") -> Column:
    """``.`` as a gap (P4), or as ``N`` (P5); in sequences only, never in names."""
    return F.translate(seq, ".", to)


def leaf_tag(column: Column) -> Column:
    """``s12`` style names as their number."""
    return F.regexp_extract(column, r"^s(\d+)$", 1).try_cast("long")


def fasta_line(name: Column, seq: Column) -> Column:
    return F.concat(F.lit(">"), name, F.lit("\n"), seq)
