"""Sampling, dedup, renaming and counting of taxa."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from treeloom.operators.ranking import ranked


def draw(seed: int | str, *parts: Column | str) -> Column:
    """A seeded pseudo-random order: the MD5 of the seed and the parts, joined by ``|``."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(p).cast("string") if isinstance(p, str) else p for p in parts]))


def sample(df: DataFrame, by: str, name: str, k: int, seed: int | str, *also: Column | str) -> DataFrame:
    """At most ``k`` rows of each ``by``, uniformly without replacement (W1); all where there are no more.

    The rank limit is pushed below the shuffle, so each task sends on at most
    ``k`` rows of a group, also where one group holds nearly all rows.
    """
    w = Window.partitionBy(by).orderBy(draw(seed, by, *also, name), name)
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= k).drop("_rank")


def dedup_sequences(df: DataFrame, by: list[str], seq: str, order: str, root: str | None = None) -> DataFrame:
    """The first row (by ``order``) of each equal ``seq`` (F2), without those that equal the root's."""
    first = df.groupBy(*by, seq).agg(F.min(order).alias(order))
    return first if root is None else first.where(F.col(seq) != root)


def dense_rename(df: DataFrame, by: list[str], order: str, first: Column | None = None) -> DataFrame:
    """``new_name`` s0, s1, ... within ``by`` (P1); rows where ``first`` holds come first, so that a root is s0."""
    keys = ([F.when(first, 0).otherwise(1)] if first is not None else []) + [F.col(order)]
    return ranked(df, by, keys, "_place").withColumn("new_name", F.concat(F.lit("s"), F.col("_place").cast("string"))).drop("_place")


def root_row(df: DataFrame, name: str = "name") -> DataFrame:
    """The outgroup's row."""
    return df.where(F.col(name) == "root")


def without_root(df: DataFrame, name: str = "name", prefix: bool = False) -> DataFrame:
    """Rows other than the root's (F1), or other than names that start so."""
    return df.where(~F.col(name).rlike("^root") if prefix else F.col(name) != "root")


def count_by(df: DataFrame, *by: str) -> DataFrame:
    """(by, n): rows of each group (A1, A5)."""
    return df.groupBy(*by).agg(F.count("*").alias("n"))


def total(counts: DataFrame) -> DataFrame:
    """The sum of the parts' counts."""
    return counts.agg(F.sum("n").alias("n"))


def count_and_length(df: DataFrame, by: str, seq: str) -> DataFrame:
    """(by, n, mean_length) with the mean cut to a whole number (A1, A3)."""
    return df.groupBy(by).agg(F.count("*").alias("n"), F.expr(f"sum(length({seq})) div count(*)").alias("mean_length"))


def split_reference(df: DataFrame, names: DataFrame, on: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose name is among ``names``, and the others."""
    return df.join(names, on, "left_semi"), df.join(names, on, "left_anti")
