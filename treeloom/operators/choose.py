"""Which edge a query belongs to, and what follows from it."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from treeloom.operators.clades import preorder
from treeloom.operators.sampling import draw, sample
from treeloom.plans.durable import measured, stored, tables
from treeloom.plans.sizing import broadcast_if_small


def best_edge(cand: DataFrame, by: list[str], weight: str, order: str, edge: str = "edge") -> DataFrame:
    """The edge of highest weight, the first by ``order`` on ties (A7): one map-side combined aggregate."""
    return cand.groupBy(*by).agg(F.min(F.struct((-F.col(weight)).alias("w"), F.col(order).alias("o"), F.col(edge).alias("e"))).alias("m")).select(*by, F.col("m.e").alias(edge), (-F.col("m.w")).alias(weight))


def best_edge_mp(cand: DataFrame, by: list[str], seed: int | str, edge: str = "edge") -> DataFrame:
    """One of equally parsimonious edges, by seeded draw."""
    return cand.groupBy(*by).agg(F.min_by(edge, draw(seed, *by, edge)).alias(edge))


def top_k(cand: DataFrame, by: list[str], weight: str, order: str, k: int) -> DataFrame:
    """The ``k`` best candidates of each query."""
    w = Window.partitionBy(*by).orderBy(F.col(weight).desc(), F.col(order))
    return cand.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= k).drop("_rank")


#: Places that an entry of the next level of range minima covers for each of this one's.
FAN = 16


def _range_minima(pre: DataFrame, longest: int) -> DataFrame:
    """(level, place, least): the least ``up`` of the FAN**level places from ``place`` on, up to ranges of ``longest``."""
    spark = pre.sparkSession
    with tables(spark) as work:
        parts = [stored(pre.where("up IS NOT NULL").select(F.lit(0).alias("level"), "place", F.col("up").alias("least")))]
        while FAN ** len(parts) <= longest:
            step = FAN ** (len(parts) - 1)
            spread = parts[-1].select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(FAN - 1)), lambda i: F.col("place") - i * step)).alias("place"), "least")
            parts.append(stored(spread.where("place > 0").groupBy("place").agg(F.min("least").alias("least")).select(F.lit(len(parts)).alias("level"), "place", "least")))
        work.keep(*parts)
    return reduce(DataFrame.union, parts)


#: Places of a block, in which one task finds minima by itself; trees up to TREE_ROWS nodes need no blocks.
BLOCK, TREE_ROWS = 1 << 16, 200_000
#: Ranges that are looked up in a block at a time.
ASKED_ROWS = 250_000


def _least(asked: DataFrame, by: list[str], pre: DataFrame) -> DataFrame:
    """(by, least): the least ``up`` of ``pre`` (place, up) from ``_from`` to ``_to`` of each row (by, _from, _to); one row or more for each.

    Minima over ranges of FAN**k places answer that by at most FAN lookups; they
    take one row for a place and level.
    """
    asked, seen = measured(asked, longest=F.max(F.col("_to") - F.col("_from") + 1))
    minima = _range_minima(pre, seen["longest"] or 0)
    level = reduce(lambda a, b: a + b, [(F.col("_to") - F.col("_from") + 1 >= FAN**k).cast("int") for k in range(1, 16)])
    asked = asked.withColumn("level", level).withColumn("_width", F.expr(f"cast(power({FAN}, level) as bigint)"))
    whole = F.sequence(F.col("_from"), F.col("_to") - F.col("_width") + 1, F.col("_width"))
    looked = asked.select(*by, "level", F.explode(F.array_union(whole, F.array(F.col("_to") - F.col("_width") + 1))).alias("place"))
    return looked.join(broadcast_if_small(minima), ["level", "place"]).select(*by, "least")


def _least_by_blocks(asked: DataFrame, by: list[str], pre: DataFrame) -> DataFrame:
    """``_least`` for a large tree: places are dealt to blocks once, and a range is looked up in the blocks of its two ends.

    The blocks between them have one row each, in which ``_least`` looks. A block
    that very many ranges end in is dealt to several tasks.
    """
    block = lambda c: F.floor(F.col(c) / BLOCK)
    size, low, high = F.lit(BLOCK).cast("long"), block("_from"), block("_to")
    end = lambda at, a, b: F.struct(at.alias("block"), a.alias("a"), b.alias("b"))
    one = F.array(end(low, F.col("_from") - low * size, F.col("_to") - low * size))
    two = F.array(end(low, F.col("_from") - low * size, size - 1), end(high, F.lit(0).cast("long"), F.col("_to") - high * size))
    ends = asked.select(*by, F.explode(F.when(low == high, one).otherwise(two)).alias("x")).select(*by, "x.*")
    ups = pre.where("up IS NOT NULL").select(block("place").alias("block"), (F.col("place") % BLOCK).alias("at"), "up")
    parts = stored(ends.groupBy("block").agg(F.ceil(F.count("*") / ASKED_ROWS).alias("parts")))
    left = ends.join(broadcast_if_small(parts), "block").withColumn("part", F.pmod(F.xxhash64(*by, "a", "b"), F.col("parts"))).drop("parts")
    right = ups.join(broadcast_if_small(parts), "block").select("block", "at", "up", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))

    def run(asked: pd.DataFrame, ups: pd.DataFrame) -> pd.DataFrame:
        none = np.iinfo(np.int64).max
        minima = [np.full(BLOCK, none)]
        minima[0][ups["at"].to_numpy()] = ups["up"].to_numpy()
        for k in range(BLOCK.bit_length() - 1):
            minima.append(np.minimum(minima[k], np.concatenate([minima[k][1 << k :], np.full(1 << k, none)])))
        a, b = asked["a"].to_numpy(), asked["b"].to_numpy()
        k = np.frexp(b - a + 1)[1] - 1
        least = np.array(minima)[k, a]
        np.minimum(least, np.array(minima)[k, b - (1 << k) + 1], out=least)
        return asked[by].assign(least=least)[least < none]

    schema = asked.select(*by, F.lit(0).cast("long").alias("least")).schema
    met = left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInPandas(run, schema)
    between = asked.select(*by, (low + 1).alias("_from"), (high - 1).alias("_to")).where("_from <= _to")
    blocks = stored(ups.groupBy(F.col("block").alias("place")).agg(F.min("up").alias("up")))
    return met.unionByName(_least(between, by, blocks))


def lowest_common_ancestor(cand: DataFrame, by: list[str], tree: DataFrame, edge: str = "edge") -> DataFrame:
    """The deepest node above all candidates of a query (A8, T10), itself included. ``tree``: (node, parent).

    All nodes between two in preorder lie below the common ancestor of the two,
    so the first and the last candidate decide: two numbers for a query, combined
    map-side. Of the nodes after the first, up to the last, the least place of a
    parent is that of the common ancestor, however deep the tree is.
    """
    pre = preorder(tree)
    at, n = pre.select("node", "place"), pre.count()
    ends = cand.join(broadcast_if_small(at.withColumnRenamed("node", edge), n), edge).groupBy(*by).agg(F.min("place").alias("_first"), F.max("place").alias("_last"))
    ends = stored(ends)
    asked = ends.where("_first < _last").select(*by, (F.col("_first") + 1).alias("_from"), F.col("_last").alias("_to"))
    met = (_least if n <= TREE_ROWS else _least_by_blocks)(asked, by, pre).groupBy(*by).agg(F.min("least").alias("place"))
    met = met.unionByName(ends.where("_first = _last").select(*by, F.col("_first").alias("place")))
    return met.join(broadcast_if_small(at.withColumnRenamed("node", "lca"), n), "place").select(*by, "lca")


def problematic(placed: DataFrame, root_edge: Column | str, edge: str = "edge") -> DataFrame:
    """Rows on the root's edge."""
    return placed.where(F.col(edge) == root_edge)


def next_round_pool(sampled: DataFrame, bad: DataFrame, by: str | None = None, name: str = "name", limit: int | None = None, seed: int | str = 0) -> DataFrame:
    """The next round's pool (F7): sample and problematic rows as a bag.

    With ``limit``, at most so many problematic rows of each ``by`` (F6, W8): the
    cap is pushed below the shuffle, as in a sample.
    """
    return sampled.unionByName(bad if limit is None else sample(bad, by, name, limit, seed))


def edge_members(edges: DataFrame, placed: DataFrame, edge: str, name: str) -> DataFrame:
    """(edge, n, name): a row for each name on an edge, and one without a name for an empty edge.

    Rows, not a list for each edge: an edge may hold most names. Placed rows stay
    where they are and meet the full edges and their counts, which go to every
    task; empty edges are added. Beyond the limit of a broadcast it is an inner
    join, whose hot keys Spark can split.
    """
    n = placed.groupBy(edge).agg(F.count("*").alias("n"))
    full = stored(n.join(edges.select(edge).distinct(), edge, "left_semi"))
    empty = edges.select(edge).distinct().join(full, edge, "left_anti").select(edge, F.lit(0).cast("long").alias("n"), F.lit(None).cast(placed.schema[name].dataType).alias(name))
    return placed.select(edge, name).join(broadcast_if_small(full), edge).select(edge, "n", name).union(empty)
