"""Parsimony placement as tables (X9): site sets packed 64 to a long, folded over trees, compared by bit operations.

A sequence is an array of blocks of 64 sites, each with one long for each base:
a bit says that the site may have that base. Fitch's rule, the intersection of
two sets or their union where it is empty, and the number of sites at which a
query must change, are a few bit operations for a block. All trees are folded
together, one join for each level of the deepest; queries meet the edges of
their tree in a broadcast join behind a check of its size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeloom.operators.clades import depths
from treeloom.operators.sampling import draw
from treeloom.plans.durable import measured, stored, tables
from treeloom.plans.sizing import broadcast_if_small

#: Fixed value: the bases, in the order of a block's longs.
BASES = "ACGT"
#: Bytes of edge sets that may be broadcast to the queries.
EDGE_BYTES = 64 << 20


def planes(seq: Column) -> Column:
    """``seq`` as blocks of 64 sites; a letter that is no base may be any, and so may what is missing of the last block."""
    known = F.regexp_replace(F.upper(seq), f"[^{BASES}]", "N")
    blocks = F.ceil(F.length(seq) / 64).cast("int")

    def block(i: Column) -> Column:
        part = F.rpad(F.substring(known, i * 64 + 1, F.lit(64)), 64, "N")
        bits = lambda b: F.conv(F.translate(part, BASES + "N", "".join("01"[x == b] for x in BASES) + "1"), 2, -10).cast("long")
        return F.struct(*[bits(b).alias(b) for b in BASES])

    return F.when(blocks > 0, F.transform(F.sequence(F.lit(0), blocks - 1), block)).otherwise(F.array().cast(f"array<struct<{','.join(f'{b}:bigint' for b in BASES)}>>"))


def _shared(x: Column, y: Column) -> Column:
    """The sites of a block at which two sets meet."""
    out = x[BASES[0]].bitwiseAND(y[BASES[0]])
    for b in BASES[1:]:
        out = out.bitwiseOR(x[b].bitwiseAND(y[b]))
    return out


def meet(a: Column, b: Column) -> Column:
    """Fitch's rule on all blocks: where two sets meet their intersection, else their union."""

    def block(x: Column, y: Column) -> Column:
        apart = F.bitwise_not(_shared(x, y))
        return F.struct(*[x[k].bitwiseAND(y[k]).bitwiseOR(x[k].bitwiseOR(y[k]).bitwiseAND(apart)).alias(k) for k in BASES])

    return F.zip_with(a, b, block)


def steps(edge: Column, query: Column) -> Column:
    """How many steps a tree grows by if ``query`` joins ``edge``: the sites at which their sets are apart."""
    return F.aggregate(F.zip_with(edge, query, lambda x, y: F.lit(64) - F.bit_count(_shared(x, y))), F.lit(0), lambda n, x: n + x)


def edge_sets(nodes: DataFrame, leaves: DataFrame, roots: DataFrame) -> DataFrame:
    """(clade_id, node, sets): what the two ends of each edge have in common by Fitch's rule, the rest of the tree and the outgroup included.

    ``nodes``: (clade_id, node, parent), node numbers being unique in a clade and
    a clade's top without a parent; ``leaves``: (clade_id, node, sets);
    ``roots``: (clade_id, sets), the outgroup at the top. Siblings count in the
    order of their numbers.
    """
    spark = nodes.sparkSession
    with tables(spark) as work:
        key = F.concat_ws("|", "clade_id", "node")
        up = F.when(F.col("parent").isNotNull(), F.concat_ws("|", "clade_id", "parent"))
        named = stored(nodes.select("clade_id", F.col("node").alias("own"), key.alias("node"), up.alias("parent")))
        deep, seen = measured(named.join(depths(named.select("node", "parent")), "node"), most=F.max("depth"))
        tips = leaves.select(key.alias("node"), "sets")
        deep = stored(deep.join(tips, "node", "left"))
        levels = {}
        kids = None
        most = -1 if seen["most"] is None else seen["most"]
        for d in range(most, -1, -1):  # from the deepest level up: a node's set from its children's
            here = deep.where(F.col("depth") == d)
            if kids is not None:
                fold = F.aggregate(F.slice("kids", 2, 1 << 30), F.col("kids")[0]["sets"], lambda x, k: meet(x, k["sets"]))
                here = here.join(kids.select("node", fold.alias("folded")), "node", "left").withColumn("sets", F.coalesce("folded", "sets")).drop("folded")
            levels[d] = stored(here)
            kids = levels[d].groupBy(F.col("parent").alias("node")).agg(F.sort_array(F.collect_list(F.struct("own", "sets"))).alias("kids"))  # as many as a node has children
        above, parts = None, []
        for d in range(most + 1):  # and down: the set of all the rest
            here = levels[d].withColumnRenamed("sets", "below")
            if above is None:
                here = here.join(broadcast_if_small(roots.withColumnRenamed("sets", "above")), "clade_id")
            else:
                beside = levels[d].groupBy("parent").agg(F.sort_array(F.collect_list(F.struct("own", "sets"))).alias("kids"))
                here = here.join(beside, "parent").join(above.select(F.col("node").alias("parent"), F.col("above").alias("rest")), "parent")
                others = F.filter("kids", lambda k: k["own"] != F.col("own"))
                here = here.withColumn("above", F.aggregate(others, F.col("rest"), lambda x, k: meet(x, k["sets"]))).drop("kids", "rest")
            above = stored(here.select("clade_id", "own", "node", "below", "above"))
            parts.append(above.select("clade_id", F.col("own").alias("node"), meet(F.col("below"), F.col("above")).alias("sets")))
        if not parts:
            return nodes.select("clade_id", "node").where("false").join(leaves, ["clade_id", "node"])
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        out = stored(out)
        work.keep(out)
    return out


def place(rows: DataFrame, edges: DataFrame, seed: int | str, seq: str = "seq", name: str = "name") -> DataFrame:
    """``rows`` (clade_id, name, seq, ...) with ``edge`` and ``cost``: the edge at which a tree grows least, drawn by seed among equals."""
    lists = edges.groupBy("clade_id").agg(F.sort_array(F.collect_list(F.struct(F.col("node").alias("edge"), "sets"))).alias("_edges"))  # a sample's edges
    lists, seen = measured(lists, bytes=F.sum(F.size("_edges") * (16 + 32 * F.size(F.col("_edges")[0]["sets"]))))
    held = F.broadcast(lists) if (seen["bytes"] or 0) <= EDGE_BYTES else lists
    met = rows.withColumn("_planes", planes(F.col(seq))).join(held, "clade_id")
    each = F.transform("_edges", lambda e: F.struct(steps(e["sets"], F.col("_planes")).alias("cost"), draw(seed, F.col("clade_id").cast("string"), name, e["edge"].cast("string")).alias("draw"), e["edge"].alias("edge")))
    best = met.withColumn("_best", F.array_min(each))
    return best.select(*rows.columns, F.col("_best.edge").cast("int").alias("edge"), F.col("_best.cost").alias("cost"))
