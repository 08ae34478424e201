"""Tree tables: closure, depth, preorder, subtree counts, the clade cut, induced trees, re-rooting, routing, numbering."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treeloom.operators.ranking import ranked, running
from treeloom.plans.durable import counted, measured, stored, tables
from treeloom.plans.sizing import broadcast_if_small


def closure(tree: DataFrame) -> DataFrame:
    """(node, ancestor, distance), each node above itself at 0, from (node, parent) rows.

    Paths double in length at each step, so a chain of d nodes takes log2(d) joins.
    """
    known = tree.select("node", F.col("node").alias("ancestor"), F.lit(0).alias("distance"))
    step = stored(tree.where("parent IS NOT NULL").select("node", F.col("parent").alias("ancestor")))
    known = stored(known.union(step.withColumn("distance", F.lit(1))))
    hop, reach = step, 1
    while True:
        # hop: exactly `reach` levels up; known: every pair up to `reach`
        further = hop.select(F.col("node").alias("low"), F.col("ancestor").alias("mid")).join(known.where("distance > 0"), F.col("mid") == F.col("node"))
        new = stored(further.select(F.col("low").alias("node"), "ancestor", (F.col("distance") + reach).alias("distance")))
        if new.isEmpty():
            return known
        known = stored(known.union(new))
        hop = new.where(F.col("distance") == 2 * reach).select("node", "ancestor")
        reach *= 2


#: Nodes of one range of a tree, which a task works on by itself.
RANGE_ROWS = 500_000

_FOLDS = {
    "sum": (np.add, lambda x, above: x + above),
    "any": (np.logical_or, lambda x, above: x | above),
    "first": (lambda x, above: np.where(pd.isnull(x), above, x), F.coalesce),
}


def _within(rows: DataFrame, n: int, kind: str) -> DataFrame:
    """``rows`` (node, up, x, ...) by ranges of nodes, with ``all``, x folded over what of a node's range lies above it
    (``down``: summed over what lies below), the range's highest node above it, ``_root``, the one above that, ``_out``,
    and the range's number, ``_range``. Spark draws the ranges' bounds from a sample, each time anew: rows that have a
    ``_range`` stay in it."""
    parts = -(-n // RANGE_ROWS)
    again = "_range" in rows.columns
    dealt = rows.repartitionById(parts, F.col("_range")) if again else rows.repartitionByRange(parts, "node") if parts > 1 else rows.repartition(1)
    fields = {f.name: f.dataType for f in rows.schema.fields}
    schema = T.StructType([*rows.schema.fields, T.StructField("all", fields["x"]), T.StructField("_root", fields["node"]), T.StructField("_out", fields["up"]), *([] if again else [T.StructField("_range", T.IntegerType())])])
    fold = None if kind == "down" else _FOLDS[kind][0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        t = pa.Table.from_batches(held).combine_chunks()
        at = pc.fill_null(pc.index_in(t["up"], value_set=t["node"].combine_chunks()), -1).to_numpy().astype(np.int64)
        if again:  # a task may get several ranges
            of = t["_range"].to_numpy()
            at = np.where((at >= 0) & (of[at] == of), at, -1)
        x = np.array(t["x"].to_pandas())
        root = np.where(at >= 0, at, np.arange(len(at)))
        for _ in range(64):
            on = np.flatnonzero(at >= 0)
            if not len(on):
                break
            p = at[on]
            if fold is None:
                np.add.at(x, p, x[on])
            else:
                x[on] = fold(x[on], x[p])
            root[on] = root[p]
            up = np.full(len(at), -1)
            up[on] = at[p]
            at = up
        else:
            raise ValueError("a node of the tree lies above itself")
        for name, column in (("all", pa.array(x, t["x"].type, from_pandas=True)), ("_root", t["node"].take(pa.array(root))), ("_out", t["up"].take(pa.array(root)))):
            t = t.append_column(name, column)
        if not again:
            t = t.append_column("_range", pa.array(np.full(len(at), TaskContext.get().partitionId(), np.int32)))
        yield from t.to_batches(max_chunksize=10_000)

    return dealt.mapInArrow(run, schema)


def folded_up(start: DataFrame, kind: str) -> DataFrame:
    """``start`` (node, up, x, ...) with ``all``: x folded from each node over all nodes above it; ``sum``, ``any`` or the ``first`` that is not null.

    Nodes meet in ranges of their names, where a task folds paths as far as they
    stay in the range. What leaves a range is known by the node it leaves to; if
    few nodes are left to, they are a small tree that is folded in the same way,
    else pointers between them double. So a tree whose near nodes have near names
    is shuffled once, however deep it is, and any other tree a number of times
    that is logarithmic in its depth.
    """
    fold = _FOLDS[kind][1]
    names = [*start.columns, "all"]
    with tables(start.sparkSession) as work:
        rows, n = counted(start)
        at = stored(_within(rows, n, kind).select(*names, *(["_out"] if n > RANGE_ROWS else [])))
        work.drop(rows)
        if n > RANGE_ROWS:
            left, m = counted(at.where("_out IS NOT NULL").select(F.col("_out").alias("node")).distinct())
            above = at.join(broadcast_if_small(left, m), "node", "left_semi").select("node", F.col("_out").alias("up"), F.col("all").alias("x"))
            far = (folded_up if 2 * m <= n else _doubled)(above, kind)
            far = far.select(F.col("node").alias("_out"), F.col("all").alias("_far"))
            near, at = at, stored(at.join(broadcast_if_small(far, m), "_out", "left").withColumn("all", F.when(F.col("_far").isNull(), F.col("all")).otherwise(fold(F.col("all"), F.col("_far")))).select(*names))
            work.drop(near)
        work.keep(at)
    return at


def _doubled(start: DataFrame, kind: str) -> DataFrame:
    """(node, all) of ``start`` (node, up, x): round k joins a node to its ancestor 2**k levels up."""
    fold, left = _FOLDS[kind][1], F.count_if(F.expr("up IS NOT NULL AND x IS NULL" if kind == "first" else "up IS NOT NULL"))
    with tables(start.sparkSession) as work:
        at, seen = measured(start, left=left)
        while seen["left"]:
            below = at
            above = at.select(F.col("node").alias("_node"), F.col("up").alias("_up"), F.col("x").alias("_x"))
            at, seen = measured(at.join(above, F.col("up") == F.col("_node"), "left").select("node", F.col("_up").alias("up"), F.when(F.col("_node").isNull(), F.col("x")).otherwise(fold(F.col("x"), F.col("_x"))).alias("x")), left=left)
            work.drop(below)
        work.keep(at)
    return at.select("node", F.col("x").alias("all"))


def _summed(start: DataFrame) -> DataFrame:
    """``start`` (node, up, x, ...) with ``all``: x summed over each node and all below it.

    By ranges, as in ``folded_up``: the sums of the highest nodes of all ranges
    are a smaller tree, and what that sends into a range from outside is summed there.
    """
    names = [*start.columns, "all"]
    with tables(start.sparkSession) as work:
        rows, n = counted(start)
        at = stored(_within(rows, n, "down").select(*names, *(["_root", "_range"] if n > RANGE_ROWS else [])))
        work.drop(rows)
        if n > RANGE_ROWS:
            tops, m = counted(at.where("node = _root AND up IS NOT NULL").select("node", F.col("up").alias("_port"), F.col("all").alias("x")))
            home = at.join(broadcast_if_small(tops.select(F.col("_port").alias("node")).distinct(), m), "node", "left_semi").select(F.col("node").alias("_port"), F.col("_root").alias("up"))
            least = tops.join(home, "_port", "left").select("node", "up", "x", "_port")
            sent = _summed(least) if 2 * m <= n else _doubled_sums(least)
            sent, ports = counted(sent.groupBy(F.col("_port").alias("node")).agg(F.sum("all").alias("_in")))
            more = at.drop("_root").withColumnsRenamed({"x": "_x", "all": "_own"}).join(broadcast_if_small(sent, ports), "node", "left").withColumn("x", F.coalesce("_in", F.lit(0).cast("long"))).drop("_in")
            near, at = at, stored(_within(more, n, "down").withColumn("all", F.col("_own") + F.col("all")).withColumn("x", F.col("_x")).select(*names))
            work.drop(near)
        work.keep(at)
    return at


def _doubled_sums(start: DataFrame) -> DataFrame:
    """``start`` (node, up, x, _port) with ``all``; round k adds to each node what its descendants 2**k levels down have summed so far."""
    left = F.count_if(F.col("up").isNotNull())
    with tables(start.sparkSession) as work:
        at, seen = measured(start.select("node", "up", "_port", F.col("x").alias("all")), left=left)
        while seen["left"]:
            below = at
            got = at.where("up IS NOT NULL").groupBy(F.col("up").alias("_node")).agg(F.sum("all").alias("_n"))
            above = at.select(F.col("node").alias("_mid"), F.col("up").alias("_up"))
            at = at.join(got, F.col("node") == F.col("_node"), "left").join(above, F.col("up") == F.col("_mid"), "left")
            at, seen = measured(at.select("node", F.col("_up").alias("up"), "_port", (F.col("all") + F.coalesce("_n", F.lit(0))).alias("all")), left=left)
            work.drop(below)
        work.keep(at)
    return at


def depths(tree: DataFrame) -> DataFrame:
    """(node, depth): edges between a node and the top."""
    start = tree.select("node", F.col("parent").alias("up"), F.when(F.col("parent").isNull(), 0).otherwise(1).alias("x"))
    return folded_up(start, "sum").select("node", F.col("all").alias("depth"))


def subtree_counts(tree: DataFrame, counts: DataFrame) -> DataFrame:
    """(node, n): what is counted at a node or below, where there is any (A6). ``counts``: (node, cnt)."""
    start = tree.join(counts, "node", "left").select("node", F.col("parent").alias("up"), F.coalesce("cnt", F.lit(0)).cast("long").alias("x"))
    return _summed(start).where(F.col("all") > 0).select("node", F.col("all").alias("n"))


def preorder(tree: DataFrame) -> DataFrame:
    """(node, parent, place, up): each node's place from 0 on, its parent's before it and siblings by name; ``up`` is the parent's.

    A node comes one after its parent and all that lies under earlier siblings;
    these steps add up along its ancestors.
    """
    with tables(tree.sparkSession) as work:
        size = _summed(tree.select("node", F.col("parent").alias("up"), F.lit(1).cast("long").alias("x"))).select("node", "up", F.col("all").alias("n"))
        beside = running(size, ["up"], ["node"], {"before": F.col("n")})
        step = F.when(F.col("up").isNull(), F.lit(0).cast("long")).otherwise(F.col("before") - F.col("n") + 1)
        out = folded_up(beside.select("node", "up", step.alias("x")), "sum")
        work.keep(out)
    return out.select("node", F.col("up").alias("parent"), F.col("all").alias("place"), F.when(F.col("up").isNotNull(), F.col("all") - F.col("x")).alias("up"))


def path_up(tree: DataFrame, node: str) -> DataFrame:
    """(node, step): a node at 0 and its ancestors, the top last; pointers double, so that a deep one takes few rounds."""
    with tables(tree.sparkSession) as work:
        jump = stored(tree.select("node", F.col("parent").alias("up")))
        path, reach = stored(jump.where(F.col("node") == node).select("node", F.lit(0).alias("step"))), 1
        while True:
            further, seen = measured(jump.join(broadcast_if_small(path), "node").where("up IS NOT NULL").select(F.col("up").alias("node"), (F.col("step") + reach).alias("step")), n=F.count(F.lit(1)))
            if not seen["n"]:
                break
            path, reach = stored(path.union(further)), 2 * reach
            above = jump.select(F.col("node").alias("_node"), F.col("up").alias("_up"))
            jump = stored(jump.join(above, F.col("up") == F.col("_node")).select("node", F.col("_up").alias("up")))
        work.keep(path)
    return path


def reroot(tree: DataFrame, outgroup: str, top: str | None = None) -> DataFrame:
    """(node, parent, name, length) of ``tree`` rooted at the leaf named ``outgroup``.

    The edges between the leaf and the old top turn round and take their lengths
    along. The leaf goes and its neighbour is the top, with the leaf's length as
    its own; or, with ``top``, a node of that name is put above both (T1), the
    leaf at a distance of 0. The old top goes if it is left with one child, which
    then takes its length as well, or with no child and no name.
    """
    at = tree.where(F.col("name") == outgroup).select("node", "parent").take(2)
    if len(at) != 1 or at[0].parent is None:
        raise ValueError(f"{outgroup!r} is the name of {len(at)} nodes, or of the top")
    leaf = at[0].node
    if not tree.where(F.col("parent") == leaf).isEmpty():
        raise ValueError(f"{outgroup!r} has children")
    path = path_up(tree, leaf)
    on = stored(tree.join(broadcast_if_small(path), "node").select("node", "parent", "name", "length", "step"))
    turned = on.where("step > 0").join(on.select((F.col("step") + 1).alias("step"), F.col("node").alias("below"), F.col("length").alias("under")), "step")
    new_parent = F.when(F.col("step") == 1, F.lit(top)).otherwise(F.col("below"))
    turned = stored(turned.select("node", new_parent.alias("_parent"), F.col("under").alias("_length"), (F.col("parent").isNull()).alias("_old_top"), "name"))
    old = turned.where("_old_top").first()  # one row
    kids = tree.where((F.col("parent") == old.node)).join(broadcast_if_small(path.select("node")), "node", "left_anti").limit(2).collect()
    gone = [leaf] + ([old.node] if len(kids) == 1 or (not kids and old.name is None) else [])
    both = tree.join(broadcast_if_small(turned.select("node", "_parent", "_length", F.lit(True).alias("_turned"))), "node", "left")
    parent, length = F.when(F.col("_turned"), F.col("_parent")).otherwise(F.col("parent")), F.when(F.col("_turned"), F.col("_length")).otherwise(F.col("length"))
    if len(kids) == 1:
        heir = F.col("node") == kids[0].node
        parent, length = F.when(heir, F.lit(old._parent)).otherwise(parent), F.when(heir, F.coalesce("length", F.lit(0.0)) + F.lit(old._length or 0.0)).otherwise(length)
    out = both.where(~F.col("node").isin(gone)).select("node", parent.alias("parent"), "name", length.alias("length"))
    if top is None:
        return out
    return out.union(tree.sparkSession.createDataFrame([(top, None, None, None), (leaf, top, outgroup, 0.0)], out.schema))


def clade_cut(tree: DataFrame, counts: DataFrame, top: str, limit: int) -> DataFrame:
    """(node, kind, n): the cut tips below ``top`` (T4), ``cut`` with what they own and ``empty`` leaves.

    From the children of the top down: a node without counts, above the depth
    limit, is gone through (an empty leaf stays as a tip); any other is cut and
    owns all that lies at or below it. A node is reached if no node above it,
    the top apart, was cut.
    """
    depth = depths(tree).select("node", (F.col("depth") + 1).alias("depth"))  # the top is at path depth 1
    leaf = tree.select(F.col("parent").alias("node")).where("node IS NOT NULL").distinct().withColumn("inner", F.lit(True))
    state = tree.join(depth, "node").join(counts, "node", "left").join(leaf, "node", "left")
    stop = (F.col("node") != top) & ((F.coalesce("cnt", F.lit(0)) > 0) | (F.col("depth") >= limit))
    state = stored(state.select("node", "parent", stop.alias("stop"), F.coalesce("inner", F.lit(False)).alias("inner")))
    up = state.select(F.col("node").alias("_of"), F.col("stop").alias("_stop"))
    hidden = folded_up(state.join(up, F.col("parent") == F.col("_of"), "left").select("node", F.col("parent").alias("up"), F.coalesce("_stop", F.lit(False)).alias("x")), "any").select("node", F.col("all").alias("x"))
    reached = state.join(hidden, "node").where((F.col("node") != top) & ~F.col("x") & (F.col("stop") | ~F.col("inner")))
    n = subtree_counts(tree, counts)
    return reached.join(n, "node", "left").select("node", F.when(F.col("stop"), "cut").otherwise("empty").alias("kind"), F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def route(rows: DataFrame, assignment: DataFrame, on: list[str], child: str = "child_clade_id") -> DataFrame:
    """Every row with its child clade (J1); a row without one is kept with null, for the caller to discard."""
    return rows.join(assignment.select(*on, child), on, "left")


def induced_subtree(tree: DataFrame, keep: DataFrame) -> DataFrame:
    """(node, parent) of the tree on the leaves in ``keep``.

    A node that loses a child disappears; survivors hang on the nearest ancestor
    that lost none. The top stays.
    """
    alive = stored(subtree_counts(tree, keep.select("node").distinct().withColumn("cnt", F.lit(1))).select("node", F.lit(True).alias("alive")))
    child = tree.select(F.col("node").alias("child"), "parent").where("parent IS NOT NULL").join(alive.select(F.col("node").alias("child"), "alive"), "child", "left")
    # every child alive (bool_and), by parent
    whole = child.groupBy(F.col("parent").alias("node")).agg(F.bool_and(F.coalesce("alive", F.lit(False))).alias("whole"))
    state = tree.join(alive, "node", "left_semi").join(whole, "node", "left").select("node", "parent", (F.coalesce("whole", F.lit(True)) | F.col("parent").isNull()).alias("stays"))
    state = stored(state)
    up = state.where("stays").select(F.col("node").alias("_of"))
    start = state.join(up, F.col("parent") == F.col("_of"), "left").select("node", F.col("parent").alias("up"), F.col("_of").alias("x"))
    near = folded_up(start, "first").select("node", F.col("all").alias("x"))
    return state.where("stays").select("node").join(near, "node", "left").select("node", F.col("x").alias("parent"))


def number_tips(tips: DataFrame, order: str, offset: int) -> DataFrame:
    """Child clade ids from ``offset`` + 1 on (T12), in ``order``."""
    return ranked(tips, [], [order], "_place").withColumn("child_clade_id", F.col("_place") + (offset + 1)).drop("_place")


def without_rows(tips: DataFrame, rows: DataFrame, on: list[str]) -> DataFrame:
    """Tips that no row belongs to (J6, C6): they get no job."""
    return tips.join(rows.select(*on), on, "left_anti")


def pool_of(n: Column, limit: int) -> Column:
    """Which resources a clade needs."""
    return F.when(n > limit, "large").otherwise("standard")


def tiny_tree(groups: DataFrame, by: str, name: str) -> DataFrame:
    """Newick of groups of one or two names (T8); larger groups are an error."""
    names = groups.groupBy(by).agg(F.sort_array(F.collect_list(name)).alias("names"))
    n = F.size("names")
    return names.select(by, F.when(n == 1, F.concat(F.element_at("names", 1), F.lit(";"))).when(n == 2, F.concat(F.lit("("), F.array_join("names", ","), F.lit(");"))).otherwise(F.raise_error(F.lit("a tiny tree has one or two names"))).alias("newick"))


def graft(levels: list[DataFrame]) -> DataFrame:
    """The whole tree from per-level (node, parent) tables (T9, J8): ids are global, so pieces join by union."""
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out.distinct()
