"""Parsimony placement by tables against the lengths of full trees and against the array version."""

import random

from pyspark.sql import functions as F

from treeloom import kernel_queries
from treeloom.kernels import parsimony as arrays
from treeloom.kernels.tree import Tree
from treeloom.operators import parsimony


def _clade(rng, n, sites, letters="ACGT"):
    """A random tree of n leaves (node 0 the top, some nodes with three children, some long chains) with sequences."""
    tree = Tree([-1], [None], [0.0])
    tips = [0]
    while len(tips) < n:
        v = tips.pop(rng.randrange(len(tips)) if rng.random() < 0.5 else -1)
        tips += [tree.add(v) for _ in range(rng.choice([2, 2, 2, 3]))]
    tree = tree.renumbered()
    inner = set(tree.parent)
    tree.name = [None if v in inner else f"t{v}" for v in range(len(tree))]
    return tree, {tree.name[v]: "".join(rng.choices(letters, k=sites)) for v in range(len(tree)) if v not in inner}, "".join(rng.choices(letters, k=sites))


def test_costs_equal_those_of_full_trees(spark):
    rng = random.Random(4)
    clades = {c: _clade(rng, n, sites, letters) for c, (n, sites, letters) in enumerate([(2, 64, "ACGT"), (5, 1, "ACGT"), (9, 130, "ACGT-"), (14, 63, "AC"), (30, 200, "ACGTNacgt."), (1, 10, "ACGT")])}
    nodes = [(c, v, p if p >= 0 else None) for c, (t, _, _) in clades.items() for v, p in enumerate(t.parent)]
    leaves = [(c, v, seqs[n]) for c, (t, seqs, _) in clades.items() for v, n in enumerate(t.name) if n]
    as_sets = lambda rows: spark.createDataFrame(rows, "clade_id long, node int, seq string").select("clade_id", "node", parsimony.planes(F.col("seq")).alias("sets"))
    roots = as_sets([(c, 0, r) for c, (_, _, r) in clades.items()]).drop("node")
    edges = parsimony.edge_sets(spark.createDataFrame(nodes, "clade_id long, node int, parent int"), as_sets(leaves), roots)
    queries = [(c, f"q{i}", "".join(rng.choices("ACGT-", k=len(r)))) for c, (_, _, r) in clades.items() for i in range(4)]
    rows = spark.createDataFrame(queries, "clade_id long, name string, seq string")
    lists = edges.withColumnRenamed("sets", "e").join(rows.withColumn("q", parsimony.planes(F.col("seq"))), "clade_id")
    got = {(r.clade_id, r.name, r.node): r.cost for r in lists.select("clade_id", "name", "node", parsimony.steps(F.col("e"), F.col("q")).alias("cost")).collect()}
    best = {(r.clade_id, r.name): (r.edge, r.cost) for r in parsimony.place(rows, edges, 7).collect()}
    for c, name, seq in queries:
        tree, seqs, root = clades[c]
        leaf = {n: arrays.state_sets([s])[0] for n, s in seqs.items()}
        q, r = arrays.state_sets([seq])[0], arrays.state_sets([root])[0]
        costs = [got[c, name, v] for v in range(len(tree))]
        assert costs == arrays.insertion_costs(tree, leaf, r, q).tolist()
        if all(tree.parent.count(v) in (0, 2) for v in range(len(tree))):  # lengths of polytomies depend on the order of children
            base = arrays.length(tree, leaf, r)
            for v in range(len(tree)):
                grown = Tree(list(tree.parent), list(tree.name), list(tree.length))
                joint = grown.add(grown.parent[v])
                grown.parent[v] = joint
                grown.add(joint, "query")
                assert arrays.length(grown.renumbered(), leaf | {"query": q}, r) - base == costs[v]
        edge, cost = best[c, name]
        assert cost == min(costs) and costs[edge] == cost


def test_query_equals_the_array_version(spark):
    d = "/root/testdata/sf0.001"
    got = {(r.clade_id, r.name): r.edge for r in kernel_queries.mp_place(spark, d).collect()}
    want = {(r.clade_id, r.name): r.edge for r in kernel_queries._placed(spark, d, placement="MP").collect()}
    assert got == want and len(got) == 500


def test_edge_cases(spark):
    assert spark.range(1).select(F.size(parsimony.planes(F.lit("")))).first()[0] == 0
    top = spark.range(1).select(parsimony.planes(F.lit("A" * 64))[0].alias("x")).first().x
    assert (top.A, top.C) == (-1, 0)
    none = parsimony.edge_sets(spark.createDataFrame([], "clade_id long, node int, parent int"), spark.createDataFrame([(1, 1, "A")], "clade_id long, node int, seq string").select("clade_id", "node", parsimony.planes(F.col("seq")).alias("sets")).limit(0), spark.createDataFrame([(1, "A")], "clade_id long, seq string").select("clade_id", parsimony.planes(F.col("seq")).alias("sets")))
    assert none.count() == 0
