"""Trees as tables, of odd shapes: reading text, common ancestors, re-rooting, pruning, running sums, hot edges, tables that leave."""

import os
import random

import pytest
from pyspark.sql import functions as F

from treeloom.kernels.sample_tree import _rooted
from treeloom.kernels.tree import Tree, parse_newick, robinson_foulds, to_newick
from treeloom.operators import choose, clades, encode, ranking
from treeloom.operators.ranking import ranked, running
from treeloom.plans import durable, engine
from treeloom.plans.durable import counted, measured, stored, tables
from treeloom.sources import newick
from treeloom.sources.trees import newick_tokens, write_newick

TEXTS = [
    "((a:1,b:2)x:1,(c:1,d:2)y:3)r;", "only;", "(a[note, (x)]:1e-3,b);", "('it''s, (so)':0.25,'x y':0.0,(p:0.5,q:0.5):1.0);", "(,(,));", "((((A)B)C)D)E;",
    "(A:0.1{0},B:0.2{1}){2};", " ( a ,\n b ) c ;\n", "(a,b)(c;"[:5] + ";", "[first](a,b[&rate=0.1,x={1,2}]:3);",
]


@pytest.fixture(params=[50_000, 0], ids=["window", "ranges"])
def size(request, monkeypatch):
    """Small tables by a window, and as if every table were large."""
    monkeypatch.setattr(ranking, "WINDOW_ROWS", request.param)


def _rows(text):
    t = parse_newick(text).renumbered()
    inner = set(t.parent)
    return [(i, p if p >= 0 else None, n, x, i not in inner) for i, (p, n, x) in enumerate(zip(t.parent, t.name, t.length, strict=True))]


def _read(df):
    out = {}
    for r in df.collect():
        assert r.edge_num == r.node_id
        out.setdefault(r.tree_id, []).append((r.node_id, r.parent_id, r.name, r.branch_length, r.is_leaf))
    return {k: sorted(v) for k, v in out.items()}


def _random_tree(rng, n):
    """(node, parent) of n nodes, some of them in long chains."""
    return [(f"v{i}", None if i == 0 else f"v{i - 1 if rng.random() < 0.6 else rng.randrange(i)}") for i in range(n)]


def test_newick_texts(spark, size):
    df = spark.createDataFrame([*enumerate(TEXTS), (99, None)], "tree_id long, newick string")
    assert _read(newick.edges_of(df)) == {i: _rows(t) for i, t in enumerate(TEXTS)}


def test_newick_files(spark, size, tmp_path):
    """Trees that span lines and files; a file may end before or after a comma, a parenthesis or a tree."""
    (tmp_path / "a.nwk").write_text("\n".join(TEXTS[:4]) + "\n((a:1,\nb:2)x:1,")
    (tmp_path / "b.nwk").write_text("\n(c:1,d:2)y:3)r;\n((")
    (tmp_path / "c.nwk").write_text("a:1\n")
    (tmp_path / "d.nwk").write_text(",b:2\n)x:1,(c:1")
    (tmp_path / "e.nwk").write_text("\n,d:2)y:3)r")
    (tmp_path / "f.nwk").write_text(";\nlast;\n\n")
    assert _read(newick.read_newick(spark, str(tmp_path))) == {i: _rows(t) for i, t in enumerate([*TEXTS[:4], TEXTS[0], TEXTS[0], "last;"])}


def test_newick_without_partners(spark):
    for text in ("((a,b);", "(a,b));", "a);"):
        with pytest.raises(Exception, match="without partners"):
            newick.edges_of(spark.createDataFrame([(1, text)], "tree_id long, newick string"))


@pytest.mark.parametrize("shape", ["star", "comb", "chain", "balanced"])
def test_large_newick_in_pieces(spark, tmp_path, monkeypatch, shape):
    """Five thousand nodes, cut by Spark's reader as well; no task holds the tree."""
    monkeypatch.setattr(ranking, "WINDOW_ROWS", 500)
    n = 5000
    up = {"star": lambda i: 0, "comb": lambda i: (i - 1) // 2 * 2, "chain": lambda i: i - 1, "balanced": lambda i: (i - 1) // 2}[shape]
    tree = Tree([up(i) if i else -1 for i in range(n)], [f"n{i}" for i in range(n)], [i / 8 for i in range(n)])
    (tmp_path / "t.nwk").write_text(to_newick(tree))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        back = newick.read_newick(spark, str(tmp_path / "t.nwk"))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    got = {r.name: (r.parent, r.branch_length, r.is_leaf) for r in back.join(back.select(F.col("node_id").alias("parent_id"), F.col("name").alias("parent")), "parent_id", "left").collect()}
    inner = set(tree.parent)
    assert got == {f"n{i}": (f"n{up(i)}" if i else None, i / 8 if i else 0.0, i not in inner) for i in range(n)}


def test_running_sums_and_last_values(spark, size):
    rng = random.Random(3)
    rows = [(g, i, rng.choice([None, 1, 2, -3]), rng.choice([None, f"s{i}"])) for i in range(900) for g in (["a"] if i % 3 else ["a", None, "b"])]
    df = spark.createDataFrame(rows, "g string, i long, x long, s string").repartition(5)
    got = {(r.g, r.i): (r.total, r.seen) for r in running(df, ["g"], ["i"], {"total": F.col("x")}, {"seen": F.col("s")}).collect()}
    for g in ("a", "b", None):
        total, seen = 0, None
        for _, i, x, s in sorted(r for r in rows if r[0] == g) if g else sorted((r for r in rows if r[0] is None), key=lambda r: r[1]):
            total, seen = total + (x or 0), s or seen
            assert got[g, i] == (total, seen)
    whole = running(df.where("g = 'a'"), [], ["i"], {"total": F.lit(1)})
    assert sorted(r.total for r in whole.collect()) == list(range(1, 901))
    assert running(df.limit(0), ["g"], ["i"], {"total": F.col("x")}).count() == 0


@pytest.mark.parametrize("g", ["of", "at", "block", "n"])
def test_groups_of_any_name_by_ranges(spark, monkeypatch, g):
    monkeypatch.setattr(ranking, "WINDOW_ROWS", 20)
    rows = [(k, i) for i in range(90) for k in (["a", "b", None] if i < 10 else ["a", "b"] if i < 50 else ["a"])]
    df = spark.createDataFrame(rows, f"{g} string, x long").repartition(3)
    got = {(r[g], r.x): (r.total, r.seen) for r in running(df, [g], [F.desc("x")], {"total": F.col("x")}, {"seen": F.when(F.col("x") % 7 == 0, F.col("x"))}).collect()}
    assert len(got) == len(rows)
    for k, x in rows:
        above = [y for of, y in rows if of == k and y >= x]
        assert got[k, x] == (sum(above), min((y for y in above if y % 7 == 0), default=None))
    assert {(r[g], r.x): r["rank"] for r in ranked(df, [g], ["x"]).collect()} == {(k, x): x for k, x in rows}


def test_common_ancestors_of_random_trees(spark, size):
    rng = random.Random(5)
    tree = _random_tree(rng, 400)
    up = dict(tree)

    def path(v):
        return [v] + (path(up[v]) if up[v] else [])

    groups = {q: [f"v{rng.randrange(400)}" for _ in range(rng.randrange(1, 5))] for q in range(300)}
    cand = spark.createDataFrame([(q, v) for q, vs in groups.items() for v in vs], "q long, edge string")
    got = choose.lowest_common_ancestor(cand, ["q"], spark.createDataFrame(tree, "node string, parent string"))
    want = {q: next(v for v in path(vs[0]) if all(v in path(w) for w in vs)) for q, vs in groups.items()}
    assert {r.q: r.lca for r in got.collect()} == want


def test_common_ancestors_on_a_chain(spark):
    """Rows and bytes grow with the nodes, not with their square: one for a node and each of a few levels."""
    n = 20_000
    chain = spark.range(n).select(F.concat(F.lit("n"), "id").alias("node"), F.when(F.col("id") > 0, F.concat(F.lit("n"), F.col("id") - 1)).alias("parent"))
    cand = spark.createDataFrame([(1, "n19999"), (1, "n7"), (2, "n12345"), (2, "n19998"), (2, "n12346"), (3, "n0"), (3, "n5")], "q long, edge string")
    assert {r.q: r.lca for r in choose.lowest_common_ancestor(cand, ["q"], stored(chain)).collect()} == {1: "n7", 2: "n12345", 3: "n0"}
    pre = clades.preorder(chain)
    assert pre.where(F.concat(F.lit("n"), "place") != F.col("node")).isEmpty()
    assert choose._range_minima(pre, n).count() <= 5 * n


def _nodes(spark, text):
    t = parse_newick(text)
    return spark.createDataFrame([(f"v{i}", f"v{p}" if p >= 0 else None, n, x) for i, (p, n, x) in enumerate(zip(t.parent, t.name, t.length, strict=True))], "node string, parent string, name string, length double")


def _text(nodes):
    rows = [(r.node, r.parent, r.name, r.length) for r in nodes.collect()]
    at = {r[0]: i for i, r in enumerate(rows)}
    assert sum(r[1] is None for r in rows) == 1
    return Tree([at[r[1]] if r[1] else -1 for r in rows], [r[2] for r in rows], [r[3] or 0.0 for r in rows])


@pytest.mark.parametrize("text", ["((a:3,b:2):1,(c:4,(d:1,root:5):2):2);", "((a:3,b:2):1,root:4,(c:4,d:1):2);", "(root:1,((a:1,b:2):3,c:4):5);", "((((root:1,a:2):3,b:4):5,c:6):7,d:8,e:9);", "(((root:1,a:2,f:1):3)z:4,b:5);"])
def test_rerooting_agrees_with_small_trees(spark, text):
    """Against the array version, lengths included; an old top of two is passed over, one of three stays."""
    got, want = _text(clades.reroot(_nodes(spark, text), "root")), _rooted(text)
    assert robinson_foulds(got, want) == 0
    lengths = lambda t: sorted((t.name[v], round(t.length[v], 9)) for v in t.leaves())
    assert lengths(got) == lengths(want) and len(got) == len(want)
    assert sorted(round(x, 9) for x in got.length) == sorted(round(x, 9) for x in want.length)


def test_rerooting_odd_trees(spark):
    n = 2000
    chain = spark.range(n).select(F.concat(F.lit("n"), "id").alias("node"), F.when(F.col("id") > 0, F.concat(F.lit("n"), F.col("id") - 1)).alias("parent"), F.concat(F.lit("n"), "id").alias("name"), F.col("id").cast("double").alias("length"))
    got = {r.node: (r.parent, r.length) for r in clades.reroot(stored(chain), "n1999").collect()}
    assert got == {f"n{i}": (f"n{i + 1}" if i < 1998 else None, float(i + 1)) for i in range(1999)}  # the old top has a name and stays as a leaf
    kept = {r.node: (r.parent, r.name, r.length) for r in clades.reroot(_nodes(spark, "((a:3,b:2):1,c:4);"), "a", top="new").collect()}
    assert kept == {"new": (None, None, None), "v2": ("new", "a", 0.0), "v1": ("new", None, 3.0), "v3": ("v1", "b", 2.0), "v4": ("v1", "c", 5.0)}
    for bad in ("nobody", "x"):
        with pytest.raises(ValueError):
            clades.reroot(_nodes(spark, "((a,b)x,c);"), bad)
    with pytest.raises(ValueError):
        clades.reroot(_nodes(spark, "((a,b)x,a);"), "a")


def test_a_dead_chain_is_pruned_in_few_rounds(spark, monkeypatch):
    """A clade that gave up at the end of a chain of 2,000 nodes: pointers double, no round for each layer."""
    rows = [("c0", None, None, None), ("a", "c0", "A", 1.0), ("b", "c0", "B", 2.0), ("d0", "c0", None, 1.0)] + [(f"d{i}", f"d{i - 1}", None, 1.0) for i in range(1, 2000)]
    level = spark.createDataFrame(rows, engine.NODES)
    calls = []
    real = durable.stored
    monkeypatch.setattr(durable, "stored", lambda df: calls.append(1) or real(df))
    out = engine._assemble([level], [], None, level, [])
    assert {(r.node, r.parent, r.name) for r in out.nodes.collect()} == {("c0", None, None), ("a", "c0", "A"), ("b", "c0", "B")}
    assert len(calls) < 30  # two loops of at most 12 rounds each


def test_members_of_a_hot_edge(spark):
    """One edge holds 99 % of the rows: they are not dealt by edge."""
    placed = stored(spark.range(20_000).select(F.when(F.col("id") % 100 > 0, "hot").otherwise(F.concat(F.lit("e"), F.col("id") / 100 % 7)).alias("edge"), F.col("id").alias("name")))
    edges = spark.createDataFrame([("hot",), ("e0.0",), ("none",), ("none",), (None,)], "edge string")
    out = choose.edge_members(edges, placed, "edge", "name")
    got = {(r.edge, r.n): r.rows for r in out.groupBy("edge", "n").agg(F.count("name").alias("rows")).collect()}
    assert got == {("hot", 19_800): 19_800, ("e0.0", 29): 29, ("none", 0): 0, (None, 0): 0}
    per_task = [r["count"] for r in out.where("n > 0").groupBy(F.spark_partition_id()).count().collect()]
    spread = [r["count"] for r in placed.groupBy(F.spark_partition_id()).count().collect()]
    assert max(per_task) <= max(spread)  # as the rows lay before
    assert "BroadcastHashJoin" in out._jdf.queryExecution().toString()


def test_sketched_vocabulary(spark):
    """Many rare edits, some at the floor, one in every taxon, one repeated: as counted exactly, and the rare ones never reach the count."""
    taxa = 2000
    rare = spark.range(60_000).select((F.col("id") % taxa).alias("name"), F.concat(F.lit("r"), "id").alias("edit"))
    some = spark.range(taxa).select(F.col("id").alias("name"), F.explode(F.array(F.lit("all"), F.concat(F.lit("h"), F.col("id") % 2), F.concat(F.lit("f"), F.floor(F.col("id") / 2)), F.concat(F.lit("g"), F.floor(F.col("id") / 3)))).alias("edit"))
    rows = stored(rare.union(some).union(spark.createDataFrame([(1, "twice"), (1, "twice"), (2, "twice"), (3, None)], "name long, edit string")))
    want = sorted(map(tuple, encode.vocabulary(rows, taxa).collect()))
    assert sorted(map(tuple, encode.vocabulary_of_many(rows, taxa).collect())) == want
    assert {e for e, _ in want} >= {"h0", "h1", "twice", "g0"} and "all" not in {e for e, _ in want} and "f0" not in {e for e, _ in want}
    left = encode.possible_edits(rows, taxa)
    assert left.where("edit LIKE 'r%'").count() < 3000  # 60,000 before
    tiny = encode.possible_edits(rows, taxa, cells=1024)  # a sketch too small for its edits loses none that counts
    assert sorted(map(tuple, encode.vocabulary(tiny, taxa).collect())) == want


def test_tables_leave_with_their_work(spark):
    there = lambda df: os.path.isdir(df._stored_at.removeprefix("file:"))
    with tables(spark) as outer:
        with tables(spark) as inner:
            gone, kept = stored(spark.range(5)), stored(spark.range(7))
            inner.keep(kept)
        assert not there(gone) and there(kept) and kept.count() == 7
        early = stored(spark.range(3))
        outer.drop(early)
        assert not there(early)
    assert not there(kept)
    with pytest.raises(KeyError), tables(spark):
        lost = stored(spark.range(2))
        raise KeyError
    assert not there(lost)


def test_tables_of_another_thread_stay(spark):
    import threading

    made = []
    with tables(spark):
        t = threading.Thread(target=lambda: made.append(stored(spark.range(4))))
        t.start()
        t.join()
    assert made[0].count() == 4


def test_counts_are_taken_while_writing(spark):
    table, n = counted(spark.range(1000).where("id % 3 = 0"))
    assert n == 334 and table.count() == 334
    _, got = measured(spark.range(0), n=F.count(F.lit(1)), top=F.max("id"))
    assert got == {"n": 0, "top": None}


def test_newick_written_and_read(spark, tmp_path):
    rng = random.Random(9)
    tree = _random_tree(rng, 300)
    nodes = spark.createDataFrame([(v, p, v, 0.5) for v, p in tree], "node string, parent string, name string, length double")
    write_newick(nodes, str(tmp_path / "t"))
    back = newick.read_newick(spark, str(tmp_path / "t"))
    got = {(r.name, r.parent) for r in back.join(back.select(F.col("node_id").alias("parent_id"), F.col("name").alias("parent")), "parent_id", "left").collect()}
    assert got == set(tree)


def test_ranks_by_ranges(spark, size):
    rows = [("a", i) for i in range(3000)] + [(None, i) for i in range(0, 50, 2)] + [("b", 7)]
    df = spark.createDataFrame(rows, "g string, x long").repartition(7)
    got = {(r.g, r.x): r["rank"] for r in ranked(df, ["g"], ["x"]).collect()}
    assert got == {(g, x): (x if g == "a" else x // 2 if g is None else 0) for g, x in rows}
    assert sorted(r["rank"] for r in ranked(df, [], ["g", "x"]).collect()) == list(range(len(rows)))


@pytest.mark.parametrize("names", ["near", "mixed"])
def test_trees_in_ranges(spark, monkeypatch, names):
    """Sums, places, depths and common ancestors where a tree takes many ranges and blocks, near nodes having near names or not."""
    monkeypatch.setattr(clades, "RANGE_ROWS", 60)
    monkeypatch.setattr(choose, "BLOCK", 64)
    monkeypatch.setattr(choose, "TREE_ROWS", 100)
    monkeypatch.setattr(choose, "ASKED_ROWS", 50)
    rng = random.Random(6)
    n = 900
    as_name = (lambda i: f"v{i:05d}") if names == "near" else (lambda i: f"v{i * 7919 % 10007:05d}")
    up = [None if i == 0 else i - 1 if rng.random() < 0.9 else rng.randrange(max(0, i - 40), i) for i in range(n)]
    above = [[i] for i in range(n)]
    for i in range(1, n):
        above[i] += above[up[i]]
    tree = stored(spark.createDataFrame([(as_name(i), None if u is None else as_name(u)) for i, u in enumerate(up)], "node string, parent string"))
    assert {r.node: r.depth for r in clades.depths(tree).collect()} == {as_name(i): len(a) - 1 for i, a in enumerate(above)}
    below = [0] * n
    for a in above:
        for i in a:
            below[i] += 1
    got = clades.subtree_counts(tree, tree.select("node", F.lit(1).alias("cnt"))).collect()
    assert {r.node: r.n for r in got} == {as_name(i): x for i, x in enumerate(below)}
    kids = {}
    for i, u in enumerate(up):
        kids.setdefault(u, []).append(i)
    order, todo = [], [0]
    while todo:
        order.append(i := todo.pop())
        todo += sorted(kids.get(i, []), key=as_name, reverse=True)
    got = clades.preorder(tree).collect()
    place = {i: k for k, i in enumerate(order)}
    assert {(r.node, r.place, r.up) for r in got} == {(as_name(i), place[i], None if up[i] is None else place[up[i]]) for i in range(n)}
    asked = [(q, [rng.randrange(n) for _ in range(rng.randint(1, 3))]) for q in range(600)]
    cand = spark.createDataFrame([(q, as_name(i)) for q, some in asked for i in some], "q long, edge string")
    meet = {q: as_name(max(set.intersection(*(set(above[i]) for i in some)), key=lambda i: len(above[i]))) for q, some in asked}
    assert {r.q: r.lca for r in choose.lowest_common_ancestor(cand, ["q"], tree).collect()} == meet


def test_a_deep_tree_takes_few_jobs(spark):
    """Steps on a chain whose near nodes have near names do not grow with its depth."""
    def jobs(n):
        tree = stored(spark.range(n).selectExpr("concat('n', lpad(id, 6, '0')) AS node", "if(id > 0, concat('n', lpad(id - 1, 6, '0')), null) AS parent"))
        spark.sparkContext.setJobGroup(f"chain{n}", "")
        try:
            assert clades.preorder(tree).agg(F.max("place")).first()[0] == n - 1
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"chain{n}"))

    assert jobs(5000) <= jobs(50) + 4


def test_text_of_a_large_tree_takes_few_jobs(spark):
    """The order of the pieces is a sum along their list, whose rounds do not grow with the tree."""
    def jobs(n):
        rows = spark.range(n).selectExpr("concat('n', lpad(id, 6, '0')) AS node", "if(id > 0, 'n000000', null) AS parent", "cast(null AS string) AS name", "1.0D AS length")
        spark.sparkContext.setJobGroup(f"text{n}", "")
        try:
            assert newick_tokens(stored(rows)).count() == n + 1
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"text{n}"))

    assert jobs(4000) <= jobs(40) + 4


def test_sums_below_a_deep_tree_take_few_jobs(spark):
    def jobs(n):
        tree = stored(spark.range(n).selectExpr("concat('n', lpad(id, 6, '0')) AS node", "if(id > 0, concat('n', lpad(id - 1, 6, '0')), null) AS parent", "1 AS cnt"))
        spark.sparkContext.setJobGroup(f"sums{n}", "")
        try:
            assert clades.subtree_counts(tree.select("node", "parent"), tree.select("node", "cnt")).agg(F.max("n")).first()[0] == n
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"sums{n}"))

    assert jobs(4000) <= jobs(40) + 4


def test_sums_over_ranges_of_sampled_bounds(spark, monkeypatch):
    """The sums of a range's second visit belong to the ranges of its first."""
    monkeypatch.setattr(clades, "RANGE_ROWS", 1500)
    n, name = 30_000, lambda i: f"n{i * 7919 % 30_011:05d}"
    parent = {i: (i - 1) // 3 for i in range(1, n)}
    want = [1] * n
    for i in range(n - 1, 0, -1):
        want[parent[i]] += want[i]
    rows = [(name(i), name(parent[i]) if i else None, 1) for i in range(n)]
    tree = stored(spark.createDataFrame(rows, "node string, parent string, cnt int").repartition(8))
    got = {r.node: r.n for r in clades.subtree_counts(tree.select("node", "parent"), tree.select("node", "cnt")).collect()}
    assert got == {name(i): want[i] for i in range(n)}
    near = [(f"n{i:05d}", f"n{(i - 1) // 3:05d}" if i else None, 1) for i in range(n)]
    tree = stored(spark.createDataFrame(near, "node string, parent string, cnt int").repartition(8))
    got = {r.node: r.n for r in clades.subtree_counts(tree.select("node", "parent"), tree.select("node", "cnt")).collect()}
    assert got == {f"n{i:05d}": want[i] for i in range(n)}
