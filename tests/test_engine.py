import gzip
import hashlib
import os

import pytest
from pyspark.sql import functions as F

from treeloom.cli import main
from treeloom.config import LineageConfig
from simulate import balanced, edits
from treeloom.kernels import distance
from treeloom.kernels.tree import parse_newick, robinson_foulds, to_newick
from treeloom.operators import choose, clades
from treeloom.operators.ranking import ranked
from treeloom.plans import durable, engine
from treeloom.plans.durable import stored
from treeloom.plans.engine import reconstruct
from treeloom.sources.edits import read_edits, write_edits
from treeloom.sources.fasta import count_by_file, read_fasta, write_fasta, write_phylip
from treeloom.sources.trees import jplace_edges, newick_tokens, read_jplace, write_newick


def _leaves(t):
    return sorted(t.name[v] for v in t.leaves())


@pytest.mark.parametrize("kind", ["nj", "edits"])
def test_divide_and_conquer_recovers_the_truth(spark, kind):
    if kind == "edits":
        taxa, truth = edits(6)
        df, config = spark.createDataFrame(taxa, "name string, edits array<string>"), LineageConfig(edits=True, placement="MP")
    else:
        records, truth = balanced(6, 800)
        df, config = spark.createDataFrame(records, "name string, seq string"), LineageConfig(method="nj")
    out = reconstruct(df.repartition(5), config)
    t = parse_newick(out.newick())
    assert robinson_foulds(t, parse_newick(truth)) == 0
    assert len(t.leaves()) + out.discarded.count() == 64
    assert len(out.metrics) > 1


def test_equal_sequences_become_sisters(spark):
    rows = [("root", "AAAA"), ("a", "CCAA"), ("b", "CCAA"), ("c", "CCGG"), ("d", "TTTT")]
    t = parse_newick(reconstruct(spark.createDataFrame(rows, "name string, seq string")).newick())
    assert _leaves(t) == ["a", "b", "c", "d"]


@pytest.mark.parametrize("n", [1, 2])
def test_tiny_inputs(spark, n):
    rows = [("root", "AAAA"), ("a", "CCAA"), ("b", "CCGG")][: n + 1]
    t = parse_newick(reconstruct(spark.createDataFrame(rows, "name string, seq string")).newick())
    assert _leaves(t) == ["a", "b"][:n]


def test_a_missing_root_is_an_error(spark):
    with pytest.raises(ValueError, match="root"):
        reconstruct(spark.createDataFrame([("a", "AC")], "name string, seq string"))


def test_fasta_forms(spark, tmp_path):
    one, two = tmp_path / "a.fa", tmp_path / "b.fa.gz"
    one.write_text(">x some words\nACGT\nAC\n>y\nGG\n")
    with gzip.open(two, "wt") as f:
        f.write(">z\nTTT\n")
    assert sorted(map(tuple, read_fasta(spark, str(tmp_path)).collect())) == [("x", "ACGTAC"), ("y", "GG"), ("z", "TTT")]
    assert sorted(r.n for r in count_by_file(spark, str(tmp_path)).collect()) == [1, 2]
    write_fasta(read_fasta(spark, str(one)), str(tmp_path / "out"), "gzip")
    assert sorted(r.name for r in read_fasta(spark, str(tmp_path / "out")).collect()) == ["x", "y"]
    odd = tmp_path / "odd"
    odd.mkdir()
    (odd / "c.fa").write_bytes(b"\r\n>x change 12A>G\r\nACGT\r\nAC\r\n>y>z a > b\r\nGG\r\n>empty\r\n>last\r\nT")
    with gzip.open(odd / "d.fa.gz", "wt") as f:
        f.write(">u 1>2\nA\n\nC\n")
    want = [("empty", ""), ("last", "T"), ("u", "AC"), ("x", "ACGTAC"), ("y>z", "GG")]
    assert sorted(map(tuple, read_fasta(spark, str(odd)).collect())) == want
    assert sorted(r.n for r in count_by_file(spark, str(odd)).collect()) == [1, 4]
    write_phylip(read_fasta(spark, str(one)), str(tmp_path / "phy"))
    assert [r.value for r in spark.read.text(str(tmp_path / "phy")).collect()][0] == "2 6"


def test_edit_forms(spark, tmp_path):
    (tmp_path / "e.txt").write_text("a\tins1A;del2len3\nb\t\nc\n")
    rows = read_edits(spark, str(tmp_path / "e.txt"))
    want = [("a", ["ins1A", "del2len3"]), ("b", []), ("c", [])]
    assert sorted((r.name, r.edits) for r in rows.collect()) == want
    write_edits(rows, str(tmp_path / "out"))
    assert sorted((r.name, r.edits) for r in read_edits(spark, str(tmp_path / "out")).collect()) == want


def test_placement_documents(spark):
    doc = '{"tree": "(s1:0.1{0},s2:0.2{1}){2};", "placements": [{"p": [[0, -1.5, 0.7], [1, -2.0, 0.3]], "n": ["q1", "q2"]}]}'
    df = spark.createDataFrame([(doc,)], "value string")
    got = read_jplace(df).collect()
    assert [r.name for r in got] == ["q1", "q2"]  # every name counts, not the first alone
    assert [c.edge for c in got[0].candidates] == [0, 1]
    assert sorted(map(tuple, jplace_edges(df).collect())) == [(0, "s1"), (1, "s2")]


def _chain(spark, n):
    return spark.range(n).select(F.concat(F.lit("n"), "id").alias("node"), F.when(F.col("id") > 0, F.concat(F.lit("n"), F.col("id") - 1)).alias("parent"))


def test_long_chains_close_in_few_joins(spark):
    pairs = clades.closure(_chain(spark, 40))
    assert pairs.count() == 40 * 41 // 2
    assert pairs.agg(F.max("distance")).first()[0] == 39


def test_a_chain_of_two_thousand_nodes(spark):
    n = 2000
    tree = stored(_chain(spark, n))
    assert {(r.node, r.depth) for r in clades.depths(tree).collect()} == {(f"n{i}", i) for i in range(n)}
    counts = spark.createDataFrame([("n1999", 5), ("n1000", 2)], "node string, cnt long")
    got = {r.node: r.n for r in clades.subtree_counts(tree, counts).collect()}
    assert len(got) == n and got["n0"] == got["n1000"] == 7 and got["n1001"] == got["n1999"] == 5
    assert [tuple(r) for r in clades.clade_cut(tree, counts, "n0", 5000).collect()] == [("n1000", "cut", 7)]
    text = "".join(r.text for r in newick_tokens(tree.select("*", F.col("node").alias("name"), F.lit(1.0).alias("length")), lengths=False).orderBy("at").collect())
    assert text == "(" * 1999 + "".join(f"n{i})" for i in range(1999, 0, -1)) + "n0;"


def test_newick_pieces_of_odd_names(spark):
    rows = [("t", None, None, None), ("a", "t", "it's", 0.25), ("b", "t", "x y", None), ("c", "t", None, 1.0), ("c1", "c", "p", 0.5), ("c2", "c", "q", 0.5)]
    df = spark.createDataFrame(rows, "node string, parent string, name string, length double")
    text = "".join(r.text for r in newick_tokens(df).orderBy("at").collect())
    assert text == "('it''s':0.25000,'x y':0.00000,(p:0.50000,q:0.50000):1.00000);"


def test_ranks_of_large_and_odd_groups(spark):
    rows = [("a", i) for i in range(3000)] + [(None, i) for i in range(0, 50, 2)] + [("b", 7)]
    df = spark.createDataFrame(rows, "g string, x long").repartition(7)
    got = {(r.g, r.x): r["rank"] for r in ranked(df, ["g"], ["x"]).collect()}
    assert got == {(g, x): (x if g == "a" else x // 2 if g is None else 0) for g, x in rows}
    assert sorted(r["rank"] for r in ranked(df, [], ["g", "x"]).collect()) == list(range(len(rows)))
    assert ranked(df.limit(0), ["g"], ["x"]).count() == 0


def test_common_ancestors_of_many_candidates(spark):
    tree = spark.createDataFrame([("t", None), ("x", "t"), ("y", "t"), ("x1", "x"), ("x2", "x"), ("x21", "x2")], "node string, parent string")
    rows = [(1, "x1"), (1, "x21"), (2, "x2"), (2, "x21"), (3, "x1"), (3, "x2"), (3, "y"), (4, "y"), (4, "y")]
    got = choose.lowest_common_ancestor(spark.createDataFrame(rows, "q long, edge string"), ["q"], tree)
    assert {r.q: r.lca for r in got.collect()} == {1: "x", 2: "x2", 3: "t", 4: "y"}


def test_rounds_fall_back_and_give_up(spark):
    """One builder misleads each round; what follows is the state machine's: a fresh sample, the last good round, or no tree."""
    records, truth = balanced(5, 400)
    df = spark.createDataFrame(records, "name string, seq string")

    def broken(names, seqs):
        raise RuntimeError("no tree")

    out = reconstruct(df, LineageConfig(builder=broken, max_rounds=3))
    assert {r.reason for r in out.discarded.collect()} == {"unresolved"} and out.discarded.count() == 32
    assert out.metrics[0]["rounds"] == 2 and out.metrics[0]["discarded"] == 32
    out = reconstruct(df, LineageConfig(builder=broken, max_rounds=2, unresolved="polytomy"))
    t = parse_newick(out.newick())
    assert len(t.leaves()) == 32 and len(t) == 33 and out.discarded.count() == 0


def test_a_star_below_the_first_clade_is_kept_whole(spark):
    """More taxa of one group, told apart by their own edits only, than a sample holds: leaves of their clade's top."""
    taxa = [(f"{k}{i}", [f"{k}#{j}" for j in range(6)] + [f"{k}{i}#{j}" for j in range(6)]) for k in "xyz" for i in range(40)]
    out = reconstruct(spark.createDataFrame(taxa, "name string, edits array<string>"), LineageConfig(method="nj", edits=True, placement="MP", careful=2))
    assert out.discarded.count() == 0 and sum(m["discarded"] for m in out.metrics) == 0
    tree = stored(out.nodes)
    leaves = tree.where("name IS NOT NULL").select("node", "name")
    assert sorted(r.name for r in leaves.collect()) == sorted(n for n, _ in taxa)
    cand = leaves.select(F.substring("name", 1, 1).alias("group"), F.col("node").alias("edge"))
    tops = choose.lowest_common_ancestor(cand, ["group"], tree.select("node", "parent"))
    under = clades.subtree_counts(tree.select("node", "parent"), leaves.select("node", F.lit(1).alias("cnt")))
    assert {r.group: r.n for r in tops.join(under, tops.lca == under.node).collect()} == dict.fromkeys("xyz", 40)


def test_problematic_rows_are_retried_and_counted(spark):
    records, _ = balanced(5, 400)
    rows = [*records, ("ghost1", records[0][1]), ("ghost2", records[0][1])]
    out = reconstruct(spark.createDataFrame(rows, "name string, seq string"), LineageConfig(method="nj", retry_rows=1, max_rounds=3))
    assert sorted(r.name for r in out.discarded.collect()) == ["ghost1", "ghost2"]
    assert out.metrics[0]["rounds"] == 2 and out.metrics[0]["discarded"] == 1  # equal sequences are one taxon
    assert sum(len(x) for x in [parse_newick(out.newick()).leaves()]) == 32


def test_a_failed_second_round_falls_back_to_the_first(spark):
    """C3, ``previous``: rows near the root stay on its edge, their round is good, and the next one's builder fails on them."""
    records, truth = balanced(5, 400)
    root = records[0][1]
    ghosts = [(f"ghost{i}", root[:i] + ("A" if root[i] != "A" else "C") + root[i + 1 :]) for i in range(12)]

    def builder(names, seqs):
        if any(n.startswith("ghost") for n in names):
            raise RuntimeError("misled")
        t = distance.neighbor_joining([*names[1:], "root"], distance.pairwise([*seqs[1:], seqs[0]]))
        return f"({to_newick(t)[:-1]},root:0.1);"

    for seed in range(20):  # a first sample without a ghost
        order = sorted([n for n, _ in [*records[1:], *ghosts]], key=lambda n: (hashlib.md5(f"{seed}|0|1|{n}".encode()).hexdigest(), n))
        if not any(n.startswith("ghost") for n in order[:10]):
            break
    out = reconstruct(spark.createDataFrame([*records, *ghosts], "name string, seq string"), LineageConfig(builder=builder, seed=seed, placement="MP", max_rounds=4))
    lost = {r.name for r in out.discarded.collect() if r.reason == "problematic"}
    assert out.metrics[0]["rounds"] == 2 and lost >= {n for n, _ in ghosts}
    t = parse_newick(out.newick())
    assert set(_leaves(t)) | {r.name for r in out.discarded.collect()} == {n for n, _ in [*records[1:], *ghosts]}
    assert len(out.metrics) > 1  # the first round's cut was taken


def test_the_cap_on_clades(spark):
    records, _ = balanced(5, 400)
    with pytest.raises(RuntimeError, match="max_clades"):
        reconstruct(spark.createDataFrame(records, "name string, seq string"), LineageConfig(method="nj", max_clades=1, threshold=4))


def test_models_beyond_a_broadcast_meet_salted_rows(spark, monkeypatch):
    """The same tree when models are not broadcast and the one large clade is spread over salts."""
    monkeypatch.setattr(engine, "MODEL_BYTES", -1)
    records, truth = balanced(5, 400)
    salted, real = [], clades.pool_of
    monkeypatch.setattr(engine, "pool_of", lambda n, limit: salted.append(limit) or real(n, limit))
    out = reconstruct(spark.createDataFrame(records, "name string, seq string"), LineageConfig(method="nj", chunk=8))
    assert robinson_foulds(parse_newick(out.newick()), parse_newick(truth)) == 0
    assert salted and set(salted) == {8}


def test_tables_of_finished_levels_leave(spark, monkeypatch):
    """A run's disk holds one level's rows, whatever the number of levels, and the result's two tables at its end."""
    records, _ = balanced(6, 400)
    df = stored(spark.createDataFrame(records, "name string, seq string"))
    made, full = [], []
    real = durable.stored

    def watched(table):
        out = real(table)
        made.append((out._stored_at.removeprefix("file:"), "seq" in out.columns))
        full.append(sum(os.path.isdir(p) for p, rows in made if rows))
        return out

    for module in (durable, engine):
        monkeypatch.setattr(module, "stored", watched)
    out = reconstruct(df, LineageConfig(method="nj", threshold=4))
    assert len(out.metrics) > 2
    assert max(full) <= 4  # the level's rows, its samples, its rows placed, and the next level's
    assert sum(os.path.isdir(p) for p, _ in made) == 2 and out.nodes.count() > 64


def test_unaligned_sequences(spark):
    records, truth = balanced(4, 400, indels=True)
    out = reconstruct(spark.createDataFrame(records, "name string, seq string"), LineageConfig(method="nj", unaligned=True))
    t = parse_newick(out.newick())
    assert len(t.leaves()) == 16 and robinson_foulds(t, parse_newick(truth)) <= 2


def test_command_line(spark, tmp_path):
    records, truth = balanced(4, 400)
    (tmp_path / "in.fa").write_text("".join(f">{n}\n{s}\n" for n, s in records))
    main(["-i", str(tmp_path / "in.fa"), "-o", str(tmp_path), "-m", "nj", "-f", "tree", "-e"])
    text = spark.read.text(str(tmp_path / "tree.nwk")).first().value
    write_newick(spark.read.parquet(str(tmp_path / "tree.nodes")), str(tmp_path / "pieces"))
    pieces = "".join(p.read_text() for p in sorted((tmp_path / "pieces").glob("part-*")))
    assert robinson_foulds(parse_newick(pieces), parse_newick(truth)) == 0
    assert robinson_foulds(parse_newick(text), parse_newick(truth)) == 0
    assert spark.read.parquet(str(tmp_path / "tree.nodes")).where("name IS NOT NULL").count() == 16
