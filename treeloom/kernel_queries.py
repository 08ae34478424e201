"""Registered queries whose result no SQL states: trees, placements, alignments, the whole engine."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeloom import views
from treeloom.catalog import query
from treeloom.config import LineageConfig
from treeloom.kernels import align
from treeloom.operators import choose, clades, encode, parsimony, sampling, substitution
from treeloom.plans.durable import stored
from treeloom.plans.engine import _Run, reconstruct
from treeloom.kernels.sample_tree import Model
from treeloom.kernels.tree import to_newick
from treeloom.plans.sizing import broadcast_if_small
from treeloom.views import table


def _samples(spark: SparkSession, d: str, k: int = 12) -> DataFrame:
    s = sampling.sample(views.sequences(spark, d).withColumnRenamed("label", "clade_id"), "clade_id", "name", k, 0)
    return s.withColumn("_order", sampling.draw(0, "clade_id", "name"))


def _trees(spark: SparkSession, d: str, method: str) -> DataFrame:
    """One tree for each clade's sample."""
    models = _Run(LineageConfig(method=method), views.ROOT).models(_samples(spark, d))

    def text(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"clade_id": pdf["clade_id"], "newick": [to_newick(Model.of_row(r).tree) for _, r in pdf.iterrows()]})

    return models.mapInPandas(lambda it: map(text, it), "clade_id long, newick string")


@query("nj_tree")
def nj_tree(spark: SparkSession, d: str) -> DataFrame:
    """X2."""
    return _trees(spark, d, "nj")


@query("mp_tree")
def mp_tree(spark: SparkSession, d: str) -> DataFrame:
    """X1."""
    return _trees(spark, d, "mp")


@query("ml_tree")
def ml_tree(spark: SparkSession, d: str) -> DataFrame:
    """X3, X4, X7."""
    return _trees(spark, d, "ml")


@query("user_builder_tree")
def user_builder_tree(spark: SparkSession, d: str) -> DataFrame:
    """A caller's own builder, here a caterpillar in name order."""

    def caterpillar(names: list[str], seqs: list[str]) -> str:
        out = names[0]
        for n in names[1:]:
            out = f"({out},{n})"
        return out + ";"

    models = _Run(LineageConfig(builder=caterpillar), views.ROOT).models(_samples(spark, d))
    return models.select("clade_id", F.size("names").cast("long").alias("n"), "error")


def _placed(spark: SparkSession, d: str, **how) -> DataFrame:
    run = _Run(LineageConfig(**how), views.ROOT)
    some = stored(_samples(spark, d))
    models = stored(run.models(some.join(substitution.estimates(some), "clade_id") if run.config.estimated() else some))
    rows = views.sequences(spark, d).withColumnRenamed("label", "clade_id")
    return run.place(rows.select("clade_id", "name", "seq"), models).drop("seq")


@query("ml_place")
def ml_place(spark: SparkSession, d: str) -> DataFrame:
    """Every sequence on its clade's sample tree."""
    return _placed(spark, d, method="nj")


def _mp_edges(models: DataFrame) -> DataFrame:
    """The edge sets of finished models: their trees and sequences as tables."""
    each = models.where("error IS NULL").select("clade_id", "root", "names", "seqs", F.posexplode(F.arrays_zip("parent", "label")).alias("node", "x"))
    nodes = each.select("clade_id", "node", F.when(F.col("x.parent") >= 0, F.col("x.parent")).alias("parent"), F.col("x.label").alias("name"))
    taxa = models.where("error IS NULL").select("clade_id", F.explode(F.arrays_zip("names", "seqs")).alias("x")).select("clade_id", F.col("x.names").alias("name"), parsimony.planes(F.col("x.seqs")).alias("sets"))
    leaves = nodes.where("name <> ''").join(taxa, ["clade_id", "name"]).select("clade_id", "node", "sets")
    return parsimony.edge_sets(nodes.select("clade_id", "node", "parent"), leaves, models.where("error IS NULL").select("clade_id", parsimony.planes(F.col("root")).alias("sets")))


@query("mp_place")
def mp_place(spark: SparkSession, d: str) -> DataFrame:
    """Every sequence on its clade's sample tree, by bit operations on tables of site sets."""
    models = stored(_Run(LineageConfig(placement="MP"), views.ROOT).models(_samples(spark, d)))
    rows = views.sequences(spark, d).withColumnRenamed("label", "clade_id").select("clade_id", "name", "seq")
    return parsimony.place(rows, _mp_edges(models), 0).drop("seq")


@query("careful_place")
def careful_place(spark: SparkSession, d: str) -> DataFrame:
    """The lowest common ancestor of the three best edges."""
    return _placed(spark, d, method="nj", careful=3)


@query("msa")
def msa(spark: SparkSession, d: str) -> DataFrame:
    """Each clade's sample, unaligned, on the columns of the root."""
    rows = sampling.sample(views.raw_sequences(spark, d), "label", "name", 12, 0)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf[["label", "name"]].assign(aligned=align.align_all(list(pdf["seq"]), views.ROOT))

    return rows.groupBy("label").applyInPandas(run, "label long, name string, aligned string")


@query("plus_one_align")
def plus_one_align(spark: SparkSession, d: str) -> DataFrame:
    """Every unaligned sequence to the profile of its clade's sample, a profile being one small row."""
    raw = views.raw_sequences(spark, d)
    rows = sampling.sample(raw, "label", "name", 12, 0)
    lists = rows.groupBy("label").agg(F.collect_list("seq").alias("sample"))

    def run(batches):
        for b in batches:
            done = {k: align.profile(align.align_all(list(g["sample"].iloc[0]), views.ROOT) + [views.ROOT]) for k, g in b.groupby("label")}
            yield b[["label", "name"]].assign(aligned=[align.to_profile(s, done[k]) for k, s in zip(b["label"], b["seq"], strict=True)])

    return raw.join(broadcast_if_small(stored(lists), limit=10_000), "label").mapInPandas(run, "label long, name string, aligned string")


def _clades(nodes: DataFrame, taxa: DataFrame, levels: list[str]) -> DataFrame:
    """(clade, n, together): for each value of the nested columns its taxa, and the taxa under the node where they meet in ``nodes``."""
    tree = stored(nodes.select("node", "parent", "name"))
    leaves = tree.where("name IS NOT NULL").select("node", "name").join(taxa, "name")
    paths = F.array(F.lit(""), *[F.concat_ws("/", *levels[: i + 1]) for i in range(len(levels))])
    each = stored(leaves.select(F.col("node").alias("edge"), F.explode(paths).alias("clade")))
    met = choose.lowest_common_ancestor(each, ["clade"], tree)
    under = clades.subtree_counts(tree, leaves.select("node", F.lit(1).alias("cnt"))).select(F.col("node").alias("lca"), F.col("n").alias("together"))
    return sampling.count_by(each, "clade").join(met, "clade").join(under, "lca").select("clade", "n", "together")


def _sequences(edits: DataFrame) -> tuple[DataFrame, str]:
    """(name, seq) of rows of edits as pseudo-DNA over all edits, and the sequence of a row without any."""
    rows = stored(edits)
    seqs = stored(encode.encode(rows, rows.select("edit").distinct()))
    sites = seqs.agg(F.max(F.length("seq"))).first()[0]
    half = min(sites, sites // 2 + 1)
    return seqs, "C" * half + "G" * (sites - half)


def _column_edits(taxa: DataFrame, *more: str) -> DataFrame:
    return views.column_edits(taxa, "name", [F.col(c) for c in [*views.LEVELS, *more]])


#: The levels down to the single nation, which the queries look for in the tree.
_FOUND = views.LEVELS[: len(views.NATION_SPANS)]


@query("lineage_full", views.sql_clades(views.sql_nested("customer", "c_nationkey"), _FOUND))
def lineage_full(spark: SparkSession, d: str) -> DataFrame:
    """The whole engine, with the default sample, threshold and rounds: customers by the edits that their nation and key stand for, whose nesting the tree finds again."""
    taxa = stored(views.nested(spark, d, "customer", "c_custkey", "c_nationkey"))
    seqs, root = _sequences(_column_edits(taxa))
    rows = seqs.union(spark.createDataFrame([("root", root)], "name string, seq string"))
    return _clades(reconstruct(rows, LineageConfig(method="nj", placement="MP", careful=2, max_clades=10**9)).nodes, taxa, _FOUND)


@query("lineage_edits", views.sql_clades(views.sql_nested("supplier", "s_nationkey"), _FOUND))
def lineage_edits(spark: SparkSession, d: str) -> DataFrame:
    """The same in edit mode (E3): suppliers, each with edits of its own besides."""
    taxa = stored(views.nested(spark, d, "supplier", "s_suppkey", "s_nationkey"))
    rows = _column_edits(taxa, "name").groupBy("name").agg(F.collect_list("edit").alias("edits"))
    out = reconstruct(rows, LineageConfig(method="nj", edits=True, placement="MP", careful=2, max_clades=10**9))
    return _clades(out.nodes, taxa, _FOUND)


@query("lineage_discarded", "SELECT 'problematic' AS reason, count(*) AS n FROM nation")
def lineage_discarded(spark: SparkSession, d: str) -> DataFrame:
    """Taxa without any edit cannot be told from the root, stay on its edge in every round and are left out, with all their copies."""
    seqs, root = _sequences(_column_edits(views.nested(spark, d, "supplier", "s_suppkey", "s_nationkey")))
    blank = table(spark, d, "nation").select(F.concat(F.lit("blank"), "n_nationkey"), F.lit(root))
    rows = seqs.union(blank).union(spark.createDataFrame([("root", root)], "name string, seq string"))
    out = reconstruct(rows, LineageConfig(method="nj", placement="MP", careful=2, max_clades=10**9))
    return out.discarded.groupBy("reason").agg(F.count("*").alias("n"))
