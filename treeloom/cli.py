"""Command line: ``python -m treeloom.cli -i FASTA [...]``; ``spark-submit`` works as well."""

from __future__ import annotations

import argparse
import importlib
import json

from pyspark.sql import DataFrame, SparkSession

from treeloom.config import ALIASES, METHODS, LineageConfig
from treeloom.plans.engine import Lineage, reconstruct
from treeloom.sources.edits import read_edits
from treeloom.sources.fasta import read_fasta
from treeloom.sources.trees import write_newick

#: Nodes up to which a tree is written as one line.
TEXT_NODES = 200_000


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("treeloom", description="Reconstruct a lineage tree by divide and conquer on Spark.")
    add = p.add_argument
    add("-i", "--input", required=True, help="FASTA or edit list: a file, folder or glob; .gz is read")
    add("-o", "--output", default=".", help="folder for the results")
    add("-f", "--name", default="lineage", help="name of the result")
    add("-m", "--method", default="mp", choices=[*METHODS, *ALIASES], help="how sample trees are built")
    add("-s", "--builder", help="module:function, (names, sequences) -> Newick; overrides --method")
    add("-k", "--subsample", type=int, default=10)
    add("-z", "--tip-sample", type=int, default=10**10)
    add("-t", "--threshold", type=int, default=10)
    add("-u", "--unaligned", action="store_true")
    add("-w", "--realign-ratio", type=float, default=0.5)
    add("-b", "--model", default="GTRCAT")
    add("-p", "--placement", default="ML", choices=["ML", "MP"])
    add("-P", "--careful", type=int, default=1)
    add("-x", "--max-rounds", type=int, default=5)
    add("-r", "--seed", default="0", help="a number, or random")
    add("-E", "--edits", action="store_true")
    add("-l", "--max-clades", type=int, default=10_000)
    add("-d", "--partitions", type=int, help="spread the input over so many partitions")
    add("-g", "--gzip", action="store_true", help="pack text results")
    add("-e", "--keep", action="store_true", help="keep the node table and the figures as Parquet and JSON")
    add("--unresolved", default="drop", choices=["drop", "polytomy"])
    add("--retry-rows", type=int, help="problematic rows of a clade that join its next sample; all by default")
    add("--chunk", type=int, default=10_000, help="rows of a clade beyond which it is placed in parts")
    add("-v", "--version", action="version", version="treeloom 1")
    return p


def config_of(args: argparse.Namespace) -> LineageConfig:
    builder = None
    if args.builder:
        module, _, name = args.builder.partition(":")
        builder = getattr(importlib.import_module(module), name)
    return LineageConfig(
        method=args.method, builder=builder, subsample=args.subsample, tip_sample=args.tip_sample, threshold=args.threshold, placement=args.placement, careful=args.careful,
        max_rounds=args.max_rounds, unaligned=args.unaligned, realign_ratio=args.realign_ratio, edits=args.edits, model=args.model, seed=args.seed if args.seed == "random" else int(args.seed), max_clades=args.max_clades, unresolved=args.unresolved, retry_rows=args.retry_rows, chunk=args.chunk,
    )


def publish(spark: SparkSession, out: Lineage, args: argparse.Namespace) -> None:
    """The node table, the discarded names and the figures, then the tree's text, all by Spark's writers.

    The table comes first, so that no size of the tree can lose a finished run. A
    tree of up to TEXT_NODES nodes is one line in one file, a larger one is
    written in pieces, part files in order.
    """
    base = f"{args.output}/{args.name}"
    pack = "gzip" if args.gzip else "none"
    if args.keep or (n := out.nodes.count()) > TEXT_NODES:
        out.nodes.write.mode("overwrite").parquet(f"{base}.nodes")
        spark.createDataFrame([(json.dumps(m),) for m in out.metrics], "value string").coalesce(1).write.mode("overwrite").text(f"{base}.metrics")
        n = out.nodes.count()
    out.discarded.selectExpr("concat_ws('\t', name, reason) AS value").write.mode("overwrite").option("compression", pack).text(f"{base}.discarded")
    if n <= TEXT_NODES:
        spark.createDataFrame([(out.newick(),)], "value string").coalesce(1).write.mode("overwrite").option("compression", pack).text(f"{base}.nwk")
    else:
        write_newick(out.nodes, f"{base}.nwk", compression=pack)


def main(argv: list[str] | None = None) -> Lineage:
    args = parser().parse_args(argv)
    config = config_of(args)
    spark = SparkSession.builder.appName("treeloom").getOrCreate()
    taxa: DataFrame = read_edits(spark, args.input) if args.edits else read_fasta(spark, args.input)
    if args.partitions:
        taxa = taxa.repartition(args.partitions)
    out = reconstruct(taxa, config)
    publish(spark, out, args)
    return out


if __name__ == "__main__":
    main()
