"""Views that read the engine's data model out of general business tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(name, label, seq): each embedding as 64 aligned sites by sign, in the edit encoding's letters."""
    site = lambda x, i: F.when(i < 33, F.when(x >= 0, "T").otherwise("C")).otherwise(F.when(x >= 0, "A").otherwise("G"))
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.concat(F.lit("v"), F.col("vec_id")).alias("name"), F.col("label").cast("long").alias("label"), F.array_join(F.transform("embedding", site), "").alias("seq"))


ROOT = "C" * 33 + "G" * 31


def raw_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(name, label, seq): unaligned, sites of small embeddings left out."""
    e = table(spark, sf_dir, "embeddings")
    site = lambda x, i: F.when(F.abs(x) < 0.01, "").otherwise(F.when(i < 33, F.when(x >= 0, "T").otherwise("C")).otherwise(F.when(x >= 0, "A").otherwise("G")))
    return e.select(F.concat(F.lit("v"), F.col("vec_id")).alias("name"), F.col("label").cast("long").alias("label"), F.array_join(F.transform("embedding", site), "").alias("seq"))


def user_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(name, edit): one row for each event, its type and hour being the edit."""
    return table(spark, sf_dir, "events").select(F.concat(F.lit("u"), F.col("user_id")).alias("name"), F.concat_ws(":", "event_type", F.hour("ts").cast("string")).alias("edit"))


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node, parent): root, regions, nations, suppliers."""
    region, nation, supplier = (table(spark, sf_dir, t) for t in ("region", "nation", "supplier"))
    out = spark.createDataFrame([("root", None)], "node string, parent string")
    out = out.union(region.select(F.concat(F.lit("r"), "r_regionkey"), F.lit("root")))
    out = out.union(nation.select(F.concat(F.lit("n"), "n_nationkey"), F.concat(F.lit("r"), "n_regionkey")))
    return out.union(supplier.select(F.concat(F.lit("s"), "s_suppkey"), F.concat(F.lit("n"), "s_nationkey")))


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query, edge, lwr): orders as queries, their suppliers as edges, the best discount as weight."""
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy(F.col("l_orderkey").alias("query"), F.concat(F.lit("s"), F.col("l_suppkey")).alias("edge")).agg(F.max("l_discount").alias("lwr"))


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node, cnt): line items placed on each supplier's edge."""
    return table(spark, sf_dir, "lineitem").groupBy(F.concat(F.lit("s"), F.col("l_suppkey")).alias("node")).agg(F.count("*").alias("cnt"))


#: Edits that each value of a column stands for.
EACH = 6


def column_edits(rows: DataFrame, key: str, levels: list[Column]) -> DataFrame:
    """(name, edit): what a row has in common with all others of the same ``levels``, from the outermost on.

    Rows that agree in the first columns share their edits, so that the values of
    the columns, nested in each other, are the clades of a right tree.
    """
    paths = [F.concat_ws("/", *levels[: i + 1]) for i in range(len(levels))]
    edit = F.transform(F.sequence(F.lit(1), F.lit(EACH)), lambda j: F.concat_ws("#", F.col("path"), j.cast("string")))
    return rows.select(F.col(key).cast("string").alias("name"), F.explode(F.array(*paths)).alias("path")).select("name", F.explode(edit).alias("edit"))


#: Halvings of the nations by key, from two groups of them to each alone, and of the keys within a nation.
NATION_SPANS, KEY_PARTS = (16, 8, 4, 2, 1), (2, 4, 8)


def nation_levels(nation: str) -> list[Column]:
    return [F.floor(F.col(nation) / w).cast("string") for w in NATION_SPANS]


def nested(spark: SparkSession, sf_dir: str, name: str, key: str, nation: str) -> DataFrame:
    """(name, level1, level2, ...) of the rows of a table: groups of nations, the nation, groups of keys within it."""
    levels = [*nation_levels(nation), *[(F.col(key) % n).cast("string") for n in KEY_PARTS]]
    return table(spark, sf_dir, name).select(F.concat(F.lit("t"), F.col(key)).alias("name"), *[c.alias(f"level{i}") for i, c in enumerate(levels, 1)])


LEVELS = [f"level{i}" for i in range(1, len(NATION_SPANS) + len(KEY_PARTS) + 1)]


#: DuckDB twins of the views above.
SQL_TREE = """tree AS (SELECT 'root' AS node, CAST(NULL AS VARCHAR) AS parent UNION ALL SELECT 'r' || r_regionkey, 'root' FROM region
  UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier)"""
SQL_CLOSURE = """closure AS (SELECT node, node AS ancestor, 0 AS distance FROM tree
  UNION ALL SELECT c.node, t.parent, c.distance + 1 FROM closure c JOIN tree t ON c.ancestor = t.node WHERE t.parent IS NOT NULL)"""
SQL_CAND = "cand AS (SELECT l_orderkey AS query, 's' || l_suppkey AS edge, max(l_discount) AS lwr FROM lineitem GROUP BY ALL)"
SQL_COUNTS = "counts AS (SELECT 's' || l_suppkey AS node, count(*) AS cnt FROM lineitem GROUP BY ALL)"
SQL_SEQ = """seqs AS (SELECT 'v' || vec_id AS name, CAST(label AS BIGINT) AS label, array_to_string(list_transform(embedding, lambda x, i: CASE WHEN i <= 33 THEN CASE WHEN x >= 0 THEN 'T' ELSE 'C' END ELSE CASE WHEN x >= 0 THEN 'A' ELSE 'G' END END), '') AS seq FROM embeddings)"""
SQL_EDITS = "edits AS (SELECT 'u' || user_id AS name, event_type || ':' || hour(ts) AS edit FROM events)"


def sql_clades(taxa: str, columns: list[str]) -> str:
    """Every value of nested columns with its number of taxa, which a right tree keeps together."""
    paths = ["''"] + [" || '/' || ".join(columns[: i + 1]) for i in range(len(columns))]
    each = " UNION ALL ".join(f"SELECT {p} AS clade FROM taxa" for p in paths)
    return f"WITH taxa AS ({taxa}) SELECT clade, count(*) AS n, count(*) AS together FROM ({each}) GROUP BY clade"


def sql_nested(table: str, nation: str) -> str:
    return f"SELECT {', '.join(f'{nation} // {w} AS level{i}' for i, w in enumerate(NATION_SPANS, 1))} FROM {table}"
