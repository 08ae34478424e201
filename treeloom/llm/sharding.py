"""Proportional stratified interleaving into shards of equal row counts.

Rows are ranked within their source in a seeded shuffled order; a row's
fractional rank is (rank + 1/2) / (rows of the source). Sorted by it, any run of
rows holds the sources in the corpus' mixture, so the order is cut into shards
whose counts differ by at most one.

No source is sorted in one task. Seeded hashes spread every source over buckets;
counts by (source, bucket) and their running sums, a small table, turn ranks
within a bucket into ranks within the source, and the same is done once more for
the global order over buckets of the fractional rank. At most MAX_BUCKETS
buckets exist, whose running sum is one short window. Rows of one key, or
without a key, share a hash: a bucket of over HOT_ROWS rows is dealt on by a
salt, so that no key's rows are sorted in one task either.

Defined results: a null source is a source of its own; null and empty texts are
rows like others; equal keys and repeated rows take near ranks in some order; an empty table has no shards; fewer rows than shards leave shards empty.
Columns of ``docs`` are carried through (names that begin with ``_sh_`` are
refused with a ValueError); select what is needed first, since rows travel twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from treeloom.llm._text import own_names
from treeloom.plans.durable import durable
from treeloom.plans.sizing import broadcast_if_small

BUCKET_ROWS, MAX_BUCKETS = 512, 65_536
#: Rows of a source in one bucket beyond which it is dealt on.
HOT_ROWS = 64 * BUCKET_ROWS


def _running(counts: DataFrame, by: list[Column], bucket: list[str], n: str, out: str) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*bucket).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn(out, F.coalesce(F.sum(n).over(w), F.lit(0)))


def assign_shards(docs: DataFrame, shards: int = 16, source: str = "source", key: str = "doc_id", seed: int = 17) -> DataFrame:
    """``docs`` with _sh_rank (place in the whole order), _sh_shard and _sh_slot."""
    own_names(docs, "_sh_")
    rows = docs.withColumns({"_sh_source": F.coalesce(F.concat(F.lit("s"), F.col(source).cast("string")), F.lit("n")), "_sh_hash": F.xxhash64(F.lit(seed), F.col(key)), "_sh_salt": F.monotonically_increasing_id()})
    rows = durable(rows)
    total = rows.count()
    if not total:
        return rows.select(*docs.columns, F.lit(0).cast("long").alias("_sh_rank"), F.lit(0).alias("_sh_shard"), F.lit(0).cast("long").alias("_sh_slot"))
    buckets = max(1, min(MAX_BUCKETS, total // BUCKET_ROWS))
    bucket = F.pmod(F.shiftrightunsigned(F.col("_sh_hash"), 16), F.lit(buckets)).cast("int")
    rows = rows.withColumn("_sh_bucket", bucket)
    counts = durable(rows.groupBy("_sh_source", "_sh_bucket").agg(F.count("*").alias("_sh_n")))
    rows = rows.withColumn("_sh_part", F.lit(0))
    per = max(1, -(-total // buckets))
    hot = counts.where(F.col("_sh_n") > max(HOT_ROWS, 64 * per))
    if not hot.isEmpty():
        parts = durable(hot.select("_sh_source", "_sh_bucket", F.ceil(F.col("_sh_n") / max(BUCKET_ROWS, per)).alias("_sh_parts")))
        part = F.coalesce(F.pmod(F.xxhash64("_sh_salt"), F.col("_sh_parts")), F.lit(0)).cast("int")
        rows = rows.drop("_sh_part").join(broadcast_if_small(parts), ["_sh_source", "_sh_bucket"], "left").withColumn("_sh_part", part).drop("_sh_parts")
        counts = durable(rows.groupBy("_sh_source", "_sh_bucket", "_sh_part").agg(F.count("*").alias("_sh_n")))
    else:
        counts = counts.withColumn("_sh_part", F.lit(0))
    sizes = counts.groupBy("_sh_source").agg(F.sum("_sh_n").alias("_sh_of"))
    before = durable(_running(counts, [F.col("_sh_source")], ["_sh_bucket", "_sh_part"], "_sh_n", "_sh_before").join(sizes, "_sh_source").drop("_sh_n"))
    local = F.row_number().over(Window.partitionBy("_sh_source", "_sh_bucket", "_sh_part").orderBy("_sh_hash", F.col(key), "_sh_salt")) - 1
    ranked = rows.withColumn("_sh_local", local).join(broadcast_if_small(before), ["_sh_source", "_sh_bucket", "_sh_part"])
    fraction = (F.col("_sh_before") + F.col("_sh_local") + 0.5) / F.col("_sh_of")
    ranked = ranked.withColumn("_sh_fraction", fraction).withColumn("_sh_spot", F.col("_sh_before") + F.col("_sh_local")).withColumn("_sh_bucket", F.least(F.floor(F.col("_sh_fraction") * buckets), F.lit(buckets - 1)).cast("int"))
    ranked = durable(ranked.drop("_sh_before", "_sh_of"))
    heads = ranked.groupBy("_sh_bucket").agg(F.count("*").alias("_sh_n"))
    heads = durable(_running(heads, [F.lit(0)], ["_sh_bucket"], "_sh_n", "_sh_before").drop("_sh_n"))
    local = F.row_number().over(Window.partitionBy("_sh_bucket").orderBy("_sh_fraction", "_sh_source", "_sh_spot")) - 1
    out = ranked.withColumn("_sh_local", local).join(F.broadcast(heads), "_sh_bucket")  # at most MAX_BUCKETS rows
    rank = (F.col("_sh_before") + F.col("_sh_local")).cast("long")
    out = out.withColumn("_sh_rank", rank).withColumn("_sh_shard", F.floor(F.col("_sh_rank") * shards / total).cast("int"))
    # exact integers: the double above may be off by one at a cut
    cut = lambda s: F.expr(f"({s} * {total} + {shards - 1}) div {shards}")
    shard = F.when(F.col("_sh_rank") < cut("_sh_shard"), F.col("_sh_shard") - 1).when(F.col("_sh_rank") >= cut("(_sh_shard + 1)"), F.col("_sh_shard") + 1).otherwise(F.col("_sh_shard"))
    out = out.withColumn("_sh_shard", shard.cast("int")).withColumn("_sh_slot", (F.col("_sh_rank") - cut("_sh_shard")).cast("long"))
    return out.select(*docs.columns, "_sh_rank", "_sh_shard", "_sh_slot")


def write_shards(assigned: DataFrame, path: str, parts: int = 1) -> None:
    """Write the rows as one folder for each shard, ordered by slot within each of its ``parts`` files."""
    own = ["_sh_rank", "_sh_shard", "_sh_slot"]
    end = F.max("_sh_slot").over(Window.partitionBy("_sh_shard")) if parts > 1 else None
    rows = assigned if end is None else assigned.withColumn("_sh_part", F.floor(F.col("_sh_slot") * parts / (end + 1)).cast("int"))
    by = [F.col("_sh_shard")] + ([F.col("_sh_part")] if parts > 1 else [])
    rows.repartition(*by).sortWithinPartitions(*by, "_sh_slot").select(*[c for c in assigned.columns if c not in own], F.col("_sh_shard").alias("shard")).write.partitionBy("shard").parquet(path)
