"""From documents to packed training sequences, in five stages (``corpus_pipeline`` at the top shows them).

Each stage reads what the stage before it wrote, whole, and returns a DataFrame;
all but the last return the columns of documents. No stage can be expressed in
SQL as a whole (learned rules, sketches, alignment and a tokenizer), so
ORACLE_SQL is None and the tests hold the stages against brute force.

Defined results: a null or empty text fails the base rule of the first stage;
where stages are used alone it is carried by the others and packed as its end
token. Null ids are carried, but not compared for near duplicates; rows of one id
are one document there and stay or go together. An empty table stays empty.
Columns beside those of documents are left out, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeloom.llm import decontaminate, line_dedup, near_dedup, packing, quality_rules
from treeloom.plans.durable import durable, scratch
from treeloom.plans.sizing import broadcast_if_small

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rule or a learned rule go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    docs = docs.select(*COLUMNS)
    judged = quality_rules.judge(docs, quality_rules.train(docs, labels), keep_text=True)
    return judged.where("_qr_kept").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines of a source go; n_chars follows the text."""
    out = line_dedup.dedup_lines(docs.select(*COLUMNS))
    return out.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the one of least doc_id (five-word shingles, similarity 0.8)."""
    gone = durable(near_dedup.near_duplicates(docs.select(*COLUMNS), k=5, percent=80).where("NOT kept").select(F.col("doc_id").alias("_gone")).distinct())
    return docs.join(broadcast_if_small(gone), docs.doc_id == gone["_gone"], "left_anti").select(*COLUMNS)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark passage go."""
    return decontaminate.drop_leaks(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces in sequences of 2048."""
    out = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=2048, end_id=1)
    return out.select("doc_id", "start", "length", F.crc32("token_ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("decontaminated", decontaminated), ("packed", packed)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; every stage but the last is written to the shared folder, where it stays until the session ends, and read again."""
    folder = scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs.write.parquet(f"{folder}/{k}_{name}")
            docs = spark.read.parquet(f"{folder}/{k}_{name}")
    return docs
