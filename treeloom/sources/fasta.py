"""FASTA in and out: records as rows (name, seq)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeloom.functions.columns import fasta_line


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(value): each record's text, without the ``>`` at its start.

    Records are cut where a line starts with ``>``, so that one inside a
    description stays there. A file's first record keeps its sign.
    """
    text = spark.read.option("lineSep", "\n>").text(path)
    return text.select(F.regexp_replace("value", r"^\s*>", "").alias("value")).where(F.length(F.trim(F.regexp_replace("value", r"\s+", " "))) > 0)


def read_fasta(spark: SparkSession, path: str | list[str], partitions: int | None = None) -> DataFrame:
    """(name, seq) of every record.

    ``path`` may be a file, a folder, a glob or a list; ``.gz`` is unpacked.
    Records may span lines; what follows the name on its line is dropped. A
    compressed file cannot be split, so give ``partitions`` to spread it.
    """
    body = F.col("value")
    seq = F.regexp_replace(F.regexp_replace(body, r"^[^\n]*", ""), r"\s+", "")
    rows = _lines(spark, path).select(F.regexp_extract(body, r"^[^\S\n]*(\S+)", 1).alias("name"), seq.alias("seq"))
    return rows.repartition(partitions) if partitions else rows


def count_by_file(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, n): records of each input file (A1)."""
    return _lines(spark, path).groupBy(F.input_file_name().alias("file")).agg(F.count("*").alias("n"))


def write_fasta(df: DataFrame, path: str, compression: str = "none") -> None:
    """One part file for each partition (S9); ``gzip`` packs them."""
    df.select(fasta_line(F.col("name"), F.col("seq"))).write.option("compression", compression).text(path)


def write_phylip(df: DataFrame, path: str) -> None:
    """Relaxed PHYLIP (S11): part files in order, a header with counts in the first, then name and sequence by name."""
    head = df.agg(F.concat_ws(" ", F.count("*"), F.max(F.length("seq"))).alias("value")).select(F.lit(0).alias("k"), F.lit("").alias("name"), "value")
    rows = head.union(df.select(F.lit(1), "name", F.concat_ws("  ", "name", "seq")))
    rows.orderBy("k", "name").select("value").write.text(path)
