"""Mutation lists in and out: rows (name, edits)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def parse_edits(text: Column) -> Column:
    """The edits of a ``;``-joined list; none for a missing or empty one."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), ";"), lambda x: F.trim(x) != "")


def read_edits(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(name, edits) of every line (S2): a name, white space, edits joined by ``;`` (or nothing)."""
    parts = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where(F.trim("value") != "").select(parts[0].alias("name"), parse_edits(F.try_element_at(parts, F.lit(2))).alias("edits"))


def write_edits(df: DataFrame, path: str, compression: str = "none") -> None:
    """``name TAB edit;edit`` (S10); a row without edits keeps its own line."""
    df.select(F.concat_ws("\t", "name", F.concat_ws(";", "edits"))).write.option("compression", compression).text(path)
