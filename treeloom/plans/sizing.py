"""Join sides are broadcast only behind a count of their rows."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a narrow (few dozen bytes) table that may be sent to every executor.
BROADCAST_ROWS = 1_000_000


def broadcast_if_small(df: DataFrame, rows: int | None = None, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``limit`` rows.

    Beyond the limit no hint is given: Spark then shuffles both sides and AQE
    splits hot keys. ``df`` should be cheap to count (a checkpoint or a table).
    """
    if rows is None:
        rows = df.count()
    return F.broadcast(df) if rows <= limit else df


_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def arrow_rows(spark: SparkSession, rows: int = 256) -> None:
    """Hold the session's Arrow batches to ``rows`` rows at most, so that long texts fit a Python worker.

    Spark reads the setting when a plan runs, so it must outlast the call. It is
    lowered only, once for a session, and a caller's smaller value stays.
    """
    if not 0 < int(spark.conf.get(_BATCH)) <= rows:
        spark.conf.set(_BATCH, str(rows))


@contextmanager
def arrow_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Batches of ``rows`` rows for what is materialised inside the block; the session's own value after it."""
    before = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, str(rows))
    try:
        yield
    finally:
        spark.conf.set(_BATCH, before)
