"""Reliable lineage cuts in the folder that the whole cluster shares."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Folders that are to be deleted when the JVM ends.
_LEAVING: set[str] = set()


class Tables:
    """The stored tables of a piece of work; those that are not kept leave when it ends."""

    def __init__(self, outer: Tables | None) -> None:
        self.outer, self.paths = outer, set[str]()

    def keep(self, *tables: DataFrame) -> None:
        """Hand tables that ``stored`` or ``counted`` returned to the work around this one."""
        for path in {t._stored_at for t in tables}:
            self.paths.discard(path)
            if self.outer is not None:
                self.outer.paths.add(path)

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that nothing reads any more."""
        for t in tables:
            if t._stored_at in self.paths:
                self.paths.discard(t._stored_at)
                _delete(t.sparkSession, t._stored_at)


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


#: The pieces of work under way by thread of this driver, the innermost last.
_WORK: dict[int, list[Tables]] = {}


def _under_way() -> list[Tables]:
    return _WORK.setdefault(threading.get_ident(), [])


@contextmanager
def tables(spark: SparkSession) -> Iterator[Tables]:
    """A piece of work whose stored tables are deleted at its end, but for those it keeps.

    What it returns must not read a table that leaves: store and keep it first.
    """
    work = _under_way()
    mine = Tables(work[-1] if work else None)
    work.append(mine)
    try:
        yield mine
    finally:
        work.remove(mine)
        for path in mine.paths:
            _delete(spark, path)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The session's shared checkpoint folder.

    ``spark.checkpoint.dir`` wins. Where neither it nor a folder on the context
    is set, a local session (tests, notebooks) takes a folder in its warehouse;
    on a cluster that is an error, since only its owner knows what its nodes share.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not named and not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all nodes share")
    target = named or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    sc.setCheckpointDir(target)
    return target


def durable(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and start a new lineage there.

    Unlike a local checkpoint the files outlive any executor, so a lost node
    costs a re-read, not a failed job.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    # A checkpoint hands its plan's inferred constraints on to every plan above it.
    # Over the rounds of a loop they multiply until planning takes all the time.
    key = "spark.sql.constraintPropagation.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        return df.checkpoint(eager=True)
    finally:
        spark.conf.set(key, before)


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder; what is written there leaves with the work of ``tables`` around it, else with the JVM."""
    base = f"{ensure_checkpoint_dir(spark)}/tables-{spark.sparkContext.applicationId}"
    if base not in _LEAVING:
        _LEAVING.add(base)
        folder = spark._jvm.org.apache.hadoop.fs.Path(base)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    path = f"{base}/{uuid.uuid4().hex}"
    if work := _under_way():
        work[-1].paths.add(path)
    return path


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as a Parquet table in the shared folder and read back, for tables that loops read again.

    A checkpoint runs its last stage twice and hands on the size estimate of its
    plan, which a loop of joins squares each round until planning takes all the
    time; a table is computed once and has the size of its files. Inside
    ``tables`` it leaves at the end of that work, else when the JVM ends.
    """
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def measured(df: DataFrame, **figures) -> tuple[DataFrame, dict]:
    """``stored(df)`` and aggregates over its rows, taken while it is written: no job of their own."""
    seen = Observation()
    out = stored(df.observe(seen, *[c.alias(k) for k, c in figures.items()]))
    return out, seen.get


def counted(df: DataFrame) -> tuple[DataFrame, int]:
    """``stored(df)`` and its number of rows, counted while it is written."""
    out, got = measured(df, n=F.count(F.lit(1)))
    return out, got["n"]
