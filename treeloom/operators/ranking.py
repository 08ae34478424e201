"""Row numbers, running sums and last values within groups of any size."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from treeloom.plans.durable import counted, stored
from treeloom.plans.sizing import broadcast_if_small

#: Rows of a table that one window sorts; larger tables are dealt to ranges.
WINDOW_ROWS = 50_000


def _dealt(rows: DataFrame, by: list[str], order: list[Column | str]) -> DataFrame:
    """Rows in ranges of (by, order), which split a large group: _rk_at is their order, _rk_block their range."""
    dealt = rows.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order).withColumn("_rk_at", F.monotonically_increasing_id())
    return stored(dealt).withColumn("_rk_block", F.shiftrightunsigned("_rk_at", 33))


def _named(by: list[str]) -> list[Column]:
    """A group's columns beside its rows, named by their places, so that no caller's name meets one of these."""
    return [F.col(c).alias(f"_rk_by{i}") for i, c in enumerate(by)]


def _same(by: list[str], *more: Column) -> Column:
    return reduce(lambda a, b: a & b, [*more, *[F.col(c).eqNullSafe(F.col(f"_rk_by{i}")) for i, c in enumerate(by)]])


def _same_range(by: list[str]) -> Column:
    return _same(by, F.col("_rk_block") == F.col("_rk_of"))


def _earlier(by: list[str]) -> Window:
    return Window.partitionBy(*(by or [F.lit(0)])).orderBy("_rk_block").rowsBetween(Window.unboundedPreceding, -1)


def _large(rows: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame | None]:
    """``rows`` of groups that one window may sort each, and of those larger than WINDOW_ROWS, if there are any."""
    big, m = counted(rows.groupBy(*by).agg(F.count("*").alias("_rk_n")).where(F.col("_rk_n") > WINDOW_ROWS).select(*_named(by)))
    if not m:
        return rows, None
    big = broadcast_if_small(big, m)
    return rows.join(big, _same(by), "left_anti"), rows.join(big, _same(by), "left_semi")


def ranked(df: DataFrame, by: list[str], order: list[Column | str], out: str = "rank") -> DataFrame:
    """``df`` with ``out``, each row's place from 0 on within ``by`` in ``order``.

    A window sorts a whole group in one task, which is right for groups up to
    WINDOW_ROWS rows. Rows of larger ones are dealt to ranges of (by, order) and
    numbered where they lie; the first number of each group in each range, a
    small table, makes that a place in the group. Rows equal in ``by`` and
    ``order`` share a range.
    """
    rows, n = counted(df)
    number = lambda few: few.withColumn(out, F.row_number().over(Window.partitionBy(*(by or [F.lit(0)])).orderBy(*order)).cast("long") - 1)
    if n <= WINDOW_ROWS:
        return number(rows)
    if not by:
        return _ranked_dealt(rows, by, order, out)
    small, large = _large(rows, by)
    return number(small) if large is None else number(small).unionByName(_ranked_dealt(large, by, order, out))


def _ranked_dealt(df: DataFrame, by: list[str], order: list[Column | str], out: str) -> DataFrame:
    rows = df
    dealt = _dealt(rows, by, order)
    heads = dealt.groupBy(*by, "_rk_block").agg(F.min("_rk_at").alias("_rk_first"), F.count("*").alias("_rk_n"))
    before = F.coalesce(F.sum("_rk_n").over(_earlier(by)), F.lit(0))
    heads, m = counted(heads.select(*_named(by), F.col("_rk_block").alias("_rk_of"), (before - F.col("_rk_first")).alias("_rk_shift")))
    return dealt.join(broadcast_if_small(heads, m), _same_range(by)).select(*df.columns, (F.col("_rk_at") + F.col("_rk_shift")).alias(out))


def running(df: DataFrame, by: list[str], order: list[Column | str], sums: dict[str, Column] | None = None, last: dict[str, Column] | None = None) -> DataFrame:
    """``df`` with running ``sums`` (null: 0) and ``last`` values that were not null, up to and with each row, within ``by`` in ``order``.

    As in ``ranked``, large groups are dealt to ranges: a window inside each
    range gives what the range alone would, and what came before it in the group
    is one row for each group and range. Rows equal in ``by`` and ``order`` have
    no order of their own.
    """
    sums, last = sums or {}, last or {}
    rows, n = counted(df.withColumns({**{k: F.coalesce(c.cast("long"), F.lit(0).cast("long")) for k, c in sums.items()}, **last}))
    here = _here(sums, last)
    window = lambda few: few.withColumns(here(Window.partitionBy(*(by or [F.lit(0)])).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    if n <= WINDOW_ROWS:
        return window(rows)
    if not by:
        return _running_dealt(rows, by, order, sums, last)
    small, large = _large(rows, by)
    return window(small) if large is None else window(small).unionByName(_running_dealt(large, by, order, sums, last))


def _here(sums: dict[str, Column], last: dict[str, Column]):
    return lambda w: {**{k: F.sum(k).over(w) for k in sums}, **{k: F.last(k, ignorenulls=True).over(w) for k in last}}


def _running_dealt(rows: DataFrame, by: list[str], order: list[Column | str], sums: dict[str, Column], last: dict[str, Column]) -> DataFrame:
    here = _here(sums, last)
    dealt = _dealt(rows, by, order)
    final = {k: F.max(F.when(F.col(k).isNotNull(), F.struct("_rk_at", k)))[k] for k in last}
    heads = dealt.groupBy(*by, "_rk_block").agg(*[F.sum(k).alias(k) for k in sums], *[c.alias(k) for k, c in final.items()])
    w = _earlier(by)
    carried = [*[F.coalesce(F.sum(k).over(w), F.lit(0)).alias(f"_rk_sum_{k}") for k in sums], *[F.last(k, ignorenulls=True).over(w).alias(f"_rk_last_{k}") for k in last]]
    heads, m = counted(heads.select(*_named(by), F.col("_rk_block").alias("_rk_of"), *carried))
    inside = dealt.withColumns(here(Window.partitionBy(*by, "_rk_block").orderBy("_rk_at").rowsBetween(Window.unboundedPreceding, 0)))
    both = inside.join(broadcast_if_small(heads, m), _same_range(by))
    kept = [c for c in rows.columns if c not in sums and c not in last]
    return both.select(*kept, *[(F.col(k) + F.col(f"_rk_sum_{k}")).alias(k) for k in sums], *[F.coalesce(k, f"_rk_last_{k}").alias(k) for k in last])
