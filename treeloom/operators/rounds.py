"""What a round's outcome means for its clade; the engine and the queries read the same expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def worse(para: Column, before: Column) -> Column:
    """More problematic rows than before."""
    return para > before


def failed(para: Column, before: Column, largest: Column, n: Column) -> Column:
    """No cut, more problematic rows than before, or everything (or nothing) in one child clade."""
    return para.isNull() | worse(para, before) | (largest == n) | (largest == 0)


def decision(fail: Column, para: Column, good: Column, last: bool) -> Column:
    """accept, retry (with the problematic rows), again (from scratch), previous (the last good round) or unresolved."""
    end = F.lit(last)
    return F.when(fail & good.isNotNull(), "previous").when(fail & end, "unresolved").when(fail, "again").when((para == 0) | end, "accept").otherwise("retry")


def realign(n: Column, aligned: Column, ratio: float) -> Column:
    """Whether a clade has shrunk enough since its rows were aligned (X12); not known counts as no."""
    return F.coalesce(n < aligned * ratio, F.lit(False))
