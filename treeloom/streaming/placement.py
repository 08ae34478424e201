"""Placing sequences as they arrive on a fixed set of clade models.

A finished level's models can serve new records without a new run: the same
kernel runs over a stream, record by record and without state, so that any
streaming sink and trigger applies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from treeloom.config import LineageConfig
from treeloom.plans.engine import _Run


def place_stream(stream: DataFrame, models: DataFrame, config: LineageConfig, root: str) -> DataFrame:
    """``stream``: (clade_id, name, seq) rows; ``models``: a finished table of sample trees, small enough to broadcast."""
    return _Run(config, root).place(stream, models)
