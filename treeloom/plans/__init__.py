"""Plan-level helpers: cutting lineage and choosing joins by measured size."""
