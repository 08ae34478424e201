"""From documents to packed training sequences: quality rules, line dedup, near-duplicates, decontamination, packing.

The stages' code is part of the training-data subpackage.
"""

from treeloom.llm.stages import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
