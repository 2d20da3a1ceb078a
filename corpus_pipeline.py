"""From raw documents to packed training sequences: the stages of :mod:`footing.llm.pipeline`."""

from footing.llm.pipeline import COLUMNS, ORACLE_SQL, STAGES, run

__all__ = ["COLUMNS", "ORACLE_SQL", "STAGES", "run"]
