"""From raw documents to packed sequences; the stages are those of cellweave.llm.pipeline."""

from cellweave.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
