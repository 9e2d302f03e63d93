"""The corpus pipeline's entry at the repository top; its stages are in strandline/llm/pipeline.py."""

from strandline.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
