"""The corpus pipeline: its stages, their SQL and run() come from the subpackage that holds the corpus operators."""

from pagewright.llm.pipeline import ORACLE_SQL, STAGES, decontaminated, mixed, near_duplicate_texts, quality, run, sharded

__all__ = ["ORACLE_SQL", "STAGES", "decontaminated", "mixed", "near_duplicate_texts", "quality", "run", "sharded"]
