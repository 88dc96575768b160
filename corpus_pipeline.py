"""The corpus pipeline: see ``brindle.llm.pipeline``."""

from brindle.llm.pipeline import ORACLE_SQL, ORACLES, QUERIES, STAGES, lines, mix, near_copies, quality, run, sequences

__all__ = ["ORACLES", "ORACLE_SQL", "QUERIES", "STAGES", "lines", "mix", "near_copies", "quality", "run", "sequences"]
