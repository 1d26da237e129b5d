"""The corpus pipeline: its stages, the SQL for its rows (none), and the run over all of them."""

from orrery.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
