"""From raw documents to token ids: the stages and their run are in ``cresthaven.llm.stages``."""

from cresthaven.llm.stages import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
