"""The pipeline of the llm subpackage: STAGES, run(spark, sf_dir), ORACLE_SQL."""

from corpusforge.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
