"""All queries of the score-corpus engine with their SQL."""

from pyspark.sql import DataFrame, SparkSession

from stavelake.plans import layout_queries, marks_queries, overlay_queries, rebuild_queries, repair_queries, score_queries, text_queries, timeline_queries  # noqa: F401
from stavelake.plans.registry import ORACLE_SQL, QUERIES  # noqa: F401


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole lint of a corpus."""
    return QUERIES["lint_issues"](spark, sf_dir)
