"""Versions of a score: which one a session goes on from, and what its checkpoint says afterwards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stavelake.operators import replay
from stavelake.operators.overlay import merged_log

FROM_RAW, FROM_BASELINE = "raw", "baseline"


def sync_plan(sessions: DataFrame) -> DataFrame:
    """Adds mode and source to score_id, has_raw, has_baseline, pending, total_applied and owns_edits.

    Pending corrections go onto the baseline (incremental), or onto the raw score where there is none yet (full). Without pending ones the baseline is
    restored; if it holds no correction at all, from the raw score, which clears what processing left on it. A score without either starts anew (init).
    A raw score that is asked for and not kept leaves the score as it is: source null.
    """
    clean = F.col("has_raw") & (F.col("total_applied") == 0) & ~F.col("owns_edits")
    pending = F.col("pending") > 0
    mode = F.when(pending & ~F.col("has_baseline"), "full").when(pending, "incremental").when(F.col("has_baseline") & clean, "restore-from-raw").when(F.col("has_baseline"), "restore").otherwise("init")
    out = sessions.withColumn("mode", mode)
    return out.withColumn("source", F.when(F.col("mode").isin("incremental", "restore"), FROM_BASELINE).when(F.col("has_raw"), FROM_RAW))


def checkpoints(plan: DataFrame, applied: DataFrame) -> DataFrame:
    """The checkpoint after a sync, which always leaves a baseline. applied: score_id and applied (corrections that took effect)."""
    joined = plan.join(applied, "score_id", "left").withColumn("applied", F.coalesce("applied", F.lit(0)).cast("long"))
    total = F.when(F.col("mode") == "restore-from-raw", 0).otherwise(F.col("total_applied") + F.col("applied"))
    return joined.select("score_id", "mode", "source", "applied", F.col("pending").alias("cleared"), total.cast("long").alias("total_applied"), (F.col("owns_edits") | (F.col("applied") > 0)).alias("owns_edits"), F.lit(True).alias("has_baseline"))


def synced(sessions: DataFrame, versions: DataFrame, measures: DataFrame, fixes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(elements, checkpoints). versions: elements with ``version`` (raw, baseline, score); fixes: what is pending. The elements are the new baseline too.

    A score is read at the version that its plan names, or as it stands; scores with pending corrections have them replayed.
    """
    plan = sync_plan(sessions)
    wanted = plan.select("score_id", F.coalesce("source", F.lit("score")).alias("version"), F.col("pending") > 0)
    wanted = wanted.toDF("score_id", "version", "_pending")
    rows = versions.join(wanted, ["score_id", "version"]).drop("version")
    typed = [F.col(c.split()[0]).cast(c.split()[1]).alias(c.split()[0]) for c in replay.ELEMENT.split(", ") if c.split()[0] != "was"]
    still = rows.filter("not _pending").select(*replay.MEASURE, "seq", *typed, F.col("seq").alias("was"))
    log = merged_log(fixes.join(plan.filter("pending > 0").select("score_id"), "score_id", "left_semi"))
    changed, report = replay.apply_all(measures.join(log.select("score_id").distinct(), "score_id", "left_semi"), rows.filter("_pending").drop("_pending"), log)
    applied = report.join(log.select("fix_id", "score_id"), "fix_id").groupBy("score_id").agg(F.count_if("applied").alias("applied"))
    return still.unionByName(changed.select(still.columns)), checkpoints(plan, applied)
