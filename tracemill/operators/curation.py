"""Curation: review reasons, quotas, holdout and frozen cohorts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracemill.functions.scalars import round_to


def review_reasons(candidates: DataFrame, min_quality: float = 0.75, min_verifier: float = 0.5, default_use: str = "training_candidate") -> DataFrame:
    """Candidates with their distinct reasons for review, in a fixed order."""
    reason = lambda condition, name: F.when(condition, name)
    reasons = F.array_compact(
        F.array(
            F.col("review_reason"),
            reason(F.col("task_type").isin("unknown", "new_subtype"), "unresolved_task_type"),
            reason(F.col("quality_confidence") < min_quality, "low_quality_confidence"),
            reason(F.col("verifier_score") < min_verifier, "low_verifier_score"),
            reason((F.col("source_channel") == "shadow") & F.lit(default_use == "training_candidate"), "shadow_only_candidate"),
        )
    )
    return candidates.withColumn("reasons", F.array_distinct(reasons))


def _best(by: str) -> Window:
    return Window.partitionBy(by).orderBy(F.desc("verifier_score"), F.desc("quality_confidence"), "run_id", "artifact_id")


def quotas(candidates: DataFrame, per_instance: int = 1, per_template: int | None = None) -> DataFrame:
    """Candidates with a holdout reason where their instance's, then their template's, quota is used up."""
    ranked = candidates.withColumn("_rank", F.row_number().over(_best("task_instance_key")))
    out = ranked.withColumn("holdout_reason", F.when(F.col("_rank") > per_instance, "task_instance_quota"))
    if per_template is not None:
        second = Window.partitionBy("task_template_hash", F.col("holdout_reason").isNull()).orderBy(F.desc("verifier_score"), F.desc("quality_confidence"), "run_id", "artifact_id")
        rank = F.row_number().over(second)
        out = out.withColumn("_rank", rank).withColumn("holdout_reason", F.coalesce("holdout_reason", F.when(F.col("_rank") > per_template, "task_template_quota")))
    return out.drop("_rank")


def holdout(candidates: DataFrame, fraction: float, purpose: str = "training") -> DataFrame:
    """The latest candidates that are not held out yet, a fraction of them, are held out by time.

    Counts by day find the day in which the cut lies; only that day's candidates are ranked.
    """
    free = candidates.where("holdout_reason is null").withColumn("_day", F.to_date("latest_ts"))
    days = sorted(((r["_day"], r["n"]) for r in free.groupBy("_day").agg(F.count("*").alias("n")).collect()), reverse=True)
    n = sum(x for _, x in days)
    if purpose != "training" or fraction <= 0 or n < 2:
        return candidates
    left = min(n - 1, max(1, round(n * fraction)))
    for day, count in days:
        if left <= count:
            break
        left -= count
    at = F.struct("latest_ts", "run_id", "artifact_id")
    cut = free.where(F.col("_day") == day).select(at.alias("at")).orderBy(F.desc("at")).limit(left).agg(F.min("at").alias("cut"))
    return candidates.crossJoin(F.broadcast(cut)).withColumn("holdout_reason", F.coalesce("holdout_reason", F.when(at >= F.col("cut"), "holdout_fraction"))).drop("cut")  # cut is one row


def freeze(candidates: DataFrame) -> DataFrame:
    """Statistics of a cohort's members by task type."""
    return candidates.groupBy("task_type").agg(
        F.count("*").alias("members"), F.count_distinct("task_instance_key").alias("instances"), F.count_distinct("task_template_hash").alias("templates"),
        F.min("quality_confidence").alias("min_quality"), F.max("quality_confidence").alias("max_quality"),
        round_to(F.sum(F.floor(F.col("quality_confidence") * 100 + 0.5)) / F.count("*") / 100).alias("avg_quality"),
        F.min("verifier_score").alias("min_verifier"), F.max("verifier_score").alias("max_verifier"),
    )
