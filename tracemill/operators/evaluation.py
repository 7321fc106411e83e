"""Evaluation: metrics, verdicts, promotion, overlap and the feedback queue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.functions.scalars import nearest_rank, round_to
from tracemill.operators.builders import reward
from tracemill.operators.scans import in_order

_AT = ("created_at", "seq")


def run_scores(artifacts: DataFrame) -> DataFrame:
    """Per run the newest active score that is a number or a label."""
    scores = artifacts.where("artifact_type = 'score' and status = 'active' and run_id is not null").withColumn("reward", reward(artifacts))
    return scores.groupBy("run_id").agg(F.max_by("reward", F.when(F.col("reward").isNotNull(), in_order(*_AT))).alias("score"))


def scorecard(spans: DataFrame, scores: DataFrame, fields: DataFrame, branches: DataFrame) -> DataFrame:
    """Metrics by task family: mean score and verifier, share of runs with a fallback, p95 latency."""
    run = spans.groupBy("run_id").agg(F.count("*").alias("requests"))
    fallback = branches.groupBy("run_id").agg(F.bool_or(F.col("branch_type") == "fallback").alias("fell_back"))
    joined = run.join(fields.select("run_id", "task_family", "verifier_score"), "run_id").join(scores, "run_id", "left").join(fallback, "run_id")
    cents = lambda x: F.sum(F.floor(F.col(x) * 100 + 0.5)) / F.count(x) / 100
    by_family = joined.where("task_family is not null").groupBy("task_family").agg(
        F.count("*").alias("runs"), round_to(cents("score")).alias("mean_score"), round_to(F.coalesce(cents("verifier_score"), cents("score"))).alias("mean_verifier"),
        round_to(F.count_if("fell_back") / F.count("*")).alias("fallback_rate"),
    )
    latency = nearest_rank(spans.where("latency_ms is not null").join(fields.select("run_id", "task_family"), "run_id").where("task_family is not null"), "task_family", "latency_ms", 95, "p95_latency_ms")
    return by_family.join(latency, "task_family", "left")


def latency_percentiles(spans: DataFrame) -> DataFrame:
    """Both definitions of the 95th percentile, by actor."""
    timed = spans.where("latency_ms is not null")
    linear = timed.groupBy("actor").agg(round_to(F.percentile("latency_ms", F.lit(0.95)), 3).alias("linear"))
    return nearest_rank(timed, "actor", "latency_ms", 95, "nearest_rank").join(linear, "actor")


def verdict(metrics: DataFrame, thresholds: list[tuple[str, str, float]]) -> Column:
    """Verdict by thresholds (metric, operator, value) in order; the first that decides wins."""
    if not thresholds:
        return F.lit("hold")
    out = None
    for name, operator, value in thresholds:
        x = F.col(name) if name in metrics.columns else F.lit(None).cast("double")
        miss = x < value if operator == "gte" else x > value if operator == "lte" else None
        step = F.when(x.isNull(), "fail").when(miss, "fail") if miss is not None else F.when(x.isNull(), "fail").otherwise("hold")
        out = step if out is None else F.coalesce(out, step)
    return F.coalesce(out, F.lit("pass"))


def promotion(verdict_column: Column) -> Column:
    return F.when(verdict_column == "pass", "promote").when(verdict_column == "hold", "hold").otherwise("rollback")


def overlap(training: DataFrame, evaluation: DataFrame, *keys: str) -> DataFrame:
    """Distinct values that both have, by key."""
    out = None
    for key in keys:
        both = training.select(F.col(key).alias("value")).where("value is not null").intersect(evaluation.select(F.col(key).alias("value")).where("value is not null"))
        one = both.agg(F.lit(key).alias("key"), F.count("*").alias("shared"))
        out = one if out is None else out.union(one)
    return out


def compare_models(cases: DataFrame) -> DataFrame:
    """Pass rates, mean scores and win rate of a candidate against a baseline, by group."""
    rate = lambda x: round_to(F.count_if(x) / F.count("*"))
    mean = lambda x: round_to(F.sum(x) / F.count("*"), 2)
    return cases.groupBy("lang").agg(
        F.count("*").alias("cases"), rate("candidate_pass").alias("candidate_pass_rate"), rate("baseline_pass").alias("baseline_pass_rate"),
        mean("candidate_score").alias("candidate_mean"), mean("baseline_score").alias("baseline_mean"), rate(F.col("candidate_score") >= F.col("baseline_score")).alias("win_rate"),
        round_to(F.percentile("candidate_score", F.lit(0.95)), 2).alias("candidate_p95"),
    )


def new_feedback(reviewed: DataFrame, queue: DataFrame) -> DataFrame:
    """Reasons that are not in the queue unresolved, one row each."""
    wanted = reviewed.select("run_id", F.explode("reasons").alias("reason")).distinct()
    unresolved = queue.where("status <> 'resolved'").select(F.col("run_id"), "reason")
    return wanted.join(unresolved, ["run_id", "reason"], "left_anti")


def feedback_status(events: DataFrame) -> DataFrame:
    """Latest status of every feedback item from its appended status events."""
    return events.groupBy("run_id", "reason").agg(F.max_by("status", in_order()).alias("status"), F.count("*").alias("events"))
