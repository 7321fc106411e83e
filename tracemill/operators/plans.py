"""What stands between records and a data set: blockers, context, the export plan, judge notes and their overrides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.functions.scalars import clamp, hash_split
from tracemill.operators.artifacts import E1_FIELDS
from tracemill.operators.dataset import keep_first
from tracemill.operators.scans import in_order


def missing_fields(fields: DataFrame) -> DataFrame:
    """Per run the required fields without a value, and whether all are there."""
    names = F.array_compact(F.array(*(F.when(F.col(f).isNull(), f) for f in E1_FIELDS)))
    return fields.select("run_id", F.array_join(names, ",").alias("missing_fields"), (F.size(names) == 0).alias("complete"))


def builder_blockers(fields: DataFrame, records: dict[str, DataFrame]) -> DataFrame:
    """Rows (builder, run_id, blocker): runs without required fields, and builders without records (no run)."""
    lacking = missing_fields(fields).where("not complete")
    out = lacking.select(F.explode(F.array(*(F.lit(b) for b in sorted(records) if b != "facts"))).alias("builder"), "run_id", F.concat(F.lit("missing:"), "missing_fields").alias("blocker"))
    for name, rows in records.items():
        none = rows.limit(1).agg(F.count("*").alias("n")).where("n = 0")
        out = out.union(none.select(F.lit(name), F.lit(None).cast("string"), F.lit("no_records")))
    return out


def unique_values(fields: DataFrame, *columns: str) -> DataFrame:
    """Per column its distinct values, sorted."""
    values = F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).alias("value")) for c in columns))
    rows = fields.select(F.inline(values)).where("value is not null and value <> ''")
    return rows.groupBy("name").agg(F.array_join(F.sort_array(F.collect_set("value")), ",").alias("values"))


def with_annotations(records: DataFrame, fields: DataFrame) -> DataFrame:
    """Records with their run's resolved annotations; records of no run keep nulls."""
    return records.join(fields.select("run_id", *E1_FIELDS, "ready"), "run_id", "left")


def export_plan(records: DataFrame, key: Column, guard: Column, *order: str) -> DataFrame:
    """Distinct records with their split: equal records once, records of one guard in one split."""
    return keep_first(records, key, *order).withColumn("split", hash_split(guard))


def judge_summary(facts: DataFrame, spans: DataFrame) -> DataFrame:
    """What a judge sees of a run: counts, kinds of declared events, and its first three requests."""
    seen = facts.groupBy("run_id").agg(F.count("*").alias("facts"), F.array_join(F.sort_array(F.collect_set("semantic_kind")), ",").alias("kinds"))
    at = F.struct("ts", "seq", "request_id")
    numbered = spans.groupBy("run_id").agg(F.count("*").alias("requests"), F.count_if(F.col("outcome") == "failed").alias("failed"), F.slice(F.sort_array(F.collect_list(at)), 1, 3).alias("first"))
    return seen.join(numbered, "run_id", "left").select("run_id", "facts", "kinds", F.coalesce("requests", F.lit(0)).alias("requests"), F.coalesce("failed", F.lit(0)).alias("failed"), F.array_join(F.transform("first", lambda x: x["request_id"]), ",").alias("samples"))


def judge_notes(fields: DataFrame, answers: DataFrame, low: float = 0.8) -> DataFrame:
    """Annotations of a judge: its answers (run_id, quality, verifier) over the run's own values, clamped, with reasons to review."""
    rows = fields.select("run_id", "quality_confidence", "verifier_score").join(answers, "run_id", "left")
    rows = rows.select("run_id", clamp(F.coalesce("quality", "quality_confidence"), 0.5).alias("quality"), clamp(F.coalesce("verifier", "verifier_score"), 0.0).alias("verifier"))
    reasons = F.array_compact(F.array(F.when(F.col("quality") < low, "low_quality_confidence"), F.when(F.col("verifier") < low, "low_verifier_score")))
    return rows.withColumn("reasons", F.array_join(reasons, ","))


def review_overrides(index: DataFrame, notes: DataFrame) -> DataFrame:
    """Rows that a reviewer's approval appends: each supersedes the run's newest annotation, has no reasons and full scores."""
    newest = index.where("target_kind = 'run' and status = 'active'").groupBy(F.col("target_id").alias("run_id")).agg(F.max_by("artifact_id", in_order("created_at", "seq")).alias("supersedes_artifact_id"))
    return notes.where("reasons <> ''").select("run_id").join(newest, "run_id").select("run_id", "supersedes_artifact_id", F.lit(1.0).alias("quality_confidence"), F.lit(1.0).alias("verifier_score"), F.lit("human_reviewer").alias("producer"))


def workflow_order(workflow: DataFrame, facts: DataFrame, limit: int) -> DataFrame:
    """The first runs to look at: by stage, then oldest first."""
    rank = F.array_position(F.array(*map(F.lit, ("capture", "annotate", "review", "evaluate", "dataset", "augment"))), F.col("stage"))
    latest = facts.groupBy("run_id").agg(F.max("ts").alias("latest"))
    return workflow.join(latest, "run_id").withColumn("stage_rank", rank).orderBy("stage_rank", "latest", "run_id").limit(limit).select("run_id", "stage", "stage_rank")


def ranked_preferences(rankings: DataFrame) -> DataFrame:
    """Pairs of a ranking (run_id, ranking): the first against each later one."""
    rows = rankings.where(F.size("ranking") > 1).select("run_id", F.element_at("ranking", 1).alias("chosen"), F.posexplode(F.slice("ranking", 2, F.size("ranking"))).alias("place", "rejected"))
    return rows.where("chosen <> rejected").select("run_id", "chosen", "rejected", (F.col("place") + 1).cast("long").alias("place"))


def same_prompt(pairs: DataFrame, prompts: DataFrame, allow_mismatch: bool = False) -> DataFrame:
    """Pairs with their shared prompt; those whose two prompts differ go unless that is allowed."""
    side = lambda x: prompts.select("run_id", F.col("branch_id").alias(x), F.col("prompt").alias(f"{x}_prompt"))
    rows = pairs.join(side("chosen"), ["run_id", "chosen"], "left").join(side("rejected"), ["run_id", "rejected"], "left")
    if not allow_mismatch:
        rows = rows.where("coalesce(chosen_prompt = rejected_prompt, true)")
    return rows.select("run_id", "chosen", "rejected", "source", F.coalesce("chosen_prompt", "rejected_prompt").alias("prompt"))


def trajectories(assigned: DataFrame, *by: str) -> DataFrame:
    """Steps of every run or branch, in order."""
    step = F.struct("ts", "seq", "request_id", "outcome")
    return assigned.groupBy(*by).agg(F.array_join(F.transform(F.sort_array(F.collect_list(step)), lambda s: F.concat_ws(":", s["request_id"], s["outcome"])), ",").alias("steps"))
