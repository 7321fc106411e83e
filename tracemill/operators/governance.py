"""Slices, cohorts, evaluation suites, assets, feedback and hand-off, as joins and aggregates over their rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.functions.scalars import slice_id
from tracemill.operators.builders import SAMPLE_UNITS
from tracemill.operators.scans import in_order


def _listed(values: Column) -> Column:
    return F.array_join(F.sort_array(F.collect_set(values)), ",")


def _named(*conditions: tuple[Column, str]) -> Column:
    """Names of the conditions that hold, in order, comma-joined."""
    return F.array_join(F.array_compact(F.array(*(F.when(c, n) for c, n in conditions))), ",")


def slices(fields: DataFrame) -> DataFrame:
    """One slice for every task family and type, with its runs."""
    rows = fields.where("task_family is not null and task_type is not null").groupBy("task_family", "task_type").agg(F.min("taxonomy_version").alias("taxonomy_version"), F.count("*").alias("runs"))
    return rows.select(slice_id(F.col("task_family"), F.col("task_type"), F.col("taxonomy_version")).alias("slice_id"), "task_family", "task_type", "runs")


def with_slices(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Rows with the first slice of their family and type; rows without one are left out."""
    first = known.groupBy("task_family", "task_type").agg(F.min("slice_id").alias("slice_id"))
    return rows.join(first, ["task_family", "task_type"])


def cohorts(members: DataFrame) -> DataFrame:
    """Cohorts with their slices put together again from the links, and the time of their oldest member."""
    return members.groupBy("cohort_id").agg(F.count("*").alias("members"), F.count_distinct("run_id").alias("runs"), _listed(F.col("slice_id")).alias("slice_ids"), F.min("latest_ts").alias("created_at"))


def check_cohorts(members: DataFrame, known_slices: DataFrame, existing: DataFrame) -> DataFrame:
    """Why a cohort may not be appended: no members, slices that nobody knows, an identifier in use."""
    unknown = members.select("cohort_id", "slice_id").distinct().join(known_slices.select("slice_id"), "slice_id", "left_anti").groupBy("cohort_id").agg(F.count("*").alias("unknown"))
    rows = members.groupBy("cohort_id").agg(F.count("run_id").alias("members")).join(unknown, "cohort_id", "left").join(existing.select("cohort_id", F.lit(True).alias("used")).distinct(), "cohort_id", "left")
    return rows.select("cohort_id", "members", _named((F.col("members") == 0, "no_members"), (F.col("unknown") > 0, "unknown_slices"), (F.col("used"), "cohort_exists")).alias("errors"))


def cohort_scope(members: DataFrame, facts: DataFrame, artifacts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(facts, artifacts) of a cohort as of its creation: its runs' facts, and artifacts on a run or its session that were there then."""
    at = members.groupBy("cohort_id").agg(F.min("latest_ts").alias("cohort_at"))
    runs = members.select("cohort_id", "run_id", "session_id").distinct().join(at, "cohort_id")
    then = F.col("created_at") <= F.col("cohort_at")
    own = artifacts.where("run_id is not null").select("artifact_id", "artifact_type", "run_id", "created_at").join(runs, "run_id").where(then)
    shared = artifacts.where("run_id is null").select("artifact_id", "artifact_type", "session_id", "created_at").join(runs, "session_id").where(then)
    columns = ("cohort_id", "run_id", "artifact_id", "artifact_type")
    return facts.join(runs.select("cohort_id", "run_id"), "run_id"), own.select(*columns).union(shared.select(*columns))


def eval_cases(members: DataFrame, spans: DataFrame, scores: DataFrame) -> DataFrame:
    """Cases of a cohort: each member with its run's requests, answers and score."""
    run = spans.groupBy("run_id").agg(F.count("*").alias("requests"), F.count_if(F.col("outcome") == "succeeded").alias("answered"))
    return members.select("cohort_id", "run_id", "artifact_id").join(run, "run_id").join(scores, "run_id", "left")


def candidate_status(reviewed: DataFrame, holdout_runs: DataFrame, feedback: DataFrame) -> DataFrame:
    """Per candidate run: held out for evaluation, to review, or eligible."""
    runs = reviewed.groupBy("run_id").agg(F.bool_or(F.size("reasons") > 0).alias("to_review"))
    flag = lambda rows, name: rows.select("run_id", F.lit(True).alias(name)).distinct()
    joined = runs.join(flag(holdout_runs, "held"), "run_id", "left").join(flag(feedback, "queued"), "run_id", "left")
    return joined.select("run_id", F.when(F.col("held"), "holdout").when(F.col("to_review") | F.col("queued").isNotNull(), "review").otherwise("eligible").alias("status"))


def review_queue(reviewed: DataFrame) -> DataFrame:
    """Candidates with reasons for review; the others are eligible."""
    return reviewed.where(F.size("reasons") > 0).select("run_id", "session_id", "artifact_id", "task_instance_key", F.array_join("reasons", ",").alias("reasons"))


def suite_guards(cohort_rows: DataFrame, members: DataFrame, training: DataFrame, kind: str = "offline_test") -> DataFrame:
    """Errors that keep an evaluation suite from being made of a cohort.

    ``cohort_rows`` has cohort_id and expected_use; ``training`` are the members of the snapshot it is to be
    kept apart from: no run, instance or template may be in both, and a shadow suite must come later.
    """
    rows = cohort_rows.join(members.groupBy("cohort_id").agg(F.count("*").alias("members"), F.min("latest_ts").alias("first_ts")), "cohort_id", "left")
    for key in ("run_id", "task_instance_key", "task_template_hash"):
        both = members.select("cohort_id", key).distinct().join(training.select(key).distinct(), key, "left_semi").groupBy("cohort_id").agg(F.count("*").alias(f"shared_{key}"))
        rows = rows.join(both, "cohort_id", "left")
    trained = training.agg(F.max("latest_ts").alias("trained_until"))
    rows = rows.crossJoin(F.broadcast(trained))  # one row
    shared = lambda key: (F.coalesce(f"shared_{key}", F.lit(0)) > 0, f"shared_{key}")
    errors = _named(
        (F.col("expected_use") != "evaluation", "not_for_evaluation"), (F.coalesce("members", F.lit(0)) == 0, "no_members"), shared("run_id"), shared("task_instance_key"), shared("task_template_hash"),
        (F.lit(kind == "shadow") & (F.col("first_ts") <= F.col("trained_until")), "not_later"),
    )
    return rows.select("cohort_id", F.coalesce("members", F.lit(0)).cast("long").alias("members"), errors.alias("errors"))


def scope_blockers(cohort_rows: DataFrame, reviewed: DataFrame) -> DataFrame:
    """Per cohort and builder what forbids an export: pending reviews, another use, another sample unit."""
    pending = reviewed.where(F.size("reasons") > 0).select(F.concat(F.lit("cohort_"), "task_family").alias("cohort_id"), F.lit(True).alias("pending")).distinct()
    units = F.array(*(F.struct(F.lit(b).alias("builder"), F.array(*map(F.lit, u)).alias("units")) for b, u in SAMPLE_UNITS.items()))
    rows = cohort_rows.join(pending, "cohort_id", "left").select("*", F.inline(units))
    any_unit = F.col("builder") == "facts"
    return rows.select(
        "cohort_id", "builder",
        _named((F.col("pending"), "review_pending"), (~any_unit & (F.col("expected_use") != "training"), "not_for_training"), (~any_unit & ~F.array_contains("units", F.col("sample_unit")), "sample_unit")).alias("blockers"),
    )


def validate_facts(facts: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """Facts with the reason why one may not be appended; of equal identifiers the first may."""
    ok = F.col("kind").isin(*kinds)
    reason = F.when(F.col("fact_id").isNull(), "no_identifier").when(F.col("run_id").isNull() | F.col("session_id").isNull(), "no_scope").when(F.col("ts").isNull(), "no_time").when(~F.coalesce(ok, F.lit(False)), "unknown_kind")
    checked = facts.withColumn("reason", reason)
    first = checked.where("reason is null").groupBy("fact_id").agg(F.min("seq").alias("first_seq"))
    return checked.join(first, "fact_id", "left").withColumn("reason", F.coalesce("reason", F.when(F.col("seq") > F.col("first_seq"), "repeated"))).drop("first_seq")


def latest(rows: DataFrame, *by: str, value: str = "artifact_id") -> DataFrame:
    """The newest row's value for every key: assets upserted, prepare reports by run, scorecards by slice."""
    return rows.groupBy(*by).agg(F.max_by(value, in_order("created_at", value)).alias(value))


def merged_patches(events: DataFrame, *by: str) -> DataFrame:
    """Metadata after all patches (a map column ``patch``) in order: for every key the last value, one row each."""
    entries = events.select(*by, "ts", "seq", F.explode("patch").alias("key", "value"))
    return entries.groupBy(*by, "key").agg(F.max_by("value", in_order()).alias("value"))


def branch_of_reference(refs: DataFrame, branches: DataFrame) -> DataFrame:
    """(ref_id, run_id) of references to a branch: in their run, or, where that has none, in the only run that has it."""
    known = branches.select("run_id", "branch_id").distinct()
    alone = known.groupBy("branch_id").agg(F.count("*").alias("n"), F.min("run_id").alias("only_run")).where("n = 1").drop("n")
    own = known.withColumn("own_run", F.col("run_id"))
    placed = refs.join(own, ["run_id", "branch_id"], "left").join(alone, "branch_id", "left")
    return placed.select("ref_id", F.coalesce("own_run", "only_run").alias("run_id")).where("run_id is not null")


def handoff(decisions: DataFrame, fallback: str) -> DataFrame:
    """Routing of every decision (slice, stage, decision): how much traffic a candidate gets, and what stands behind it."""
    mode = F.when(F.col("decision") != "promote", "disabled").when(F.col("stage") == "shadow", "mirror").when(F.col("stage") == "canary", "split").when(F.col("stage") == "rollout", "primary").otherwise("disabled")
    return decisions.select("*", mode.alias("route_mode"), F.when(mode != "primary", fallback).alias("fallback"))
