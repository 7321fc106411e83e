"""Dashboards: evidence levels, workflow stages, readiness, coverage and lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.functions.scalars import round_to
from tracemill.operators.scans import in_order

#: Semantic kinds that count as decision signals.
DECISION_SIGNALS = ("task_opened", "route_decided", "retry_declared", "fallback_declared", "branch_opened", "task_completed", "verifier_completed", "human_review_requested")


def run_evidence(facts: DataFrame, fields: DataFrame, completed: str = "task_completed") -> DataFrame:
    """E1 if all fields are there, E2 if also completed with two signals or more; else E0."""
    kinds = F.collect_set("semantic_kind")
    signals = facts.where(F.col("semantic_kind").isin(*DECISION_SIGNALS, completed)).groupBy("run_id").agg(F.size(kinds).alias("signals"), F.array_contains(kinds, completed).alias("completed"))
    joined = fields.select("run_id", "session_id", "ready").join(signals, "run_id", "left")
    strong = F.col("ready") & F.coalesce("completed", F.lit(False)) & (F.col("signals") >= 2)
    return joined.select("run_id", "session_id", F.coalesce("signals", F.lit(0)).cast("long").alias("signals"), F.when(strong, "E2").when(F.col("ready"), "E1").otherwise("E0").alias("level"))


def session_evidence(runs: DataFrame) -> DataFrame:
    return runs.groupBy("session_id").agg(F.min("level").alias("level"), F.count("*").alias("runs"))


def workflow(spans: DataFrame, fields: DataFrame, evidence: DataFrame, feedback: DataFrame, records: DataFrame, quality: float = 0.8, verifier: float = 0.8) -> DataFrame:
    """Stage and review status of every run."""
    run = spans.groupBy("run_id").agg(F.count("*").alias("requests"), F.count_if(F.col("outcome") == "open").alias("open"))
    queued = feedback.groupBy("run_id").agg(F.count("*").alias("feedback"))
    ready = records.select("run_id").where("run_id is not null").distinct().withColumn("builders", F.lit(True))
    rows = evidence.join(run, "run_id", "left").join(fields.select("run_id", "quality_confidence", "verifier_score"), "run_id").join(queued, "run_id", "left").join(ready, "run_id", "left")
    low = F.coalesce(F.col("quality_confidence") < quality, F.lit(False)) | F.coalesce(F.col("verifier_score") < verifier, F.lit(False))
    fed, blocked = F.coalesce("feedback", F.lit(0)) > 0, (F.coalesce("requests", F.lit(0)) == 0) | (F.col("open") > 0)
    review, builders = fed | low, F.coalesce("builders", F.lit(False))
    stage = (
        F.when(blocked, "capture").when(F.col("level") == "E0", "annotate").when(review, "review")
        .when((F.col("level") == "E2") & builders, "evaluate").when(builders, "dataset").otherwise("augment")
    )
    status = F.when(fed, "feedback").when(review, "review").otherwise("clean")
    return rows.select("run_id", "session_id", "level", stage.alias("stage"), status.alias("review_status"), F.coalesce("feedback", F.lit(0)).cast("long").alias("feedback"), F.coalesce("open", F.lit(0)).cast("long").alias("open"))


def overview(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """One row of key figures."""
    stage = lambda x: F.count_if(F.col("stage") == x).alias(f"{x}_runs")
    runs = rows.agg(F.count("*").alias("runs"), F.count_distinct("session_id").alias("sessions"), F.count_if(F.col("level") >= "E1").alias("e1_runs"), F.count_if(F.col("level") == "E2").alias("e2_runs"), *map(stage, ("capture", "annotate", "review", "evaluate", "dataset", "augment")))
    requests = spans.agg(F.count("*").alias("requests"), F.count_if(F.col("outcome") == "failed").alias("failed"), F.count_if(F.col("outcome") == "open").alias("open"))
    return runs.crossJoin(requests)  # one row each


def readiness(records: dict[str, DataFrame]) -> DataFrame:
    """Per builder its records and the runs that have some."""
    out = None
    for name, rows in records.items():
        one = rows.agg(F.lit(name).alias("builder"), F.count("*").alias("records"), F.count_distinct("run_id").alias("runs"))
        out = one if out is None else out.union(one)
    return out


def slice_coverage(candidates: DataFrame, fields: DataFrame, feedback: DataFrame) -> DataFrame:
    """Per task family and type: runs, candidates, open feedback and an opportunity level."""
    key = ["task_family", "task_type"]
    runs = fields.where("task_family is not null and task_type is not null").groupBy(*key).agg(F.count("*").alias("runs"))
    pool = candidates.groupBy(*key).agg(F.count_distinct("run_id").alias("candidates"))
    queued = feedback.select("run_id").distinct().join(fields.select("run_id", *key), "run_id").groupBy(*key).agg(F.count("*").alias("queued"))
    joined = runs.join(pool, key, "left").join(queued, key, "left").select(*key, "runs", F.coalesce("candidates", F.lit(0)).cast("long").alias("candidates"), F.coalesce("queued", F.lit(0)).cast("long").alias("queued"))
    share = F.col("candidates") / F.col("runs")
    return joined.withColumns({"coverage": round_to(share), "level": F.when(share >= 0.5, "strong").when(share >= 0.2, "partial").otherwise("thin")})


def health(spans: DataFrame, fields: DataFrame, evidence: DataFrame) -> DataFrame:
    """Shares of closed requests, of runs with annotations and with evidence, by session."""
    closed = spans.groupBy("session_id").agg(round_to(F.count_if(F.col("outcome") != "open") / F.count("*")).alias("closed_share"))
    noted = fields.groupBy("session_id").agg(round_to(F.count_if("ready") / F.count("*")).alias("ready_share"))
    strong = evidence.groupBy("session_id").agg(round_to(F.count_if(F.col("level") != "E0") / F.count("*")).alias("evidence_share"))
    return noted.join(strong, "session_id").join(closed, "session_id", "left")


def lineage(requests: DataFrame, candidates: DataFrame, evaluations: DataFrame, handoffs: DataFrame) -> DataFrame:
    """Training requests with their candidates, evaluations and handoffs, and the stage reached."""
    per = lambda rows, by, name: rows.groupBy(by).agg(F.count("*").alias(name))
    c = candidates.join(per(evaluations, "candidate_id", "evaluations"), "candidate_id", "left").join(per(handoffs, "candidate_id", "handoffs"), "candidate_id", "left")
    by_request = c.groupBy("request_id").agg(F.count("*").alias("candidates"), F.sum(F.coalesce("evaluations", F.lit(0))).alias("evaluations"), F.sum(F.coalesce("handoffs", F.lit(0))).alias("handoffs"))
    stage = F.when(F.col("handoffs") > 0, "handoff_ready").when(F.col("evaluations") > 0, "evaluated").when(F.col("candidates") > 0, "trained").otherwise("requested")
    filled = requests.join(by_request, "request_id", "left").select("request_id", *(F.coalesce(x, F.lit(0)).cast("long").alias(x) for x in ("candidates", "evaluations", "handoffs")))
    return filled.withColumn("stage", stage)


def prepare(spans: DataFrame, branches: DataFrame, secrets: DataFrame) -> DataFrame:
    """Status of a run before annotation: blocked, to review or clean, with a confidence."""
    run = spans.groupBy("run_id").agg(F.count("*").alias("requests"), F.count_if(F.col("outcome") == "open").alias("open"), F.count_if(F.col("fingerprint").isNotNull()).alias("prompts"), F.count_if(F.col("response_fact_id").isNotNull()).alias("outputs"))
    opened = branches.where("branch_type <> 'mainline'").groupBy("run_id").agg(F.count("*").alias("branches"), F.count_if(F.col("source") == "declared").alias("declared"))
    rows = run.join(opened, "run_id", "left").join(secrets, "run_id", "left")
    blockers = F.array_compact(F.array(F.when(F.col("requests") == 0, "no_request_spans"), F.when(F.col("open") > 0, "open_spans"), F.when(F.col("prompts") == 0, "no_prompts")))
    reviews = F.array_compact(F.array(F.when(F.coalesce("secrets", F.lit(0)) > 0, "secret_like_text"), F.when((F.coalesce("branches", F.lit(0)) > 0) & (F.coalesce("declared", F.lit(0)) == 0), "inferred_only_branching"), F.when(F.col("outputs") == 0, "no_assistant_output")))
    status = F.when(F.size(blockers) > 0, "blocked").when(F.size(reviews) > 0, "review").otherwise("clean")
    return rows.select("run_id", status.alias("status"), F.array_join(blockers, ",").alias("blockers"), F.array_join(reviews, ",").alias("reviews"), F.when(F.size(blockers) > 0, 0.4).when(F.size(reviews) > 0, 0.7).otherwise(1.0).alias("confidence"))


def anomalies(spans: DataFrame) -> DataFrame:
    """Per run what is odd about it, mean latency and outcome."""
    run = spans.groupBy("run_id").agg(F.bool_or(F.col("outcome") == "failed").alias("failed"), F.bool_or(F.col("outcome") == "open").alias("open"), round_to(F.sum("latency_ms") / F.count("latency_ms"), 1).alias("avg_latency_ms"), F.max_by("outcome", in_order()).alias("last_outcome"))
    found = F.array_compact(F.array(F.when(F.col("failed"), "failed_requests"), F.when(F.col("open"), "open_requests"), F.when(F.col("avg_latency_ms") > 1000, "slow")))
    return run.select("run_id", F.array_join(found, ",").alias("anomalies"), "avg_latency_ms", "last_outcome")
