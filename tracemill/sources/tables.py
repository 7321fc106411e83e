"""Readers, and adapters that map plain event tables to facts and artifacts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_jsonl(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """JSON lines, one record each; give the schema to spare a pass over the files."""
    return (spark.read.schema(schema) if schema else spark.read).json(path)


def read_manifests(spark: SparkSession, folder: str) -> DataFrame:
    """All ``*.json`` manifests under a folder, whole files."""
    return spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").option("multiLine", True).json(folder)


def facts_from_events(events: DataFrame) -> DataFrame:
    """Immutable facts with typed payload columns.

    clicks and views open requests; purchases answer, errors fail and signups declare, each for the
    last request before it in its run (a user's week).
    """
    k = F.get_json_object("props", "$.k").cast("long")
    kind = (
        F.when(F.col("event_type").isin("click", "view"), "request_started")
        .when((F.col("event_type") == "purchase") & (F.col("k") % 5 == 0), "response_chunk")
        .when(F.col("event_type") == "purchase", "response_finished")
        .when(F.col("event_type") == "error", "error_raised")
        .otherwise("semantic_event")
    )
    actor = F.when(F.col("event_type").isin("click", "purchase"), "model").when(F.col("event_type") == "view", "tool").when(F.col("event_type") == "error", "proxy").otherwise("runtime")
    base = events.withColumn("k", k).select(
        F.col("event_id").alias("seq"),
        F.concat(F.lit("fact_"), F.col("event_id")).alias("fact_id"),
        F.concat(F.lit("sess_"), F.col("user_id")).alias("session_id"),
        F.concat(F.lit("run_"), F.col("user_id"), F.lit("_"), F.floor((F.dayofyear("ts") - 1) / 7)).alias("run_id"),
        "ts", "k", kind.alias("kind"), actor.alias("actor"),
        F.concat(F.lit("user_"), F.col("user_id")).alias("user_id"),
        F.lit(None).cast("string").alias("thread_id"),
        F.concat(F.lit("task_"), F.col("user_id") % 10).alias("task_id"),
        F.floor(F.col("value") * 10 + 0.5).cast("long").alias("measure"),
    )
    run = Window.partitionBy("run_id").orderBy("ts", "seq")
    before = F.last(F.when(F.col("kind") == "request_started", F.col("fact_id")), ignorenulls=True).over(run.rowsBetween(Window.unboundedPreceding, -1))
    is_kind = lambda *names: F.col("kind").isin(*names)
    when = lambda condition, value: F.when(condition, value)
    request, semantic, answered = is_kind("request_started"), is_kind("semantic_event"), is_kind("response_finished")
    linked = base.withColumn("before", before).withColumn("before_that", F.lag("before", 3).over(run))
    latency = when(is_kind("response_finished", "error_raised"), F.col("measure"))
    return linked.select(
        "seq", "fact_id", "session_id", "run_id", "user_id", "thread_id", "task_id", "ts", "k", "kind", "actor",
        when(~request, F.col("before")).alias("parent_ref"),
        F.concat(F.lit("req_"), F.regexp_replace(F.when(request, F.col("fact_id")).otherwise(F.col("before")), "fact_", "")).alias("request_id"),
        when(request, F.when(F.col("actor") == "model", "/v1/chat/completions").otherwise("/tools/run")).alias("path"),
        F.when(answered, F.when(F.col("k") % 11 == 0, 503).otherwise(200)).when(is_kind("error_raised"), 502).cast("long").alias("status_code"),
        latency.alias("latency_ms"),
        F.floor(latency / 4).cast("long").alias("ttfb_ms"),
        when(answered & (F.col("k") % 2 == 0), latency - F.floor(latency / 4)).cast("long").alias("stream_ms"),
        when(~semantic, F.col("k") * 7).alias("body_size"),
        when(answered, F.col("k") % 4).alias("chunk_count"),
        F.coalesce(answered & (F.col("k") % 2 == 0), F.lit(False)).alias("streamed"),
        when(request, F.concat(F.lit("fp_"), F.col("k") % 3)).alias("fingerprint"),
        when(request & (F.col("k") % 23 == 0), F.lit("fallback")).alias("hinted_type"),
        when(request & ((F.col("k") % 23 == 0) | (F.col("k") % 29 == 0)), F.col("before")).alias("hinted_parent"),
        when(semantic, F.element_at(F.array(*map(F.lit, ("retry_declared", "branch_open_declared", "branch_close_declared", "fallback_declared"))), (F.col("k") % 4 + 1).cast("int"))).alias("semantic_kind"),
        when(semantic & (F.col("k") % 9 != 0), F.col("before")).alias("target_fact_id"),
        when(semantic & (F.col("k") % 9 == 0), F.concat(F.lit("req_"), F.regexp_replace("before", "fact_", ""))).alias("target_request_id"),
        when(semantic & (F.col("k") % 8 == 1), F.concat(F.lit("br_named_"), F.col("k") % 3)).alias("hint_branch_id"),
        when(semantic & (F.col("k") % 4 == 1), F.lit("subagent")).alias("hint_branch_type"),
        when(semantic & (F.col("k") % 4 == 2), F.when(F.col("k") % 3 == 0, "failed").otherwise("succeeded")).alias("hint_status"),
        when(semantic & (F.col("k") % 16 == 0), F.lit("br_main")).alias("hint_parent_branch_id"),
        when(semantic & (F.col("k") % 5 == 1), F.col("before_that")).alias("hint_parent_fact_id"),
        when(semantic & (F.col("k") % 5 == 2), F.concat(F.lit("req_"), F.regexp_replace("before_that", "fact_", ""))).alias("hint_parent_request_id"),
        F.when(F.col("k") % 10 == 0, "imported").otherwise("captured").alias("capture_source"),
    )


def artifacts_from_facts(facts: DataFrame) -> DataFrame:
    """External supervision on every fifth fact: annotations, scores, preferences and labels."""
    f = facts.where(F.col("seq") % 5 == 0)
    turn, k = F.col("seq") % 7, F.col("k")
    text = lambda prefix, x: F.concat(F.lit(prefix), x)
    number = F.regexp_replace("session_id", "sess_", "").cast("long")
    note = turn.isin(0, 1)
    return f.select(
        "seq", text("art_", F.col("seq")).alias("artifact_id"),
        F.when(note, "annotation").when(turn.isin(2, 3), "score").when(turn == 4, "preference").when(turn == 5, "binary_label").otherwise("note").alias("artifact_type"),
        F.when(turn == 1, text("session:", F.col("session_id"))).when(turn == 2, text("fact:", F.coalesce("parent_ref", "fact_id"))).when(turn == 5, F.lit("branch:br_main")).otherwise(text("run:", F.col("run_id"))).alias("target_ref"),
        F.when(k % 4 == 0, "human_reviewer").otherwise("judge").alias("producer"), F.lit("v1").alias("version"),
        "session_id", F.when(turn != 1, F.col("run_id")).alias("run_id"), F.col("ts").alias("created_at"),
        F.when((F.col("seq") % 10 == 0) & (k % 13 == 0), "superseded").otherwise("active").alias("status"),
        ((k % 50) / 50.0).alias("confidence"),
        F.when(k % 9 == 0, text("art_", F.col("seq") - 35)).alias("supersedes_artifact_id"),
        F.when(note, text("family_", number % 3)).alias("task_family"),
        F.when(note & (k % 15 != 0), F.when(k % 12 == 0, "unknown").otherwise(text("type_", number % 5))).alias("task_type"),
        F.when(note, text("tpl_", number % 11)).alias("task_template_hash"),
        F.when(note & (k % 17 != 0), text("inst_", number % 29)).alias("task_instance_key"),
        F.when(note, F.lit("unit_tests")).alias("verifier_name"),
        F.when(note, (k % 101) / 100.0).alias("verifier_score"),
        F.when(note & (k % 19 != 0), (100 - k % 101) / 100.0).alias("quality_confidence"),
        F.when(note, F.lit("tx1")).alias("taxonomy_version"), F.when(note, F.lit("a1")).alias("annotation_version"),
        F.when(note, F.when(k % 10 == 0, "shadow").otherwise("captured")).alias("source_channel"),
        F.when(note & (k % 14 == 0), F.lit("manual_check")).alias("review_reason"),
        F.when(turn.isin(2, 3) & (k % 6 != 0), (k % 101) / 100.0).alias("score"),
        F.when((turn == 5) | (turn.isin(2, 3) & (k % 6 == 0)), k % 2 == 0).alias("label"),
        F.when(turn == 4, text("br_retry_", k % 3 + 1)).alias("chosen_branch_id"), F.when(turn == 4, F.lit("br_main")).alias("rejected_branch_id"),
    )
