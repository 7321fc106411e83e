"""Request spans: every request with its last response, last error and chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.functions.scalars import or_else, round_to
from tracemill.operators.scans import in_order

_LIFE = ("fact_id", "status_code", "latency_ms", "ttfb_ms", "stream_ms", "body_size", "chunk_count", "streamed")


def request_spans(facts: DataFrame) -> DataFrame:
    """One row per request; lifecycle facts match on parent within the run, the last of each kind wins."""
    life = F.struct(*_LIFE)
    at = lambda kind: F.when(F.col("kind") == kind, in_order())
    ends = (
        facts.where(F.col("kind").isin("response_finished", "error_raised", "response_chunk") & F.col("parent_ref").isNotNull())
        .groupBy("run_id", F.col("parent_ref").alias("request_fact_id"))
        .agg(F.max_by(life, at("response_finished")).alias("r"), F.max_by(life, at("error_raised")).alias("e"), F.count_if(F.col("kind") == "response_chunk").alias("chunks"))
    )
    requests = facts.where("kind = 'request_started'").select(
        "run_id", F.col("fact_id").alias("request_fact_id"), "session_id", "request_id", "seq", "ts", "actor", "path", "user_id", "thread_id", "task_id",
        "fingerprint", "hinted_type", "hinted_parent", "capture_source", F.col("body_size").alias("request_body_size"),
    )
    r, e = (lambda c: F.col(f"r.{c}")), (lambda c: F.col(f"e.{c}"))
    outcome = F.when(e("fact_id").isNotNull(), "failed").when(r("status_code") >= 400, "failed").when(r("fact_id").isNotNull(), "succeeded").otherwise("open")
    return requests.join(ends, ["run_id", "request_fact_id"], "left").select(
        *requests.columns, outcome.alias("outcome"),
        F.coalesce(r("status_code"), e("status_code")).alias("status_code"),
        or_else(r("latency_ms"), e("latency_ms")).alias("latency_ms"),
        or_else(r("ttfb_ms"), e("ttfb_ms")).alias("ttfb_ms"),
        r("stream_ms").alias("stream_ms"),
        or_else(r("body_size"), e("body_size"), F.lit(0)).cast("long").alias("response_body_size"),
        or_else(r("chunk_count"), F.coalesce("chunks", F.lit(0))).cast("long").alias("chunk_count"),
        F.coalesce(r("streamed"), F.lit(False)).alias("streamed"),
        r("fact_id").alias("response_fact_id"), e("fact_id").alias("error_fact_id"),
    )


def session_summary(facts: DataFrame, spans: DataFrame, branches: DataFrame, artifacts: DataFrame) -> DataFrame:
    """One row per session: counts of facts, requests, outcomes, branches, artifacts, bytes and mean latency."""
    all_facts = facts.groupBy("session_id").agg(F.count("*").alias("facts"), F.count_distinct("run_id").alias("runs"), F.count_distinct("user_id").alias("users"))
    if_outcome = lambda x: F.count_if(F.col("outcome") == x)
    requests = spans.groupBy("session_id").agg(
        F.count("*").alias("requests"), if_outcome("succeeded").alias("succeeded"), if_outcome("failed").alias("failed"), if_outcome("open").alias("open"),
        F.count_if("streamed").alias("streamed"), F.sum("request_body_size").alias("request_bytes"), F.sum("response_body_size").alias("response_bytes"),
        round_to(F.sum("latency_ms") / F.count("latency_ms"), 1).alias("avg_latency_ms"),
    )
    opened = branches.groupBy("session_id").agg(F.count("*").alias("branches"), F.count_if(F.col("source") == "declared").alias("declared"), F.count_if(F.col("source") == "inferred").alias("inferred"))
    attached = artifacts.groupBy("session_id").agg(F.count("*").alias("artifacts"), F.count_if(F.col("status") == "active").alias("active_artifacts"))
    joined = all_facts.join(requests, "session_id", "left").join(opened, "session_id", "left").join(attached, "session_id", "left")
    counts = [c for c in joined.columns if c not in ("session_id", "avg_latency_ms")]
    return joined.select("session_id", "avg_latency_ms", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts))


def replay(spans: DataFrame) -> DataFrame:
    """Requests of a session, numbered in order."""
    from pyspark.sql import Window

    return spans.select("session_id", "request_id", "actor", "outcome", F.row_number().over(Window.partitionBy("session_id").orderBy("ts", "seq")).alias("number"))


def chunk_facts(facts: DataFrame, cap: int = 32) -> DataFrame:
    """Per request the chunks stored up to the cap and those left out."""
    chunks = facts.where("kind = 'response_chunk' and parent_ref is not null").groupBy("run_id", "parent_ref").agg(F.count("*").alias("n"))
    return chunks.select("run_id", "parent_ref", F.least("n", F.lit(cap)).cast("long").alias("stored"), F.greatest(F.col("n") - cap, F.lit(0)).cast("long").alias("omitted"))
