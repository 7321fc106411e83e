"""Continuous capture: facts as a stream, with watermarks as an added bound on late data."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.operators import governance


def read_facts(spark, path: str, schema, files_per_trigger: int = 100) -> DataFrame:
    """Facts as they arrive in a folder of Parquet files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def _timed(facts: DataFrame, lateness: str) -> DataFrame:
    """With a watermark, which needs times with a zone."""
    return facts.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)


def unique_facts(facts: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """Facts without repeated identifiers within the watermark."""
    return _timed(facts, lateness).dropDuplicatesWithinWatermark(["fact_id"])


def windowed_counts(facts: DataFrame, window: str = "1 day", lateness: str = "1 hour") -> DataFrame:
    """Facts by kind in tumbling windows, out once the watermark has passed the window."""
    return _timed(facts, lateness).groupBy(F.window("ts", window), "kind").agg(F.count("*").alias("facts")).select(F.col("window.start").alias("start"), "kind", "facts")


def lifecycle(facts: DataFrame) -> DataFrame:
    """Updates of (run, request, outcome, chunks) as facts arrive in any order.

    Aggregates alone hold the state: a late fact only changes its own request. Requests whose start has not
    come yet have no outcome.
    """
    request = F.when(F.col("kind") == "request_started", F.col("fact_id")).otherwise(F.col("parent_ref"))
    rows = facts.where("kind <> 'semantic_event'").withColumn("request_fact_id", request).where("request_fact_id is not null")
    answered = F.when(F.col("kind") == "response_finished", F.struct("ts", "seq", F.coalesce("status_code", F.lit(0)).alias("status")))
    is_kind = lambda kind: F.bool_or(F.col("kind") == kind)
    seen = rows.groupBy("run_id", "request_fact_id").agg(is_kind("request_started").alias("started"), is_kind("error_raised").alias("failed"), F.max(answered).alias("last"), F.count_if(F.col("kind") == "response_chunk").alias("chunks"))
    outcome = F.when(F.col("failed"), "failed").when(F.col("last.status") >= 400, "failed").when(F.col("last").isNotNull(), "succeeded").otherwise("open")
    return seen.select("run_id", "request_fact_id", F.when(F.col("started"), outcome).alias("outcome"), "chunks")


def session_owners(claims: DataFrame) -> DataFrame:
    """First claim of every session so far, as claims (session_id, owner_key, ts, seq) arrive."""
    return claims.groupBy("session_id").agg(F.min(F.struct("ts", "seq", "owner_key")).alias("first")).select("session_id", F.col("first.owner_key").alias("owner_key"))


def append_new(path: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink; a batch that is repeated after a failure replaces its own folder."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def append_facts(path: str, kinds: tuple[str, ...]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink of facts that keeps each identifier once and takes a batch whole or not at all.

    A fact without identifier or scope, or of an unknown kind, stops its batch before anything is written. Identifiers of
    other batches are left out by an anti-join; a batch that comes again replaces its own folder, so it leaves one copy.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        checked = governance.validate_facts(batch, kinds)
        bad = checked.where("reason is not null and reason <> 'repeated'").select("fact_id", "reason").take(5)
        if bad:
            raise ValueError(f"batch {number} is not appended: " + "; ".join(f"{r.fact_id}: {r.reason}" for r in bad))
        new = checked.where("reason is null").select(*batch.columns).dropDuplicates(["fact_id"])
        try:
            stored = spark.read.parquet(path).where(F.col("batch") != number).select("fact_id")
            new = new.join(stored, "fact_id", "left_anti").select(*batch.columns)
        except AnalysisException as e:
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
        new.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write
