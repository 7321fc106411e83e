"""Streams give what the batch operators give over the same facts."""

from pyspark.sql import functions as F

from tracemill.operators import scans
from tracemill.plans.model import Model
from tracemill.streaming import capture

FOLDER = "/root/testdata/sf0.001"


def _run(df, name, mode):
    df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination(120)
    return df.sparkSession.table(name)


def test_streams_against_batch(spark, tmp_path):
    facts = Model.of(spark, FOLDER).facts
    for part in range(3):  # facts arrive in any order
        facts.where(F.pmod(F.hash("fact_id"), F.lit(3)) == part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = capture.read_facts(spark, f"{tmp_path}/in", facts.schema, files_per_trigger=1)
    got = {tuple(r) for r in _run(capture.lifecycle(stream), "life", "complete").where("outcome is not null").select("run_id", "request_fact_id", "outcome").collect()}
    assert got == {tuple(r) for r in Model.of(spark, FOLDER).spans.select("run_id", "request_fact_id", "outcome").collect()}
    claims = lambda f: f.select("task_id", F.col("user_id").alias("owner_key"), "ts", "seq").withColumnRenamed("task_id", "session_id")
    owners = {tuple(r) for r in _run(capture.session_owners(claims(stream)), "owners", "complete").collect()}
    assert owners == {tuple(r) for r in scans.session_owners(claims(facts)).select("session_id", "owner_key").collect()}


def test_repeated_facts_come_once_and_windows_count(spark, tmp_path):
    facts = Model.of(spark, FOLDER).facts.select("fact_id", "kind", "ts", "seq")
    facts.union(facts.limit(50)).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = capture.read_facts(spark, f"{tmp_path}/in", facts.schema)
    assert _run(capture.unique_facts(stream, "400 days"), "once", "append").count() == facts.count()
    windows = _run(capture.windowed_counts(stream, "7 days", "0 seconds"), "windows", "append")
    assert windows.count() and windows.agg(F.sum("facts")).first()[0] <= facts.count() + 50


def test_a_repeated_batch_replaces_itself(spark, tmp_path):
    write = capture.append_new(str(tmp_path))
    for _ in range(2):
        write(spark.range(5), 7)
    assert spark.read.parquet(str(tmp_path)).count() == 5
