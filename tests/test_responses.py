"""Captured responses from a stream equal what plain aggregation gives over the same chunks."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from tracemill.operators import streams
from tracemill.sources import tables, wire
from tracemill.streaming import responses

FOLDER = "/root/testdata/sf0.001"
NOON = datetime.datetime(2024, 1, 1, 12)


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(key)


def run(spark, rows, path, name, files=3, **options):
    """Facts of rows that arrive in shuffled files, and a far later row that lets all timers expire."""
    random.Random(3).shuffle(rows)
    for i in range(files):
        spark.createDataFrame(rows[i::files], responses.CHUNKS).coalesce(1).write.mode("append").parquet(f"{path}/in")
    late = ("late", "r", "s", "q", "/x", 200, None, None, "end", 0, NOON + datetime.timedelta(days=9))
    stream = spark.readStream.schema(responses.CHUNKS).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    go = lambda: responses.captured(stream, lateness="1 day", **options).writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination(240)
    go()
    spark.createDataFrame([late], responses.CHUNKS).coalesce(1).write.mode("append").parquet(f"{path}/in")  # the query goes on from its checkpoint
    go()
    go()
    return spark.read.parquet(f"{path}/out").where("request_fact_id <> 'late'")


def chunk(key, index, data, at=0, mark=None, chunks=None):
    return (key, "run", "sess", "req", "/v1/chat/completions", 200, index, data, mark, chunks, NOON + datetime.timedelta(seconds=at))


def test_flags_caps_and_gaps(rocks, tmp_path):
    done = b'data: {"a": "\xc3\xa9"}\n\ndata: [DONE]\n\n'
    rows = [chunk("cap", i + 1, b"x" * 3, i) for i in range(40)] + [chunk("cap", None, None, 40, "end", 40)]
    rows += [chunk("whole", i + 1, done[i : i + 1], i) for i in range(len(done))] * 2 + [chunk("whole", None, None, 99, "end", len(done))]
    rows += [chunk("gone", 1, b"data: {}\n\n"), chunk("gone", None, None, 1, "disconnect", 1)]
    rows += [chunk("open", 1, b"data: x\n\n"), chunk("open", 2, b"data: [DO")]
    rows += [chunk("gap", 1, b"ab"), chunk("gap", 3, b"cd", 5), chunk("gap", None, None, 6, "end", 3)]
    rows += [chunk("empty", None, None, 0, "end", 0), chunk("cut", 1, b"0123456789"), chunk("cut", None, None, 1, "end", 1), chunk("tail", 1, b"data: [DONE]"), chunk("tail", None, None, 1, "end", 1)]
    out = run(rocks, rows, str(tmp_path), "flags", preview_bytes=6)
    got = {r.request_fact_id: r for r in out.where("kind = 'response_finished'").collect()}
    flags = lambda r: (r.chunk_count, r.stored_chunk_count, r.omitted_chunk_count, r.body_size, r.stream_complete, r.client_disconnected, r.expired, r.capture_truncated)
    n = len(done)
    assert out.where("kind = 'response_finished'").count() == len(got) == 8
    assert {k: flags(r) for k, r in got.items()} == {
        "cap": (40, 32, 8, 120, False, False, False, True), "whole": (n, min(n, 32), max(0, n - 32), n, True, False, False, True), "gone": (1, 1, 0, 10, False, True, False, True), "open": (2, 2, 0, 18, False, False, True, True),
        "gap": (2, 2, 0, 4, False, False, True, False), "empty": (0, 0, 0, 0, False, False, False, False), "cut": (1, 1, 0, 10, False, False, False, True), "tail": (1, 1, 0, 12, True, False, False, True),
    }
    assert [tuple(f) for f in got["whole"].fragments] == [("json", '{"a": "é"}'), ("done", "[DONE]")] and got["cut"].preview == "012345" and got["cap"].stream_duration_ms == 40_000
    assert [(r.chunk_index, r.elapsed_ms) for r in out.where("kind = 'response_chunk' and request_fact_id = 'cap'").orderBy("chunk_index").collect()] == [(i + 1, i * 1000) for i in range(32)]


def test_equals_batch_over_conversations(rocks, tmp_path):
    spark = rocks
    chunks = wire.stream_chunks(wire.exchanges(tables.table(spark, FOLDER, "conversations"))).withColumn("key", F.concat_ws("_", "conv_id", "turn"))
    rows = [(r.key, "run", "sess", "req", r.path, 200, r.chunk_index + 1, r.chunk.encode(), None, None, NOON + datetime.timedelta(milliseconds=r.chunk_index)) for r in chunks.collect()]
    ends = {}
    for r in rows:
        ends[r[0], r[4]] = max(ends.get((r[0], r[4]), 0), r[6])
    rows += [(k, "run", "sess", "req", p, 200, None, None, "end", n, NOON + datetime.timedelta(milliseconds=n)) for (k, p), n in ends.items()]
    out = run(spark, rows, str(tmp_path), "batch")
    batch = chunks.groupBy("key").agg(F.count("*").alias("n"), F.sum(F.octet_length("chunk")).alias("bytes"))
    want = {(r.key, r.n, min(r.n, 32), max(0, r.n - 32), r.bytes, True) for r in batch.collect()}
    assert {tuple(r) for r in out.where("kind = 'response_finished'").select("request_fact_id", "chunk_count", "stored_chunk_count", "omitted_chunk_count", "body_size", "stream_complete").collect()} == want
    told = {r.request_fact_id: r.assistant_message for r in streams.assemble(responses.finished_events(out), "request_fact_id", path="path").collect()}
    assert told == {r.key: r.assistant_message for r in streams.assemble(streams.events(chunks, "key", "path"), "key", path="path").collect()}
