"""Bodies in files: written, read with checks, collected."""

import gzip
import hashlib
import os

import pytest
from pyspark.sql import functions as F

from tracemill.functions import variants as V
from tracemill.operators import records
from tracemill.sources import payloads

BODY = "session_id string, run_id string, request_id string, body_kind string, request_path string, content_type string, body binary"


def written(spark, root, rows):
    table = spark.createDataFrame([("s/1", "run", f"req_{i}", "response_body", "/v1/chat/completions", kind, body) for i, (kind, body) in enumerate(rows)], BODY)
    return spark.createDataFrame(payloads.write_bodies(table, root).collect(), f"session_id string, run_id string, request_id string, body_kind string, body_ref {payloads.BODY_REF}")


def refs(spark, rows):
    return spark.createDataFrame([(k, None if r is None else tuple(r.get(f.split(":")[0]) for f in payloads.BODY_REF[7:-1].split(","))) for k, r in rows], f"k string, body_ref {payloads.BODY_REF}")


def test_written_bodies_read_back(spark, tmp_path):
    root = str(tmp_path / "bodies root")
    texts = [("application/json", b'{"a": 1}'), ("text/event-stream", "data: é\n\n".encode()), ("text/plain", b""), (None, bytes(range(256)) * 500), ("application/json", b'{"a": 1}')]
    made = written(spark, root, texts)
    got = payloads.read_bodies(made, payloads.body_files(spark, root), root).orderBy("request_id").collect()
    assert [(r.state, r.body) for r in got] == [("ok", b) for _, b in texts]
    ref = got[1].body_ref
    assert ref.relative_path.startswith("s_1/run/req_1/response_body-v1_chat_completions-") and ref.relative_path.endswith(".sse.gz") and ref.byte_size == 10 and ref.sha256 == hashlib.sha256(texts[1][1]).hexdigest()
    assert ref.compressed_size == os.path.getsize(f"{root}/{ref.relative_path}")
    written(spark, root, texts)  # a second run leaves the same files
    assert payloads.body_files(spark, root).count() == 5 and not [f for _, _, fs in os.walk(root) for f in fs if f.startswith(".tmp-")]


def test_states_of_bad_references(spark, tmp_path):
    root = tmp_path / "root"
    os.makedirs(root / "s/r/q")
    good, outside = gzip.compress(b"body"), tmp_path / "outside.json.gz"
    for path, data in ((root / "s/r/q/good.json.gz", good), (root / "s/r/q/torn.json.gz", good[:-6]), (root / "s/r/q/plain.json.gz", b"no gzip"), (outside, good)):
        path.write_bytes(data)
    digest = hashlib.sha256(b"body").hexdigest()
    ref = lambda below, **more: {"storage": "local_file", "relative_path": below, "byte_size": 4, "sha256": digest} | more
    rows = {
        "ok": ref("s/r/q/good.json.gz"), "unchecked": ref("s/r/./q/../q/good.json.gz", byte_size=None, sha256=None), "absolute": ref(None, path=str(root / "s/r/q/good.json.gz")), "none": None, "unsupported": ref("x", storage="s3"),
        "no_path": ref(""), "escapes": ref("../outside.json.gz"), "escapes_absolute": ref(None, path=str(outside)), "escapes_beside": ref("../root2/x"), "missing": ref("s/r/q/gone.json.gz"), "unreadable": ref("s/r/q/plain.json.gz"), "torn": ref("s/r/q/torn.json.gz"),
        "size": ref("s/r/q/good.json.gz", byte_size=5, sha256="0" * 64), "digest": ref("s/r/q/good.json.gz", sha256="0" * 64),
    }
    got = {r.k: (r.state, r.body) for r in payloads.read_bodies(refs(spark, list(rows.items())), payloads.body_files(spark, str(root)), str(root)).collect()}
    assert {k: s for k, (s, _) in got.items()} == {
        "ok": "ok", "unchecked": "ok", "absolute": "ok", "none": "none", "unsupported": "unsupported", "no_path": "no_path", "escapes": "escapes", "escapes_absolute": "escapes", "escapes_beside": "escapes", "missing": "missing",
        "unreadable": "unreadable", "torn": "unreadable", "size": "size_mismatch", "digest": "digest_mismatch",
    }
    assert all((body == b"body") == (state == "ok") for state, body in got.values())


def test_collection(spark, tmp_path):
    root = str(tmp_path / "root")
    payloads.mark_root(root)
    made = written(spark, root, [("application/json", b"live"), ("application/json", b"orphan"), ("text/plain", b"recent")])
    paths = {r.request_id: r.body_ref.relative_path for r in made.collect()}
    (tmp_path / "root/keep-me.txt").write_text("leave me")
    (tmp_path / "root/a.json.gz").write_text("too high up")
    (tmp_path / "root/.tmp-stray.json.gz").write_bytes(b"x")
    for name in ("req_0", "req_1"):
        os.utime(f"{root}/{paths[name]}", (1_000_000, 1_000_000))
    live = made.where("request_id = 'req_0'").select("body_ref").unionByName(refs(spark, [("x", {"storage": "local_file", "relative_path": "../y"}), ("n", None), ("s", {"storage": "s3", "relative_path": "z"})]).select("body_ref"))
    dry = payloads.collect_garbage(spark, root, live, dry_run=True)
    size = os.path.getsize(f"{root}/{paths['req_1']}")
    want = {"scanned_files": 5, "managed_files": 3, "skipped_unmanaged_files": 2, "orphan_files": 2, "skipped_recent_files": 1, "would_delete_files": 1, "would_delete_bytes": size, "referenced_files": 1, "referenced_outside_root": 1}
    assert {k: dry[k] for k in want} == want and (dry["deleted_files"], dry["deleted_bytes"]) == (0, 0) and os.path.exists(f"{root}/{paths['req_1']}")
    done = payloads.collect_garbage(spark, root, live)
    assert (done["deleted_files"], done["deleted_bytes"]) == (1, size)
    assert not os.path.exists(f"{root}/{paths['req_1']}") and all(os.path.exists(f"{root}/{p}") for p in (paths["req_0"], paths["req_2"], "keep-me.txt", "a.json.gz", ".tmp-stray.json.gz"))
    assert payloads.collect_garbage(spark, root, live, grace_seconds=0)["deleted_files"] == 1  # the recent one
    with pytest.raises(ValueError):
        payloads.collect_garbage(spark, root, live, grace_seconds=-1)


def test_unmanaged_roots(spark, tmp_path):
    none = refs(spark, [("n", None)])
    assert payloads.collect_garbage(spark, str(tmp_path / "gone"), none)["scanned_files"] == 0
    os.makedirs(tmp_path / "bare/s")
    (tmp_path / "bare/s/x.json.gz").write_bytes(b"x")
    with pytest.raises(ValueError):
        payloads.collect_garbage(spark, str(tmp_path / "bare"), none)


def test_kept_bodies_become_samples(spark, tmp_path):
    """A body that was kept elsewhere, read back into its fact, gives the sample that it would have given in place."""
    root = str(tmp_path / "root")
    made = written(spark, root, [("application/json", b'{"messages": [{"role": "user", "content": "hi"}]}'), ("application/json", b'{"choices": [{"message": {"content": "yo"}}]}')])
    read = payloads.read_bodies(made, payloads.body_files(spark, root), root)
    kind = F.when(F.col("request_id") == "req_0", "request_started").otherwise("response_finished")
    parent = F.when(F.col("request_id") != "req_0", "req_0")
    facts = read.select(F.col("request_id").alias("fact_id"), "run_id", "session_id", "request_id", F.lit("model").alias("actor"), kind.alias("kind"), parent.alias("parent_ref"), F.concat(F.lit('{"json":'), F.col("body").cast("string"), F.lit("}")).alias("payload"))
    (sample,) = records.sft(facts).collect()
    assert [m.content for m in sample.messages] == ["hi", "yo"]
    assert facts.select(V.string(V.parsed(F.col("payload")), "$.json.messages[0].content").alias("c")).where("c is not null").count() == 1
