"""Small hand-made cases of rules that the registered queries do not tell apart."""

import json
from datetime import datetime

from pyspark.sql import functions as F

from tracemill.functions import scalars, variants
from tracemill.operators import artifacts, branches, dataset, messages, scans
from tracemill.sources import tables

HINTS = "run_id string, session_id string, fact_id string, request_id string, request_fact_id string, ts timestamp, seq long, kind string, semantic_kind string, target_fact_id string, target_request_id string, hint_branch_id string, hint_branch_type string, hint_status string, hint_parent_branch_id string, hint_parent_fact_id string, hint_parent_request_id string"


def _hint(spark, rows):
    names = [x.split()[0] for x in HINTS.split(", ")]
    return spark.createDataFrame([tuple({"run_id": "r", "kind": "semantic_event", **x}.get(n) for n in names) for x in rows], HINTS)


def _spans(spark, rows):
    made = [("r", "s", f"f{i}", q, datetime(2024, 1, 1, 0, i), i, outcome, "model", "/v1", "u", None, None, "p" if same else f"p{i}", None, None, None, None) for i, (q, outcome, same) in enumerate(rows)]
    return spark.createDataFrame(made, "run_id string, session_id string, request_fact_id string, request_id string, ts timestamp, seq long, outcome string, actor string, path string, user_id string, thread_id string, task_id string, fingerprint string, hinted_type string, hinted_parent string, response_fact_id string, error_fact_id string")


def test_hints_match_by_request_and_the_first_in_fact_order_wins(spark):
    at = lambda m: datetime(2024, 1, 1, 1, m)
    spans = _spans(spark, [("q0", "failed", False), ("q1", "succeeded", False), ("q2", "open", False)])
    facts = _hint(spark, [
        {"ts": at(5), "seq": 100, "semantic_kind": "retry_declared", "target_request_id": "q1", "hint_parent_request_id": "q0"},
        {"ts": at(1), "seq": 200, "semantic_kind": "fallback_declared", "target_fact_id": "f1", "hint_parent_branch_id": None, "hint_parent_fact_id": "f0"},  # earlier, though recorded later
        {"ts": at(6), "seq": 101, "semantic_kind": "branch_open_declared", "hint_branch_type": "subagent", "target_request_id": "q2", "hint_parent_request_id": "q1"},
        {"ts": at(9), "seq": 10, "semantic_kind": "branch_close_declared", "target_fact_id": "f1", "hint_status": "failed"},
        {"ts": at(8), "seq": 11, "semantic_kind": "branch_close_declared", "target_request_id": "q1", "hint_status": "succeeded"},
    ])
    assigned = branches.assign(facts, spans)
    got = {r.request_id: (r.branch_id, r.parent_branch_id) for r in assigned.collect()}
    assert got == {"q0": ("br_main", None), "q1": ("br_fallback_1", "br_main"), "q2": ("br_subagent_2", "br_fallback_1")}
    rows = {r.branch_id: r.status for r in branches.infer_branches(facts, assigned).collect()}
    assert rows == {"br_main": "failed", "br_fallback_1": "succeeded", "br_subagent_2": "failed"}


def test_retries_need_the_same_prompt(spark):
    none = _hint(spark, [])
    kinds = lambda rows: [r.branch_type for r in branches.assign(none, _spans(spark, rows)).orderBy("seq").collect()]
    assert kinds([("a", "failed", True), ("b", "succeeded", True)]) == ["mainline", "retry"]
    assert kinds([("a", "failed", False), ("b", "succeeded", False)]) == ["mainline", "mainline"]


def test_messages_of_irregular_requests(spark):
    bodies = [
        {"messages": [{"role": "user", "content": [{"type": "text", "text": "a"}, "b", {"x": 1}]}, "no message", {"role": "assistant", "tool_calls": [{"id": "c1", "function": {"name": "f", "arguments": {"k": 1}}}]}]},
        {"input": "plain"}, {"input": {"type": "message", "content": 7}}, {"input": [{"type": "function_call_output", "call_id": "c1", "output": {"value": "done"}}, {"type": "function_call", "name": "g", "arguments": "{}", "call_id": "c2"}]},
        {"messages": []}, {"model": "m"}, {"messages": [{"role": "user", "content": None}]},
    ]
    df = spark.createDataFrame([(i, json.dumps(b)) for i, b in enumerate(bodies)] + [(90, "{broken"), (91, None)], "i long, body string")
    got = {r.i: r.m for r in df.select("i", messages.prompt_messages(F.col("body")).alias("m")).collect()}
    assert [(m.role, m.content) for m in got[0]] == [("user", "a\nb"), ("assistant", None)]
    assert (got[0][1].tool_calls[0].id, got[0][1].tool_calls[0].function.name, got[0][1].tool_calls[0].function.arguments) == ("c1", "f", '{"k": 1}')
    assert [(m.role, m.content) for m in got[1] + got[2]] == [("user", "plain"), ("user", "7")]
    assert (got[3][0].role, got[3][0].content, got[3][0].tool_call_id) == ("tool", "done", "c1")
    assert got[3][1].role == "assistant" and got[3][1].tool_calls[0].function.name == "g"
    assert all(got[i] is None for i in (4, 5, 6, 90, 91))


def test_messages_of_either_path_agree(spark):
    call = lambda ident, name, arguments, call_id=None: {"id": ident, "type": "function", "function": {"name": name, "arguments": arguments}, "call_id": call_id}
    plain = [
        {"role": "system", "content": "be"}, {"role": "user", "content": [{"type": "input_text", "text": "a"}, "b", {"text": ""}]},
        {"role": "assistant", "content": "c", "tool_calls": [{"id": "i", "function": {"name": "f", "arguments": "{}"}, "call_id": "k"}]}, {"role": "tool", "content": "d", "call_id": "k", "name": "f"},
    ]
    odd = [
        {"type": "tool_result", "output": "o", "content": "c", "call_id": "z"}, {"type": "function_call_output"}, {"type": "function_call", "id": "i"}, {"type": "function_call"},
        {"role": "assistant", "content": "x", "id": "msg_1"}, {"role": "user", "content": "", "output": "out"}, {"role": "assistant", "content": "y", "tool_calls": [{"function": {"arguments": {"q": 1}}}, 3]},
    ]
    bodies = [json.dumps({"messages": plain}), json.dumps({"messages": plain + odd}), json.dumps({"input": odd}), json.dumps({"input": ""})]
    df = spark.createDataFrame(list(enumerate(bodies)), "i long, body string")
    got = {r.i: [m.asDict(recursive=True) for m in r.m] for r in df.select("i", messages.prompt_messages(F.col("body")).alias("m")).collect()}
    assert all(got[i] == messages.messages_of(json.loads(b)) for i, b in enumerate(bodies))
    assert [(m["role"], m["content"], m["tool_call_id"], m["name"]) for m in got[0]] == [("system", "be", None, None), ("user", "a\nb", None, None), ("assistant", "c", None, None), ("tool", "d", "k", "f")]
    assert got[0][2]["tool_calls"] == [call("i", "f", "{}", "k")]
    assert [(m["role"], m["content"], m["tool_calls"], m["tool_call_id"]) for m in got[2]] == [
        ("tool", "o", None, "z"), ("assistant", None, [call("i", "", "")], None), ("assistant", "x", [call("msg_1", "", "")], None), ("user", "out", None, None), ("assistant", "y", [call(None, "", '{"q": 1}')], None),
    ]
    assert got[3] == [{"role": "user", "content": "", "tool_calls": None, "tool_call_id": None, "name": None}]


def test_answers_of_all_shapes(spark):
    call = {"id": "i", "type": "function", "function": {"name": "f", "arguments": "{}"}}
    payloads = [
        {"canonical": {"assistant_message": {"role": "assistant", "content": "c"}}, "json": {"output_text": "no"}}, {"canonical": {"assistant_message": {"content": None}}, "json": {"output_text": "yes"}},
        {"json": {"choices": [{"message": {"role": "assistant", "content": None, "tool_calls": [call]}}]}}, {"json": {"choices": [{"message": {"content": {"text": "t"}}}]}}, {"json": {"output_text": ["a", "", 3, "b"]}},
        {"json": {"output": [{"type": "reasoning"}, {"type": "message", "content": [{"type": "output_text", "text": "m"}]}, {"type": "function_call", "id": "i", "name": "f", "arguments": {"a": 1}, "call_id": "k"}]}},
        {"json": {"choices": [{"message": {"content": None}}]}}, {"json": [1]}, {"preview": "x"}, {"json": {"choices": [{"message": {"content": {"odd": 1}}}]}}, {"canonical": {"assistant_message": {"content": ""}}},
    ]
    df = spark.createDataFrame([(i, json.dumps(p)) for i, p in enumerate(payloads)] + [(90, None), (91, "{")], "i long, p string")
    got = {r.i: r.m.asDict(recursive=True) if r.m else None for r in df.select("i", messages.answer(variants.parsed(F.col("p"))).alias("m")).collect()}
    assert all(got[i] == messages.answer_of(p) for i, p in enumerate(payloads)) and got[90] is None and got[91] is None
    assert [got[i] and got[i]["content"] for i in range(11)] == ["c", "yes", None, "t", "a\nb", "m", None, None, None, '{"odd": 1}', ""]
    assert got[5]["tool_calls"] == [{"id": "i", "type": "function", "function": {"name": "f", "arguments": '{"a": 1}'}, "call_id": "k"}] and got[2]["tool_calls"][0]["function"] == call["function"]


def test_values_have_types(spark):
    row = lambda text, *cs: spark.createDataFrame([(text,)], "x string").select(variants.parsed(F.col("x")).alias("v")).select(*(c(F.col("v")).alias(f"c{i}") for i, c in enumerate(cs))).first()
    v = variants
    text = '{"b": true, "i": 3, "f": 2.5, "s": "7", "n": null, "o": {"z": [], "y": {"x": [1, "t", {"w": null}]}}}'
    assert list(row(text, lambda x: v.number(x, "$.b"), lambda x: v.number(x, "$.i"), lambda x: v.number(x, "$.s"), lambda x: v.whole(x, "$.f"), lambda x: v.whole(x, "$.i"), lambda x: v.truth(x, "$.b"), lambda x: v.truth(x, "$.i"), lambda x: v.string(x, "$.i"))) == [None, 3.0, None, None, 3, True, None, None]
    assert [tuple(x) for x in row(text, lambda x: v.leaves(v.at(x, "$.o")))[0]] == [("y.x.0", "1", False), ("y.x.1", "t", True), ("y.x.2.w", "null", False)]
    assert [tuple(x) for x in row(text, lambda x: v.leaves(v.at(x, "$.o"), 1))[0]] == [("y", '{"x":[1,"t",{"w":null}]}', False), ("z", "[]", False)]
    assert row(text, lambda x: v.merged(x, v.parsed(F.lit('{"b": null, "i": "new", "q": {"k": 1}}')), v.parsed(F.lit("[1]"))))[0] == {"f": "2.5", "s": '"7"', "o": '{"y":{"x":[1,"t",{"w":null}]},"z":[]}', "i": '"new"', "q": '{"k":1}'}


def test_strings_at_any_depth(spark):
    deep = "br_9"
    for i in range(30):
        deep = {"k": deep} if i % 2 else ["x", deep, i]
    texts = [json.dumps(v) for v in ("br_1", ["br_1", 1, None, True], {"a": {"b": [{"c": "br_2"}, "br_1"]}, "d": "br_2"}, deep, [], {}, 7)] + [None, "{"]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string").select("i", variants.strings(F.col("t")).alias("s"))
    got = {r.i: sorted(r.s) if r.s is not None else None for r in df.collect()}
    assert got == {0: ["br_1"], 1: ["br_1"], 2: ["br_1", "br_2"], 3: ["br_9", "x"], 4: [], 5: [], 6: [], 7: None, 8: None}


def test_branches_that_payloads_mention(spark):
    rows = spark.createDataFrame([("r1", "br_a"), ("r1", "br_b"), ("r2", "br_a")], "run_id string, branch_id string")
    notes = [("t", "r1", "branch:br_a", {"x": "br_a"}), ("deep", "r1", "run:r1", {"a": [{"b": {"c": ["br_b"]}}]}), ("any", None, "run:r9", ["br_a"]), ("own", "r2", "run:r2", {"x": "br_b", "br_a": 1}), ("part", "r1", "run:r1", {"x": "br_a "}), ("none", "r1", "run:r1", None)]
    notes = spark.createDataFrame([(i, "note", run, target, payload and json.dumps(payload)) for i, run, target, payload in notes], "artifact_id string, artifact_type string, run_id string, target_ref string, payload string")
    assert sorted((r.artifact_id, r.run_id, r.branch_id) for r in artifacts.branch_mentions(rows, notes).collect()) == [("any", "r1", "br_a"), ("any", "r2", "br_a"), ("deep", "r1", "br_b"), ("t", "r1", "br_a")]


def test_a_name_of_all_runs_is_dealt_over_many_tasks(spark):
    rows = spark.range(600).select(F.when(F.col("id") > 0, F.concat(F.lit("r"), "id")).alias("run_id"), F.lit("br_main").alias("branch_id"))
    notes = spark.range(301).select(F.concat(F.lit("a"), "id").alias("artifact_id"), F.lit("note").alias("artifact_type"), F.when(F.col("id") == 300, "r7").alias("run_id"), F.lit("branch:br_main").alias("target_ref"), F.lit("[]").alias("payload"))
    got = artifacts.branch_mentions(rows, notes)
    parts = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(parts) == got.distinct().count() == 600 * 300 + 1
    assert max(parts) < 0.1 * sum(parts)


def test_cells_of_a_product_lie_evenly_in_tasks(spark):
    rows = spark.range(600).select(F.when(F.col("id") > 0, F.concat(F.lit("r"), "id")).alias("run_id"), F.explode(F.array(F.lit("br_main"), F.lit("br_b"))).alias("branch_id"))
    notes = spark.range(300).select(F.concat(F.lit("a"), "id").alias("artifact_id"), F.lit("note").alias("artifact_type"), F.lit(None).cast("string").alias("run_id"), F.when(F.col("id") > 5, "branch:br_main").otherwise("branch:br_b").alias("target_ref"), F.lit("[]").alias("payload"))
    got = artifacts.branch_mentions(rows, notes)
    parts = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(parts) == got.distinct().count() == 600 * 300
    assert got.where("run_id is null").count() == 300
    assert len(parts) == 256 and max(parts) < 3 * sum(parts) / len(parts)


def test_fields_of_candidates_merge_open_payloads(spark):
    fields = {f: "v" for f in artifacts.E1_FIELDS} | {"verifier_score": 0.9, "quality_confidence": 0.5, "annotation_kind": "e1"}
    columns = "artifact_id string, artifact_type string, status string, target_ref string, run_id string, session_id string, supersedes_artifact_id string, created_at long, seq long, payload string"
    rows = [("s1", "session:s", fields | {"odd": [1], "note": "s", "flag": True}), ("r1", "run:r", {"annotation_kind": "e1", "task_type": "own", "note": None, "verifier_score": True, "new": {"k": 1}}), ("r2", "run:q", fields | {"annotation_kind": "other"})]
    notes = spark.createDataFrame([(i, "annotation", "active", target, None, "s", None, n, n, json.dumps(p)) for n, (i, target, p) in enumerate(rows)], columns)
    facts = spark.createDataFrame([("r", "s", 1, 1), ("q", "z", 2, 2), ("w", "s", 3, 3)], "run_id string, session_id string, ts long, seq long")
    got = artifacts.candidate_fields(facts, notes).collect()
    assert [(r.run_id, r.artifact_ids) for r in got] == [("w", ["s1"]), ("r", ["s1", "r1"])]
    merged = got[1].fields
    assert merged["task_type"] == '"own"' and merged["odd"] == "[1]" and merged["new"] == '{"k":1}' and "note" not in merged and "annotation_kind" not in merged and merged["flag"] == "true"
    assert (got[1].verifier_score, got[0].verifier_score, got[1].quality_confidence) == (0.9, 0.9, 0.5)  # a truth value is no number
    assert [r.run_id for r in artifacts.candidate_fields(facts, notes, limit=1).collect()] == ["w"]
    assert [r.run_id for r in artifacts.candidate_fields(facts, notes, run_id="r").collect()] == ["r"] and artifacts.candidate_fields(facts, notes, session_id="z").collect() == []


def test_answers_and_fingerprints(spark):
    one = lambda text, f: spark.createDataFrame([(text,)], "x string").select(f(F.col("x")).alias("v")).first()[0]
    assert one('{"choices": [{"message": {"content": "hi"}}]}', messages.assistant_text) == "hi"
    assert one('{"output": [{"content": [{"text": "yo"}]}]}', messages.assistant_text) == "yo"
    assert one("no braces", messages.json_object) is None
    finger = lambda x: messages.fingerprint(x, ("user", "stream"))
    assert one('{"b": 1, "a": [2], "user": "u"}', finger) == one('{"a": [2], "stream": true, "b": 1}', finger)
    assert one('{"user": "u"}', finger) is None
    left, right = '{"m": [{"role": "user", "p": {"y": [1, {"b": 2, "a": 1}], "x": null}}], "q\\"": "é\\n"}', '{"stream": true, "q\\"": "\\u00e9\\n", "m": [{"p": {"x": null, "y": [1, {"a": 1, "b": 2}]}, "role": "user"}]}'
    assert one(left, messages.fingerprint) == one(right, messages.fingerprint) != one(left.replace("1,", "3,"), messages.fingerprint)
    assert json.loads(one(left, messages.fingerprint)) == json.loads(left) and one("[1]", messages.fingerprint) is None


def test_text_scalars(spark):
    one = lambda value, f: spark.createDataFrame([(value,)], "x string").select(f(F.col("x"))).first()[0]
    key = "sk-" + "a1" * 10
    assert one(f"a {key} b, task-{'x' * 20}, é{key}", lambda x: scalars.secret_counts(x)["openai_key"]) == 1
    assert one(f"a {key} b", scalars.redact) == "a <redacted:openai_key> b"
    assert one("task_type.of-run", scalars.humanize) == "Task Type Of Run"
    assert one("0.256", lambda x: scalars.format_percent(x.cast("double"))) == "26%"
    assert [one(v, lambda x: scalars.clamp(x.cast("double"), 0.5)) for v in ("1.7", "-1", None)] == [1.0, 0.0, 0.5]
    assert one("k", lambda x: scalars.mask_headers(F.create_map(F.lit("Authorization"), x, F.lit("accept"), x))) == {"Authorization": "***", "accept": "k"}


def test_files_round_trip(spark, tmp_path):
    records = spark.createDataFrame([(1, "train", "r1", "s"), (2, "test", "r2", "s")], "id long, split string, run_id string, session_id string")
    dataset.write_export(records, dataset.manifest(records, "facts"), str(tmp_path / "out"))
    assert sorted(r.id for r in tables.read_jsonl(spark, str(tmp_path / "out/records"), "id long, run_id string").collect()) == [1, 2]
    assert tables.read_manifests(spark, str(tmp_path / "out/manifest")).first().records == 2
    assert [r.created_at for r in scans.newest_first(spark.createDataFrame([(1, 1), (3, 1)], "created_at long, seq long")).collect()] == [3, 1]
