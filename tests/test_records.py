"""Training records with messages: shapes, prompt conflicts, rankings, rewards and what does not resolve."""

import json

import pytest
from pyspark.sql import functions as F

from tracemill.operators import records

FACT = "fact_id string, run_id string, session_id string, request_id string, actor string, kind string, parent_ref string, payload string"


def facts(spark, rows):
    return spark.createDataFrame([(i, "run_1", "s", f"r_{i}", "model", kind, parent, payload if payload is None else json.dumps(payload)) for i, kind, parent, payload in rows], FACT)


def test_samples_of_all_shapes(spark):
    hi = [{"role": "user", "content": "hi"}]
    asked = {"chat": {"json": {"messages": hi}}, "responses": {"json": {"input": "hi"}}, "kept": {"body_ref": {"sha256": "0"}, "input_messages": hi}, "none": {"json": {"model": "m"}}, "broken": None}
    answers = {
        "chat": {"json": {"choices": [{"message": {"role": "assistant", "content": None, "tool_calls": [{"id": "c", "function": {"name": "f", "arguments": "{}"}}]}}]}},
        "responses": {"json": {"output": [{"type": "function_call", "name": "g", "arguments": "1", "call_id": "k"}, {"type": "message", "content": [{"type": "output_text", "text": "done"}]}]}},
        "kept": {"canonical": {"assistant_message": {"role": "assistant", "content": "spill"}}}, "none": {"json": {"output_text": "x"}}, "broken": {"json": {"output_text": "x"}},
    }
    rows = [(f"q_{k}", "request_started", None, p) for k, p in asked.items()] + [(f"a_{k}", "response_finished", f"q_{k}", p) for k, p in answers.items()]
    rows += [("a_silent", "response_finished", "q_chat", {"json": {"choices": []}}), ("a_orphan", "response_finished", "q_gone", answers["kept"]), ("a_twice", "response_finished", "q_chat", answers["kept"])]
    got = {r.response_fact_id: r.asDict(recursive=True) for r in records.sft(facts(spark, rows)).collect()}
    assert set(got) == {"a_chat", "a_responses", "a_kept", "a_twice"}
    assert all([m["content"] for m in r["prompt"]] == ["hi"] and r["messages"] == r["prompt"] + [r["completion"]] for r in got.values())
    assert got["a_chat"]["completion"]["content"] is None and got["a_chat"]["completion"]["tool_calls"][0]["function"] == {"name": "f", "arguments": "{}"}
    assert got["a_responses"]["completion"]["content"] == "done" and got["a_responses"]["completion"]["tool_calls"][0]["call_id"] == "k"
    assert got["a_kept"]["lineage"] == {"builder": "sft", "fact_ids": ["q_kept", "a_kept"], "request_id": "r_q_kept"}
    assert records.sft(facts(spark, rows).where(F.lit(False))).collect() == []


def branch_rows(spark, rows):
    message = "struct<role:string,content:string,tool_calls:array<struct<id:string,type:string,function:struct<name:string,arguments:string>,call_id:string>>,tool_call_id:string,name:string>"
    table = spark.createDataFrame([("s", run, branch, [branch + "_r"], status, prompt) for run, branch, status, prompt in rows], "session_id string, run_id string, branch_id string, request_ids array<string>, status string, text string")
    prompt = F.from_json(F.when(F.col("text").isNotNull(), F.to_json(F.array(F.struct(F.lit("user").alias("role"), F.col("text").alias("content"))))), f"array<{message}>")
    return table.select("session_id", "run_id", "branch_id", "request_ids", "status", prompt.alias("prompt"), F.array().cast("array<string>").alias("trajectory"), F.lit(None).cast("string").alias("terminal_output"))


ARTIFACT = "artifact_id string, artifact_type string, status string, target_ref string, session_id string, run_id string, confidence double, payload string"
NO_PAIRS = "run_id string, chosen string, rejected string, source string"


def preferences(spark, branches, artifacts, pairs=()):
    table = spark.createDataFrame([(i, kind, status, "run:x", "s", run, 0.5, json.dumps(payload)) for i, kind, status, run, payload in artifacts], ARTIFACT)
    rows = records.preference(branch_rows(spark, branches), table, spark.createDataFrame(list(pairs), NO_PAIRS)).collect()
    return sorted((r.lineage.artifact_id, r.chosen.branch_id, r.rejected.branch_id, r.prompt and r.prompt[0].content, r.source, r.supervision.reason) for r in rows)


def test_preferences_and_their_prompts(spark):
    branches = [("run_1", "main", "failed", "p"), ("run_1", "retry", "succeeded", "p"), ("run_1", "odd", "failed", "q"), ("run_1", "mute", "failed", None), ("run_2", "only", "failed", "p"), ("run_2", "main", "failed", "p")]
    pair = lambda a, b, **more: {"chosen": a, "rejected": b, **more}
    got = preferences(spark, branches, [
        ("same", "preference", "active", "run_1", pair("retry", "main", reason="why")), ("conflict", "preference_pair", "active", "run_1", pair("retry", "odd")), ("allowed", "chosen_rejected", "active", "run_1", pair("retry", "odd", allow_prompt_mismatch=True)),
        ("mute", "preference", "active", "run_1", {"chosen": "", "chosen_branch_id": "retry", "rejected_branch_id": "mute"}), ("old", "preference", "superseded", "run_1", pair("retry", "main")), ("gone", "preference", "active", "run_1", pair("retry", "gone")),
        ("elsewhere", "preference", "active", "run_1", pair("retry", "only")), ("anywhere", "preference", "active", None, pair("retry", "only")), ("unclear", "preference", "active", None, pair("retry", "main")),
        ("ranked", "ranking", "active", "run_1", {"ordered": [], "ranking": ["retry", 3, "gone", "main", "odd", "mute"]}), ("short", "ranking", "active", "run_1", {"ordered": ["retry"]}),
    ], [("run_1", "retry", "main", "parent_child_outcome")])
    assert got == sorted([
        ("same", "retry", "main", "p", "preference", "why"), ("allowed", "retry", "odd", None, "chosen_rejected", None), ("mute", "retry", "mute", "p", "preference", None), ("elsewhere", "retry", "only", "p", "preference", None),
        ("anywhere", "retry", "only", "p", "preference", None), ("ranked", "retry", "main", "p", "ranking", None), ("ranked", "retry", "mute", "p", "ranking", None),
    ])
    fallback = preferences(spark, branches, [("conflict", "preference", "active", "run_1", pair("retry", "odd"))], [("run_1", "retry", "main", "x"), ("run_1", "retry", "odd", "x")])
    assert fallback == [(None, "retry", "main", "p", "x", "x")]


@pytest.mark.parametrize("payload,want", [({"score": 0.5}, 0.5), ({"reward": True, "value": 2}, 2.0), ({"score": "1"}, None), ({"label": False}, 0.0), ({"label": 3}, 3.0), ({"label": 0.5}, None), ({}, None), ([1], None)])
def test_rewards(spark, payload, want):
    df = spark.createDataFrame([(json.dumps(payload),)], "payload string")
    assert df.select(records.reward(F.parse_json("payload")).alias("r")).first().r == want


def test_members_that_are_kept(spark):
    df = spark.createDataFrame([('{"status_code": 200, "json": {"a": 1}, "text": "t", "x": 1}',), ('{"x": 1}',), (None,)], "payload string")
    got = [r.p for r in df.select(records.picked(F.try_parse_json("payload"), ("status_code", "error"), "canonical", "json", "text").alias("p")).collect()]
    assert got == [{"status_code": "200", "json": '{"a":1}'}, None, None]
