"""Training records with their messages: requests, branches and runs, and the samples that are made of them.

Payloads are JSON text in a column ``payload`` of facts and artifacts. Prompts, answers and tool calls of all body
shapes end in one nested schema (``messages.MESSAGE``). Joins are on (run_id, fact), so facts bucketed by run stay put.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.functions import variants as V
from tracemill.functions.scalars import target_kind, target_value
from tracemill.operators import governance, messages
from tracemill.operators.builders import PREFERENCE_TYPES, REWARD_TYPES

_RESPONSE = ("status_code", "content_type", "streamed", "stream_complete", "client_disconnected", "chunk_count", "ttfb_ms", "total_latency_ms", "stream_duration_ms")
_ERROR = ("status_code", "error", "error_code", "content_type", "ttfb_ms", "total_latency_ms")


def _value(column: str = "payload") -> Column:
    return V.parsed(F.col(column))


def picked(value: Column, names: tuple[str, ...], *either: str) -> Column:
    """Named members of an object as a map to JSON text, and the first of ``either`` that is there; null if none is."""
    all_ = F.transform_values(V.members(value), lambda k, v: F.coalesce(F.to_json(v), F.lit("null")))
    first = F.get(F.filter(F.array(*map(F.lit, either)), lambda n: F.map_contains_key(all_, n)), 0) if either else F.lit(None).cast("string")
    found = F.map_filter(all_, lambda k, v: k.isin(*names) | F.coalesce(k == first, F.lit(False)))
    return F.when(F.size(found) > 0, found)


def _with_prompts(rows: DataFrame, payload: str, name: str) -> DataFrame:
    """Rows with the prompt of their payloads (VARIANT), whose usual messages are read once in a column of their own."""
    return rows.withColumn("_plain", messages.plain_messages(V.at(F.col(payload), "$.json"))).withColumn(name, messages.request_messages(F.col(payload), F.col("_plain"))).drop("_plain")


def sft(facts: DataFrame) -> DataFrame:
    """A sample for each answer of the model to a model request: prompt, completion, all messages, lineage.

    Requests without messages and answers that say nothing give none. Request and answer are matched by fact in the
    whole scope, whatever their runs.
    """
    of_model = facts.where("actor = 'model'")
    requested = of_model.where("kind = 'request_started'").select(F.col("fact_id").alias("request_fact_id"), "request_id", _value().alias("_request"))
    asked = _with_prompts(requested, "_request", "prompt").drop("_request").where("prompt is not null")
    answered = of_model.where("kind = 'response_finished' and parent_ref is not null").select("session_id", "run_id", F.col("parent_ref").alias("request_fact_id"), F.col("fact_id").alias("response_fact_id"), messages.answer(_value()).alias("completion")).where("completion is not null")
    lineage = F.struct(F.lit("sft").alias("builder"), F.array("request_fact_id", "response_fact_id").alias("fact_ids"), F.col("request_id"))
    return asked.join(answered, "request_fact_id").select("session_id", "run_id", "request_fact_id", "response_fact_id", "request_id", "prompt", "completion", F.array_append("prompt", F.col("completion")).alias("messages"), F.struct(F.lit("sft").alias("type")).alias("supervision"), lineage.alias("lineage"))


def requests(facts: DataFrame, assigned: DataFrame) -> DataFrame:
    """A record for each request of ``assigned`` (branches.assign): its branch, prompt, answer, and what came back."""
    side = lambda name: facts.select("run_id", F.col("fact_id").alias(f"{name}_fact_id"), F.col("payload").alias(f"_{name}"))
    about = facts.where("kind = 'request_started'").select("run_id", F.col("fact_id").alias("request_fact_id"), "actor", "path", F.col("payload").alias("_request"))
    rows = assigned.select("run_id", "session_id", "request_fact_id", F.coalesce("request_id", "request_fact_id").alias("request_id"), "ts", "seq", "outcome", "branch_id", "response_fact_id", "error_fact_id")
    rows = rows.join(about, ["run_id", "request_fact_id"]).join(side("response"), ["run_id", "response_fact_id"], "left").join(side("error"), ["run_id", "error_fact_id"], "left")
    rows = rows.withColumns({c: _value(c) for c in ("_request", "_response", "_error")})
    rows = _with_prompts(rows, "_request", "input_messages").withColumn("output_message", messages.answer(F.col("_response")))
    body, came = V.at(F.col("_request"), "$.json"), F.col("_response")
    response = F.when(F.col("output_message").isNotNull(), picked(came, _RESPONSE)).otherwise(picked(came, _RESPONSE, "canonical", "json", "text", "preview"))
    said = F.coalesce("input_messages", F.array().cast(messages.MESSAGES))
    return rows.select(
        "session_id", "run_id", "request_id", "request_fact_id", "actor", "path", "branch_id", "outcome", "ts", "seq", "input_messages", "output_message",
        F.when(F.col("output_message").isNotNull(), F.array_append(said, F.col("output_message"))).otherwise(F.col("input_messages")).alias("messages"),
        F.to_json(body).alias("request_payload"), response.alias("response"), "response_fact_id", picked(F.col("_error"), _ERROR, "json", "text").alias("error"), "error_fact_id",
    )


_STEP = ("request_id", "request_fact_id", "actor", "path", "branch_id", "outcome", "input_messages", "output_message", "messages", "response", "error")


def _by(rows: Column, key: str) -> Column:
    """Structs in order of one field; the others, maps among them, need no order."""
    return F.array_sort(rows, lambda a, b: F.when(a[key] < b[key], -1).when(a[key] > b[key], 1).otherwise(0))


def _trajectory(records: DataFrame, *by: str) -> DataFrame:
    """Steps of each group in order, the first prompt among them, and the last thing that came back."""
    steps = F.transform(_by(F.collect_list(F.struct(F.struct("ts", "seq", "request_fact_id").alias("at"), F.struct(*_STEP).alias("step"))), "at"), lambda s: s["step"])
    rows = records.groupBy(*by).agg(F.min("session_id").alias("session_id"), steps.alias("trajectory"))
    null = F.lit(None)
    end = lambda kind, message, body: F.struct(F.lit(kind).alias("type"), message.cast(messages.MESSAGE).alias("message"), body.cast("map<string,string>").alias("body"))
    ends = F.transform("trajectory", lambda s: F.when(s["output_message"].isNotNull(), end("assistant_message", s["output_message"], null)).when(s["response"].isNotNull(), end("response", null, s["response"])).when(s["error"].isNotNull(), end("error", null, s["error"])))
    present = F.filter(ends, lambda e: e.isNotNull())
    prompts = F.filter(F.transform("trajectory", lambda s: s["input_messages"]), lambda p: F.size(p) > 0)
    return rows.withColumns({"prompt": F.get(prompts, 0), "terminal_output": F.get(present, F.size(present) - 1)})


def branch_records(records: DataFrame, branches: DataFrame) -> DataFrame:
    """One record for each branch with requests: its kind and status, request ids, prompt, trajectory and end."""
    known = branches.groupBy("run_id", "branch_id").agg(F.min_by(F.struct("branch_type", "status", "source", "parent_branch_id"), "opened_seq").alias("b"))
    steps = _trajectory(records, "run_id", "branch_id")
    ids = lambda name: F.transform("trajectory", lambda s: s[name]).alias(f"{name}s")
    return steps.join(known, ["run_id", "branch_id"]).select("session_id", "run_id", "branch_id", "b.*", ids("request_id"), ids("request_fact_id"), "prompt", "trajectory", "terminal_output")


def run_records(records: DataFrame, branch_rows: DataFrame) -> DataFrame:
    """One record for each run with requests: its first prompt, requests and branches in order."""
    inner = branch_rows.groupBy("run_id").agg(_by(F.collect_list(F.struct("branch_id", "branch_type", "status", "request_ids", "terminal_output")), "branch_id").alias("branches"))
    return _trajectory(records, "run_id").join(inner, "run_id", "left").select("session_id", "run_id", "prompt", F.col("trajectory").alias("requests"), "branches")


def stated_pairs(artifacts: DataFrame) -> DataFrame:
    """Pairs that active preference artifacts state: a chosen and a rejected branch, or a ranking's first against each later one."""
    rows = artifacts.where(F.col("artifact_type").isin(*PREFERENCE_TYPES) & (F.col("status") == "active")).withColumn("_p", _value())
    listed = F.filter(F.transform(F.coalesce(F.when(F.size(V.items(F.col("_p"), "$.ordered")) > 0, V.items(F.col("_p"), "$.ordered")), V.items(F.col("_p"), "$.ranking")), lambda x: V.string(x)), lambda x: x.isNotNull())
    filled = lambda *names: F.coalesce(*(V.named(F.col("_p"), f"$.{n}") for n in names))
    pair = lambda chosen, rejected: F.struct(chosen.alias("chosen"), rejected.alias("rejected"))
    ranked = F.when(F.size(listed) > 1, F.transform(F.slice(listed, 2, F.size(listed)), lambda x: pair(listed[0], x)))
    pairs = F.when(F.col("artifact_type") == "ranking", ranked).otherwise(F.array(pair(filled("chosen", "chosen_branch_id"), filled("rejected", "rejected_branch_id"))))
    allowed = ~F.coalesce(F.to_json(V.at(F.col("_p"), "$.allow_prompt_mismatch")), F.lit("null")).isin("null", "false", "0", '""', "[]", "{}")
    flat = rows.select("artifact_id", F.col("artifact_type").alias("source"), "target_ref", "run_id", "confidence", V.named(F.col("_p"), "$.reason").alias("reason"), allowed.alias("allowed"), F.posexplode(pairs).alias("place", "pair"))
    return flat.select("*", "pair.*").drop("pair").where("chosen is not null and rejected is not null")


def _with_sides(pairs: DataFrame, branch_rows: DataFrame) -> DataFrame:
    """Pairs (…, chosen_run, chosen, rejected_run, rejected) with both branches' records; conflicting prompts go unless allowed."""
    side = lambda name: branch_rows.select(F.col("run_id").alias(f"{name}_run"), F.col("branch_id").alias(name), F.struct("session_id", "run_id", "branch_id", "request_ids", "status", "prompt", "trajectory", "terminal_output").alias(f"_{name}"))
    rows = pairs.join(side("chosen"), ["chosen_run", "chosen"]).join(side("rejected"), ["rejected_run", "rejected"])
    left, right = F.col("_chosen.prompt"), F.col("_rejected.prompt")
    kept = rows.where(F.col("allowed") | F.coalesce(left == right, F.lit(True)))
    shared = F.when(F.coalesce(left == right, F.lit(True)), F.coalesce(left, right))
    supervision = F.struct(F.lit("preference").alias("type"), "source", "reason", "confidence")
    lineage = F.struct(F.lit("preference").alias("builder"), "artifact_id", "target_ref")
    return kept.select("_chosen.session_id", "_chosen.run_id", shared.alias("prompt"), F.col("_chosen").alias("chosen"), F.col("_rejected").alias("rejected"), "source", supervision.alias("supervision"), lineage.alias("lineage"))


def preference(branch_rows: DataFrame, artifacts: DataFrame, pairs: DataFrame) -> DataFrame:
    """Preference samples of the artifacts; where none of them resolves, of the comparable pairs.

    A branch is looked for in the artifact's run, else anywhere if its name is in one run only.
    """
    stated = stated_pairs(artifacts)
    known = branch_rows.select("run_id", "branch_id").distinct()
    for name in ("chosen", "rejected"):
        refs = stated.select(F.struct("artifact_id", "place").alias("ref_id"), "run_id", F.col(name).alias("branch_id"))
        found = governance.branch_of_reference(refs, known).select("ref_id.*", F.col("run_id").alias(f"{name}_run"))
        stated = stated.join(found, ["artifact_id", "place"])
    rows = _with_sides(stated, branch_rows)
    none = rows.agg((F.count("*") == 0).alias("none"))
    text = F.lit(None).cast("string")
    inferred = pairs.select(F.col("run_id").alias("chosen_run"), "chosen", F.col("run_id").alias("rejected_run"), "rejected", "source", F.lit(False).alias("allowed"), F.col("source").alias("reason"), F.lit(None).cast("double").alias("confidence"), text.alias("artifact_id"), text.alias("target_ref"))
    inferred = inferred.crossJoin(F.broadcast(none)).where("none").drop("none")  # one row
    return rows.unionByName(_with_sides(inferred, branch_rows))


def reward(value: Column) -> Column:
    """Number of a reward, score or value; else a label as 0 or 1, or a whole number."""
    label = V.truth(value, "$.label")
    return F.coalesce(*(V.number(value, f"$.{k}") for k in ("reward", "score", "value")), F.when(label, 1.0).when(~label, 0.0), V.whole(value, "$.label").cast("double"))


def binary_rl(facts: DataFrame, records: DataFrame, branch_rows: DataFrame, runs: DataFrame, artifacts: DataFrame) -> DataFrame:
    """A sample for each active artifact with a reward, its target with the requests that it is about.

    What a reference does not resolve to keeps the reference alone, so no artifact is lost.
    """
    active = artifacts.where(F.col("artifact_type").isin(*REWARD_TYPES) & (F.col("status") == "active")).withColumn("reward", reward(_value())).where("reward is not null")
    rows = active.select("artifact_id", "artifact_type", "target_ref", "session_id", "run_id", "confidence", "reward", "payload", target_kind(F.col("target_ref")).alias("unit"), target_value(F.col("target_ref")).alias("target"))
    on = lambda *units: rows.where(F.col("unit").isin(*units))
    step = F.struct(*_STEP)
    of_facts = facts.select(F.col("fact_id").alias("target"), F.col("run_id").alias("fact_run"), F.when(F.col("kind") == "request_started", F.col("fact_id")).otherwise(F.col("parent_ref")).alias("request_fact_id"))
    with_steps = of_facts.join(records.select("request_fact_id", F.array(step).alias("steps"), F.col("input_messages").alias("prompt")), "request_fact_id", "left")
    fact_rows = on("fact").join(with_steps, "target", "left").select(*rows.columns, F.when(F.col("fact_run").isNotNull(), "fact").alias("kind"), F.col("fact_run").alias("of_run"), "prompt", "steps")
    refs = on("branch").select(F.col("artifact_id").alias("ref_id"), "run_id", F.col("target").alias("branch_id"))
    found = governance.branch_of_reference(refs, branch_rows.select("run_id", "branch_id").distinct()).select(F.col("ref_id").alias("artifact_id"), F.col("run_id").alias("of_run"))
    of_branches = branch_rows.select(F.col("run_id").alias("of_run"), F.col("branch_id").alias("target"), "prompt", F.col("trajectory").alias("steps"))
    branch_out = on("branch").join(found, "artifact_id", "left").join(of_branches, ["of_run", "target"], "left").select(*rows.columns, F.when(F.col("of_run").isNotNull(), "branch").alias("kind"), "of_run", "prompt", "steps")
    of_runs = runs.select(F.col("run_id").alias("of_run"), "prompt", F.col("requests").alias("steps"), F.lit(True).alias("there"))
    wanted = on("run", "session", "").withColumn("of_run", F.when(F.col("unit") == "run", F.coalesce("run_id", "target")).otherwise(F.col("run_id")))
    run_out = wanted.join(of_runs, "of_run", "left").select(*rows.columns, F.when(F.col("there"), "run").alias("kind"), "of_run", "prompt", "steps")
    other = rows.where(~F.col("unit").isin("fact", "branch", "run", "session", ""))
    null = lambda kind, name: F.lit(None).cast(kind).alias(name)
    other_out = other.select(*rows.columns, null("string", "kind"), null("string", "of_run"), null(messages.MESSAGES, "prompt"), null(fact_rows.schema["steps"].dataType.simpleString(), "steps"))
    whole = fact_rows.unionByName(branch_out).unionByName(run_out).unionByName(other_out)
    resolved = F.col("kind").isNotNull()
    unit = F.coalesce("kind", F.when(F.col("unit") == "", "session").otherwise(F.col("unit")))
    target = F.struct(unit.alias("type"), F.when(resolved, F.col("of_run")).alias("run_id"), F.when(~resolved, F.col("target_ref")).alias("target_ref"), F.when(resolved, F.col("prompt")).alias("prompt"), F.when(resolved, F.col("steps")).alias("requests"))
    supervision = F.struct(F.lit("binary_rl").alias("type"), "artifact_type", "reward", "confidence", "payload")
    return whole.select("session_id", "run_id", target.alias("target"), "reward", "artifact_type", "confidence", supervision.alias("supervision"), F.struct(F.lit("binary_rl").alias("builder"), "artifact_id", "target_ref").alias("lineage"))
