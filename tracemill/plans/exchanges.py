"""Registered queries of streams, messages and the training records made of them, with the SQL that gives the same rows.

The tables are ``conversations`` seen as captured exchanges (``sources.wire``): bodies of five shapes, answers streamed in
pieces, requests tried again. The SQL says what must come out, from the conversations themselves.
"""

from __future__ import annotations

import gzip

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.operators import artifacts, branches, export, messages, plugins, records, scans, scope, streams
from tracemill.plans.model import Model
from tracemill.plans.registry import query
from tracemill.sources import payloads, wire

_KEY = ("conv_id", "turn")


def _said(prompt: str | Column) -> Column:
    """Messages as lines of ``role: content``."""
    return F.array_join(F.transform(prompt, lambda m: F.concat_ws(": ", m["role"], m["content"])), "\n")


def _asked(calls: str | Column) -> Column:
    return F.coalesce(F.array_join(F.transform(calls, lambda c: F.concat(c["id"], F.lit("="), c["function"]["name"], c["function"]["arguments"])), ";"), F.lit(""))


_CALLS = """CASE WHEN turn % 4 = 3 THEN 'call_' || conv_id || '_' || turn || '_0=lookup{"turn":' || turn || ',"of":' || conv_id || '};call_' || conv_id || '_' || turn || '_1=note{"n":[' || turn || ',' || (turn + 1) || '],"deep":{"x":"é"}}' ELSE '' END"""
_SHAPE = "(['chat', 'responses', 'chat_stream', 'responses_stream', 'kept_elsewhere'])[conv_id % 5 + 1]"
_EXCHANGES = f"""(SELECT conv_id, turn, (conv_id * 1048576 + turn) * 4 AS base, conv_id % 3 = 0 AS retried, {_SHAPE} AS shape, 'chat_' || conv_id || '_' || turn AS run_id, 'chat_' || conv_id AS session_id, text, prompt, n, {_CALLS} AS calls
    FROM (SELECT *, string_agg(role || ': ' || text, chr(10)) OVER w AS prompt, count(*) OVER w AS n FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) WHERE role = 'assistant' AND n > 0)"""


def _assembled(m: Model) -> DataFrame:
    chunks = wire.stream_chunks(wire.exchanges(m.table("conversations")))
    rows = streams.assemble(streams.events(chunks, *_KEY, "path"), *_KEY, path="path")
    said = F.col("assistant_message")
    return rows.select(*_KEY, "complete", said["role"].alias("role"), said["content"].alias("content"), _asked(said["tool_calls"]).alias("calls"), F.coalesce(F.size("output"), F.lit(0)).cast("long").alias("items"), "output_text")


query(
    "assembled_streams",
    _assembled,
    f"SELECT conv_id, turn, true AS complete, 'assistant' AS role, text AS content, calls, CASE WHEN shape = 'responses_stream' THEN CASE WHEN calls <> '' THEN 3 ELSE 1 END ELSE 0 END AS items, CASE WHEN shape = 'responses_stream' THEN text END AS output_text FROM {_EXCHANGES} WHERE shape LIKE '%stream'",
)
query(
    "prompt_messages",
    lambda m: m.exchange_facts.where("kind = 'request_started'").select("fact_id", messages.request_messages(F.parse_json("payload")).alias("p")).select("fact_id", _said("p").alias("prompt"), F.size("p").cast("long").alias("messages")),
    f"SELECT 'w' || (base + j) AS fact_id, prompt, n AS messages FROM {_EXCHANGES}, (VALUES (0), (2)) a(j) WHERE j = 0 OR retried",
)
query(
    "sft_messages",
    lambda m: records.sft(m.exchange_facts).select("session_id", "run_id", "request_fact_id", "response_fact_id", "request_id", _said("prompt").alias("prompt"), F.col("completion.content").alias("completion"), _asked("completion.tool_calls").alias("calls"), F.size("messages").cast("long").alias("messages"), F.array_join("lineage.fact_ids", ",").alias("lineage")),
    f"SELECT session_id, run_id, q AS request_fact_id, r AS response_fact_id, q AS request_id, prompt, text AS completion, calls, n + 1 AS messages, q || ',' || r AS lineage FROM (SELECT *, 'w' || (base + CASE WHEN retried THEN 2 ELSE 0 END) AS q, 'w' || (base + 3) AS r FROM {_EXCHANGES})",
)
query("exchange_branches", lambda m: m.exchange_branches.select("run_id", "branch_id", "branch_type", "parent_branch_id", "status", "open_reason"), f"SELECT run_id, 'br_main' AS branch_id, 'mainline' AS branch_type, NULL AS parent_branch_id, CASE WHEN retried THEN 'failed' ELSE 'succeeded' END AS status, 'run_start' AS open_reason FROM {_EXCHANGES} UNION ALL SELECT run_id, 'br_retry_1', 'retry', 'br_main', 'succeeded', 'retry_after:w' || base FROM {_EXCHANGES} WHERE retried")
query(
    "request_records",
    lambda m: m.request_records.select("run_id", "request_fact_id", "branch_id", "outcome", _said("input_messages").alias("prompt"), F.col("output_message.content").alias("answer"), F.size("messages").cast("long").alias("messages"), F.array_join(F.sort_array(F.map_keys("response")), ",").alias("response"), F.array_join(F.sort_array(F.map_keys("error")), ",").alias("error"), F.get_json_object(F.col("error")["json"], "$.detail.turn").cast("long").alias("error_turn"), F.col("request_payload").isNotNull().alias("has_body")),
    f"""SELECT run_id, 'w' || (base + j) AS request_fact_id, CASE WHEN j = 2 THEN 'br_retry_1' ELSE 'br_main' END AS branch_id, CASE WHEN answered THEN 'succeeded' ELSE 'failed' END AS outcome, prompt, CASE WHEN answered THEN text END AS answer, n + CAST(answered AS INT) AS messages,
    CASE WHEN answered THEN CASE WHEN shape LIKE '%stream' THEN 'status_code,stream_complete,streamed' ELSE 'status_code' END END AS response, CASE WHEN NOT answered THEN 'error,json,status_code' END AS error, CASE WHEN NOT answered THEN turn END AS error_turn, shape <> 'kept_elsewhere' AS has_body
    FROM (SELECT *, j = 2 OR NOT retried AS answered FROM {_EXCHANGES}, (VALUES (0), (2)) a(j) WHERE j = 0 OR retried)""",
)
query(
    "run_records",
    lambda m: m.run_records.select("run_id", "session_id", _said("prompt").alias("prompt"), F.array_join(F.transform("requests", lambda r: F.concat(r["request_id"], F.lit(":"), r["branch_id"])), ",").alias("requests"), F.array_join(F.transform("branches", lambda b: F.concat(b["branch_id"], F.lit(":"), b["terminal_output"]["type"])), ",").alias("branches")),
    f"SELECT run_id, session_id, prompt, 'w' || base || ':br_main' || CASE WHEN retried THEN ',w' || (base + 2) || ':br_retry_1' ELSE '' END AS requests, CASE WHEN retried THEN 'br_main:error,br_retry_1:assistant_message' ELSE 'br_main:assistant_message' END AS branches FROM {_EXCHANGES}",
)


def _pair_columns(rows: DataFrame) -> DataFrame:
    end = lambda side: F.coalesce(F.col(f"{side}.terminal_output.message.content"), F.col(f"{side}.terminal_output.body")["error"])
    return rows.select("session_id", "run_id", _said("prompt").alias("prompt"), F.col("chosen.branch_id").alias("chosen"), F.col("rejected.branch_id").alias("rejected"), F.array_join("chosen.request_ids", ",").alias("chosen_requests"), end("chosen").alias("chosen_end"), end("rejected").alias("rejected_end"), "source", "supervision.reason", "lineage.artifact_id")


_PAIRS = """SELECT session_id, run_id, prompt, 'br_retry_1' AS chosen, 'br_main' AS rejected, 'w' || (base + 2) AS chosen_requests, text AS chosen_end, '"upstream_failed"' AS rejected_end, {} FROM {} WHERE retried"""
query("preference_messages", lambda m: _pair_columns(records.preference(m.branch_records, m.exchange_artifacts.where("artifact_type = 'score'"), branches.branch_pairs(m.exchange_branches))), _PAIRS.format("'parent_child_outcome' AS source, 'parent_child_outcome' AS reason, NULL AS artifact_id", _EXCHANGES))
query(
    "preference_stated",
    lambda m: _pair_columns(records.preference(m.branch_records, m.exchange_artifacts, branches.branch_pairs(m.exchange_branches))),
    _PAIRS.format("CASE WHEN turn % 3 = 2 THEN 'ranking' ELSE 'preference' END AS source, CASE WHEN turn % 3 = 0 THEN 'tried again' END AS reason, 'pref_' || run_id AS artifact_id", _EXCHANGES) + " AND conv_id % 7 <> 6 AND turn % 5 <> 4",
)
query(
    "binary_rl_messages",
    lambda m: records.binary_rl(m.exchange_facts, m.request_records, m.branch_records, m.run_records, m.exchange_artifacts).select("lineage.artifact_id", "session_id", "run_id", "reward", F.col("target.type").alias("target"), F.col("target.run_id").alias("target_run"), "target.target_ref", F.coalesce(F.size("target.requests"), F.lit(0)).cast("long").alias("requests"), _said("target.prompt").alias("prompt")),
    f"""SELECT 'score_' || run_id AS artifact_id, session_id, own AS run_id, reward, unit AS target, CASE WHEN found THEN run_id END AS target_run, CASE WHEN NOT found THEN ref END AS target_ref, CASE WHEN NOT found THEN 0 WHEN unit = 'run' AND retried THEN 2 ELSE 1 END AS requests, CASE WHEN found THEN prompt END AS prompt
    FROM (SELECT *, CASE which WHEN 0 THEN 'fact' WHEN 1 THEN 'branch' WHEN 4 THEN 'slice' WHEN 3 THEN CASE WHEN own IS NULL THEN 'session' ELSE 'run' END ELSE 'run' END AS unit, which IN (0, 2) OR (which IN (1, 3) AND (own IS NOT NULL OR (which = 1 AND (SELECT count(*) FROM {_EXCHANGES}) = 1))) AS found,
            CASE which WHEN 1 THEN 'branch:br_main' WHEN 3 THEN 'session:' || session_id ELSE 'slice:s' || turn END AS ref
        FROM (SELECT *, conv_id % 5 AS which, CASE WHEN turn % 5 <> 4 THEN run_id END AS own, CASE conv_id % 7 WHEN 0 THEN turn / 8 WHEN 1 THEN CAST(turn % 3 = 0 AS INT) WHEN 2 THEN turn WHEN 4 THEN 1 WHEN 5 THEN 0.25 END AS reward FROM {_EXCHANGES}) WHERE reward IS NOT NULL)""",
)


# bodies kept beside the facts
def _packed(text: str) -> Column:
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else gzip.compress(t.encode(), mtime=0))

    return F.pandas_udf(run, "binary")(text)


def _bodies(m: Model) -> DataFrame:
    """Documents as kept bodies; some files are no archives, and some references name another place, size or digest."""
    docs, wrong = m.table("documents").select("doc_id", "text"), lambda n: F.col("doc_id") % n == 0
    path = F.concat(F.lit("s/r/"), F.col("doc_id"), F.lit("/body.txt.gz"))
    files = docs.where("text is not null").select(path.alias("relative_path"), F.when(wrong(7), F.concat(F.lit("plain "), "text").cast("binary")).otherwise(_packed("text")).alias("content"))
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    ref = F.struct(
        F.when(wrong(17), "s3").otherwise("local_file").alias("storage"), F.when(wrong(13), F.concat(F.lit("../"), path)).otherwise(path).alias("relative_path"), F.lit(None).cast("string").alias("path"), F.lit("gzip").alias("encoding"), F.lit("text/plain").alias("content_type"),
        F.when(wrong(10), size + 1).otherwise(size).alias("byte_size"), F.lit(None).cast("long").alias("compressed_size"), F.when(wrong(11), F.sha2(F.lit("other"), 256)).otherwise(F.sha2("text", 256)).alias("sha256"),
    )
    return payloads.read_bodies(docs.select("doc_id", ref.alias("body_ref")), files, "/bodies")


query(
    "payload_integrity",
    lambda m: _bodies(m).select("doc_id", "state", F.octet_length("body").cast("long").alias("size")),
    "SELECT doc_id, state, CASE WHEN state = 'ok' THEN strlen(text) END AS size FROM (SELECT doc_id, text, CASE WHEN doc_id % 17 = 0 THEN 'unsupported' WHEN doc_id % 13 = 0 THEN 'escapes' WHEN text IS NULL THEN 'missing' WHEN doc_id % 7 = 0 THEN 'unreadable' WHEN doc_id % 10 = 0 THEN 'size_mismatch' WHEN doc_id % 11 = 0 THEN 'digest_mismatch' ELSE 'ok' END AS state FROM documents)",
)


def _collection(m: Model) -> DataFrame:
    """Pages as kept files, some of another kind; every third is referred to by a document, as are files that are not there."""
    name = lambda n: F.concat(F.lit("s/r/"), n, F.lit("/body.json.gz"))
    page = F.col("page_id")
    files = m.table("pages").select(F.when(page % 9 == 1, F.concat(F.lit("s/r/"), page, F.lit("/notes.txt"))).otherwise(name(page)).alias("relative_path"), F.octet_length("html").cast("long").alias("length"), F.timestamp_seconds(page % 500).alias("modified"))
    refs = m.table("documents").select(F.struct(F.lit("local_file").alias("storage"), F.concat(F.when(F.col("doc_id") % 5 == 0, "../").otherwise(""), name(F.col("doc_id") * 3)).alias("relative_path"), F.lit(None).cast("string").alias("path")).alias("body_ref"))
    return payloads.summary(payloads.file_states(files, refs, "/bodies", F.timestamp_seconds(F.lit(500))), refs, "/bodies")


query(
    "payload_collection",
    _collection,
    """SELECT count(*) AS scanned_files, count(*) FILTER (WHERE state <> 'unmanaged') AS managed_files, count(*) FILTER (WHERE state = 'unmanaged') AS skipped_unmanaged_files, count(*) FILTER (WHERE state IN ('recent', 'orphan')) AS orphan_files, count(*) FILTER (WHERE state = 'recent') AS skipped_recent_files,
    count(*) FILTER (WHERE state = 'orphan') AS would_delete_files, CAST(coalesce(sum(size) FILTER (WHERE state = 'orphan'), 0) AS BIGINT) AS would_delete_bytes, (SELECT count(DISTINCT doc_id) FILTER (WHERE doc_id % 5 <> 0) FROM documents) AS referenced_files, (SELECT count(*) FILTER (WHERE doc_id % 5 = 0) FROM documents) AS referenced_outside_root
    FROM (SELECT strlen(html) AS size, CASE WHEN page_id % 9 = 1 THEN 'unmanaged' WHEN page_id IN (SELECT doc_id * 3 FROM documents WHERE doc_id % 5 <> 0) THEN 'referenced' WHEN 500 - page_id % 500 < 300 THEN 'recent' ELSE 'orphan' END AS state FROM pages)""",
)


# open payloads of artifacts
def _with_leaves(m: Model) -> DataFrame:
    """Artifacts whose payloads name branches one, two and three levels deep."""
    third = F.when(F.col("seq") % 3 == 0, "br_main")
    payload = F.to_json(F.struct(F.col("chosen_branch_id").alias("chosen"), F.struct(F.array("rejected_branch_id", "task_type").alias("list")).alias("pair"), F.array(F.struct(F.struct(third.alias("about"), F.col("score").alias("n")).alias("deep"))).alias("notes")))
    return m.artifacts.select("artifact_id", "artifact_type", "run_id", "target_ref", payload.alias("payload"))


query(
    "branch_mentions",
    lambda m: artifacts.branch_mentions(m.branches, _with_leaves(m)),
    "SELECT DISTINCT b.run_id, b.branch_id, a.artifact_id, a.artifact_type FROM branches b JOIN artifacts a ON (a.run_id IS NULL OR a.run_id = b.run_id) AND (a.target_ref = 'branch:' || b.branch_id OR a.chosen_branch_id = b.branch_id OR a.rejected_branch_id = b.branch_id OR (a.seq % 3 = 0 AND b.branch_id = 'br_main'))",
)


def _open_notes(m: Model) -> DataFrame:
    """Annotations with their fields in open payloads: members that no schema knows, and nulls that hide a session's value."""
    note = F.when(F.col("target_ref").startswith("session:"), "of session").otherwise(F.when(F.col("seq") % 2 == 0, None).otherwise("of run"))
    members = [F.lit("e1").alias("annotation_kind"), *artifacts.E1_FIELDS, note.alias("note"), F.when(F.col("run_id").isNull(), F.col("seq")).alias("only_session"), F.struct(F.col("seq").alias("at")).alias("odd")]
    return m.artifacts.withColumn("payload", F.to_json(F.struct(*members), {"ignoreNullFields": "false"}))


_SHOWN = ("task_type", "verifier_name", "note", "only_session")
query(
    "candidate_fields",
    lambda m: artifacts.candidate_fields(m.facts, _open_notes(m)).select("run_id", "session_id", F.array_join("artifact_ids", ",").alias("artifact_ids"), F.size("fields").cast("long").alias("members"), "verifier_score", *(F.get_json_object(F.concat(F.lit('{"v":'), F.col("fields")[c], F.lit("}")), "$.v").alias(c) for c in _SHOWN), F.get_json_object(F.col("fields")["odd"], "$.at").cast("long").alias("odd")),
    f"""SELECT run_id, session_id, concat_ws(',', sa, ra) AS artifact_ids, {" + ".join(f"CAST(own_{f} IS NOT NULL AS BIGINT)" for f in (*artifacts.E1_FIELDS, "note", "only_session", "odd"))} AS members, vs AS verifier_score, own_task_type AS task_type, own_verifier_name AS verifier_name, own_note AS note, CAST(own_only_session AS VARCHAR) AS only_session, own_odd AS odd
    FROM (SELECT u.run_id, u.session_id, s.artifact_id AS sa, r.artifact_id AS ra, coalesce(r.verifier_score, s.verifier_score) AS vs, {", ".join(f"CASE WHEN r.artifact_id IS NOT NULL THEN r.{f} ELSE s.{f} END AS own_{f}" for f in artifacts.E1_FIELDS)},
            CASE WHEN r.artifact_id IS NULL THEN 'of session' WHEN r.seq % 2 = 1 THEN 'of run' END AS own_note, CASE WHEN r.artifact_id IS NULL THEN s.seq END AS own_only_session, coalesce(r.seq, s.seq) AS own_odd
        FROM (SELECT run_id, min(session_id) AS session_id FROM facts GROUP BY run_id) u
        LEFT JOIN (SELECT a.* FROM annotations a JOIN live USING (artifact_id) WHERE a.target_kind = 'session') s ON s.target_id = u.session_id LEFT JOIN (SELECT a.* FROM annotations a JOIN live USING (artifact_id) WHERE a.target_kind = 'run') r ON r.target_id = u.run_id
        WHERE {" AND ".join(f"coalesce(r.{f}, s.{f}) IS NOT NULL" for f in artifacts.NEEDED)})""",
)
query(
    "retry_fingerprints",
    lambda m: m.exchange_facts.where("kind = 'request_started'").groupBy("run_id").agg(F.count("*").alias("requests"), F.count_distinct("fingerprint").alias("fingerprints"), F.count_distinct("payload").alias("payloads")),
    f"SELECT run_id, CASE WHEN retried THEN 2 ELSE 1 END AS requests, 1 AS fingerprints, CASE WHEN retried THEN 2 ELSE 1 END AS payloads FROM {_EXCHANGES}",
)


# export plans and scopes
_NAMED = {"task_family": "'family_' || (conv_id % 3)", "task_type": "CASE WHEN conv_id % 11 <> 3 THEN 'type_' || (conv_id % 2) END", "task_template_hash": "'tpl_' || (conv_id % 13)", "task_instance_key": "'inst_' || (conv_id % 40)", "taxonomy_version": "'tx' || (conv_id % 2)"}
_PLAIN = {"verifier_name": "'unit'", "verifier_score": "0.5e0", "quality_confidence": "0.75e0", "annotation_version": "'a1'", "source_channel": "'captured'"}


def _exchange_fields(m: Model) -> DataFrame:
    """Resolved annotations of the runs of exchanges: some lack their task type, those of every ninth conversation have none."""
    names = {**{c: x.replace("'", "\"") for c, x in _NAMED.items()}, **{c: x.replace("'", "\"").replace("e0", "D") for c, x in _PLAIN.items()}}
    rows = wire.exchanges(m.table("conversations")).where("conv_id % 9 <> 4")
    shown = [F.expr(names[c]).alias(c) for c in artifacts.E1_FIELDS]
    lacking = F.when(F.col("task_type").isNull(), 1).otherwise(0).cast("long")
    return rows.select(F.concat_ws("_", F.lit("chat"), "conv_id", "turn").alias("run_id"), F.concat(F.lit("chat_"), "conv_id").alias("session_id"), *shown).withColumns({"missing": lacking, "ready": lacking == 0})


def _export(m: Model, **more) -> export.Plan:
    """SFT records of all exchanges, those of every fourth conversation twice under other names, planned for export."""
    rows = records.sft(m.exchange_facts)
    again = rows.where(F.regexp_extract("session_id", r"(\d+)", 1).cast("long") % 4 == 0).withColumn("request_id", F.concat("request_id", F.lit("_again")))
    return export.plan("sft", rows.unionByName(again), _exchange_fields(m), m.exchange_facts, m.exchange_artifacts, order=("request_id",), snapshot_id="ds_fixed", **more)


_FIELDS_SQL = f"(SELECT *, {', '.join(f'CASE WHEN conv_id % 9 <> 4 THEN {x} END AS {c}' for c, x in _NAMED.items())} FROM {_EXCHANGES})"
_SPLIT = "CASE WHEN p < 80 THEN 'train' WHEN p < 90 THEN 'val' ELSE 'test' END"
# equal records: same task, prompt, answer and calls; of them the least request name stays
_PLANNED = f"""(SELECT *, {_SPLIT} AS split FROM (SELECT *, CAST('0x' || substr(sha256(split_guard_key), 1, 8) AS BIGINT) % 100 AS p FROM (
    SELECT arg_min(run_id, q) AS run_id, arg_min(conv_id, q) AS conv_id, min(q) AS request_id, coalesce('task_instance_key:' || task_instance_key, 'run_id:' || arg_min(run_id, q)) AS split_guard_key, count(*) AS copies, task_family, task_type, task_instance_key, task_template_hash
    FROM (SELECT *, 'w' || (base + CASE WHEN retried THEN 2 ELSE 0 END) || suffix AS q FROM {_FIELDS_SQL}, (VALUES (''), ('_again')) s(suffix) WHERE suffix = '' OR conv_id % 4 = 0) GROUP BY prompt, text, calls, task_family, task_type, task_instance_key, task_template_hash)))"""
query(
    "export_records",
    lambda m: _export(m).records.select("run_id", "request_id", "split", "split_guard_key", "copies", "task_type", "evidence_level", "dataset_recipe_id", "dataset_snapshot_id"),
    f"SELECT run_id, request_id, split, split_guard_key, copies, task_type, CASE WHEN task_family IS NULL THEN NULL WHEN task_type IS NULL THEN 'E0' ELSE 'E1' END AS evidence_level, 'recipe.sft.v1' AS dataset_recipe_id, 'ds_fixed' AS dataset_snapshot_id FROM {_PLANNED}",
)
query(
    "export_distributions",
    lambda m: export.distributions(_export(m).records),
    " UNION ALL ".join(f"SELECT '{c}' AS name, {v} AS value, count(*) AS records FROM {_PLANNED} WHERE {w} GROUP BY value" for c, v, w in (*((c, c, f"{c} IS NOT NULL") for c in ("task_family", "task_type", "task_template_hash")), ("verifier_name", "'unit'", "task_family IS NOT NULL"), ("source_channel", "'captured'", "task_family IS NOT NULL"), ("split", "split", "true"))),
)
query("export_blockers", lambda m: _export(m, cohort={"cohort_id": "c", "expected_use": "evaluation", "review_required": True}).blockers, f"SELECT 0 AS place, run_id, 'run ' || run_id || ' missing E1 annotations: task_type' AS blocker FROM {_FIELDS_SQL} WHERE task_family IS NOT NULL AND task_type IS NULL UNION ALL SELECT 2, NULL, 'cohort has pending review queue items' UNION ALL SELECT 3, NULL, 'cohort expected_use=evaluation is not exportable as a training dataset snapshot'")


def _frozen(m: Model) -> DataFrame:
    """Cohorts by task family as frozen: the first has frozen ids, the others what was there at their newest member's end."""
    members = m.members.select("cohort_id", "run_id", "session_id", F.when(F.col("cohort_id") == "cohort_family_0", F.array("artifact_id")).alias("frozen_artifact_ids"))
    made = m.members.groupBy("cohort_id").agg(F.max("latest_ts").alias("created_at"))
    return scope.cohort_artifacts(members, made, m.facts, m.branches, m.artifacts.select("artifact_id", "run_id", "session_id", "target_ref", "created_at", "artifact_type"))


query(
    "frozen_cohort_artifacts",
    lambda m: _frozen(m).select("cohort_id", "artifact_id", "artifact_type"),
    """SELECT DISTINCT cohort_id, artifact_id, artifact_type FROM members JOIN artifacts USING (artifact_id) WHERE cohort_id = 'cohort_family_0'
    UNION ALL SELECT c.cohort_id, a.artifact_id, a.artifact_type FROM (SELECT cohort_id, max(latest_ts) AS made FROM members WHERE cohort_id <> 'cohort_family_0' GROUP BY cohort_id) c JOIN artifacts a ON a.created_at <= c.made
    WHERE (c.cohort_id, a.session_id) IN (SELECT (cohort_id, session_id) FROM members) AND ((c.cohort_id, a.run_id) IN (SELECT (cohort_id, run_id) FROM members)
        OR (starts_with(a.target_ref, 'run:') AND (c.cohort_id, substr(a.target_ref, 5)) IN (SELECT (cohort_id, run_id) FROM members)) OR starts_with(a.target_ref, 'session:') AND (c.cohort_id, substr(a.target_ref, 9)) IN (SELECT (cohort_id, session_id) FROM members)
        OR (starts_with(a.target_ref, 'fact:') AND (c.cohort_id, substr(a.target_ref, 6)) IN (SELECT (cohort_id, fact_id) FROM members JOIN facts USING (run_id))) OR (starts_with(a.target_ref, 'branch:') AND (c.cohort_id, substr(a.target_ref, 8)) IN (SELECT (cohort_id, branch_id) FROM members JOIN branches USING (run_id))))""",
)
query(
    "frozen_ids",
    lambda m: scope.frozen_ids(m.members, m.facts, m.branches, scans.live(m.artifacts), F.lit("2100-01-01").cast("timestamp")).select("run_id", F.array_join("frozen_artifact_ids", ",").alias("ids")),
    """SELECT m.run_id, string_agg(a.artifact_id, ',' ORDER BY a.artifact_id) AS ids FROM (SELECT DISTINCT run_id, session_id FROM members) m JOIN live a ON a.session_id = m.session_id
    WHERE CASE WHEN starts_with(a.target_ref, 'fact:') THEN (m.run_id, substr(a.target_ref, 6)) IN (SELECT (run_id, fact_id) FROM facts) WHEN starts_with(a.target_ref, 'branch:') THEN (m.run_id, substr(a.target_ref, 8)) IN (SELECT (run_id, branch_id) FROM branches)
        ELSE coalesce(a.run_id = m.run_id, false) OR a.target_ref = 'run:' || m.run_id OR a.target_ref = 'session:' || m.session_id END GROUP BY m.run_id""",
)


# what users bring
def shared_words(answer: str, reference: str | None) -> dict:
    """A grader: the share of the reference's distinct words that the answer has; half of them pass."""
    wanted = set((reference or "").split())
    score = len(wanted & set(answer.split())) / len(wanted) if wanted else 0.0
    return {"pass": score >= 0.5, "score": score}


def longest_turns(turns: DataFrame, **_: DataFrame) -> DataFrame:
    """A builder: the longest answer of each conversation, as the run it came from."""
    said = turns.where("role = 'assistant'")
    return said.groupBy("conv_id").agg(F.max(F.struct(F.length("text").alias("n"), "turn")).alias("m")).select(F.concat_ws("_", F.lit("chat"), "conv_id", "m.turn").alias("run_id"), F.col("m.n").cast("long").alias("characters"))


query(
    "custom_grader",
    lambda m: records.sft(m.exchange_facts).select("run_id", plugins.grade_with("tracemill.plans.exchanges:shared_words", F.col("completion.content"), F.get("prompt", 0)["content"]).alias("g")).select("run_id", "g.passed", F.floor(F.col("g.score") * 1000 + 0.5).cast("long").alias("score")),
    f"""SELECT run_id, coalesce(s, 0) >= 0.5 AS passed, CAST(floor(coalesce(s, 0) * 1000 + 0.5) AS BIGINT) AS score FROM (SELECT run_id, len(list_intersect(a, b)) / nullif(len(b), 0) AS s
    FROM (SELECT run_id, list_distinct(regexp_extract_all(text, '\\S+')) AS a, list_distinct(regexp_extract_all(first, '\\S+')) AS b FROM {_EXCHANGES} JOIN (SELECT conv_id, arg_min(text, turn) AS first FROM conversations GROUP BY conv_id) USING (conv_id)))""",
)
query("custom_builder", lambda m: plugins.checked(plugins.load("tracemill.plans.exchanges:longest_turns"), ("run_id", "characters"))(turns=m.table("conversations")), "SELECT 'chat_' || conv_id || '_' || max(turn) FILTER (WHERE n = most) AS run_id, most AS characters FROM (SELECT conv_id, turn, length(text) AS n, max(length(text)) OVER (PARTITION BY conv_id) AS most FROM conversations WHERE role = 'assistant') GROUP BY conv_id, most")
