"""The derived tables of ``model`` as common table expressions, for SQL that gives the same rows."""

from __future__ import annotations

from tracemill.operators.artifacts import E1_FIELDS


def rounded(x: str, places: int = 4) -> str:
    """Half-up rounding by the formula of ``scalars.round_to``."""
    return f"(CAST(floor(CAST({x} AS DOUBLE) * 1e{places} + 0.5) AS BIGINT) / 1e{places})"


def _resolved() -> str:
    def side(kind: str) -> str:
        last = ", ".join(f"last({f} ORDER BY created_at, seq) FILTER (WHERE {f} IS NOT NULL) AS {f}" for f in E1_FIELDS)
        return f"(SELECT target_id, {last} FROM annotations WHERE status = 'active' AND target_kind = '{kind}' GROUP BY target_id)"

    fields = ", ".join(f"coalesce(r.{f}, s.{f}) AS {f}" for f in E1_FIELDS)
    missing = " + ".join(f"CAST(coalesce(r.{f}, s.{f}) IS NULL AS BIGINT)" for f in E1_FIELDS)
    return f"""SELECT *, missing = 0 AS ready FROM (SELECT u.run_id, u.session_id, {fields}, {missing} AS missing
        FROM (SELECT run_id, first(session_id ORDER BY ts, seq) AS session_id FROM facts GROUP BY run_id) u
        LEFT JOIN {side("session")} s ON s.target_id = u.session_id LEFT JOIN {side("run")} r ON r.target_id = u.run_id)"""


def _candidates() -> str:
    fields = ", ".join(f"coalesce(r.{f}, s.{f}) AS {f}" for f in E1_FIELDS)
    needed = " AND ".join(f"{f} IS NOT NULL" for f in ("task_family", "task_type", "task_template_hash", "task_instance_key", "verifier_score", "quality_confidence", "source_channel"))
    side = lambda kind: f"(SELECT a.* FROM annotations a JOIN live USING (artifact_id) WHERE a.target_kind = '{kind}')"
    return f"""SELECT * FROM (SELECT u.run_id, u.session_id, u.latest_ts, coalesce(r.artifact_id, s.artifact_id) AS artifact_id, coalesce(r.review_reason, s.review_reason) AS review_reason, {fields}
        FROM (SELECT run_id, min(session_id) AS session_id, max(ts) AS latest_ts FROM facts GROUP BY run_id) u
        LEFT JOIN {side("session")} s ON s.target_id = u.session_id LEFT JOIN {side("run")} r ON r.target_id = u.run_id) WHERE {needed}"""


#: Common table expressions by name, each after those that it reads.
TABLES = {
    "facts": """SELECT seq, fact_id, session_id, run_id, user_id, thread_id, task_id, ts, k, kind, actor,
        CASE WHEN kind <> 'request_started' THEN before END AS parent_ref,
        'req_' || replace(CASE WHEN kind = 'request_started' THEN fact_id ELSE before END, 'fact_', '') AS request_id,
        CASE WHEN kind = 'request_started' THEN CASE WHEN actor = 'model' THEN '/v1/chat/completions' ELSE '/tools/run' END END AS path,
        CAST(CASE WHEN kind = 'response_finished' THEN CASE WHEN k % 11 = 0 THEN 503 ELSE 200 END WHEN kind = 'error_raised' THEN 502 END AS BIGINT) AS status_code,
        latency AS latency_ms, CAST(floor(latency / 4) AS BIGINT) AS ttfb_ms,
        CASE WHEN kind = 'response_finished' AND k % 2 = 0 THEN latency - CAST(floor(latency / 4) AS BIGINT) END AS stream_ms,
        CASE WHEN kind <> 'semantic_event' THEN k * 7 END AS body_size,
        CASE WHEN kind = 'response_finished' THEN k % 4 END AS chunk_count,
        kind = 'response_finished' AND k % 2 = 0 AS streamed,
        CASE WHEN kind = 'request_started' THEN 'fp_' || (k % 3) END AS fingerprint,
        CASE WHEN kind = 'request_started' AND k % 23 = 0 THEN 'fallback' END AS hinted_type,
        CASE WHEN kind = 'request_started' AND (k % 23 = 0 OR k % 29 = 0) THEN before END AS hinted_parent,
        CASE WHEN kind = 'semantic_event' THEN (['retry_declared', 'branch_open_declared', 'branch_close_declared', 'fallback_declared'])[k % 4 + 1] END AS semantic_kind,
        CASE WHEN kind = 'semantic_event' AND k % 9 <> 0 THEN before END AS target_fact_id,
        CASE WHEN kind = 'semantic_event' AND k % 9 = 0 THEN 'req_' || replace(before, 'fact_', '') END AS target_request_id,
        CASE WHEN kind = 'semantic_event' AND k % 8 = 1 THEN 'br_named_' || (k % 3) END AS hint_branch_id,
        CASE WHEN kind = 'semantic_event' AND k % 4 = 1 THEN 'subagent' END AS hint_branch_type,
        CASE WHEN kind = 'semantic_event' AND k % 4 = 2 THEN CASE WHEN k % 3 = 0 THEN 'failed' ELSE 'succeeded' END END AS hint_status,
        CASE WHEN kind = 'semantic_event' AND k % 16 = 0 THEN 'br_main' END AS hint_parent_branch_id,
        CASE WHEN kind = 'semantic_event' AND k % 5 = 1 THEN before_that END AS hint_parent_fact_id,
        CASE WHEN kind = 'semantic_event' AND k % 5 = 2 THEN 'req_' || replace(before_that, 'fact_', '') END AS hint_parent_request_id,
        CASE WHEN k % 10 = 0 THEN 'imported' ELSE 'captured' END AS capture_source
        FROM (SELECT *, lag(before, 3) OVER (PARTITION BY run_id ORDER BY ts, seq) AS before_that FROM (SELECT *, CASE WHEN kind IN ('response_finished', 'error_raised') THEN measure END AS latency,
            last_value(CASE WHEN kind = 'request_started' THEN fact_id END IGNORE NULLS) OVER (PARTITION BY run_id ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
            FROM (SELECT event_id AS seq, 'fact_' || event_id AS fact_id, 'sess_' || user_id AS session_id,
                'run_' || user_id || '_' || CAST(floor((dayofyear(ts) - 1) / 7) AS BIGINT) AS run_id, ts, k,
                CASE WHEN event_type IN ('click', 'view') THEN 'request_started' WHEN event_type = 'purchase' AND k % 5 = 0 THEN 'response_chunk'
                    WHEN event_type = 'purchase' THEN 'response_finished' WHEN event_type = 'error' THEN 'error_raised' ELSE 'semantic_event' END AS kind,
                CASE WHEN event_type IN ('click', 'purchase') THEN 'model' WHEN event_type = 'view' THEN 'tool' WHEN event_type = 'error' THEN 'proxy' ELSE 'runtime' END AS actor,
                'user_' || user_id AS user_id, CAST(NULL AS VARCHAR) AS thread_id, 'task_' || (user_id % 10) AS task_id, CAST(floor(value * 10 + 0.5) AS BIGINT) AS measure
                FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events))))""",
    "artifacts": """SELECT seq, 'art_' || seq AS artifact_id,
        CASE WHEN note THEN 'annotation' WHEN turn IN (2, 3) THEN 'score' WHEN turn = 4 THEN 'preference' WHEN turn = 5 THEN 'binary_label' ELSE 'note' END AS artifact_type,
        CASE WHEN turn = 1 THEN 'session:' || session_id WHEN turn = 2 THEN 'fact:' || coalesce(parent_ref, fact_id) WHEN turn = 5 THEN 'branch:br_main' ELSE 'run:' || run_id END AS target_ref,
        CASE WHEN k % 4 = 0 THEN 'human_reviewer' ELSE 'judge' END AS producer, 'v1' AS version, session_id, CASE WHEN turn <> 1 THEN run_id END AS run_id, ts AS created_at,
        CASE WHEN seq % 10 = 0 AND k % 13 = 0 THEN 'superseded' ELSE 'active' END AS status, (k % 50) / 50.0 AS confidence,
        CASE WHEN k % 9 = 0 THEN 'art_' || (seq - 35) END AS supersedes_artifact_id,
        CASE WHEN note THEN 'family_' || (number % 3) END AS task_family,
        CASE WHEN note AND k % 15 <> 0 THEN CASE WHEN k % 12 = 0 THEN 'unknown' ELSE 'type_' || (number % 5) END END AS task_type,
        CASE WHEN note THEN 'tpl_' || (number % 11) END AS task_template_hash, CASE WHEN note AND k % 17 <> 0 THEN 'inst_' || (number % 29) END AS task_instance_key,
        CASE WHEN note THEN 'unit_tests' END AS verifier_name, CASE WHEN note THEN (k % 101) / 100.0 END AS verifier_score,
        CASE WHEN note AND k % 19 <> 0 THEN (100 - k % 101) / 100.0 END AS quality_confidence,
        CASE WHEN note THEN 'tx1' END AS taxonomy_version, CASE WHEN note THEN 'a1' END AS annotation_version,
        CASE WHEN note THEN CASE WHEN k % 10 = 0 THEN 'shadow' ELSE 'captured' END END AS source_channel,
        CASE WHEN note AND k % 14 = 0 THEN 'manual_check' END AS review_reason,
        CASE WHEN turn IN (2, 3) AND k % 6 <> 0 THEN (k % 101) / 100.0 END AS score,
        CASE WHEN turn = 5 OR (turn IN (2, 3) AND k % 6 = 0) THEN k % 2 = 0 END AS label,
        CASE WHEN turn = 4 THEN 'br_retry_' || (k % 3 + 1) END AS chosen_branch_id, CASE WHEN turn = 4 THEN 'br_main' END AS rejected_branch_id
        FROM (SELECT *, seq % 7 AS turn, seq % 7 IN (0, 1) AS note, CAST(replace(session_id, 'sess_', '') AS BIGINT) AS number FROM facts WHERE seq % 5 = 0)""",
    "live": """SELECT a.* FROM artifacts a WHERE status <> 'superseded' AND NOT EXISTS (SELECT 1 FROM artifacts n WHERE n.supersedes_artifact_id = a.artifact_id)""",
    "spans": """SELECT q.run_id, q.request_fact_id, q.session_id, q.request_id, q.seq, q.ts, q.actor, q.path, q.user_id, q.thread_id, q.task_id, q.fingerprint, q.hinted_type, q.hinted_parent, q.capture_source, q.request_body_size,
        CASE WHEN e.fact_id IS NOT NULL THEN 'failed' WHEN r.status_code >= 400 THEN 'failed' WHEN r.fact_id IS NOT NULL THEN 'succeeded' ELSE 'open' END AS outcome,
        coalesce(r.status_code, e.status_code) AS status_code, coalesce(nullif(r.latency_ms, 0), e.latency_ms) AS latency_ms, coalesce(nullif(r.ttfb_ms, 0), e.ttfb_ms) AS ttfb_ms, r.stream_ms,
        coalesce(nullif(r.body_size, 0), nullif(e.body_size, 0), 0) AS response_body_size, coalesce(nullif(r.chunk_count, 0), c.chunks, 0) AS chunk_count, coalesce(r.streamed, false) AS streamed, r.fact_id AS response_fact_id, e.fact_id AS error_fact_id
        FROM (SELECT *, fact_id AS request_fact_id, body_size AS request_body_size FROM facts WHERE kind = 'request_started') q
        LEFT JOIN (SELECT DISTINCT ON (run_id, parent_ref) * FROM facts WHERE kind = 'response_finished' AND parent_ref IS NOT NULL ORDER BY run_id, parent_ref, ts DESC, seq DESC) r ON r.run_id = q.run_id AND r.parent_ref = q.fact_id
        LEFT JOIN (SELECT DISTINCT ON (run_id, parent_ref) * FROM facts WHERE kind = 'error_raised' AND parent_ref IS NOT NULL ORDER BY run_id, parent_ref, ts DESC, seq DESC) e ON e.run_id = q.run_id AND e.parent_ref = q.fact_id
        LEFT JOIN (SELECT run_id, parent_ref, count(*) AS chunks FROM facts WHERE kind = 'response_chunk' GROUP BY ALL) c ON c.run_id = q.run_id AND c.parent_ref = q.fact_id""",
    "hints": """SELECT run_id, ts, seq, semantic_kind, target_fact_id, target_request_id, hint_branch_id, hint_status, hint_parent_branch_id, hint_parent_fact_id, hint_parent_request_id,
        coalesce(hint_branch_type, CASE semantic_kind WHEN 'retry_declared' THEN 'retry' WHEN 'fallback_declared' THEN 'fallback' WHEN 'subagent_declared' THEN 'subagent' END) AS hint_type FROM facts WHERE kind = 'semantic_event'""",
    "cases": """SELECT s.*, h.semantic_kind AS h_kind, h.hint_type, h.hint_branch_id, h.hint_status, h.hint_parent_branch_id, h.hint_parent_fact_id, h.hint_parent_request_id,
        CASE WHEN h.seq IS NOT NULL THEN 1 WHEN s.hinted_type IS NOT NULL THEN 2 WHEN s.hinted_parent IS NOT NULL THEN 3 ELSE 4 END AS which
        FROM spans s LEFT JOIN (SELECT DISTINCT ON (q.request_fact_id) q.request_fact_id, h.* FROM spans q JOIN hints h ON h.run_id = q.run_id AND (h.target_fact_id = q.request_fact_id OR h.target_request_id = q.request_id)
            WHERE semantic_kind <> 'branch_close_declared' AND hint_type IS NOT NULL ORDER BY q.request_fact_id, h.ts, h.seq) h ON h.request_fact_id = s.request_fact_id""",
    "named": """SELECT *, coalesce(opened, 'mainline') AS branch_type, CASE WHEN opened IS NULL THEN 'br_main' ELSE coalesce(hint_branch_id, 'br_' || opened || '_' || number) END AS branch_id
        FROM (SELECT *, CASE which WHEN 1 THEN hint_type WHEN 2 THEN hinted_type WHEN 3 THEN 'subagent' ELSE CASE WHEN retried IS NOT NULL THEN 'retry' END END AS opened,
            sum(CAST(which < 4 OR retried IS NOT NULL AS INT)) OVER (PARTITION BY run_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS number
            FROM (SELECT *, CASE WHEN which = 4 AND lag(outcome) OVER alike = 'failed' THEN lag(request_fact_id) OVER alike END AS retried FROM cases
                WINDOW alike AS (PARTITION BY run_id, which = 4, actor, path, user_id, thread_id, task_id, fingerprint ORDER BY ts, seq)))""",
    "assigned": """SELECT n.*, CASE WHEN n.branch_type <> 'mainline' THEN coalesce(n.hint_parent_branch_id, CASE WHEN p.ts < n.ts OR (p.ts = n.ts AND p.seq < n.seq) THEN p.branch_id END,
            CASE WHEN n.which = 1 AND n.hint_parent_fact_id IS NULL THEN (SELECT last(o.branch_id ORDER BY o.ts, o.seq) FROM named o WHERE o.run_id = n.run_id AND o.request_id = n.hint_parent_request_id AND (o.ts < n.ts OR (o.ts = n.ts AND o.seq < n.seq))) END, 'br_main') END AS parent_branch_id
        FROM named n LEFT JOIN named p ON p.run_id = n.run_id AND p.request_fact_id = CASE WHEN n.which IN (2, 3) THEN n.hinted_parent WHEN n.which = 1 THEN n.hint_parent_fact_id ELSE n.retried END""",
    "branches": """SELECT a.run_id, a.session_id, a.branch_id, a.branch_type, a.parent_branch_id,
        CASE WHEN a.which = 1 THEN coalesce(f.hint_status, a.hint_status, a.ended) ELSE a.ended END AS status,
        CASE WHEN a.which = 1 THEN 'declared' ELSE 'inferred' END AS source,
        CASE a.which WHEN 1 THEN 'semantic:' || a.h_kind WHEN 2 THEN 'hinted_branch_type' WHEN 3 THEN 'parent_request:' || a.hinted_parent ELSE 'retry_after:' || a.retried END AS open_reason, a.seq AS opened_seq
        FROM (SELECT *, CASE WHEN outcome = 'succeeded' THEN 'succeeded' ELSE 'failed' END AS ended FROM assigned WHERE branch_type <> 'mainline') a
        LEFT JOIN (SELECT DISTINCT ON (o.request_fact_id) o.request_fact_id, c.* FROM assigned o JOIN hints c ON c.run_id = o.run_id AND (c.target_fact_id = o.request_fact_id OR c.hint_branch_id = o.branch_id OR c.target_request_id = o.request_id)
            WHERE c.semantic_kind = 'branch_close_declared' ORDER BY o.request_fact_id, c.ts, c.seq) f ON f.request_fact_id = a.request_fact_id
        UNION ALL SELECT run_id, min(session_id), 'br_main', 'mainline', NULL, CASE WHEN bool_and(outcome = 'succeeded') THEN 'succeeded' WHEN bool_or(outcome = 'failed') THEN 'failed' ELSE 'open' END, 'inferred', 'run_start', min(seq) FROM assigned GROUP BY run_id""",
    "pairs": """SELECT DISTINCT * FROM (
        SELECT c.run_id, CASE WHEN c.status = 'succeeded' THEN c.branch_id ELSE p.branch_id END AS chosen, CASE WHEN c.status = 'succeeded' THEN p.branch_id ELSE c.branch_id END AS rejected, 'parent_child_outcome' AS source
        FROM branches c JOIN branches p ON p.run_id = c.run_id AND p.branch_id = c.parent_branch_id WHERE (c.status, p.status) IN (('succeeded', 'failed'), ('failed', 'succeeded'))
        UNION ALL SELECT g.run_id, g.branch_id, b.branch_id, 'sibling_outcome' FROM branches g JOIN branches b ON b.run_id = g.run_id AND b.parent_branch_id = g.parent_branch_id WHERE g.status = 'succeeded' AND b.status = 'failed') WHERE chosen <> rejected""",
    "annotations": f"""SELECT artifact_id, seq, created_at, status, supersedes_artifact_id, review_reason, producer, {", ".join(E1_FIELDS)},
        CASE WHEN split_part(target_ref, ':', 1) IN ('run', 'session') THEN split_part(target_ref, ':', 1) WHEN run_id IS NOT NULL THEN 'run' ELSE 'session' END AS target_kind,
        CASE WHEN split_part(target_ref, ':', 1) IN ('run', 'session') THEN split_part(target_ref, ':', 2) ELSE coalesce(run_id, session_id) END AS target_id
        FROM artifacts WHERE artifact_type = 'annotation'""",
    "fields": _resolved(),
    "candidates": _candidates(),
    "records": """SELECT artifact_id, unit, target, run_id, reward FROM (
        SELECT artifact_id, split_part(target_ref, ':', 1) AS unit, substr(target_ref, strpos(target_ref, ':') + 1) AS target, run_id AS own_run, session_id, coalesce(score, CASE WHEN label THEN 1.0 WHEN NOT label THEN 0.0 END) AS reward
        FROM artifacts WHERE artifact_type IN ('score', 'reward', 'binary_label', 'label') AND status = 'active') a
        JOIN (SELECT 'fact' AS unit, fact_id AS target, run_id FROM facts UNION ALL SELECT DISTINCT 'branch', branch_id, run_id FROM branches UNION ALL SELECT DISTINCT 'run', run_id, run_id FROM facts UNION ALL SELECT DISTINCT 'session', session_id, NULL FROM facts) t
        USING (unit, target) WHERE reward IS NOT NULL AND (unit <> 'branch' OR own_run = t.run_id)""",
    "feedback": """SELECT run_id, 'superseded_annotation' AS reason FROM artifacts WHERE artifact_type = 'annotation' AND run_id IS NOT NULL AND status = 'superseded'""",
    "evidence": """SELECT f.run_id, f.session_id, coalesce(s.signals, 0) AS signals, CASE WHEN f.ready AND coalesce(s.completed, false) AND s.signals >= 2 THEN 'E2' WHEN f.ready THEN 'E1' ELSE 'E0' END AS level
        FROM fields f LEFT JOIN (SELECT run_id, count(DISTINCT semantic_kind) AS signals, bool_or(semantic_kind = 'branch_open_declared') AS completed FROM facts
            WHERE semantic_kind IN ('task_opened', 'route_decided', 'retry_declared', 'fallback_declared', 'branch_opened', 'task_completed', 'verifier_completed', 'human_review_requested', 'branch_open_declared') GROUP BY run_id) s USING (run_id)""",
    "workflow": """SELECT run_id, session_id, level, CASE WHEN coalesce(requests, 0) = 0 OR open > 0 THEN 'capture' WHEN level = 'E0' THEN 'annotate' WHEN review THEN 'review' WHEN level = 'E2' AND ready THEN 'evaluate' WHEN ready THEN 'dataset' ELSE 'augment' END AS stage,
        CASE WHEN feedback > 0 THEN 'feedback' WHEN review THEN 'review' ELSE 'clean' END AS review_status, feedback, coalesce(open, 0) AS open
        FROM (SELECT e.*, s.requests, s.open, coalesce(q.n, 0) AS feedback, r.run_id IS NOT NULL AS ready, coalesce(q.n, 0) > 0 OR coalesce(f.quality_confidence < 0.8, false) OR coalesce(f.verifier_score < 0.8, false) AS review
            FROM evidence e JOIN fields f USING (run_id) LEFT JOIN (SELECT run_id, count(*) AS requests, count(*) FILTER (WHERE outcome = 'open') AS open FROM spans GROUP BY run_id) s USING (run_id)
            LEFT JOIN (SELECT run_id, count(*) AS n FROM feedback GROUP BY run_id) q USING (run_id) LEFT JOIN (SELECT DISTINCT run_id FROM records WHERE run_id IS NOT NULL) r USING (run_id))""",
    "reviewed": """SELECT *, concat_ws(',', review_reason, CASE WHEN task_type IN ('unknown', 'new_subtype') THEN 'unresolved_task_type' END, CASE WHEN quality_confidence < 0.75 THEN 'low_quality_confidence' END,
        CASE WHEN verifier_score < 0.5 THEN 'low_verifier_score' END, CASE WHEN source_channel = 'shadow' THEN 'shadow_only_candidate' END) AS reasons FROM candidates""",
    "quota": """SELECT *, CASE WHEN row_number() OVER (PARTITION BY task_instance_key ORDER BY verifier_score DESC, quality_confidence DESC, run_id, artifact_id) > 1 THEN 'task_instance_quota' END AS held FROM candidates""",
    "scores": """SELECT run_id, last(reward ORDER BY created_at, seq) FILTER (WHERE reward IS NOT NULL) AS score
        FROM (SELECT *, coalesce(score, CASE WHEN label THEN 1.0 WHEN NOT label THEN 0.0 END) AS reward FROM artifacts WHERE artifact_type = 'score' AND status = 'active' AND run_id IS NOT NULL) GROUP BY run_id""",
}
TABLES["slices"] = """SELECT 'slice.' || task_family || '.' || task_type || '.' || substr(sha1(task_family || '|' || task_type || '|' || coalesce(taxonomy_version, '')), 1, 8) AS slice_id, task_family, task_type, runs
        FROM (SELECT task_family, task_type, min(taxonomy_version) AS taxonomy_version, count(*) AS runs FROM fields WHERE task_family IS NOT NULL AND task_type IS NOT NULL GROUP BY ALL)"""
TABLES["members"] = """SELECT q.*, s.slice_id, 'cohort_' || q.task_family AS cohort_id FROM quota q JOIN slices s USING (task_family, task_type) WHERE held IS NULL"""


def nearest(x: str, percent: int) -> str:
    return f"list_sort(list({x}))[CAST(round_even((count({x}) - 1) * {percent / 100}, 0) AS BIGINT) + 1]"


TABLES["scorecard"] = f"""SELECT m.*, l.p95_latency_ms FROM (SELECT f.task_family, count(*) AS runs,
        {rounded("CAST(sum(CAST(floor(c.score * 100 + 0.5) AS BIGINT)) AS DOUBLE) / count(c.score) / 100")} AS mean_score,
        {rounded("CAST(sum(CAST(floor(f.verifier_score * 100 + 0.5) AS BIGINT)) AS DOUBLE) / count(f.verifier_score) / 100")} AS mean_verifier,
        {rounded("count(*) FILTER (WHERE b.fell_back) / count(*)")} AS fallback_rate
        FROM (SELECT DISTINCT run_id FROM spans) s JOIN fields f USING (run_id) LEFT JOIN scores c USING (run_id) JOIN (SELECT run_id, bool_or(branch_type = 'fallback') AS fell_back FROM branches GROUP BY run_id) b USING (run_id)
        WHERE f.task_family IS NOT NULL GROUP BY f.task_family) m
        LEFT JOIN (SELECT task_family, {nearest("s.latency_ms", 95)} AS p95_latency_ms FROM spans s JOIN fields USING (run_id) WHERE s.latency_ms IS NOT NULL AND task_family IS NOT NULL GROUP BY task_family) l USING (task_family)"""


def sql(body: str) -> str:
    """``body`` with the expressions that it reads, directly or through others, before it."""
    import re

    used: list[str] = []
    text = body
    for name in reversed(TABLES):
        if re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", text):
            used.insert(0, name)
            text += "\n" + TABLES[name]
    return ("WITH " + ",\n".join(f"{n} AS MATERIALIZED ({TABLES[n]})" for n in used) + "\n" + body) if used else body
