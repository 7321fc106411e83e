"""All registered queries with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.functions import scalars
from tracemill.operators import artifacts, branches, builders, curation, dashboard, dataset, evaluation, scans, spans
from tracemill.plans.model import Model
from tracemill.plans.oracle import nearest, rounded, sql

FLAGSHIP = "session_inspect_summary"
QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(name: str, build: Callable[[Model], DataFrame], body: str | None) -> None:
    """Register ``build``, of the model of a folder, with its SQL."""
    QUERIES[name] = lambda spark, folder: build(Model.of(spark, folder))
    if body:
        ORACLE_SQL[name] = sql(body)


def _no_time(df: DataFrame) -> DataFrame:
    return df.drop("ts", "created_at", "latest_ts", "latest")


SPAN_COLUMNS = "run_id, request_fact_id, session_id, request_id, seq, actor, path, user_id, thread_id, task_id, fingerprint, hinted_type, hinted_parent, capture_source, request_body_size, outcome, status_code, latency_ms, ttfb_ms, stream_ms, response_body_size, chunk_count, streamed, response_fact_id, error_fact_id"
CANDIDATE_COLUMNS = ("run_id", "session_id", "artifact_id", "review_reason", *artifacts.E1_FIELDS)
_E1 = ", ".join(artifacts.E1_FIELDS)

# scans
query("facts", lambda m: _no_time(m.facts), "SELECT * EXCLUDE (ts) FROM facts")
query("artifacts", lambda m: _no_time(m.artifacts), "SELECT * EXCLUDE (created_at) FROM artifacts")
query("list_facts_of_task", lambda m: scans.list_facts(m.facts, task_id="task_3", kind="error_raised").select("fact_id", "run_id", "status_code", "latency_ms"), "SELECT fact_id, run_id, status_code, latency_ms FROM facts WHERE task_id = 'task_3' AND kind = 'error_raised'")
query("list_latest_artifacts", lambda m: scans.list_artifacts(m.artifacts, latest_only=True, artifact_type="score").select("artifact_id", "run_id", "score", "label"), "SELECT artifact_id, run_id, score, label FROM live WHERE artifact_type = 'score'")
query("latest_ids", lambda m: scans.latest_ids(m.facts), "SELECT last(session_id ORDER BY ts, seq) AS session_id, last(run_id ORDER BY ts, seq) AS run_id, last(request_id ORDER BY ts, seq) FILTER (WHERE request_id IS NOT NULL) AS request_id FROM facts")
for _by in ("session_id", "run_id"):
    query(f"recency_by_{_by[:-3]}", lambda m, by=_by: _no_time(scans.recency(m.facts, by)), f"SELECT {_by}, count(*) AS facts, max(seq) AS last_seq, first(session_id ORDER BY ts, seq) AS first_session FROM facts GROUP BY {_by}")
query("request_fact", lambda m: scans.request_fact(m.facts), "SELECT session_id, run_id, request_id, first(fact_id ORDER BY ts, seq) AS fact_id FROM facts WHERE kind = 'request_started' GROUP BY ALL")
query("resolve_target", lambda m: scans.resolve_target(m.facts), "SELECT session_id, last(fact_id ORDER BY actor = 'model', ts, seq) AS fact_id FROM facts WHERE kind = 'response_finished' GROUP BY session_id")
query(
    "session_owners",
    lambda m: scans.session_owners(m.facts.select(F.col("task_id").alias("session_id"), F.col("user_id").alias("owner_key"), "ts", "seq")),
    "SELECT f.task_id AS session_id, o.owner_key, count(*) FILTER (WHERE f.user_id <> o.owner_key) AS conflicts FROM facts f JOIN (SELECT task_id, first(user_id ORDER BY ts, seq) AS owner_key FROM facts GROUP BY task_id) o USING (task_id) GROUP BY ALL",
)
query(
    "orphan_payloads",
    lambda m: scans.orphan_payloads(m.table("pages").select(F.concat(F.lit("p/"), "page_id").alias("relative_path"), F.timestamp_seconds(F.col("page_id") % 500).alias("modified")), m.table("documents").select(F.concat(F.lit("p/"), F.col("doc_id") * 3).alias("relative_path")), F.timestamp_seconds(F.lit(500))).select("relative_path"),
    "SELECT 'p/' || page_id AS relative_path FROM pages WHERE page_id % 500 < 200 AND page_id NOT IN (SELECT doc_id * 3 FROM documents)",
)


# sinks, as the rows that they leave
def _slices(m: Model, half: int) -> DataFrame:
    return m.artifacts.where(f"artifact_type = 'annotation' and task_type is not null and seq % 2 = {half}").groupBy("task_type").agg(F.min("seq").alias("created_at"), F.max("verifier_score").alias("best"))


_SLICES = "SELECT task_type, min(seq) AS created_at, max(verifier_score) AS best FROM artifacts WHERE artifact_type = 'annotation' AND task_type IS NOT NULL AND seq % 2 = {} GROUP BY task_type"
query("upsert_slices", lambda m: scans.upsert(_slices(m, 0), _slices(m, 1), "task_type"), f"SELECT task_type, coalesce(o.created_at, n.created_at) AS created_at, CASE WHEN n.task_type IS NOT NULL THEN n.best ELSE o.best END AS best FROM ({_SLICES.format(0)}) o FULL JOIN ({_SLICES.format(1)}) n USING (task_type)")
query(
    "unique_new_artifacts",
    lambda m: scans.unique_new(m.artifacts.where("seq % 2 = 0"), m.artifacts.where("seq % 2 = 1"), "artifact_type", "task_type", "score", "label").select("artifact_id", "artifact_type", "task_type", "score", "label"),
    "SELECT first(artifact_id ORDER BY created_at, seq) AS artifact_id, artifact_type, task_type, score, label FROM artifacts n WHERE seq % 2 = 1 AND NOT EXISTS (SELECT 1 FROM artifacts o WHERE o.seq % 2 = 0 AND o.artifact_type IS NOT DISTINCT FROM n.artifact_type AND o.task_type IS NOT DISTINCT FROM n.task_type AND o.score IS NOT DISTINCT FROM n.score AND o.label IS NOT DISTINCT FROM n.label) GROUP BY artifact_type, task_type, score, label",
)
query(
    "feedback_status",
    lambda m: evaluation.feedback_status(m.artifacts.where("run_id is not null").select("run_id", F.col("artifact_type").alias("reason"), F.when(F.col("seq") % 15 == 0, "resolved").when(F.col("seq") % 10 == 0, "reviewed").otherwise("queued").alias("status"), F.col("created_at").alias("ts"), "seq")),
    "SELECT run_id, artifact_type AS reason, last(CASE WHEN seq % 15 = 0 THEN 'resolved' WHEN seq % 10 = 0 THEN 'reviewed' ELSE 'queued' END ORDER BY created_at, seq) AS status, count(*) AS events FROM artifacts WHERE run_id IS NOT NULL GROUP BY run_id, artifact_type",
)

# request spans, branches and pairs
query("request_spans", lambda m: _no_time(m.spans), f"SELECT {SPAN_COLUMNS} FROM spans")
query(
    "session_inspect_summary",
    lambda m: spans.session_summary(m.facts, m.spans, m.branches, m.artifacts),
    f"""SELECT f.session_id, f.facts, f.runs, f.users, coalesce(requests, 0) AS requests, coalesce(succeeded, 0) AS succeeded, coalesce(failed, 0) AS failed, coalesce(open, 0) AS open, coalesce(streamed, 0) AS streamed,
    CAST(coalesce(request_bytes, 0) AS BIGINT) AS request_bytes, CAST(coalesce(response_bytes, 0) AS BIGINT) AS response_bytes, avg_latency_ms, coalesce(b.branches, 0) AS branches, coalesce(declared, 0) AS declared, coalesce(inferred, 0) AS inferred, coalesce(a.artifacts, 0) AS artifacts, coalesce(active_artifacts, 0) AS active_artifacts
    FROM (SELECT session_id, count(*) AS facts, count(DISTINCT run_id) AS runs, count(DISTINCT user_id) AS users FROM facts GROUP BY session_id) f
    LEFT JOIN (SELECT session_id, count(*) AS requests, count(*) FILTER (WHERE outcome = 'succeeded') AS succeeded, count(*) FILTER (WHERE outcome = 'failed') AS failed, count(*) FILTER (WHERE outcome = 'open') AS open, count(*) FILTER (WHERE streamed) AS streamed, sum(request_body_size) AS request_bytes, sum(response_body_size) AS response_bytes,
        {rounded("CAST(sum(latency_ms) AS DOUBLE) / count(latency_ms)", 1)} AS avg_latency_ms FROM spans GROUP BY session_id) s USING (session_id)
    LEFT JOIN (SELECT session_id, count(*) AS branches, count(*) FILTER (WHERE source = 'declared') AS declared, count(*) FILTER (WHERE source = 'inferred') AS inferred FROM branches GROUP BY session_id) b USING (session_id)
    LEFT JOIN (SELECT session_id, count(*) AS artifacts, count(*) FILTER (WHERE status = 'active') AS active_artifacts FROM artifacts GROUP BY session_id) a USING (session_id)""",
)
query("replay", lambda m: spans.replay(m.spans).withColumn("number", F.col("number").cast("long")), "SELECT session_id, request_id, actor, outcome, row_number() OVER (PARTITION BY session_id ORDER BY ts, seq) AS number FROM spans")
query("chunk_facts", lambda m: spans.chunk_facts(m.facts, cap=2), "SELECT run_id, parent_ref, least(count(*), 2) AS stored, greatest(count(*) - 2, 0) AS omitted FROM facts WHERE kind = 'response_chunk' AND parent_ref IS NOT NULL GROUP BY run_id, parent_ref")
query("branches", lambda m: m.branches, "SELECT * FROM branches")
query("branch_assignment", lambda m: m.assigned.select("run_id", "request_fact_id", "branch_id", "branch_type", "parent_branch_id"), "SELECT run_id, request_fact_id, branch_id, branch_type, parent_branch_id FROM assigned")
query("branch_inspect_summaries", lambda m: branches.branch_summaries(m.assigned), "SELECT run_id, branch_id, count(*) AS requests, count(*) FILTER (WHERE outcome = 'succeeded') AS succeeded, count(*) FILTER (WHERE outcome = 'failed') AS failed, count(*) FILTER (WHERE outcome = 'open') AS open, string_agg(request_id, ',' ORDER BY seq) AS request_ids FROM assigned GROUP BY run_id, branch_id")
query("branch_pairs", lambda m: m.pairs, "SELECT * FROM pairs")

# supervision
query("annotation_index", lambda m: _no_time(artifacts.annotation_index(m.artifacts)), "SELECT * EXCLUDE (created_at) FROM annotations")
query("resolve_e1", lambda m: m.fields, f"SELECT run_id, session_id, {_E1}, missing, ready FROM fields")
query("e1_candidates", lambda m: artifacts.candidates(m.facts, m.artifacts, min_quality=0.4, min_verifier=0.2).select(*CANDIDATE_COLUMNS), f"SELECT {', '.join(CANDIDATE_COLUMNS)} FROM candidates WHERE quality_confidence >= 0.4 AND verifier_score >= 0.2")
query(
    "bootstrap_e1",
    lambda m: artifacts.bootstrap_e1(m.facts, m.spans, m.branches),
    f"""SELECT run_id, CASE WHEN closed > 0 THEN {rounded("succeeded / closed", 3)} ELSE 0e0 END AS verifier_score, CASE WHEN closed > 0 THEN 0.65e0 ELSE 0.5e0 END AS quality_confidence,
    CASE WHEN requests <= 1 AND n <= 1 THEN 'low' WHEN requests <= 3 AND n <= 2 THEN 'medium' ELSE 'high' END AS difficulty, CASE WHEN sources = 1 THEN source ELSE 'mixed' END AS source_channel, coalesce(sha256(fingerprint), 'unknown') AS task_template_hash
    FROM (SELECT run_id, count(*) FILTER (WHERE outcome <> 'open') AS closed, count(*) FILTER (WHERE outcome = 'succeeded') AS succeeded, count(*) AS requests, first(fingerprint ORDER BY ts, seq) AS fingerprint FROM spans GROUP BY run_id)
    JOIN (SELECT run_id, count(*) AS n FROM branches GROUP BY run_id) USING (run_id) JOIN (SELECT run_id, count(DISTINCT capture_source) AS sources, min(capture_source) AS source FROM facts GROUP BY run_id) USING (run_id)""",
)
query("request_overlays", lambda m: artifacts.request_overlays(m.spans, m.artifacts), "SELECT DISTINCT s.run_id, s.request_fact_id, a.artifact_id, a.artifact_type FROM spans s JOIN artifacts a ON a.target_ref IN ('fact:' || s.request_fact_id, 'fact:' || s.response_fact_id, 'fact:' || s.error_fact_id)")
query(
    "branch_overlays",
    lambda m: artifacts.branch_overlays(m.branches, m.artifacts),
    "SELECT DISTINCT b.run_id, b.branch_id, a.artifact_id, a.artifact_type FROM branches b JOIN artifacts a ON (a.run_id IS NULL OR a.run_id = b.run_id) AND (a.target_ref = 'branch:' || b.branch_id OR a.chosen_branch_id = b.branch_id OR a.rejected_branch_id = b.branch_id)",
)
for _scope in ("run", "session"):
    query(f"{_scope}_overlays", lambda m, scope=_scope: artifacts.scope_overlays(m.facts, m.artifacts, scope), f"SELECT substr(target_ref, {len(_scope) + 2}) AS {_scope}_id, artifact_type, count(*) AS artifacts FROM artifacts WHERE starts_with(target_ref, '{_scope}:') GROUP BY ALL")
query("template_scores", lambda m: artifacts.template_scores(m.spans), "SELECT 'fact:' || coalesce(response_fact_id, error_fact_id) AS target_ref, run_id, CASE WHEN outcome = 'succeeded' THEN 1e0 ELSE 0e0 END AS score, 0.8e0 AS confidence FROM spans WHERE outcome <> 'open'")
query("template_preferences", lambda m: artifacts.template_preferences(m.pairs), "SELECT 'run:' || run_id AS target_ref, run_id, chosen AS chosen_branch_id, rejected AS rejected_branch_id, source, 0.7e0 AS confidence FROM pairs")

# builders and export
query("sft_records", lambda m: builders.sft(m.facts), "SELECT q.fact_id AS request_fact_id, q.run_id, q.session_id, q.request_id, q.path, q.fingerprint, r.fact_id AS response_fact_id, r.status_code FROM facts q JOIN facts r ON r.parent_ref = q.fact_id WHERE q.kind = 'request_started' AND q.actor = 'model' AND r.kind = 'response_finished' AND r.actor = 'model'")
query(
    "sft_conversations",
    lambda m: builders.sft_conversations(m.table("conversations")),
    "SELECT conv_id, turn, messages, prompt, text AS completion FROM (SELECT *, count(*) OVER w AS messages, string_agg(role || ': ' || text, chr(10)) OVER w AS prompt FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) WHERE role = 'assistant' AND messages > 0",
)
query(
    "preference_records",
    lambda m: builders.preference(m.branches, m.artifacts, m.pairs),
    "SELECT a.run_id, a.chosen_branch_id AS chosen, a.rejected_branch_id AS rejected, 'artifact' AS source, a.artifact_id FROM artifacts a WHERE a.artifact_type = 'preference' AND a.status = 'active' AND a.chosen_branch_id <> a.rejected_branch_id AND (a.run_id, a.chosen_branch_id) IN (SELECT run_id, branch_id FROM branches) AND (a.run_id, a.rejected_branch_id) IN (SELECT run_id, branch_id FROM branches)",
)
query("binary_rl_records", lambda m: m.records, "SELECT * FROM records")
query("run_trajectories", lambda m: builders.run_trajectories(m.spans).select("run_id", F.array_join(F.transform("steps", lambda s: F.concat_ws(":", s["request_id"], s["actor"], s["outcome"])), ",").alias("steps")), "SELECT run_id, string_agg(request_id || ':' || actor || ':' || outcome, ',' ORDER BY seq) AS steps FROM spans GROUP BY run_id")
query("first_and_last", lambda m: builders.first_and_last(m.spans), "SELECT run_id, first(fingerprint ORDER BY ts, seq) FILTER (WHERE fingerprint IS NOT NULL) AS first_prompt, last(request_id ORDER BY ts, seq) FILTER (WHERE outcome <> 'open') AS terminal_request FROM spans GROUP BY run_id")
query("dedupe_keep_first", lambda m: dataset.keep_first(m.table("documents").select("doc_id", "text", "source"), F.coalesce("text", F.lit("")), "doc_id").select("doc_id", "source", "copies"), "SELECT min(doc_id) AS doc_id, arg_min(source, doc_id) AS source, count(*) AS copies FROM documents GROUP BY sha256(coalesce(text, ''))")
query("hash_split", lambda m: dataset.split_by_hash(m.facts.select("fact_id", "run_id"), scalars.guard_key(run_id=F.col("run_id"))), "SELECT fact_id, run_id, CASE WHEN p < 80 THEN 'train' WHEN p < 90 THEN 'val' ELSE 'test' END AS split FROM (SELECT fact_id, run_id, CAST('0x' || substr(sha256('run_id:' || run_id), 1, 8) AS BIGINT) % 100 AS p FROM facts)")
query(
    "temporal_split",
    lambda m: dataset.split_by_time(m.candidates.withColumn("slice_id", scalars.slice_id(F.col("task_family"), F.col("task_type"), F.col("taxonomy_version"))), min_groups=4),
    """SELECT slice_id, task_type, task_instance_key, runs, CASE WHEN n >= 4 THEN CASE WHEN place <= n - 2 * tenth THEN 'train' WHEN place <= n - tenth THEN 'val' ELSE 'test' END WHEN p < 80 THEN 'train' WHEN p < 90 THEN 'val' ELSE 'test' END AS split, CASE WHEN n >= 4 THEN 'time_window' ELSE 'hash_fallback' END AS mode
    FROM (SELECT *, CAST(greatest(1, round_even(n * 0.1, 0)) AS BIGINT) AS tenth, CAST('0x' || substr(sha256(task_instance_key), 1, 8) AS BIGINT) % 100 AS p FROM (SELECT *, count(*) OVER (PARTITION BY slice_id, task_type) AS n, row_number() OVER (PARTITION BY slice_id, task_type ORDER BY latest, task_instance_key) AS place
        FROM (SELECT 'slice.' || task_family || '.' || task_type || '.' || substr(sha1(task_family || '|' || task_type || '|' || coalesce(taxonomy_version, '')), 1, 8) AS slice_id, task_type, task_instance_key, max(latest_ts) AS latest, count(*) AS runs FROM candidates GROUP BY ALL)))""",
)
query("distribution", lambda m: dataset.distribution(m.candidates, "task_type"), "SELECT task_type AS value, count(*) AS records FROM candidates WHERE task_type <> '' GROUP BY task_type")
query(
    "export_manifest",
    lambda m: dataset.manifest(dataset.split_by_hash(builders.sft(m.facts), F.col("run_id")), "sft"),
    "SELECT 'sft' AS builder, count(*) AS records, count(DISTINCT run_id) AS runs, count(DISTINCT session_id) AS sessions, count(*) FILTER (WHERE p < 80) AS train, count(*) FILTER (WHERE p >= 80 AND p < 90) AS val, count(*) FILTER (WHERE p >= 90) AS test FROM (SELECT q.run_id, q.session_id, CAST('0x' || substr(sha256(q.run_id), 1, 8) AS BIGINT) % 100 AS p FROM facts q JOIN facts r ON r.parent_ref = q.fact_id WHERE q.kind = 'request_started' AND q.actor = 'model' AND r.kind = 'response_finished' AND r.actor = 'model')",
)
query("comparison_records", lambda m: dataset.comparison_records(m.pairs, 10), "SELECT run_id, part, unnest([chosen, rejected]) AS a, unnest([rejected, chosen]) AS b, unnest(['A', 'B']) AS label FROM (SELECT *, CASE WHEN row_number() OVER (ORDER BY run_id, chosen, rejected, source) <= 10 THEN 'test' ELSE 'train' END AS part FROM pairs)")

# curation
query("review_reasons", lambda m: curation.review_reasons(m.candidates).select("run_id", "artifact_id", F.array_join("reasons", ",").alias("reasons")), "SELECT run_id, artifact_id, reasons FROM reviewed")
query("cluster_quota", lambda m: curation.quotas(m.candidates).select("run_id", "artifact_id", "holdout_reason"), "SELECT run_id, artifact_id, held AS holdout_reason FROM quota")
query(
    "holdout_tail",
    lambda m: curation.holdout(curation.quotas(m.candidates), 0.34).select("run_id", "artifact_id", "holdout_reason"),
    """SELECT run_id, artifact_id, coalesce(held, CASE WHEN (latest_ts, run_id, artifact_id) >= (SELECT (latest_ts, run_id, artifact_id) FROM (SELECT *, row_number() OVER (ORDER BY latest_ts DESC, run_id DESC, artifact_id DESC) AS place, count(*) OVER () AS n FROM quota WHERE held IS NULL) WHERE place = least(n - 1, greatest(1, CAST(round_even(n * 0.34, 0) AS BIGINT)))) THEN 'holdout_fraction' END) AS holdout_reason FROM quota""",
)
query(
    "freeze_cohort",
    lambda m: curation.freeze(m.candidates),
    f"SELECT task_type, count(*) AS members, count(DISTINCT task_instance_key) AS instances, count(DISTINCT task_template_hash) AS templates, min(quality_confidence) AS min_quality, max(quality_confidence) AS max_quality, {rounded('CAST(sum(CAST(floor(quality_confidence * 100 + 0.5) AS BIGINT)) AS DOUBLE) / count(*) / 100')} AS avg_quality, min(verifier_score) AS min_verifier, max(verifier_score) AS max_verifier FROM candidates GROUP BY task_type",
)

# evaluation
query("run_scores", lambda m: evaluation.run_scores(m.artifacts), "SELECT * FROM scores")
query("scorecard", lambda m: evaluation.scorecard(m.spans, evaluation.run_scores(m.artifacts), m.fields, m.branches), "SELECT * FROM scorecard")


def _verdicts(m: Model) -> DataFrame:
    metrics = evaluation.scorecard(m.spans, evaluation.run_scores(m.artifacts), m.fields, m.branches)
    decided = metrics.withColumn("verdict", evaluation.verdict(metrics, [("mean_score", "gte", 0.4), ("p95_latency_ms", "lte", 5000), ("fallback_rate", "lte", 0.2)]))
    return decided.select("task_family", "verdict", evaluation.promotion(F.col("verdict")).alias("decision"))


query("promotion_decisions", _verdicts, "SELECT task_family, verdict, CASE verdict WHEN 'pass' THEN 'promote' WHEN 'hold' THEN 'hold' ELSE 'rollback' END AS decision FROM (SELECT task_family, CASE WHEN mean_score IS NULL OR mean_score < 0.4 OR p95_latency_ms IS NULL OR p95_latency_ms > 5000 OR fallback_rate IS NULL OR fallback_rate > 0.2 THEN 'fail' ELSE 'pass' END AS verdict FROM scorecard)")
query("latency_percentiles", lambda m: evaluation.latency_percentiles(m.spans), f"SELECT actor, {nearest('latency_ms', 95)} AS nearest_rank, {rounded('quantile_cont(latency_ms, 0.95)', 3)} AS linear FROM spans WHERE latency_ms IS NOT NULL GROUP BY actor")
query(
    "train_eval_overlap",
    lambda m: evaluation.overlap(m.candidates.where("quality_confidence >= 0.5"), m.candidates.where("quality_confidence < 0.5"), "run_id", "task_instance_key", "task_template_hash"),
    " UNION ALL ".join(f"SELECT '{k}' AS key, count(*) AS shared FROM (SELECT {k} FROM candidates WHERE quality_confidence >= 0.5 INTERSECT SELECT {k} FROM candidates WHERE quality_confidence < 0.5)" for k in ("run_id", "task_instance_key", "task_template_hash")),
)


def _cases(m: Model) -> DataFrame:
    score = lambda x: (x % 101).cast("double")
    docs = m.table("documents").where("n_chars is not null").select("lang", score(F.col("n_chars")).alias("candidate_score"), score(F.col("doc_id") * 7).alias("baseline_score"))
    return docs.withColumns({"candidate_pass": F.col("candidate_score") >= 50, "baseline_pass": F.col("baseline_score") >= 50})


query(
    "compare_models",
    lambda m: evaluation.compare_models(_cases(m)),
    f"SELECT lang, count(*) AS cases, {rounded('count(*) FILTER (WHERE c >= 50) / count(*)')} AS candidate_pass_rate, {rounded('count(*) FILTER (WHERE b >= 50) / count(*)')} AS baseline_pass_rate, {rounded('sum(c) / count(*)', 2)} AS candidate_mean, {rounded('sum(b) / count(*)', 2)} AS baseline_mean, {rounded('count(*) FILTER (WHERE c >= b) / count(*)')} AS win_rate, {rounded('quantile_cont(c, 0.95)', 2)} AS candidate_p95 FROM (SELECT lang, CAST(n_chars % 101 AS DOUBLE) AS c, CAST((doc_id * 7) % 101 AS DOUBLE) AS b FROM documents WHERE n_chars IS NOT NULL) GROUP BY lang",
)
query(
    "new_feedback",
    lambda m: evaluation.new_feedback(curation.review_reasons(m.candidates), m.fields.where("verifier_score < 0.3").select("run_id", F.lit("low_verifier_score").alias("reason"), F.lit("queued").alias("status"))),
    "SELECT DISTINCT run_id, reason FROM (SELECT run_id, unnest(string_split(reasons, ',')) AS reason FROM reviewed WHERE reasons <> '') WHERE (run_id, reason) NOT IN (SELECT (run_id, 'low_verifier_score') FROM fields WHERE verifier_score < 0.3)",
)

# dashboards
_evidence = lambda m: dashboard.run_evidence(m.facts, m.fields, completed="branch_open_declared")
_workflow = lambda m: dashboard.workflow(m.spans, m.fields, _evidence(m), m.feedback, m.records)
query("run_evidence", _evidence, "SELECT * FROM evidence")
query("session_evidence", lambda m: dashboard.session_evidence(_evidence(m)), "SELECT session_id, min(level) AS level, count(*) AS runs FROM evidence GROUP BY session_id")
query("workflow_runs", _workflow, "SELECT * FROM workflow")
query(
    "dashboard_overview",
    lambda m: dashboard.overview(_workflow(m), m.spans),
    "SELECT * FROM (SELECT count(*) AS runs, count(DISTINCT session_id) AS sessions, count(*) FILTER (WHERE level >= 'E1') AS e1_runs, count(*) FILTER (WHERE level = 'E2') AS e2_runs, " + ", ".join(f"count(*) FILTER (WHERE stage = '{s}') AS {s}_runs" for s in ("capture", "annotate", "review", "evaluate", "dataset", "augment")) + " FROM workflow), (SELECT count(*) AS requests, count(*) FILTER (WHERE outcome = 'failed') AS failed, count(*) FILTER (WHERE outcome = 'open') AS open FROM spans)",
)
query("dataset_readiness", lambda m: dashboard.readiness({"facts": m.facts, "binary_rl": m.records, "pairs": m.pairs}), " UNION ALL ".join(f"SELECT '{n}' AS builder, count(*) AS records, count(DISTINCT run_id) AS runs FROM {t}" for n, t in (("facts", "facts"), ("binary_rl", "records"), ("pairs", "pairs"))))
query(
    "slice_coverage",
    lambda m: dashboard.slice_coverage(m.candidates, m.fields, m.feedback),
    f"""SELECT *, CASE WHEN share >= 0.5 THEN 'strong' WHEN share >= 0.2 THEN 'partial' ELSE 'thin' END AS level FROM (SELECT * , {rounded("candidates / runs")} AS coverage FROM (SELECT task_family, task_type, r.runs, coalesce(c.candidates, 0) AS candidates, coalesce(q.queued, 0) AS queued, coalesce(c.candidates, 0) / r.runs AS share
    FROM (SELECT task_family, task_type, count(*) AS runs FROM fields WHERE task_family IS NOT NULL AND task_type IS NOT NULL GROUP BY ALL) r LEFT JOIN (SELECT task_family, task_type, count(DISTINCT run_id) AS candidates FROM candidates GROUP BY ALL) c USING (task_family, task_type)
    LEFT JOIN (SELECT task_family, task_type, count(*) AS queued FROM (SELECT DISTINCT run_id FROM feedback) JOIN fields USING (run_id) GROUP BY ALL) q USING (task_family, task_type)))""".replace("SELECT *, CASE", "SELECT * EXCLUDE (share), CASE"),
)
query(
    "health_matrix",
    lambda m: dashboard.health(m.spans, m.fields, _evidence(m)),
    f"SELECT session_id, ready_share, evidence_share, closed_share FROM (SELECT session_id, {rounded('count(*) FILTER (WHERE ready) / count(*)')} AS ready_share FROM fields GROUP BY session_id) JOIN (SELECT session_id, {rounded("count(*) FILTER (WHERE level <> 'E0') / count(*)")} AS evidence_share FROM evidence GROUP BY session_id) USING (session_id) LEFT JOIN (SELECT session_id, {rounded("count(*) FILTER (WHERE outcome <> 'open') / count(*)")} AS closed_share FROM spans GROUP BY session_id) USING (session_id)",
)


def _lineage(m: Model) -> DataFrame:
    items = m.table("lineitem").withColumn("candidate_id", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    trained = items.select(F.col("l_orderkey").alias("request_id"), "candidate_id")
    return dashboard.lineage(m.table("orders").select(F.col("o_orderkey").alias("request_id")), trained, items.where("l_returnflag = 'R'").select("candidate_id"), items.where("l_linestatus = 'F' and l_quantity < 10").select("candidate_id"))


query(
    "training_lineage",
    _lineage,
    """SELECT *, CASE WHEN handoffs > 0 THEN 'handoff_ready' WHEN evaluations > 0 THEN 'evaluated' WHEN candidates > 0 THEN 'trained' ELSE 'requested' END AS stage FROM (SELECT o_orderkey AS request_id, coalesce(candidates, 0) AS candidates, CAST(coalesce(evaluations, 0) AS BIGINT) AS evaluations, CAST(coalesce(handoffs, 0) AS BIGINT) AS handoffs FROM orders LEFT JOIN (
    SELECT request_id, count(*) AS candidates, sum(coalesce(e.n, 0)) AS evaluations, sum(coalesce(h.n, 0)) AS handoffs FROM (SELECT l_orderkey AS request_id, l_orderkey * 10 + l_linenumber AS candidate_id FROM lineitem) c LEFT JOIN (SELECT l_orderkey * 10 + l_linenumber AS candidate_id, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) e USING (candidate_id)
    LEFT JOIN (SELECT l_orderkey * 10 + l_linenumber AS candidate_id, count(*) AS n FROM lineitem WHERE l_linestatus = 'F' AND l_quantity < 10 GROUP BY 1) h USING (candidate_id) GROUP BY request_id) ON request_id = o_orderkey)""",
)
query(
    "run_anomalies",
    lambda m: dashboard.anomalies(m.spans),
    f"SELECT run_id, concat_ws(',', CASE WHEN failed THEN 'failed_requests' END, CASE WHEN open THEN 'open_requests' END, CASE WHEN avg_latency_ms > 1000 THEN 'slow' END) AS anomalies, avg_latency_ms, last_outcome FROM (SELECT run_id, bool_or(outcome = 'failed') AS failed, bool_or(outcome = 'open') AS open, {rounded('CAST(sum(latency_ms) AS DOUBLE) / count(latency_ms)', 1)} AS avg_latency_ms, last(outcome ORDER BY ts, seq) AS last_outcome FROM spans GROUP BY run_id)",
)

# scalar functions
def _bounded(pattern: str) -> str:
    """For SQL: \\b as explicit classes. Signs that are no word characters come twice, so that neighbours share none."""
    core = pattern.replace(r"\b", "").replace("sk-", "sk--").replace(r"\s+", r"(?:\s\s)+").replace(r"[A-Za-z0-9._\-]{24,}", r"(?:[A-Za-z0-9_]|\.\.|--){23,}[A-Za-z0-9_]")
    return rf"(?:^|[^\pL\pN_]){core}(?:$|[^\pL\pN_])"


_SECRETS = {label: _bounded(pattern) for label, pattern in scalars.SECRET_PATTERNS if label != "private_key"}
_TWICE = r"regexp_replace(text, '([^\pL\pN_])', '\1\1', 'g')"
query(
    "secret_counts",
    lambda m: m.table("documents").select("doc_id", scalars.secret_counts(F.col("text")).alias("c")).select("doc_id", *(F.col(f"c.{n}").cast("long").alias(n) for n, _ in scalars.SECRET_PATTERNS)),
    f"SELECT doc_id, coalesce(len(regexp_extract_all(text, '{dict(scalars.SECRET_PATTERNS)['private_key']}')), 0) AS private_key, " + ", ".join(f"coalesce(len(regexp_extract_all({_TWICE}, '{p}')), 0) AS {n}" for n, p in _SECRETS.items()) + " FROM documents",
)
_FLAT = r"trim(regexp_replace({}, '[ \t\r\n]+', ' ', 'g'))"
query(
    "grade_answers",
    lambda m: m.table("benchmark").alias("a").join(m.table("benchmark").select((F.col("item_id") - 1).alias("item_id"), F.substring("text", 1, 3).alias("reference")), "item_id").select("item_id", scalars.exact_match(F.col("text"), F.col("reference")).alias("exact"), scalars.contains_reference(F.col("text"), F.col("reference")).alias("contained")),
    f"SELECT a.item_id, {_FLAT.format('a.text')} = {_FLAT.format('substr(b.text, 1, 3)')} AS exact, contains({_FLAT.format('a.text')}, {_FLAT.format('substr(b.text, 1, 3)')}) AS contained FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id + 1",
)
query("slugs", lambda m: m.table("part").select("p_partkey", scalars.slug(F.col("p_name")).alias("slug")), "SELECT p_partkey, coalesce(nullif(regexp_replace(regexp_replace(lower(coalesce(p_name, '')), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'unknown') AS slug FROM part")
query("shortened_text", lambda m: m.table("documents").where("text is not null").select("doc_id", scalars.shorten(F.col("text"), 72).alias("short")), r"SELECT doc_id, CASE WHEN length(flat) > 72 THEN rtrim(substr(flat, 1, 69), ' ') || '...' ELSE flat END AS short FROM (SELECT doc_id, trim(regexp_replace(text, '[ \t\r\n]+', ' ', 'g'), ' ') AS flat FROM documents WHERE text IS NOT NULL)")

from tracemill.plans import exchanges, governed  # noqa: E402, F401  (registers more queries)
