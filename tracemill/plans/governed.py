"""Registered queries of governance, messages and export plans, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.functions import scalars
from tracemill.operators import artifacts, curation, dashboard, evaluation, governance, messages, plans
from tracemill.plans.model import Model
from tracemill.plans.oracle import E1_FIELDS, rounded
from tracemill.plans.registry import _SECRETS, _TWICE, query

_REASONS = "string_agg(DISTINCT slice_id, ',' ORDER BY slice_id)"


def _cohort_rows(m: Model) -> DataFrame:
    """Cohorts with their use and sample unit: the one of the last family is for evaluation, one has another unit."""
    rows = m.candidates.select(F.concat(F.lit("cohort_"), "task_family").alias("cohort_id")).distinct()
    use = F.when(F.col("cohort_id") == "cohort_family_2", "evaluation").otherwise("training")
    return rows.select("cohort_id", use.alias("expected_use"), F.when(F.col("cohort_id") == "cohort_family_1", "branch").otherwise("run").alias("sample_unit"))


_COHORTS = "(SELECT DISTINCT 'cohort_' || task_family AS cohort_id, CASE WHEN task_family = 'family_2' THEN 'evaluation' ELSE 'training' END AS expected_use, CASE WHEN task_family = 'family_1' THEN 'branch' ELSE 'run' END AS sample_unit FROM candidates)"
_PATCHES = "artifact_type IN ('score', 'annotation') AND run_id IS NOT NULL"

# slices and cohorts
query("list_slices", lambda m: m.slices, "SELECT * FROM slices")
query("resolve_slice_id", lambda m: governance.with_slices(m.fields.select("run_id", "task_family", "task_type"), m.slices).select("run_id", "slice_id"), "SELECT run_id, slice_id FROM fields JOIN slices USING (task_family, task_type)")
query("list_cohorts", lambda m: governance.cohorts(m.members).drop("created_at"), f"SELECT cohort_id, count(*) AS members, count(DISTINCT run_id) AS runs, {_REASONS} AS slice_ids FROM members GROUP BY cohort_id")
query("list_cohort_members", lambda m: m.members.where("task_type = 'type_1'").select("cohort_id", "run_id", "artifact_id", "task_instance_key", "slice_id"), "SELECT cohort_id, run_id, artifact_id, task_instance_key, slice_id FROM members WHERE task_type = 'type_1'")
query(
    "append_cohort_checks",
    lambda m: governance.check_cohorts(m.members, m.slices.where("runs >= 3"), m.members.where("task_family = 'family_1'")),
    "SELECT cohort_id, count(*) AS members, concat_ws(',', CASE WHEN count(*) FILTER (WHERE slice_id NOT IN (SELECT slice_id FROM slices WHERE runs >= 3)) > 0 THEN 'unknown_slices' END, CASE WHEN cohort_id = 'cohort_family_1' THEN 'cohort_exists' END) AS errors FROM members GROUP BY cohort_id",
)


def _scope(m: Model) -> DataFrame:
    facts, attached = governance.cohort_scope(m.members, m.facts, m.artifacts)
    count = lambda rows, name: rows.groupBy("cohort_id", "run_id").agg(F.count("*").alias(name))
    return count(facts, "facts").join(count(attached, "artifacts"), ["cohort_id", "run_id"], "left").select("cohort_id", "run_id", "facts", F.coalesce("artifacts", F.lit(0)).alias("artifacts"))


query(
    "cohort_scope",
    _scope,
    """SELECT cohort_id, run_id, facts, coalesce(n, 0) AS artifacts FROM (SELECT c.cohort_id, c.run_id, count(*) AS facts FROM (SELECT DISTINCT cohort_id, run_id FROM members) c JOIN facts f USING (run_id) GROUP BY ALL)
    LEFT JOIN (SELECT c.cohort_id, c.run_id, count(*) AS n FROM (SELECT DISTINCT cohort_id, run_id, session_id FROM members) c JOIN (SELECT cohort_id, min(latest_ts) AS cohort_at FROM members GROUP BY cohort_id) t USING (cohort_id)
        JOIN artifacts a ON a.created_at <= t.cohort_at AND (a.run_id = c.run_id OR (a.run_id IS NULL AND a.session_id = c.session_id)) GROUP BY ALL) USING (cohort_id, run_id)""",
)
query(
    "cohort_eval_cases",
    lambda m: governance.eval_cases(m.members, m.spans, evaluation.run_scores(m.artifacts)),
    "SELECT cohort_id, run_id, artifact_id, requests, answered, score FROM members JOIN (SELECT run_id, count(*) AS requests, count(*) FILTER (WHERE outcome = 'succeeded') AS answered FROM spans GROUP BY run_id) USING (run_id) LEFT JOIN scores USING (run_id)",
)
query(
    "candidate_status",
    lambda m: governance.candidate_status(curation.review_reasons(m.candidates), m.members.where("task_family = 'family_2'"), m.feedback),
    "SELECT run_id, CASE WHEN run_id IN (SELECT run_id FROM members WHERE task_family = 'family_2') THEN 'holdout' WHEN bool_or(reasons <> '') OR run_id IN (SELECT run_id FROM feedback) THEN 'review' ELSE 'eligible' END AS status FROM reviewed GROUP BY run_id",
)
query("review_queue", lambda m: governance.review_queue(curation.review_reasons(m.candidates)), "SELECT run_id, session_id, artifact_id, task_instance_key, reasons FROM reviewed WHERE reasons <> ''")
for _kind in ("offline_test", "shadow"):
    query(
        f"suite_guards_{_kind}",
        lambda m, kind=_kind: governance.suite_guards(_cohort_rows(m), m.members, m.members.where("task_family = 'family_0'"), kind),
        f"""SELECT cohort_id, coalesce(n, 0) AS members, concat_ws(',', CASE WHEN expected_use <> 'evaluation' THEN 'not_for_evaluation' END, CASE WHEN n IS NULL THEN 'no_members' END, CASE WHEN r THEN 'shared_run_id' END, CASE WHEN i THEN 'shared_task_instance_key' END, CASE WHEN t THEN 'shared_task_template_hash' END{", CASE WHEN first_ts <= (SELECT max(latest_ts) FROM members WHERE task_family = 'family_0') THEN 'not_later' END" if _kind == "shadow" else ""}) AS errors
    FROM {_COHORTS} LEFT JOIN (SELECT cohort_id, count(*) AS n, min(latest_ts) AS first_ts, {", ".join(f"bool_or({k} IN (SELECT {k} FROM members WHERE task_family = 'family_0')) AS {a}" for k, a in (("run_id", "r"), ("task_instance_key", "i"), ("task_template_hash", "t")))} FROM members GROUP BY cohort_id) USING (cohort_id)""",
    )
query(
    "scope_blockers",
    lambda m: governance.scope_blockers(_cohort_rows(m), curation.review_reasons(m.candidates)),
    f"""SELECT cohort_id, builder, concat_ws(',', CASE WHEN cohort_id IN (SELECT 'cohort_' || task_family FROM reviewed WHERE reasons <> '') THEN 'review_pending' END, CASE WHEN builder <> 'facts' AND expected_use <> 'training' THEN 'not_for_training' END, CASE WHEN builder <> 'facts' AND NOT list_contains(units, sample_unit) THEN 'sample_unit' END) AS blockers
    FROM {_COHORTS}, (VALUES ('sft', ['request', 'run']), ('preference', ['branch']), ('binary_rl', ['run']), ('facts', ['request', 'branch', 'run'])) b(builder, units)""",
)

# appends and mutable rows
_DIRTY = ("request_started", "response_chunk", "response_finished", "error_raised", "semantic_event")


def _dirty(m: Model) -> DataFrame:
    f = m.facts.select("fact_id", "run_id", "session_id", "ts", "kind", "seq", "k")
    again = f.where("k % 7 = 0").withColumn("seq", F.col("seq") + 1_000_000_000)
    rows = f.union(again).withColumn("kind", F.when(F.col("k") % 11 == 0, "unheard").otherwise(F.col("kind")))
    return rows.withColumn("fact_id", F.when(F.col("k") % 13 != 0, F.col("fact_id"))).withColumn("run_id", F.when(F.col("k") % 17 != 0, F.col("run_id")))


query(
    "append_facts_checks",
    lambda m: governance.validate_facts(_dirty(m), _DIRTY).groupBy(F.coalesce("reason", F.lit("accepted")).alias("verdict")).agg(F.count("*").alias("facts")),
    "SELECT CASE WHEN k % 13 = 0 THEN 'no_identifier' WHEN k % 17 = 0 THEN 'no_scope' WHEN k % 11 = 0 THEN 'unknown_kind' WHEN again THEN 'repeated' ELSE 'accepted' END AS verdict, count(*) AS facts FROM (SELECT k, false AS again FROM facts UNION ALL SELECT k, true FROM facts WHERE k % 7 = 0) GROUP BY 1",
)
query("latest_note_by_run", lambda m: governance.latest(m.artifacts.where("artifact_type = 'note' and run_id is not null"), "run_id"), "SELECT run_id, last(artifact_id ORDER BY created_at, artifact_id) AS artifact_id FROM artifacts WHERE artifact_type = 'note' AND run_id IS NOT NULL GROUP BY run_id")
query("upsert_assets", lambda m: governance.latest(m.artifacts, "session_id", "artifact_type"), "SELECT session_id, artifact_type, last(artifact_id ORDER BY created_at, artifact_id) AS artifact_id FROM artifacts GROUP BY ALL")
query(
    "feedback_metadata",
    lambda m: governance.merged_patches(m.artifacts.where(_PATCHES).select("run_id", F.col("created_at").alias("ts"), "seq", F.map_filter(F.create_map(F.lit("producer"), F.col("producer"), F.lit("status"), F.col("status"), F.lit("reason"), F.col("review_reason")), lambda k, v: v.isNotNull()).alias("patch")), "run_id"),
    f"SELECT run_id, key, last(value ORDER BY created_at, seq) AS value FROM (" + " UNION ALL ".join(f"SELECT run_id, '{k}' AS key, {c} AS value, created_at, seq FROM artifacts WHERE {_PATCHES} AND {c} IS NOT NULL" for k, c in (("producer", "producer"), ("status", "status"), ("reason", "review_reason"))) + ") GROUP BY run_id, key",
)
query(
    "branch_references",
    lambda m: governance.branch_of_reference(m.artifacts.where("chosen_branch_id is not null").select(F.col("artifact_id").alias("ref_id"), F.when(F.col("seq") % 2 == 1, F.col("run_id")).alias("run_id"), F.col("chosen_branch_id").alias("branch_id")), m.branches),
    """SELECT artifact_id AS ref_id, b.run_id FROM artifacts a JOIN (SELECT DISTINCT run_id, branch_id FROM branches) b ON b.branch_id = a.chosen_branch_id AND b.run_id = a.run_id WHERE a.seq % 2 = 1
    UNION ALL SELECT artifact_id, b.run_id FROM artifacts a JOIN (SELECT branch_id, min(run_id) AS run_id FROM branches GROUP BY branch_id HAVING count(DISTINCT run_id) = 1) b ON b.branch_id = a.chosen_branch_id WHERE a.seq % 2 = 0 OR (a.run_id, a.chosen_branch_id) NOT IN (SELECT (run_id, branch_id) FROM branches)""",
)
query(
    "router_handoff",
    lambda m: governance.handoff(m.slices.select("slice_id", F.element_at(F.array(*map(F.lit, ("shadow", "canary", "rollout", "offline"))), (F.col("runs") % 4 + 1).cast("int")).alias("stage"), F.when(F.col("runs") % 3 == 0, "hold").otherwise("promote").alias("decision")), "baseline"),
    "SELECT *, CASE WHEN route_mode <> 'primary' THEN 'baseline' END AS fallback FROM (SELECT slice_id, stage, decision, CASE WHEN decision <> 'promote' THEN 'disabled' WHEN stage = 'shadow' THEN 'mirror' WHEN stage = 'canary' THEN 'split' WHEN stage = 'rollout' THEN 'primary' ELSE 'disabled' END AS route_mode FROM (SELECT slice_id, (['shadow', 'canary', 'rollout', 'offline'])[runs % 4 + 1] AS stage, CASE WHEN runs % 3 = 0 THEN 'hold' ELSE 'promote' END AS decision FROM slices))",
)

# readiness, plans and judges
_MISSING = "concat_ws(',', " + ", ".join(f"CASE WHEN {f} IS NULL THEN '{f}' END" for f in E1_FIELDS) + ")"
query("missing_fields", lambda m: plans.missing_fields(m.fields), f"SELECT run_id, {_MISSING} AS missing_fields, ready AS complete FROM fields")
query(
    "builder_blockers",
    lambda m: plans.builder_blockers(m.fields, {"binary_rl": m.records, "facts": m.facts, "sft": m.facts.where("kind = 'unheard'")}),
    f"SELECT builder, run_id, 'missing:' || {_MISSING} AS blocker FROM fields, (VALUES ('binary_rl'), ('sft')) b(builder) WHERE NOT ready UNION ALL SELECT 'sft', NULL, 'no_records'",
)
query("unique_annotation_values", lambda m: plans.unique_values(m.fields, "task_type", "source_channel", "verifier_name"), " UNION ALL ".join(f"SELECT '{c}' AS name, string_agg(DISTINCT {c}, ',' ORDER BY {c}) AS values FROM fields WHERE {c} <> ''" for c in ("task_type", "source_channel", "verifier_name")))
query("annotated_records", lambda m: plans.with_annotations(m.records, m.fields).select("artifact_id", "run_id", "reward", "task_type", "source_channel", "ready"), "SELECT artifact_id, run_id, reward, task_type, source_channel, ready FROM records LEFT JOIN fields USING (run_id)")
query(
    "export_plan",
    lambda m: plans.export_plan(m.facts.where("kind = 'request_started'").select("seq", "run_id", "fingerprint", "path", "actor"), F.concat_ws("|", "run_id", "actor", "path", "fingerprint"), scalars.guard_key(run_id=F.col("run_id")), "seq").groupBy("split").agg(F.count("*").alias("records"), F.sum(F.col("copies") - 1).alias("repeated"), F.count_distinct("run_id").alias("runs")),
    "SELECT CASE WHEN p < 80 THEN 'train' WHEN p < 90 THEN 'val' ELSE 'test' END AS split, count(*) AS records, CAST(sum(n - 1) AS BIGINT) AS repeated, count(DISTINCT run_id) AS runs FROM (SELECT run_id, count(*) AS n, CAST('0x' || substr(sha256('run_id:' || run_id), 1, 8) AS BIGINT) % 100 AS p FROM facts WHERE kind = 'request_started' GROUP BY run_id, actor, path, fingerprint) GROUP BY 1",
)
query(
    "judge_summary",
    lambda m: plans.judge_summary(m.facts, m.spans),
    "SELECT run_id, facts, coalesce(kinds, '') AS kinds, coalesce(requests, 0) AS requests, coalesce(failed, 0) AS failed, samples FROM (SELECT run_id, count(*) AS facts, string_agg(DISTINCT semantic_kind, ',' ORDER BY semantic_kind) AS kinds FROM facts GROUP BY run_id) LEFT JOIN (SELECT run_id, count(*) AS requests, count(*) FILTER (WHERE outcome = 'failed') AS failed, array_to_string(list(request_id ORDER BY ts, seq)[1:3], ',') AS samples FROM spans GROUP BY run_id) USING (run_id)",
)


def _notes(m: Model) -> DataFrame:
    answers = m.artifacts.where("artifact_type = 'score' and run_id is not null").groupBy("run_id").agg(F.max("score").alias("quality"), (F.max("confidence") * 2).alias("verifier"))
    return plans.judge_notes(m.fields, answers)


def _clamped(x: str, default: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN {default} ELSE greatest(0e0, least(1e0, {rounded(x)})) END"


_NOTES = f"""(SELECT run_id, quality, verifier, concat_ws(',', CASE WHEN quality < 0.8 THEN 'low_quality_confidence' END, CASE WHEN verifier < 0.8 THEN 'low_verifier_score' END) AS reasons
    FROM (SELECT run_id, {_clamped("coalesce(a.q, f.quality_confidence)", "0.5e0")} AS quality, {_clamped("coalesce(a.v, f.verifier_score)", "0e0")} AS verifier
        FROM fields f LEFT JOIN (SELECT run_id, max(score) AS q, max(confidence) * 2 AS v FROM artifacts WHERE artifact_type = 'score' AND run_id IS NOT NULL GROUP BY run_id) a USING (run_id)))"""
query("judge_notes", _notes, f"SELECT * FROM {_NOTES}")
query(
    "review_overrides",
    lambda m: plans.review_overrides(artifacts.annotation_index(m.artifacts), _notes(m)),
    f"SELECT run_id, supersedes_artifact_id, 1e0 AS quality_confidence, 1e0 AS verifier_score, 'human_reviewer' AS producer FROM {_NOTES} JOIN (SELECT target_id AS run_id, last(artifact_id ORDER BY created_at, seq) AS supersedes_artifact_id FROM annotations WHERE target_kind = 'run' AND status = 'active' GROUP BY target_id) USING (run_id) WHERE reasons <> ''",
)
query(
    "workflow_order",
    lambda m: plans.workflow_order(dashboard.workflow(m.spans, m.fields, dashboard.run_evidence(m.facts, m.fields, completed="branch_open_declared"), m.feedback, m.records), m.facts, 50),
    "SELECT run_id, stage, stage_rank FROM (SELECT run_id, stage, CAST(list_position(['capture', 'annotate', 'review', 'evaluate', 'dataset', 'augment'], stage) AS BIGINT) AS stage_rank, latest FROM workflow JOIN (SELECT run_id, max(ts) AS latest FROM facts GROUP BY run_id) USING (run_id) ORDER BY stage_rank, latest, run_id LIMIT 50)",
)
query(
    "prepare_runs",
    lambda m: dashboard.prepare(m.spans, m.branches, m.facts.join(m.table("documents").select(F.col("doc_id").alias("seq"), scalars.secret_counts(F.col("text")).alias("c")), "seq").groupBy("run_id").agg(F.sum(sum((F.col(f"c.{n}") for n, _ in scalars.SECRET_PATTERNS), F.lit(0))).alias("secrets"))),
    """SELECT run_id, CASE WHEN blockers <> '' THEN 'blocked' WHEN reviews <> '' THEN 'review' ELSE 'clean' END AS status, blockers, reviews, CASE WHEN blockers <> '' THEN 0.4e0 WHEN reviews <> '' THEN 0.7e0 ELSE 1e0 END AS confidence FROM (SELECT run_id, concat_ws(',', CASE WHEN open > 0 THEN 'open_spans' END, CASE WHEN prompts = 0 THEN 'no_prompts' END) AS blockers,
    concat_ws(',', CASE WHEN coalesce(secrets, 0) > 0 THEN 'secret_like_text' END, CASE WHEN coalesce(n, 0) > 0 AND coalesce(declared, 0) = 0 THEN 'inferred_only_branching' END, CASE WHEN outputs = 0 THEN 'no_assistant_output' END) AS reviews
    FROM (SELECT run_id, count(*) FILTER (WHERE outcome = 'open') AS open, count(fingerprint) AS prompts, count(response_fact_id) AS outputs FROM spans GROUP BY run_id) LEFT JOIN (SELECT run_id, count(*) AS n, count(*) FILTER (WHERE source = 'declared') AS declared FROM branches WHERE branch_type <> 'mainline' GROUP BY run_id) USING (run_id)
    LEFT JOIN (SELECT run_id, sum("""
    + " + ".join([f"coalesce(len(regexp_extract_all(text, '{dict(scalars.SECRET_PATTERNS)['private_key']}')), 0)", *(f"coalesce(len(regexp_extract_all({_TWICE}, '{p}')), 0)" for p in _SECRETS.values())])
    + ") AS secrets FROM facts JOIN documents ON doc_id = seq GROUP BY run_id) USING (run_id))",
)

# pairs, trajectories and templates
query(
    "ranked_preferences",
    lambda m: plans.ranked_preferences(m.branches.groupBy("run_id").agg(F.sort_array(F.collect_list(F.struct((F.col("status") != "succeeded").alias("worse"), "opened_seq", "branch_id"))).alias("r")).select("run_id", F.transform("r", lambda x: x["branch_id"]).alias("ranking"))),
    "SELECT run_id, first AS chosen, branch_id AS rejected, place - 1 AS place FROM (SELECT run_id, branch_id, row_number() OVER w AS place, first_value(branch_id) OVER w AS first FROM branches WINDOW w AS (PARTITION BY run_id ORDER BY status <> 'succeeded', opened_seq, branch_id)) WHERE place > 1 AND branch_id <> first",
)
query(
    "same_prompt_pairs",
    lambda m: plans.same_prompt(m.pairs, m.assigned.join(m.spans.select("run_id", "request_fact_id", "fingerprint"), ["run_id", "request_fact_id"]).groupBy("run_id", "branch_id").agg(F.min_by("fingerprint", F.struct("ts", "seq")).alias("prompt"))),
    "SELECT p.run_id, chosen, rejected, source, coalesce(c.prompt, r.prompt) AS prompt FROM pairs p LEFT JOIN (SELECT run_id, branch_id, first(fingerprint ORDER BY ts, seq) AS prompt FROM assigned GROUP BY ALL) c ON c.run_id = p.run_id AND c.branch_id = chosen LEFT JOIN (SELECT run_id, branch_id, first(fingerprint ORDER BY ts, seq) AS prompt FROM assigned GROUP BY ALL) r ON r.run_id = p.run_id AND r.branch_id = rejected WHERE coalesce(c.prompt = r.prompt, true)",
)
query("branch_trajectories", lambda m: plans.trajectories(m.assigned, "run_id", "branch_id"), "SELECT run_id, branch_id, string_agg(request_id || ':' || outcome, ',' ORDER BY ts, seq, request_id) AS steps FROM assigned GROUP BY ALL")
query(
    "all_templates",
    lambda m: artifacts.template_scores(m.spans).select(F.lit("score").alias("template"), "run_id", "confidence").union(artifacts.template_preferences(m.pairs).select(F.lit("preference"), "run_id", "confidence")).union(artifacts.bootstrap_e1(m.facts, m.spans, m.branches).select(F.lit("annotation"), "run_id", "quality_confidence")).groupBy("template", "run_id", "confidence").agg(F.count("*").alias("artifacts")),
    "SELECT template, run_id, confidence, count(*) AS artifacts FROM (SELECT 'score' AS template, run_id, 0.8e0 AS confidence FROM spans WHERE outcome <> 'open' UNION ALL SELECT 'preference', run_id, 0.7e0 FROM pairs UNION ALL SELECT 'annotation', run_id, CASE WHEN bool_or(outcome <> 'open') THEN 0.65e0 ELSE 0.5e0 END FROM spans GROUP BY run_id) GROUP BY ALL",
)

# answers
query(
    "grades",
    lambda m: m.table("labels").select("doc_id", messages.grade(F.element_at(F.array(F.when(F.col("quality") == 1, "true").otherwise("false"), F.col("quality").cast("string"), F.to_json(F.struct((F.col("quality") == 1).alias("pass"))), F.to_json(F.struct((F.col("quality") / 2).alias("score")))), (F.col("doc_id") % 4 + 1).cast("int"))).alias("g")).select("doc_id", "g.passed", "g.score"),
    "SELECT doc_id, CASE WHEN doc_id % 4 = 3 THEN false ELSE quality = 1 END AS passed, CASE WHEN doc_id % 4 = 3 THEN quality / 2 ELSE CAST(quality AS DOUBLE) END AS score FROM labels",
)
query(
    "json_answers",
    lambda m: m.table("labels").select("doc_id", F.get_json_object(messages.json_object(F.concat(F.lit("It is:\n```json\n{\"quality\": "), F.col("quality").cast("string"), F.lit(", \"why\": {\"n\": 1}}\n```\nso."))), "$.quality").cast("long").alias("quality")),
    "SELECT doc_id, CAST(quality AS BIGINT) AS quality FROM labels",
)
