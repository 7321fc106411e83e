"""Supervision: the flattened annotation index, resolved annotations per run, overlays and templates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.functions import variants as V
from tracemill.functions.scalars import difficulty, round_to, target_kind, target_value
from tracemill.operators.scans import in_order, live

#: Required annotation fields.
E1_FIELDS = ("task_family", "task_type", "task_template_hash", "task_instance_key", "verifier_name", "verifier_score", "quality_confidence", "taxonomy_version", "annotation_version", "source_channel")
_AT = ("created_at", "seq")
#: Cells of a product on each side, and blocks of its runs.
_GRID, _RUN_BLOCKS = 16, 1024


def annotation_index(artifacts: DataFrame) -> DataFrame:
    """Annotations with the kind and id of their target; a bare reference means its run, else its session."""
    kind = target_kind(F.col("target_ref"))
    target = F.when(kind.isin("run", "session"), kind).when(F.col("run_id").isNotNull(), "run").otherwise("session")
    ident = F.when(kind.isin("run", "session"), target_value(F.col("target_ref"))).when(F.col("run_id").isNotNull(), F.col("run_id")).otherwise(F.col("session_id"))
    return artifacts.where("artifact_type = 'annotation'").select("artifact_id", "seq", "created_at", "status", "supersedes_artifact_id", target.alias("target_kind"), ident.alias("target_id"), *E1_FIELDS, "review_reason", "producer")


def resolve_e1(facts: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Per run the last non-null value of each field: the run's own annotations over its session's."""
    active = annotation_index(artifacts).where("status = 'active'")
    latest = lambda kind, key: active.where(F.col("target_kind") == kind).groupBy(F.col("target_id").alias(key)).agg(*(F.max_by(f, F.when(F.col(f).isNotNull(), in_order(*_AT))).alias(f"{kind}_{f}") for f in E1_FIELDS))
    runs = facts.groupBy("run_id").agg(F.min_by("session_id", in_order()).alias("session_id"))
    both = runs.join(latest("session", "session_id"), "session_id", "left").join(latest("run", "run_id"), "run_id", "left")
    fields = both.select("run_id", "session_id", *(F.coalesce(f"run_{f}", f"session_{f}").alias(f) for f in E1_FIELDS))
    return fields.withColumns({"missing": sum((F.col(f).isNull().cast("int") for f in E1_FIELDS), F.lit(0)).cast("long"), "ready": ~sum((F.col(f).isNull().cast("int") for f in E1_FIELDS), F.lit(0)).cast("boolean")})


def candidates(facts: DataFrame, artifacts: DataFrame, min_quality: float | None = None, min_verifier: float | None = None, **equal: str) -> DataFrame:
    """Runs with all required fields from live annotations, the run's value before its session's, per field."""
    index = annotation_index(live(artifacts))
    runs = facts.groupBy("run_id").agg(F.min("session_id").alias("session_id"), F.max("ts").alias("latest_ts"), F.max("seq").alias("latest_seq"))
    side = lambda kind, key: index.where(F.col("target_kind") == kind).select(F.col("target_id").alias(key), F.col("artifact_id").alias(f"{kind}_artifact"), F.col("review_reason").alias(f"{kind}_reason"), *(F.col(f).alias(f"{kind}_{f}") for f in E1_FIELDS))
    both = runs.join(side("session", "session_id"), "session_id", "left").join(side("run", "run_id"), "run_id", "left")
    rows = both.select(
        "run_id", "session_id", "latest_ts", "latest_seq", F.coalesce("run_artifact", "session_artifact").alias("artifact_id"), F.coalesce("run_reason", "session_reason").alias("review_reason"),
        *(F.coalesce(f"run_{f}", f"session_{f}").alias(f) for f in E1_FIELDS),
    )
    for f in ("task_family", "task_type", "task_template_hash", "task_instance_key", "verifier_score", "quality_confidence", "source_channel"):
        rows = rows.where(F.col(f).isNotNull())
    if min_quality is not None:
        rows = rows.where(F.col("quality_confidence") >= min_quality)
    if min_verifier is not None:
        rows = rows.where(F.col("verifier_score") >= min_verifier)
    for column, value in equal.items():
        if value is not None:
            rows = rows.where(F.col(column) == value)
    return rows.orderBy(F.desc("latest_ts"), "run_id")


#: Fields that a candidate needs, and those of them that are numbers.
NEEDED = ("task_family", "task_type", "task_template_hash", "task_instance_key", "verifier_score", "quality_confidence", "source_channel")
_NUMBERS = ("verifier_score", "quality_confidence")


def candidate_fields(facts: DataFrame, artifacts: DataFrame, session_id: str | None = None, run_id: str | None = None, limit: int | None = None) -> DataFrame:
    """Candidates with all members of their annotations' payloads (JSON text), newest first.

    A candidate has every needed field in its run's or its session's live annotation; a number must be one. ``fields``
    maps each member to JSON text: the run's over the session's, and what ends as null is gone, even where the
    session has a value. A scope is pushed down to facts and annotations.
    """
    if session_id is not None:
        facts = facts.where(F.col("session_id") == session_id)
    if run_id is not None:
        facts = facts.where(F.col("run_id") == run_id)
    runs = facts.groupBy("run_id").agg(F.min("session_id").alias("session_id"), F.max("ts").alias("latest_ts"))
    notes = live(artifacts).where("artifact_type = 'annotation'").withColumn("_p", V.parsed(F.col("payload"))).where(V.string(F.col("_p"), "$.annotation_kind") == "e1")
    kind = target_kind(F.col("target_ref"))
    on = F.when(kind.isin("run", "session"), kind).when(F.col("run_id").isNotNull(), "run").when(F.col("session_id").isNotNull() & (kind == ""), "session")
    ident = F.when(kind.isin("run", "session"), target_value(F.col("target_ref"))).otherwise(F.coalesce("run_id", "session_id"))
    value = lambda f: V.number(F.col("_p"), f"$.{f}").cast("string") if f in _NUMBERS else V.named(F.col("_p"), f"$.{f}")
    index = notes.select("artifact_id", on.alias("on"), ident.alias("ident"), F.col("payload"), *(value(f).alias(f) for f in NEEDED))
    side = lambda name: index.where(F.col("on") == name).select(F.col("ident").alias(f"{name}_id"), *(F.col(c).alias(f"_{name}_{c}") for c in ("artifact_id", "payload", *NEEDED)))
    own = side("run") if run_id is None else side("run").where(F.col("run_id") == run_id)
    both = runs.join(side("session"), "session_id", "left").join(own, "run_id", "left")
    first = {f: F.coalesce(f"_run_{f}", f"_session_{f}") for f in NEEDED}
    for f in NEEDED:
        both = both.where(first[f].isNotNull())
    merged = F.map_filter(V.merged(V.parsed(F.col("_session_payload")), V.parsed(F.col("_run_payload"))), lambda k, v: k != "annotation_kind")
    rows = both.select("run_id", "session_id", "latest_ts", F.array_compact(F.array("_session_artifact_id", "_run_artifact_id")).alias("artifact_ids"), merged.alias("fields"), *(first[f].cast("double").alias(f) for f in _NUMBERS))
    rows = rows.orderBy(F.desc("latest_ts"), "run_id")
    return rows if limit is None else rows.limit(limit)


def bootstrap_e1(facts: DataFrame, spans: DataFrame, branches: DataFrame) -> DataFrame:
    """Annotations from a run's own outcomes: share of closed requests that succeeded, difficulty, channel."""
    closed, won = F.count_if(F.col("outcome") != "open"), F.count_if(F.col("outcome") == "succeeded")
    by_run = spans.groupBy("run_id").agg(closed.alias("closed"), won.alias("succeeded"), F.count("*").alias("requests"), F.min_by("fingerprint", in_order()).alias("fingerprint"))
    opened = branches.groupBy("run_id").agg(F.count("*").alias("branches"))
    channel = facts.groupBy("run_id").agg(F.count_distinct("capture_source").alias("sources"), F.min("capture_source").alias("source"))
    rows = by_run.join(opened, "run_id").join(channel, "run_id")
    return rows.select(
        "run_id",
        F.when(F.col("closed") > 0, round_to(F.col("succeeded") / F.col("closed"), 3)).otherwise(0.0).alias("verifier_score"),
        F.when(F.col("closed") > 0, 0.65).otherwise(0.5).alias("quality_confidence"),
        difficulty(F.col("requests"), F.col("branches")).alias("difficulty"),
        F.when(F.col("sources") == 0, "captured").when(F.col("sources") == 1, F.col("source")).otherwise("mixed").alias("source_channel"),
        F.coalesce(F.sha2("fingerprint", 256), F.lit("unknown")).alias("task_template_hash"),
    )


def request_overlays(spans: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Artifacts on a request, its response or its error, counted per request."""
    refs = F.array_compact(F.array("request_fact_id", "response_fact_id", "error_fact_id"))
    facts = spans.select("run_id", "request_fact_id", F.explode(refs).alias("fact"))
    on_fact = artifacts.where(target_kind(F.col("target_ref")) == "fact").select("artifact_id", "artifact_type", target_value(F.col("target_ref")).alias("fact"))
    return facts.join(on_fact, "fact").dropDuplicates(["request_fact_id", "artifact_id"]).select("run_id", "request_fact_id", "artifact_id", "artifact_type")


def branch_overlays(branches: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Artifacts on a branch, by target or by a branch named in the payload; of the run, or of no run."""
    named = F.array_compact(F.array(F.when(target_kind(F.col("target_ref")) == "branch", target_value(F.col("target_ref"))), "chosen_branch_id", "rejected_branch_id"))
    leaves = artifacts.select("artifact_id", "artifact_type", F.col("run_id").alias("own_run"), F.explode(F.array_distinct(named)).alias("branch_id"))
    rows = branches.select("run_id", "branch_id").distinct()
    inside = rows.join(leaves.where("own_run is not null").withColumnRenamed("own_run", "run_id"), ["run_id", "branch_id"])
    return inside.select("run_id", "branch_id", "artifact_id", "artifact_type").union(_anywhere(rows, leaves.where("own_run is null").drop("own_run")))


def branch_mentions(branches: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Artifacts on a branch by target, or by any string in their payload (JSON text) that is its name; of the run, or of no run.

    The strings of every payload are laid out once and joined by name, in the run where the artifact has one. A name that
    all runs share makes a row for each of them where an artifact has no run, as it concerns them all: see ``_anywhere``.
    """
    target = F.when(target_kind(F.col("target_ref")) == "branch", target_value(F.col("target_ref")))
    named = F.array_distinct(F.array_compact(F.array_append(F.coalesce("_strings", F.array().cast("array<string>")), target)))
    laid = artifacts.withColumn("_strings", V.strings(F.col("payload"))).select("artifact_id", "artifact_type", F.col("run_id").alias("own_run"), F.explode(named).alias("branch_id"))
    rows = branches.select("run_id", "branch_id").distinct()
    inside = rows.join(laid.where("own_run is not null").withColumnRenamed("own_run", "run_id"), ["run_id", "branch_id"])
    return inside.select("run_id", "branch_id", "artifact_id", "artifact_type").union(_anywhere(rows, laid.where("own_run is null").drop("own_run")))


def _anywhere(rows: DataFrame, named: DataFrame) -> DataFrame:
    """Each artifact of no run with every run that has a branch of its name: for a name of all runs, the product of both.

    The product of a name is dealt over ``_GRID`` by ``_GRID`` cells, so that no task holds more than a share of either side
    and each side is sent ``_GRID`` times, however large the other is. Cells go to tasks by number, one of each name to a task:
    by hash, a third of the tasks get none and others five. A cell's runs come in blocks, and a block's rows lie by
    artifact: files then repeat a few short patterns, where the runs of each artifact in a row take bytes for each.
    """
    cells = _GRID * _GRID
    share = lambda column, n=_GRID: F.pmod(F.xxhash64(column), F.lit(n))
    every = F.explode(F.sequence(F.lit(0), F.lit(_GRID - 1)))
    cell = F.pmod(share("branch_id", cells) + F.col("_across") * _GRID + F.col("_down"), F.lit(cells)).cast("int").alias("_cell")
    runs = F.collect_list(F.struct("run_id"))["run_id"].alias("_runs")  # in structs, as a list of the ids alone leaves out null
    blocks = rows.groupBy("branch_id", share("run_id", _RUN_BLOCKS).alias("_block")).agg(runs)
    left = blocks.select("branch_id", "_runs", share("_block").alias("_across"), every.alias("_down")).select(cell, "branch_id", "_runs").repartitionById(cells, "_cell")
    right = named.select("*", share("artifact_id").alias("_down"), every.alias("_across")).select(cell, "branch_id", "artifact_id", "artifact_type").repartitionById(cells, "_cell")
    both = left.hint("merge").join(right, ["_cell", "branch_id"])  # merged, all artifacts of a cell follow one block of runs
    return both.select(F.explode("_runs").alias("run_id"), "branch_id", "artifact_id", "artifact_type")


def scope_overlays(facts: DataFrame, artifacts: DataFrame, scope: str) -> DataFrame:
    """Artifacts on a run or a session, counted by type."""
    ids = facts.select(f"{scope}_id").distinct()
    on = artifacts.where(target_kind(F.col("target_ref")) == scope).select(target_value(F.col("target_ref")).alias(f"{scope}_id"), "artifact_type")
    return ids.join(on, f"{scope}_id").groupBy(f"{scope}_id", "artifact_type").agg(F.count("*").alias("artifacts"))


def template_scores(spans: DataFrame) -> DataFrame:
    """A score artifact for each closed request: 1 if it succeeded, else 0."""
    return spans.where("outcome <> 'open'").select(F.concat(F.lit("fact:"), F.coalesce("response_fact_id", "error_fact_id")).alias("target_ref"), "run_id", F.when(F.col("outcome") == "succeeded", 1.0).otherwise(0.0).alias("score"), F.lit(0.8).alias("confidence"))


def template_preferences(pairs: DataFrame) -> DataFrame:
    """A preference artifact for each comparable pair."""
    return pairs.select(F.concat(F.lit("run:"), F.col("run_id")).alias("target_ref"), "run_id", F.col("chosen").alias("chosen_branch_id"), F.col("rejected").alias("rejected_branch_id"), "source", F.lit(0.7).alias("confidence"))
