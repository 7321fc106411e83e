"""Exports: annotated, distinct records with a split that leaks nothing, what forbids them, and their description.

``plan`` puts a builder's records through all steps as one lazy DataFrame; ``write`` refuses while there are blockers, and
else writes the records in one pass, by split. Counts of the description are gathered by an ``Observation`` while the
partitions are written; its lists (runs, keys, artifacts) and distributions grow with the data, so they are written beside
it as rows, not into it.
"""

from __future__ import annotations

import datetime
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tracemill.functions.scalars import hash_split
from tracemill.operators import dataset
from tracemill.operators.artifacts import E1_FIELDS
from tracemill.operators.builders import PREFERENCE_TYPES, REWARD_TYPES, SAMPLE_UNITS

#: Members of a record that make it equal to another one; the rest are names and places.
CANONICAL = ("builder", "chosen", "completion", "messages", "prompt", "rejected", "reward", "target", "task_instance_key", "task_template_hash", "task_type")
#: Where a record's guard key comes from: the first that is there and not empty.
GUARDS = (("", ("task_instance_key", "run_id", "session_id", "request_id", "fact_id")), ("target", ("run_id", "branch_id", "fact_id", "target_ref")), ("lineage", ("request_id", "artifact_id", "target_ref")))
DISTRIBUTIONS = ("task_family", "task_type", "task_template_hash", "difficulty", "teacher_model", "verifier_name", "source_channel", "split")
UNITS = {"sft": "request", "preference": "branch", "binary_rl": "run"}
_NO_RECORDS = {
    "facts": ("no facts found", "no facts found"),
    "sft": ("no successful model response pairs found for SFT", "no successful model response pairs found for SFT"),
    "preference": ("active preference artifacts did not resolve to known branches", "no active preference artifacts or comparable related branch pairs found"),
    "binary_rl": ("active binary RL artifacts did not contain numeric rewards", "no active score/reward artifacts found for binary RL"),
}


def _names(rows: DataFrame, parent: str = "") -> set[str]:
    if not parent:
        return set(rows.columns)
    kind = rows.schema[parent].dataType if parent in rows.columns else None
    return set(kind.fieldNames()) if hasattr(kind, "fieldNames") else set()


def record_run(records: DataFrame) -> Column:
    """The run that a record is about: its own, else its target's."""
    own = [F.nullif(F.col(f"{p}.run_id" if p else "run_id"), F.lit("")) for p in ("", "target") if "run_id" in _names(records, p)]
    return F.coalesce(*own, F.lit(None).cast("string"))


def annotate(records: DataFrame, fields: DataFrame) -> DataFrame:
    """Records with their run's resolved annotation (``artifacts.resolve_e1``), its evidence level, and its task columns.

    Columns that a record has already win over the annotation's.
    """
    names = [c for c in fields.columns if c not in ("run_id", "session_id", "missing", "ready")]
    noted = F.struct(*names)
    found = fields.select(F.col("run_id").alias("_run"), F.when(F.coalesce(*(F.col(c).cast("string") for c in names)).isNotNull(), noted).alias("annotation"), F.when(F.col("ready"), "E1").otherwise("E0").alias("evidence_level"))
    rows = records.withColumn("_run", record_run(records)).join(found, "_run", "left").drop("_run")
    rows = rows.withColumn("evidence_level", F.when(F.col("annotation").isNotNull(), F.col("evidence_level")))
    for c in ("task_family", "task_type", "task_instance_key"):
        rows = rows.withColumn(c, F.coalesce(*([c] if c in records.columns else []), f"annotation.{c}"))
    return rows


def canonical_hash(records: DataFrame) -> Column:
    """Hash of what a record says, whatever its names and places: its canonical members in fixed order, as JSON."""
    here = {"builder": "lineage.builder", "task_template_hash": "annotation.task_template_hash"}
    known = _names(records)
    parts = [F.col(here.get(c, c)).alias(c) for c in CANONICAL if here.get(c, c).split(".")[0] in known]
    return F.sha2(F.to_json(F.struct(*parts)), 256)


def guard(records: DataFrame) -> Column:
    """Records with the same guard key go into one split: ``name:value`` of the first name with a value, else a hash of all."""
    found = []
    for parent, names in GUARDS:
        for name in names:
            if name in _names(records, parent):
                path = f"{parent}.{name}" if parent else name
                found.append(F.concat(F.lit(f"{path}:"), F.nullif(F.col(path).cast("string"), F.lit(""))))
    return F.coalesce(*found, F.sha2(F.to_json(F.struct(*records.columns)), 256))


def distinct(records: DataFrame, *order: str) -> DataFrame:
    """The first record of each canonical hash, and how often it was there; copies meet in partial results before they move."""
    hashed = records.withColumn("canonical_record_hash", canonical_hash(records))
    return dataset.keep_first(hashed, F.col("canonical_record_hash"), *(order or ("canonical_record_hash",)))


def cohort_splits(members: DataFrame, facts: DataFrame) -> DataFrame:
    """(run_id, split, guard, mode, slice_id, task_type) of a cohort's members (run_id, slice_id, task_type, task_instance_key)."""
    ends = facts.groupBy("run_id").agg(F.max("ts").alias("latest_ts"))
    rows = members.withColumn("task_type", F.coalesce("task_type", F.lit("unknown"))).join(ends, "run_id", "left")
    placed = dataset.split_by_time(rows)
    return rows.select("run_id", "slice_id", "task_type", "task_instance_key").join(placed.select("slice_id", "task_type", "task_instance_key", "split", "mode"), ["slice_id", "task_type", "task_instance_key"]).withColumnRenamed("task_instance_key", "guard")


def missing_annotations(fields: DataFrame) -> DataFrame:
    """(run_id, blocker) of runs without all required fields."""
    lacking = F.array_compact(F.array(*(F.when(F.col(f).isNull(), f) for f in E1_FIELDS)))
    return fields.where(F.size(lacking) > 0).select("run_id", F.concat(F.lit("run "), "run_id", F.lit(" missing E1 annotations: "), F.array_join(lacking, ", ")).alias("blocker"))


def blockers(builder: str, records: DataFrame, fields: DataFrame, artifacts: DataFrame, cohort: dict | None = None) -> DataFrame:
    """Rows (place, run_id, blocker) of what forbids an export of a builder's records, in order of place.

    ``cohort`` has expected_use, sample_unit and review_required. Annotations that are missing forbid all but facts; a
    preference or reward export that is forbidden, or empty, says as well what its artifacts lack.
    """
    spark = records.sparkSession
    schema = "place int, run_id string, blocker string"
    lacking = missing_annotations(fields).select(F.lit(0).alias("place"), "run_id", "blocker") if builder != "facts" else spark.createDataFrame([], schema)
    out = lacking
    if builder in _NO_RECORDS:
        with_artifacts, without = _NO_RECORDS[builder]
        any_record = records.limit(1).agg((F.count("*") > 0).alias("any"))
        any_lack = lacking.limit(1).agg((F.count("*") > 0).alias("lack"))
        kinds = PREFERENCE_TYPES if builder == "preference" else REWARD_TYPES
        active = artifacts.where(F.col("artifact_type").isin(*kinds) & (F.col("status") == "active")).limit(1).agg((F.count("*") > 0).alias("active"))
        told = F.col("any") & (F.lit(builder in ("facts", "sft")) | ~F.col("lack"))
        one = any_record.crossJoin(any_lack).crossJoin(active)  # one row each
        out = out.union(one.where(~told).select(F.lit(1), F.lit(None).cast("string"), F.when(F.col("active"), with_artifacts).otherwise(without)))
    elif builder not in SAMPLE_UNITS:
        none = records.limit(1).agg(F.count("*").alias("n")).where("n = 0")
        out = out.union(none.select(F.lit(1), F.lit(None).cast("string"), F.lit(f"no records of builder {builder}")))
    contract = cohort_blockers(builder, cohort) if cohort else []
    return out.union(spark.createDataFrame([(2 + i, None, b) for i, b in enumerate(contract)], schema)) if contract else out


def cohort_blockers(builder: str, cohort: dict) -> list[str]:
    """What a cohort's contract forbids: pending reviews, another use, another sample unit."""
    use, unit = cohort.get("expected_use") or "training", cohort.get("sample_unit")
    own = UNITS.get(builder, "fact")
    found = ["cohort has pending review queue items"] if cohort.get("review_required") is True else []
    if builder != "facts" and use != "training":
        found.append(f"cohort expected_use={use} is not exportable as a training dataset snapshot")
    if unit and builder != "facts" and unit not in SAMPLE_UNITS.get(builder, (own,)):
        found.append(f"builder sample_unit is incompatible with cohort slice contract: builder={own}, cohort={unit}")
    return found


def distributions(records: DataFrame) -> DataFrame:
    """Rows (name, value, records): how often each value of the described columns comes."""
    known, noted = _names(records), _names(records, "annotation")
    value = lambda c: F.coalesce(*([c] if c in known else []), *([f"annotation.{c}"] if c in noted else []))
    pairs = [F.struct(F.lit(c).alias("name"), value(c).alias("value")) for c in DISTRIBUTIONS if c in known or c in noted]
    return records.select(F.inline(F.array(*pairs))).where("value <> ''").groupBy("name", "value").agg(F.count("*").alias("records"))


def lists(records: DataFrame, facts: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Rows (name, value) of what went in: runs, sessions and artifacts of the scope, instances, templates, taxonomies and guard keys of the records."""
    noted = _names(records, "annotation")
    of_records = [F.struct(F.lit(n).alias("name"), v.alias("value")) for n, v in (
        ("task_instance_keys", F.coalesce("task_instance_key", *(["annotation.task_instance_key"] if "task_instance_key" in noted else []))), ("guard_keys", F.col("split_guard_key")),
        *((f"{c}s" if c != "task_template_hash" else "task_template_hashes", F.col(f"annotation.{c}")) for c in ("task_template_hash", "taxonomy_version") if c in noted),
    )]
    scope = facts.select(F.inline(F.array(F.struct(F.lit("source_run_ids").alias("name"), F.col("run_id").alias("value")), F.struct(F.lit("source_session_ids").alias("name"), F.col("session_id").alias("value")))))
    return scope.union(artifacts.select(F.lit("artifact_ids"), "artifact_id")).union(records.select(F.inline(F.array(*of_records)))).where("value <> ''").distinct()


@dataclass
class Plan:
    """An export before it is written."""

    builder: str
    records: DataFrame
    blockers: DataFrame
    facts: DataFrame
    artifacts: DataFrame
    recipe_id: str
    snapshot_id: str
    scope: dict = field(default_factory=dict)

    def blocked_by(self, limit: int = 20) -> list[str]:
        """The first blockers."""
        return [r.blocker for r in self.blockers.orderBy("place", "run_id").limit(limit).collect()]


def plan(
    builder: str, records: DataFrame, fields: DataFrame, facts: DataFrame, artifacts: DataFrame, order: tuple[str, ...] = (), cohort: dict | None = None, members: DataFrame | None = None, recipe_id: str | None = None, snapshot_id: str | None = None, **scope: str
) -> Plan:
    """Records of a builder annotated, each once, split and named.

    ``facts`` and ``artifacts`` are the scope's; ``members`` of a cohort place their runs by time within their slice and
    task type, all other records go by the hash of their guard key.
    """
    recipe_id, snapshot_id = recipe_id or f"recipe.{builder}.v1", snapshot_id or f"ds_{uuid.uuid4().hex}"
    rows = distinct(annotate(records, fields), *order)
    key = guard(rows.drop("copies"))
    if members is not None:
        placed = cohort_splits(members, facts).groupBy(F.col("run_id").alias("_run")).agg(F.max(F.struct("split", "guard")).alias("_placed"))
        rows = rows.withColumn("_run", record_run(rows)).withColumn("_key", key).join(placed, "_run", "left")
        rows = rows.withColumns({"split_guard_key": F.coalesce("_placed.guard", "_key"), "split": F.coalesce("_placed.split", hash_split(F.col("_key")))}).drop("_run", "_key", "_placed")
    else:
        rows = rows.withColumn("split_guard_key", key).withColumn("split", hash_split(F.col("split_guard_key")))
    rows = rows.withColumns({"dataset_recipe_id": F.lit(recipe_id), "dataset_snapshot_id": F.lit(snapshot_id)})
    if cohort and cohort.get("cohort_id"):
        rows = rows.withColumn("cohort_id", F.lit(cohort["cohort_id"]))
        scope = scope | {"cohort_id": cohort["cohort_id"]}
    return Plan(builder, rows, blockers(builder, records, fields, artifacts, cohort), facts, artifacts, recipe_id, snapshot_id, scope)


def write(export: Plan, path: str) -> dict:
    """Write an export and return its description, which is written as well; while blockers stand nothing is written.

    Below ``path``: ``records`` by split, ``lists`` and ``distributions`` as rows, ``manifest`` as one row of JSON.
    """
    if found := export.blocked_by():
        raise ValueError("export is blocked: " + "; ".join(found))
    spark, seen = export.records.sparkSession, Observation()
    split = lambda s: F.count_if(F.col("split") == s)
    guarded = F.startswith(F.col("split_guard_key"), F.lit("task_instance_key:"))
    observed = export.records.observe(seen, F.count("*").alias("records"), F.sum("copies").alias("input"), split("train").alias("train"), split("val").alias("val"), split("test").alias("test"), F.count_if(~guarded).alias("fallback"))
    observed.write.partitionBy("split").mode("errorifexists").json(f"{path}/records")
    counts = seen.get
    written = spark.read.json(f"{path}/records", schema=export.records.drop("split").schema.add("split", "string"))
    lists(written, export.facts, export.artifacts).write.json(f"{path}/lists")
    distributions(written).write.json(f"{path}/distributions")
    sizes = {r.name: r.n for r in spark.read.json(f"{path}/lists", schema="name string, value string").groupBy("name").agg(F.count("*").alias("n")).collect()}  # a row for each list
    range_ = export.facts.agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.count("*").alias("facts")).first()
    n, given = int(counts["records"] or 0), int(counts["input"] or 0)
    manifest = {
        "dataset_snapshot_id": export.snapshot_id, "dataset_recipe_id": export.recipe_id, "builder": export.builder, "sample_unit": UNITS.get(export.builder, "fact"), "created_at": datetime.datetime.now(datetime.timezone.utc).isoformat(),
        "cohort_id": export.scope.get("cohort_id"), "session_id": export.scope.get("session_id"), "run_id": export.scope.get("run_id"), "scope_mode": "cohort" if export.scope.get("cohort_id") else "preview",
        "record_count": n, "ready": n > 0, "blockers": [], "output_path": path, "time_range_start": str(range_.start) if range_.start else None, "time_range_end": str(range_.end) if range_.end else None, "fact_count": range_.facts,
        "artifact_count": sizes.get("artifact_ids", 0), "source_runs": sizes.get("source_run_ids", 0), "source_sessions": sizes.get("source_session_ids", 0), "task_instances": sizes.get("task_instance_keys", 0),
        "task_templates": sizes.get("task_template_hashes", 0), "taxonomy_versions": sizes.get("taxonomy_versions", 0),
        "split_rule": "cohort_split.v1" if export.scope.get("cohort_id") else "hash_split.v1", "split_train": int(counts["train"] or 0), "split_val": int(counts["val"] or 0), "split_test": int(counts["test"] or 0), "distinct_guard_keys": sizes.get("guard_keys", 0),
        "guard_priority": list(GUARDS[0][1]), "guard_fallback_used": bool(counts["fallback"]), "dedupe_rule": "exact_dedupe.v1", "dedupe_input": given, "dedupe_output": n, "duplicates_removed": given - n, "near_duplicate_key": "task_template_hash",
    }
    kinds = {bool: "boolean", int: "long", list: "array<string>"}
    schema = ", ".join(f"{k} {kinds.get(type(v), 'string')}" for k, v in manifest.items())
    spark.createDataFrame([tuple(manifest.values())], schema).coalesce(1).write.json(f"{path}/manifest")  # one row
    return manifest
