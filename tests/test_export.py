"""Scopes and exports: frozen views, equal records, guard keys, blockers, written files."""

import datetime
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from tracemill.operators import export, scope
from tracemill.operators.artifacts import E1_FIELDS

DAY = lambda n: datetime.datetime(2024, 1, n)
ARTIFACT = "artifact_id string, artifact_type string, status string, target_ref string, run_id string, session_id string, created_at timestamp"


def scoped(spark):
    facts = spark.createDataFrame([("f1", "r1"), ("f2", "r2"), ("f3", "r3")], "fact_id string, run_id string")
    branches = spark.createDataFrame([("r1", "br_main"), ("r1", "br_x"), ("r3", "br_y")], "run_id string, branch_id string")
    rows = [
        ("own", "run:zz", "r1", "s1", 1), ("at_run", "run:r1", None, "s1", 1), ("at_session", "session:s1", None, "s1", 1), ("at_fact", "fact:f1", "r9", "s1", 1), ("at_branch", "branch:br_x", None, "s1", 1), ("bare", "note", None, "s1", 1),
        ("late", "run:r1", "r1", "s1", 9), ("other_run", "run:r2", "r2", "s1", 1), ("other_fact", "fact:f3", None, "s1", 1), ("other_kind", "slice:x", None, "s1", 1), ("other_session", "run:r1", "r1", "s2", 1), ("timeless", "run:r1", None, "s1", None), ("bare_run", "note", "r9", "s1", 1),
    ]
    artifacts = spark.createDataFrame([(i, "note", "active", t, r, s, d and DAY(d)) for i, t, r, s, d in rows], ARTIFACT)
    return facts, branches, artifacts


def test_cohorts_see_what_was_there(spark):
    facts, branches, artifacts = scoped(spark)
    members = spark.createDataFrame([("live", "r1", "s1", None), ("frozen", "r1", "s1", ["late", "other_run", ""]), ("frozen", "r2", "s1", [])], "cohort_id string, run_id string, session_id string, frozen_artifact_ids array<string>")
    cohorts = spark.createDataFrame([("live", DAY(5)), ("frozen", DAY(5))], "cohort_id string, created_at timestamp")
    got = {}
    for r in scope.cohort_artifacts(members, cohorts, facts, branches, artifacts).collect():
        got.setdefault(r.cohort_id, []).append(r.artifact_id)
    assert sorted(got["frozen"]) == ["late", "other_run"]  # just those, whenever made
    assert sorted(got["live"]) == ["at_branch", "at_fact", "at_run", "at_session", "bare", "bare_run", "own", "timeless"]
    assert sorted((r.cohort_id, r.fact_id) for r in scope.cohort_facts(members, facts).collect()) == [("frozen", "f1"), ("frozen", "f2"), ("live", "f1")]
    later = artifacts.withColumn("artifact_id", F.concat(F.lit("after_"), "artifact_id")).withColumn("created_at", F.lit(DAY(6)))
    again = scope.cohort_artifacts(members, cohorts, facts, branches, artifacts.union(later)).groupBy("cohort_id").count().collect()
    assert {r.cohort_id: r["count"] for r in again} == {"frozen": 2, "live": 8}


def test_what_a_new_cohort_freezes(spark):
    facts, branches, artifacts = scoped(spark)
    candidates = spark.createDataFrame([("r1", "s1"), ("r3", "s1")], "run_id string, session_id string")
    got = {r.run_id: r.frozen_artifact_ids for r in scope.frozen_ids(candidates, facts, branches, artifacts, F.lit(DAY(5))).collect()}
    assert got == {"r1": ["at_branch", "at_fact", "at_run", "at_session", "bare", "own", "timeless"], "r3": ["at_session", "bare", "other_fact"]}


def test_what_a_run_shows(spark):
    _, _, artifacts = scoped(spark)
    runs = spark.createDataFrame([("r1", "s1"), ("r2", "s1")], "run_id string, session_id string")
    got = {}
    for r in scope.run_artifacts(artifacts, runs).collect():
        got.setdefault(r.scope_run, []).append(r.artifact_id)
    shared = ["at_branch", "at_session", "bare", "other_fact", "other_kind"]
    assert sorted(got["r1"]) == sorted([*shared, "own", "at_run", "late", "timeless"]) and sorted(got["r2"]) == sorted([*shared, "other_run"])


FIELDS = "run_id string, session_id string, " + ", ".join(f"{f} {'double' if f in ('verifier_score', 'quality_confidence') else 'string'}" for f in E1_FIELDS) + ", missing long, ready boolean"


def fields_of(spark, rows):
    values = lambda run, given: [given.get(f, 0.5 if f in ("verifier_score", "quality_confidence") else f"{f}_1") for f in E1_FIELDS]
    full = [(run, "s", *values(run, given)) for run, given in rows.items()]
    return spark.createDataFrame([(*r, sum(v is None for v in r[2:]), None not in r[2:]) for r in full], FIELDS)


RECORD = "run_id string, session_id string, request_id string, prompt string, completion string, lineage struct<builder:string,request_id:string>"


def records_of(spark, rows):
    return spark.createDataFrame([(run, "s", q, p, c, ("sft", q)) for run, q, p, c in rows], RECORD)


@pytest.fixture
def made(spark):
    records = records_of(spark, [("r1", "q1", "p", "c"), ("r1", "q2", "p", "c"), ("r2", "q3", "p", "c"), ("r2", "q4", "p", "d"), ("r9", "q5", "p", "c"), (None, "q6", "x", "y")])
    fields = fields_of(spark, {"r1": {"task_instance_key": "i1"}, "r2": {"task_instance_key": "i2", "task_type": "t2"}})
    facts = spark.createDataFrame([("r1", "s", DAY(1)), ("r2", "s", DAY(3))], "run_id string, session_id string, ts timestamp")
    artifacts = spark.createDataFrame([("a1", "note", "active", "run:r1", "r1", "s", DAY(1))], ARTIFACT)
    return records, fields, facts, artifacts


def split_of(key):
    n = int(hashlib.sha256(key.encode()).hexdigest()[:8], 16) % 100
    return "train" if n < 80 else "val" if n < 90 else "test"


def test_planned_and_written(spark, made, tmp_path):
    records, fields, facts, artifacts = made
    planned = export.plan("sft", records, fields, facts, artifacts, order=("request_id",), snapshot_id="ds_1", session_id="s")
    got = {r.request_id: r for r in planned.records.collect()}
    assert set(got) == {"q1", "q3", "q4", "q5", "q6"} and got["q1"].copies == 2  # q2 says what q1 says; q3 and q5 are other tasks
    assert got["q1"].split_guard_key == "task_instance_key:i1" and got["q5"].split_guard_key == "run_id:r9" and got["q6"].split_guard_key == "session_id:s"
    assert all(r.split == split_of(r.split_guard_key) for r in got.values()) and got["q3"].split == got["q4"].split
    assert (got["q4"].task_type, got["q4"].evidence_level, got["q5"].annotation, got["q5"].evidence_level) == ("t2", "E1", None, None)
    assert {(r.dataset_recipe_id, r.dataset_snapshot_id) for r in got.values()} == {("recipe.sft.v1", "ds_1")}
    manifest = export.write(planned, str(tmp_path / "out"))
    lines = [json.loads(line) for f in (tmp_path / "out/records").rglob("part-*.json") for line in f.read_text().splitlines()]
    assert sorted(r["request_id"] for r in lines) == ["q1", "q3", "q4", "q5", "q6"] and {p.name for p in (tmp_path / "out/records").iterdir() if p.is_dir()} == {f"split={r.split}" for r in got.values()}
    stored = json.loads(next((tmp_path / "out/manifest").glob("part-*.json")).read_text())
    assert {k: v for k, v in manifest.items() if v is not None} == stored
    splits = [sum(r.split == s for r in got.values()) for s in ("train", "val", "test")]
    assert [stored[k] for k in ("record_count", "duplicates_removed", "fact_count", "artifact_count", "source_runs", "task_instances", "split_train", "split_val", "split_test", "distinct_guard_keys", "guard_fallback_used", "time_range_end")] == [5, 1, 2, 1, 2, 2, *splits, 4, True, "2024-01-03 00:00:00"]
    names = spark.read.json(str(tmp_path / "out/lists"))
    assert sorted(r.value for r in names.where("name = 'guard_keys'").collect()) == ["run_id:r9", "session_id:s", "task_instance_key:i1", "task_instance_key:i2"]
    counts = {(r.name, r.value): r.records for r in spark.read.json(str(tmp_path / "out/distributions")).collect()}
    assert counts["task_type", "t2"] == 2 and counts["task_type", "task_type_1"] == 1 and counts["source_channel", "source_channel_1"] == 3
    with pytest.raises(Exception):
        export.write(planned, str(tmp_path / "out"))


def test_cohorts_split_by_time_and_name_themselves(spark, made):
    _, _, _, artifacts = made
    runs = [f"r{i:02}" for i in range(12)]
    records = records_of(spark, [(r, f"q{r}", r, "c") for r in runs] + [("else", "q", "p", "c")])
    fields = fields_of(spark, {r: {"task_instance_key": f"i{r}"} for r in [*runs, "else"]})
    facts = spark.createDataFrame([(r, "s", DAY(1 + i)) for i, r in enumerate(runs)] + [("else", "s", DAY(1))], "run_id string, session_id string, ts timestamp")
    members = spark.createDataFrame([(r, "slice", None, f"i{r}") for r in runs], "run_id string, slice_id string, task_type string, task_instance_key string")
    planned = export.plan("sft", records, fields, facts, artifacts, order=("request_id",), cohort={"cohort_id": "c", "expected_use": "training", "sample_unit": "run"}, members=members)
    got = {r.run_id: (r.split, r.split_guard_key, r.cohort_id) for r in planned.records.collect()}
    assert [got[r][0] for r in runs] == ["train"] * 10 + ["val", "test"] and got["r00"][1:] == ("ir00", "c") and got["else"][1] == "task_instance_key:ielse"
    assert planned.blocked_by() == []


def test_blockers(spark, made, tmp_path):
    records, fields, facts, artifacts = made
    lacking = fields.union(fields_of(spark, {"r3": {"task_type": None, "verifier_score": None}}))
    none = records.where(F.lit(False))
    plan = lambda builder, rows=records, notes=fields, arts=artifacts, **more: export.plan(builder, rows, notes, facts, arts, order=("request_id",), **more)
    missing = "run r3 missing E1 annotations: task_type, verifier_score"
    assert plan("sft").blocked_by() == [] and plan("sft", notes=lacking).blocked_by() == [missing]
    assert plan("sft", none).blocked_by() == ["no successful model response pairs found for SFT"] and plan("facts", none, lacking).blocked_by() == ["no facts found"]
    scores = artifacts.withColumn("artifact_type", F.lit("score"))
    assert plan("binary_rl", notes=lacking).blocked_by() == [missing, "no active score/reward artifacts found for binary RL"]
    assert plan("binary_rl", none, arts=scores).blocked_by() == ["active binary RL artifacts did not contain numeric rewards"] and plan("binary_rl", arts=scores).blocked_by() == []
    assert plan("preference", none, arts=artifacts.withColumn("artifact_type", F.lit("ranking"))).blocked_by() == ["active preference artifacts did not resolve to known branches"]
    cohort = {"cohort_id": "c", "review_required": True, "expected_use": "evaluation", "sample_unit": "branch"}
    want = ["cohort has pending review queue items", "cohort expected_use=evaluation is not exportable as a training dataset snapshot", "builder sample_unit is incompatible with cohort slice contract: builder=request, cohort=branch"]
    assert plan("sft", cohort=cohort).blocked_by() == want and plan("facts", cohort=cohort).blocked_by() == want[:1]
    with pytest.raises(ValueError, match="missing E1"):
        export.write(plan("sft", notes=lacking), str(tmp_path / "no"))
    assert not (tmp_path / "no").exists()


def test_guard_keys_of_all_kinds(spark):
    rows = [('{"run_id": "", "target": {"branch_id": "b"}, "lineage": {"artifact_id": "a"}}', "target.branch_id:b"), ('{"target": {}, "lineage": {"target_ref": "t"}}', "lineage.target_ref:t"), ('{"fact_id": "f", "session_id": "s"}', "session_id:s")]
    schema = "run_id string, session_id string, fact_id string, target struct<run_id:string,branch_id:string>, lineage struct<artifact_id:string,target_ref:string>"
    table = spark.createDataFrame([(t, w) for t, w in rows] + [("{}", None)], "t string, want string").select(F.from_json("t", schema).alias("r"), "want").select("r.*", "want")
    got = table.select(export.guard(table.drop("want")).alias("g"), "want").collect()
    assert all(r.g == r.want for r in got if r.want) and [len(r.g) for r in got if not r.want] == [64]
