"""Which facts and artifacts belong to a cohort, a candidate or a run.

The rules are disjunctions over an artifact's run, session and target. Each artifact lays out the keys by which it
could belong, each scope the keys that it has, and one equi-join on (scope, kind, value) decides: no pair of an artifact
and a scope is looked at that does not share a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.functions.scalars import target_kind, target_value


def _key(kind: str | Column, value: str | Column) -> Column:
    return F.struct((F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), (F.col(value) if isinstance(value, str) else value).alias("value"))


def _keys(*keys: Column) -> Column:
    return F.filter(F.array(*keys), lambda k: k["value"].isNotNull())


def _scope_keys(members: DataFrame, facts: DataFrame, branches: DataFrame, by: str) -> DataFrame:
    """Rows (by, kind, value) of the runs, sessions, facts and branches of each scope."""
    runs = members.select(by, "run_id").distinct()
    own = members.select(by, F.explode(F.array(_key("run", "run_id"), _key("session", "session_id"))).alias("k")).select(by, "k.*")
    of = lambda rows, kind, name: rows.join(runs, "run_id").select(by, F.lit(kind).alias("kind"), F.col(name).alias("value"))
    return own.unionByName(of(facts.select("run_id", "fact_id"), "fact", "fact_id")).unionByName(of(branches.select("run_id", "branch_id"), "branch", "branch_id")).distinct()


def _held(candidates: DataFrame, keys: DataFrame, by: str, rule: Column) -> DataFrame:
    """Candidates one of whose keys (``rule``) their scope has, each once."""
    laid = candidates.select(by, "artifact_id", F.explode(rule).alias("k")).select(by, "artifact_id", "k.*")
    return laid.join(keys, [by, "kind", "value"], "left_semi").select(by, "artifact_id").distinct()


def cohort_facts(members: DataFrame, facts: DataFrame) -> DataFrame:
    """(cohort_id, facts) of the runs of each cohort's members."""
    return facts.join(members.select("cohort_id", "run_id").distinct(), "run_id")


def cohort_artifacts(members: DataFrame, cohorts: DataFrame, facts: DataFrame, branches: DataFrame, artifacts: DataFrame) -> DataFrame:
    """(cohort_id, artifacts) as each cohort was frozen.

    ``members`` has cohort_id, run_id, session_id and frozen_artifact_ids (an array, or null); ``cohorts`` cohort_id and
    created_at. A cohort with frozen ids has just those. Else it has the artifacts of its sessions that were there when it
    was made (or whose time is unknown) and that are of its runs, or aim at one of its runs, sessions, facts or branches;
    without a kind of target, those of its sessions.
    """
    frozen = members.select("cohort_id", F.explode("frozen_artifact_ids").alias("artifact_id")).where("artifact_id <> ''").distinct()
    by_id = frozen.join(artifacts, "artifact_id")
    live = cohorts.select("cohort_id", F.col("created_at").alias("_made")).join(frozen.select("cohort_id").distinct(), "cohort_id", "left_anti")
    sessions = members.select("cohort_id", "session_id").distinct().join(live, "cohort_id")
    there = F.coalesce(F.col("created_at") <= F.col("_made"), F.lit(True))
    candidates = artifacts.join(sessions, "session_id").where(there)
    kind = target_kind(F.col("target_ref"))
    aimed = F.when(kind == "", "session").when(kind.isin("run", "session", "fact", "branch"), kind)
    rule = _keys(_key("run", "run_id"), _key(F.coalesce(aimed, F.lit("none")), F.when(kind == "", F.col("session_id")).when(aimed.isNotNull(), target_value(F.col("target_ref")))))
    held = _held(candidates, _scope_keys(members.join(live.select("cohort_id"), "cohort_id", "left_semi"), facts, branches, "cohort_id"), "cohort_id", rule)
    by_rule = held.join(artifacts, "artifact_id")
    return by_id.unionByName(by_rule.select(*by_id.columns))


def frozen_ids(candidates: DataFrame, facts: DataFrame, branches: DataFrame, artifacts: DataFrame, now: Column) -> DataFrame:
    """(run_id, frozen_artifact_ids) that a cohort made now keeps for each of its runs, ordered, of live artifacts (``scans.live``).

    An artifact of the run's session counts by its target alone if that is a fact or a branch; else if it is of the run, or
    aims at the run or the session, or at nothing of a kind while it has no run.
    """
    live = artifacts.where(F.coalesce(F.col("created_at") <= now, F.lit(True)))
    runs = candidates.select("run_id", "session_id").distinct().withColumn("scope", F.col("run_id"))
    kind, value = target_kind(F.col("target_ref")), target_value(F.col("target_ref"))
    near = live.withColumnRenamed("run_id", "_own").join(runs.select("scope", "session_id"), "session_id")
    exact = kind.isin("fact", "branch")
    bare = (kind == "") & F.col("_own").isNull()
    rule = F.when(exact, _keys(_key(kind, value))).otherwise(_keys(_key("run", "_own"), _key(F.when(kind.isin("run", "session"), kind).otherwise("none"), value), _key("session", F.when(bare, F.col("session_id")))))
    held = _held(near, _scope_keys(runs, facts, branches, "scope"), "scope", rule)
    return held.groupBy(F.col("scope").alias("run_id")).agg(F.sort_array(F.collect_set("artifact_id")).alias("frozen_artifact_ids"))


def run_artifacts(artifacts: DataFrame, runs: DataFrame) -> DataFrame:
    """(artifacts, scope_run) that a view of each run (run_id, session_id) shows, of live artifacts of its session.

    Those of the run or that aim at it, and those of no run unless they aim at a run.
    """
    own = artifacts.withColumn("_k", F.explode(F.array_distinct(F.array_compact(F.array("run_id", F.when(target_kind(F.col("target_ref")) == "run", target_value(F.col("target_ref"))))))))
    of_run = own.join(runs.select(F.col("run_id").alias("_k"), "session_id"), ["_k", "session_id"]).withColumnRenamed("_k", "scope_run")
    shared = artifacts.where(F.col("run_id").isNull() & (target_kind(F.col("target_ref")) != "run")).join(runs.select(F.col("run_id").alias("scope_run"), "session_id"), "session_id")
    return of_run.select(*artifacts.columns, "scope_run").unionByName(shared.select(*artifacts.columns, "scope_run"))
