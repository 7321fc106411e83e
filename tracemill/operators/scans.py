"""Scans of facts and artifacts: filters, scopes, newest-first lists and point look-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ORDER = ("ts", "seq")


def in_order(*columns: str) -> Column:
    """The order of facts as one comparable value."""
    return F.struct(*(columns or ORDER))


def list_facts(facts: DataFrame, **equal: str) -> DataFrame:
    """Facts of a scope, in order; at least one of session_id, request_id, run_id, task_id."""
    given = {k: v for k, v in equal.items() if v is not None}
    if not given.keys() & {"session_id", "request_id", "run_id", "task_id"}:
        raise ValueError("list_facts needs a session, request, run or task")
    for column, value in given.items():
        facts = facts.where(F.col(column) == value)
    return facts.orderBy(*ORDER)


def live(artifacts: DataFrame) -> DataFrame:
    """Artifacts that no other supersedes and that are not marked superseded."""
    newer = artifacts.where("supersedes_artifact_id is not null").select(F.col("supersedes_artifact_id").alias("artifact_id")).distinct()
    return artifacts.where("status <> 'superseded'").join(newer, "artifact_id", "left_anti")


def list_artifacts(artifacts: DataFrame, latest_only: bool = False, artifact_ids: list[str] | None = None, **equal: str) -> DataFrame:
    """Artifacts by equality filters and ids, oldest first. A status filter stands in for the marked ones."""
    if latest_only:
        newer = artifacts.where("supersedes_artifact_id is not null").select(F.col("supersedes_artifact_id").alias("artifact_id")).distinct()
        kept = artifacts if equal.get("status") is not None else artifacts.where("status <> 'superseded'")
        artifacts = kept.join(newer, "artifact_id", "left_anti")
    if artifact_ids is not None:
        artifacts = artifacts.where(F.col("artifact_id").isin(artifact_ids) if artifact_ids else F.lit(False))
    for column, value in equal.items():
        if value is not None:
            artifacts = artifacts.where(F.col(column) == value)
    return artifacts.orderBy("created_at", "seq")


def newest_first(rows: DataFrame, **equal: str) -> DataFrame:
    for column, value in equal.items():
        if value is not None:
            rows = rows.where(F.col(column) == value)
    return rows.orderBy(F.desc("created_at"), F.desc("seq"))


def latest_ids(facts: DataFrame) -> DataFrame:
    """One row: newest session, run and request id."""
    at = in_order()
    return facts.agg(
        F.max_by("session_id", at).alias("session_id"),
        F.max_by("run_id", at).alias("run_id"),
        F.max_by("request_id", F.when(F.col("request_id").isNotNull(), at)).alias("request_id"),
    )


def recency(facts: DataFrame, by: str) -> DataFrame:
    """Ids with their facts and last fact; newest first, then by id."""
    return facts.groupBy(by).agg(F.count("*").alias("facts"), F.max("ts").alias("latest"), F.max("seq").alias("last_seq"), F.min_by("session_id", in_order()).alias("first_session")).orderBy(F.desc("latest"), by)


def request_fact(facts: DataFrame) -> DataFrame:
    """First request_started of every (session, run, request)."""
    started = facts.where("kind = 'request_started'")
    return started.groupBy("session_id", "run_id", "request_id").agg(F.min_by("fact_id", in_order()).alias("fact_id"))


def resolve_target(facts: DataFrame) -> DataFrame:
    """Per session: fact of the last response, by a model if there is one."""
    done = facts.where("kind = 'response_finished'")
    return done.groupBy("session_id").agg(F.max_by("fact_id", F.struct(F.col("actor") == "model", "ts", "seq")).alias("fact_id"))


def session_owners(claims: DataFrame) -> DataFrame:
    """First claim of a session wins; number of conflicting claims."""
    first = claims.groupBy("session_id").agg(F.min_by("owner_key", in_order()).alias("owner_key"))
    other = claims.withColumnRenamed("owner_key", "claimed").join(first, "session_id")
    return other.groupBy("session_id", "owner_key").agg(F.count_if(F.col("claimed") != F.col("owner_key")).alias("conflicts"))


def upsert(old: DataFrame, new: DataFrame, key: str, keep: tuple[str, ...] = ("created_at",)) -> DataFrame:
    """New rows replace old ones by key; columns in ``keep`` stay as they were."""
    o = old.select(F.col(key), F.lit(True).alias("_old"), *(F.col(c).alias(f"_old_{c}") for c in old.columns if c != key))
    n = new.select(F.col(key), F.lit(True).alias("_new"), *(F.col(c).alias(f"_new_{c}") for c in old.columns if c != key))
    both = o.join(n, key, "full_outer")
    pick = lambda c: F.coalesce(f"_old_{c}", f"_new_{c}") if c in keep else F.when(F.col("_new"), F.col(f"_new_{c}")).otherwise(F.col(f"_old_{c}"))
    return both.select(key, *(pick(c).alias(c) for c in old.columns if c != key))


def unique_new(existing: DataFrame, new: DataFrame, *signature: str) -> DataFrame:
    """New rows whose signature is neither among existing rows nor among earlier new ones."""
    fresh = new.groupBy(*signature).agg(F.min_by(F.struct(*new.columns), in_order("created_at", "seq")).alias("r")).select("r.*")
    same = lambda a, b: a.eqNullSafe(b)
    condition = None
    other = existing.select(*(F.col(c).alias(f"_e_{c}") for c in signature)).distinct()
    for c in signature:
        one = same(F.col(c), F.col(f"_e_{c}"))
        condition = one if condition is None else condition & one
    return fresh.join(other, condition, "left_anti")


def orphan_payloads(files: DataFrame, references: DataFrame, now, grace_seconds: int = 300) -> DataFrame:
    """Managed files that nothing refers to and that are older than the grace time."""
    old = files.where(F.col("modified") < now - F.make_interval(secs=F.lit(grace_seconds)))
    return old.join(references.select("relative_path").distinct(), "relative_path", "left_anti")
