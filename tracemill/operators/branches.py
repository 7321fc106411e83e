"""Branches of a run, declared or inferred, and comparable branch pairs, as joins and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.operators.scans import in_order

SIGNATURE = ("actor", "path", "user_id", "thread_id", "task_id", "fingerprint")


def _hints(facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(open hints, close hints) of semantic facts."""
    kind = F.coalesce(
        F.col("hint_branch_type"),
        F.when(F.col("semantic_kind") == "retry_declared", "retry").when(F.col("semantic_kind") == "fallback_declared", "fallback").when(F.col("semantic_kind") == "subagent_declared", "subagent"),
    )
    hints = facts.where("kind = 'semantic_event'").select("run_id", "ts", "seq", "semantic_kind", "target_fact_id", "target_request_id", kind.alias("hint_type"), "hint_branch_id", "hint_status", "hint_parent_branch_id", "hint_parent_fact_id", "hint_parent_request_id")
    closing = F.col("semantic_kind") == "branch_close_declared"
    return hints.where(~closing & F.coalesce("target_fact_id", "target_request_id").isNotNull() & F.col("hint_type").isNotNull()), hints.where(closing)


def _first(hints: DataFrame, key: str, name: str) -> DataFrame:
    """The first hint in fact order for every (run, key)."""
    fields = F.struct("semantic_kind", "hint_type", "hint_branch_id", "hint_status", "hint_parent_branch_id", "hint_parent_fact_id", "hint_parent_request_id", "ts", "seq")
    return hints.where(F.col(key).isNotNull()).groupBy("run_id", F.col(key).alias(name)).agg(F.min_by(fields, in_order()).alias("hint"))


def _earliest(*hints: str) -> Column:
    """Of several hints the one that comes first in fact order."""
    at = lambda h: F.struct(F.col(f"{h}.ts").alias("ts"), F.col(f"{h}.seq").alias("seq"))
    best = F.array_min(F.array_compact(F.array(*(F.when(F.col(h).isNotNull(), F.struct(at(h).alias("at"), F.col(h).alias("hint"))) for h in hints))))
    return best["hint"]


def assign(facts: DataFrame, spans: DataFrame) -> DataFrame:
    """Every request with the case it falls in, its branch and its branch's parent.

    In order: declared by a hint, type in a header, parent in a header, plain. A plain request opens a
    retry when the plain request of the same signature before it failed; else it stays on the main
    branch. Numbers count all branches opened so far in the run.
    """
    opening, _ = _hints(facts)
    by_fact = _first(opening, "target_fact_id", "request_fact_id").withColumnRenamed("hint", "fact_hint")
    by_request = _first(opening, "target_request_id", "request_id").withColumnRenamed("hint", "request_hint")
    known = spans.join(by_fact, ["run_id", "request_fact_id"], "left").join(by_request, ["run_id", "request_id"], "left").withColumn("hint", _earliest("fact_hint", "request_hint"))
    case = F.when(F.col("hint").isNotNull(), 1).when(F.col("hinted_type").isNotNull(), 2).when(F.col("hinted_parent").isNotNull(), 3).otherwise(4)
    known = known.withColumn("case", case)
    alike = Window.partitionBy("run_id", F.col("case") == 4, *SIGNATURE).orderBy("ts", "seq")
    before = F.lag(F.struct("outcome", "request_fact_id")).over(alike)
    known = known.withColumn("retried", F.when((F.col("case") == 4) & (before["outcome"] == "failed"), before["request_fact_id"]))
    opens = (F.col("case") < 4) | F.col("retried").isNotNull()
    number = F.sum(opens.cast("int")).over(Window.partitionBy("run_id").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, 0))
    kind = F.when(F.col("case") == 1, F.col("hint.hint_type")).when(F.col("case") == 2, F.col("hinted_type")).when(F.col("case") == 3, "subagent").when(F.col("retried").isNotNull(), "retry")
    named = known.select(
        "run_id", "session_id", "request_fact_id", "request_id", "ts", "seq", "outcome", "case", "hint", "retried", "hinted_parent", "response_fact_id", "error_fact_id",
        F.coalesce(kind, F.lit("mainline")).alias("branch_type"),
        F.when(opens, F.coalesce("hint.hint_branch_id", F.concat(F.lit("br_"), kind, F.lit("_"), number.cast("string")))).otherwise("br_main").alias("branch_id"),
    )
    # parents: of a fact, or of the last earlier request with an identifier
    wanted = F.when(F.col("case").isin(2, 3), F.col("hinted_parent")).when(F.col("case") == 1, F.col("hint.hint_parent_fact_id")).otherwise(F.col("retried"))
    named = named.withColumns({"wanted": wanted, "wanted_request": F.when((F.col("case") == 1) & wanted.isNull(), F.col("hint.hint_parent_request_id"))})
    parents = named.select("run_id", F.col("request_fact_id").alias("wanted"), F.col("branch_id").alias("found"), F.struct("ts", "seq").alias("found_at"))
    placed = named.join(parents, ["run_id", "wanted"], "left")
    others = named.select("run_id", F.col("request_id").alias("wanted_request"), F.struct("ts", "seq").alias("other_at"), F.col("branch_id").alias("other"))
    asked = placed.where("wanted_request is not null").select("run_id", "request_fact_id", "wanted_request", F.struct("ts", "seq").alias("own_at"))
    last = asked.join(others, ["run_id", "wanted_request"]).where("other_at < own_at").groupBy("run_id", "request_fact_id").agg(F.max_by("other", "other_at").alias("by_request"))
    placed = placed.join(last, ["run_id", "request_fact_id"], "left")
    earlier = F.when(F.col("found_at") < F.struct("ts", "seq"), F.col("found"))
    parent = F.when(F.col("branch_type") == "mainline", None).otherwise(F.coalesce("hint.hint_parent_branch_id", earlier, "by_request", F.lit("br_main")))
    return placed.withColumn("parent_branch_id", parent).drop("wanted", "found", "found_at", "wanted_request", "by_request")


def infer_branches(facts: DataFrame, assigned: DataFrame) -> DataFrame:
    """One row per opened branch and one main branch per run."""
    _, closing = _hints(facts)
    by_fact = _first(closing, "target_fact_id", "request_fact_id").withColumnRenamed("hint", "close_fact")
    by_branch = _first(closing, "hint_branch_id", "branch_id").withColumnRenamed("hint", "close_branch")
    by_request = _first(closing, "target_request_id", "request_id").withColumnRenamed("hint", "close_request")
    opened = assigned.where("branch_type <> 'mainline'").join(by_fact, ["run_id", "request_fact_id"], "left").join(by_branch, ["run_id", "branch_id"], "left").join(by_request, ["run_id", "request_id"], "left")
    ended = F.when(F.col("outcome") == "succeeded", "succeeded").otherwise("failed")
    close_status = _earliest("close_branch", "close_fact", "close_request")["hint_status"]
    status = F.when(F.col("case") == 1, F.coalesce(close_status, F.col("hint.hint_status"), ended)).otherwise(ended)
    reason = (
        F.when(F.col("case") == 1, F.concat(F.lit("semantic:"), F.col("hint.semantic_kind")))
        .when(F.col("case") == 2, "hinted_branch_type")
        .when(F.col("case") == 3, F.concat(F.lit("parent_request:"), F.col("hinted_parent")))
        .otherwise(F.concat(F.lit("retry_after:"), F.col("retried")))
    )
    source = F.when(F.col("case") == 1, "declared").otherwise("inferred")
    rows = opened.select("run_id", "session_id", "branch_id", "branch_type", "parent_branch_id", status.alias("status"), source.alias("source"), reason.alias("open_reason"), F.col("seq").alias("opened_seq"))
    main_status = F.when(F.every(F.col("outcome") == "succeeded"), "succeeded").when(F.bool_or(F.col("outcome") == "failed"), "failed").otherwise("open")
    main = assigned.groupBy("run_id").agg(F.min("session_id").alias("session_id"), main_status.alias("status"), F.min("seq").alias("opened_seq"))
    text = lambda x: F.lit(x).cast("string")
    return rows.unionByName(main.select("run_id", "session_id", F.lit("br_main").alias("branch_id"), F.lit("mainline").alias("branch_type"), text(None).alias("parent_branch_id"), "status", F.lit("inferred").alias("source"), F.lit("run_start").alias("open_reason"), "opened_seq"))


def branch_summaries(assigned: DataFrame) -> DataFrame:
    """Per (run, branch): requests in order with outcomes counted."""
    count = lambda x: F.count_if(F.col("outcome") == x)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("seq", "request_id"))), lambda x: x["request_id"])
    return assigned.groupBy("run_id", "branch_id").agg(F.count("*").alias("requests"), count("succeeded").alias("succeeded"), count("failed").alias("failed"), count("open").alias("open"), F.array_join(ordered, ",").alias("request_ids"))


def branch_pairs(branches: DataFrame) -> DataFrame:
    """Chosen and rejected branches: a child against its parent, and siblings, of different outcome."""
    b = branches.select("run_id", "branch_id", "parent_branch_id", "status").distinct()
    p = b.select("run_id", F.col("branch_id").alias("parent_branch_id"), F.col("status").alias("parent_status"))
    related = b.join(p, ["run_id", "parent_branch_id"])
    won, lost = (F.col("status") == "succeeded") & (F.col("parent_status") == "failed"), (F.col("status") == "failed") & (F.col("parent_status") == "succeeded")
    direct = related.where(won | lost).select("run_id", F.when(won, F.col("branch_id")).otherwise(F.col("parent_branch_id")).alias("chosen"), F.when(won, F.col("parent_branch_id")).otherwise(F.col("branch_id")).alias("rejected"), F.lit("parent_child_outcome").alias("source"))
    under = b.where("parent_branch_id is not null")
    good = under.where("status = 'succeeded'").select("run_id", "parent_branch_id", F.col("branch_id").alias("chosen"))
    bad = under.where("status = 'failed'").select("run_id", "parent_branch_id", F.col("branch_id").alias("rejected"))
    siblings = good.join(bad, ["run_id", "parent_branch_id"]).select("run_id", "chosen", "rejected", F.lit("sibling_outcome").alias("source"))
    return direct.union(siblings).where("chosen <> rejected").distinct()
