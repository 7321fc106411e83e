"""Dataset builders: facts, supervised, preference and binary-reward records, with a registry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracemill.functions.scalars import target_kind, target_value
from tracemill.operators.scans import in_order

#: Artifact types that state a reward, and those that state a preference.
REWARD_TYPES = ("score", "reward", "binary_label", "label")
PREFERENCE_TYPES = ("preference", "preference_pair", "chosen_rejected", "ranking")
SAMPLE_UNITS = {"sft": ("request", "run"), "preference": ("branch",), "binary_rl": ("run",), "facts": ("request", "branch", "run")}


def sft(facts: DataFrame) -> DataFrame:
    """One record for each answered model request, joined over the whole scope."""
    asked = facts.where("kind = 'request_started' and actor = 'model'").select(F.col("fact_id").alias("request_fact_id"), "run_id", "session_id", "request_id", "path", "fingerprint")
    answered = facts.where("kind = 'response_finished' and actor = 'model'").select(F.col("parent_ref").alias("request_fact_id"), F.col("fact_id").alias("response_fact_id"), "status_code")
    return asked.join(answered, "request_fact_id")


def sft_conversations(turns: DataFrame) -> DataFrame:
    """Prompt of all earlier turns and the completion, for every assistant turn that has a prompt."""
    earlier = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    message = F.concat_ws(": ", "role", "text")
    rows = turns.withColumns({"prompt": F.array_join(F.collect_list(message).over(earlier), "\n"), "messages": F.count("*").over(earlier)})
    return rows.where("role = 'assistant' and messages > 0").select("conv_id", "turn", "messages", "prompt", F.col("text").alias("completion"))


def preference(branches: DataFrame, artifacts: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs from active preference artifacts whose branches exist; inferred pairs if there are none at all."""
    known = branches.select("run_id", "branch_id").distinct()
    stated = artifacts.where(F.col("artifact_type").isin(*PREFERENCE_TYPES) & (F.col("status") == "active")).select("artifact_id", "run_id", F.col("chosen_branch_id").alias("chosen"), F.col("rejected_branch_id").alias("rejected"), "confidence")
    for side in ("chosen", "rejected"):
        stated = stated.join(known.withColumnRenamed("branch_id", side), ["run_id", side], "left_semi")
    stated = stated.where("chosen <> rejected").select("run_id", "chosen", "rejected", F.lit("artifact").alias("source"), "artifact_id")
    any_stated = stated.agg((F.count("*") > 0).alias("any"))
    inferred = pairs.crossJoin(F.broadcast(any_stated)).where("not any")  # one row
    return stated.unionByName(inferred.select("run_id", "chosen", "rejected", "source", F.lit(None).cast("string").alias("artifact_id")))


def reward(artifacts: DataFrame):
    """Number of a reward-like artifact: its score, else its label as 0 or 1."""
    return F.coalesce(F.col("score"), F.when(F.col("label"), 1.0).when(~F.col("label"), 0.0))


def binary_rl(facts: DataFrame, branches: DataFrame, artifacts: DataFrame) -> DataFrame:
    """A record for each active reward on a fact, branch, run or session that exists."""
    active = artifacts.where(F.col("artifact_type").isin(*REWARD_TYPES) & (F.col("status") == "active"))
    rows = active.select("artifact_id", "run_id", "session_id", target_kind(F.col("target_ref")).alias("unit"), target_value(F.col("target_ref")).alias("target"), reward(artifacts).alias("reward")).where("reward is not null")
    on = lambda unit: rows.where(F.col("unit") == unit)
    fact_rows = on("fact").drop("run_id").join(facts.select(F.col("fact_id").alias("target"), "run_id"), "target")
    branch_rows = on("branch").join(branches.select("run_id", F.col("branch_id").alias("target")).distinct(), ["run_id", "target"])
    runs = facts.select(F.col("run_id").alias("target")).distinct()
    run_rows = on("run").join(runs, "target").withColumn("run_id", F.col("target"))
    session_rows = on("session").join(facts.select(F.col("session_id").alias("target")).distinct(), "target")
    columns = ("artifact_id", "unit", "target", "run_id", "reward")
    out = fact_rows.select(*columns)
    for more in (branch_rows, run_rows, session_rows):
        out = out.union(more.select(*columns))
    return out


def run_trajectories(spans: DataFrame) -> DataFrame:
    """Nested record per run: its requests in order."""
    step = F.struct("seq", "request_id", "actor", "outcome", "latency_ms")
    return spans.groupBy("run_id").agg(F.array_sort(F.collect_list(step)).alias("steps"))


def first_and_last(spans: DataFrame) -> DataFrame:
    """Per run the first prompt fingerprint and the last request with an end."""
    ended = F.when(F.col("outcome") != "open", in_order())
    return spans.groupBy("run_id").agg(F.min_by("fingerprint", F.when(F.col("fingerprint").isNotNull(), in_order())).alias("first_prompt"), F.max_by("request_id", ended).alias("terminal_request"))


_BUILDERS: dict[str, Callable[..., DataFrame]] = {}
_ALIASES: dict[str, str] = {}


def register(name: str, builder: Callable[..., DataFrame], aliases: tuple[str, ...] = (), replace: bool = False) -> None:
    """Make a builder (a callable of DataFrames that returns one) known by name."""
    if name in _BUILDERS and not replace:
        raise ValueError(f"builder {name} is registered already")
    _BUILDERS[name] = builder
    _ALIASES.update({a: name for a in aliases})


def unregister(name: str) -> None:
    _BUILDERS.pop(name, None)
    for alias in [a for a, n in _ALIASES.items() if n == name]:
        del _ALIASES[alias]


def get(name: str) -> Callable[..., DataFrame]:
    try:
        return _BUILDERS[_ALIASES.get(name, name)]
    except KeyError:
        raise ValueError(f"unknown builder {name}") from None


def names() -> list[str]:
    return sorted(_BUILDERS)


register("facts", lambda facts, **_: facts)
register("sft", lambda facts, **_: sft(facts))
register("preference", lambda branches, artifacts, pairs, **_: preference(branches, artifacts, pairs))
register("binary_rl", lambda facts, branches, artifacts, **_: binary_rl(facts, branches, artifacts), aliases=("binary-rl",))
