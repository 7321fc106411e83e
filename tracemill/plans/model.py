"""The derived tables of a folder of plain tables.

Facts, spans and branches, from which everything else is made, are computed once for each folder and session
and read back from the shared folder, bucketed by run. The rest are plans.

Most joins are on the run and something of it. Spark deals both sides anew by all of these keys unless
``spark.sql.requireAllClusterKeysForCoPartition`` is off, so a model turns that off in its session: rows that lie by
run stay where they are, and no run's rows are more than the windows over a run bring together anyway.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.operators import artifacts, branches, builders, curation, governance, records, spans
from tracemill.plans.store import stored
from tracemill.sources import tables, wire


class Model:
    """Facts and artifacts of a folder with what is derived from them."""

    _known: dict[tuple[str, str], Model] = {}

    @classmethod
    def of(cls, spark: SparkSession, folder: str) -> Model:
        """The model of a folder in this application; ``forget`` it when the tables change."""
        key = (spark.sparkContext.applicationId, folder)
        if key not in cls._known:
            cls._known[key] = cls(spark, folder)
        return cls._known[key]

    @classmethod
    def forget(cls, spark: SparkSession, folder: str) -> None:
        cls._known.pop((spark.sparkContext.applicationId, folder), None)

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")

    def table(self, name: str) -> DataFrame:
        return tables.table(self.spark, self.folder, name)

    @cached_property
    def facts(self) -> DataFrame:
        return stored(tables.facts_from_events(self.table("events")), "run_id")

    @cached_property
    def artifacts(self) -> DataFrame:
        return tables.artifacts_from_facts(self.facts)

    @cached_property
    def spans(self) -> DataFrame:
        return stored(spans.request_spans(self.facts), "run_id")

    @cached_property
    def assigned(self) -> DataFrame:
        return stored(branches.assign(self.facts, self.spans), "run_id")

    @cached_property
    def branches(self) -> DataFrame:
        return stored(branches.infer_branches(self.facts, self.assigned), "run_id")

    @cached_property
    def pairs(self) -> DataFrame:
        return branches.branch_pairs(self.branches)

    @cached_property
    def fields(self) -> DataFrame:
        return artifacts.resolve_e1(self.facts, self.artifacts)

    @cached_property
    def candidates(self) -> DataFrame:
        return artifacts.candidates(self.facts, self.artifacts)

    @cached_property
    def records(self) -> DataFrame:
        return builders.binary_rl(self.facts, self.branches, self.artifacts)

    @cached_property
    def feedback(self) -> DataFrame:
        """Queued feedback: superseded annotations ask for another look at their run."""
        return self.artifacts.where("artifact_type = 'annotation' and run_id is not null and status = 'superseded'").select("run_id", F.lit("superseded_annotation").alias("reason"), F.lit("queued").alias("status"), F.col("created_at").alias("ts"), "seq")

    @cached_property
    def slices(self) -> DataFrame:
        return governance.slices(self.fields)

    @cached_property
    def members(self) -> DataFrame:
        """Members of one cohort for each task family: candidates within their instance's quota. Few rows with a long plan, which scopes read many times."""
        free = curation.quotas(self.candidates).where("holdout_reason is null")
        return stored(governance.with_slices(free, self.slices).withColumn("cohort_id", F.concat(F.lit("cohort_"), "task_family")), "run_id")

    # exchanges with bodies, from conversations
    @cached_property
    def exchange_facts(self) -> DataFrame:
        return stored(wire.facts_from_conversations(self.table("conversations")), "run_id")

    @cached_property
    def exchange_artifacts(self) -> DataFrame:
        return wire.artifacts_from_exchanges(wire.exchanges(self.table("conversations")))

    @cached_property
    def exchange_assigned(self) -> DataFrame:
        return branches.assign(self.exchange_facts, spans.request_spans(self.exchange_facts))

    @cached_property
    def exchange_branches(self) -> DataFrame:
        return branches.infer_branches(self.exchange_facts, self.exchange_assigned)

    @cached_property
    def request_records(self) -> DataFrame:
        return stored(records.requests(self.exchange_facts, self.exchange_assigned), "run_id")

    @cached_property
    def branch_records(self) -> DataFrame:
        return records.branch_records(self.request_records, self.exchange_branches)

    @cached_property
    def run_records(self) -> DataFrame:
        return records.run_records(self.request_records, self.branch_records)
