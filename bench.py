"""Seconds of the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS], as one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession

from tracemill.plans.model import Model
from tracemill.plans.registry import QUERIES

HEADLINE = (
    "session_inspect_summary", "request_spans", "branches", "branch_pairs", "branch_inspect_summaries", "resolve_e1", "e1_candidates", "binary_rl_records", "preference_records",
    "sft_conversations", "dedupe_keep_first", "temporal_split", "holdout_tail", "scorecard", "workflow_runs", "dashboard_overview", "training_lineage", "secret_counts",
)


def main() -> None:
    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.driver.memory", "8g").config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES[HEADLINE[0]](spark, folder).write.format("noop").mode("overwrite").save()  # compiles code
    Model.forget(spark, folder)
    began = time.perf_counter()
    Model.of(spark, folder).branches.count()  # writes facts, spans, assignments and branches, which the queries read
    took = {"model_tables": round(time.perf_counter() - began, 3)}
    for name in HEADLINE:
        began = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    spark.stop()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
