"""Export: exact dedupe, leakage-safe splits, distributions, manifest and files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.functions.scalars import hash_split


def keep_first(records: DataFrame, key: Column, *order: str) -> DataFrame:
    """The first record for every key."""
    hashed = records.withColumn("_key", F.sha2(key, 256))
    return hashed.groupBy("_key").agg(F.min_by(F.struct(*records.columns), F.struct(*order)).alias("r"), F.count("*").alias("copies")).select("r.*", "copies")


def split_by_hash(records: DataFrame, key: Column) -> DataFrame:
    return records.withColumn("split", hash_split(key))


def split_by_time(members: DataFrame, min_groups: int = 10) -> DataFrame:
    """Split of every (slice, task type, instance): by time where there are enough groups, else by hash.

    The last tenth of the groups is the test part and the tenth before it the validation part.
    """
    groups = members.groupBy("slice_id", "task_type", "task_instance_key").agg(F.max("latest_ts").alias("latest"), F.count("*").alias("runs"))
    over = Window.partitionBy("slice_id", "task_type")
    tenth = F.greatest(F.lit(1), F.bround(F.col("n") * 0.1, 0).cast("int"))
    ranked = groups.withColumns({"n": F.count("*").over(over), "place": F.row_number().over(over.orderBy("latest", "task_instance_key"))})
    timed = F.when(F.col("place") <= F.col("n") - 2 * tenth, "train").when(F.col("place") <= F.col("n") - tenth, "val").otherwise("test")
    return ranked.select("slice_id", "task_type", "task_instance_key", "runs", F.when(F.col("n") >= min_groups, timed).otherwise(hash_split(F.col("task_instance_key"))).alias("split"), F.when(F.col("n") >= min_groups, "time_window").otherwise("hash_fallback").alias("mode"))


def distribution(records: DataFrame, column: str) -> DataFrame:
    return records.where(F.col(column).isNotNull() & (F.col(column) != "")).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("records"))


def manifest(records: DataFrame, builder: str) -> DataFrame:
    """One row that describes an export."""
    split = lambda x: F.count_if(F.col("split") == x)
    return records.agg(F.lit(builder).alias("builder"), F.count("*").alias("records"), F.count_distinct("run_id").alias("runs"), F.count_distinct("session_id").alias("sessions"), split("train").alias("train"), split("val").alias("val"), split("test").alias("test"))


def write_export(records: DataFrame, description: DataFrame, path: str) -> None:
    """JSON lines by split, and the manifest beside them."""
    records.write.partitionBy("split").mode("errorifexists").json(f"{path}/records")
    description.coalesce(1).write.mode("errorifexists").json(f"{path}/manifest")  # one row


def comparison_records(pairs: DataFrame, test_size: int) -> DataFrame:
    """Preference pairs as (A, B, label), both orders; the first ``test_size`` pairs are the test part."""
    key = ["run_id", "chosen", "rejected", "source"]
    first = F.broadcast(pairs.select(*key).orderBy(*key).limit(test_size).withColumn("part", F.lit("test")))  # test_size rows
    numbered = pairs.join(first, key, "left")
    both = F.array(F.struct(F.col("chosen").alias("a"), F.col("rejected").alias("b"), F.lit("A").alias("label")), F.struct(F.col("rejected").alias("a"), F.col("chosen").alias("b"), F.lit("B").alias("label")))
    return numbered.select("run_id", F.coalesce("part", F.lit("train")).alias("part"), F.inline(both))
