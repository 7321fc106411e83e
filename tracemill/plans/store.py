"""Derived tables that are computed once and read back."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str | None:
    """The folder in ``spark.checkpoint.dir``; a temporary one in a local session; else none."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and spark.sparkContext.master.startswith("local"):
        base = "file://" + os.path.join(tempfile.gettempdir(), "checkpoints")
    return base.rstrip("/") if base else None


def stored(df: DataFrame, by: str) -> DataFrame:
    """``df`` written to the shared folder, bucketed by a key, so that joins and windows on it need no shuffle.

    Where there is no shared folder it stays a plan.
    """
    spark = df.sparkSession
    base = shared_folder(spark)
    if base is None:
        return df
    name, buckets = f"derived_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartition(buckets, by).write.bucketBy(buckets, by).sortBy(by).option("path", f"{base}/{name}").saveAsTable(name)
    return spark.table(name)
