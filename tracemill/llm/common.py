"""Shared helpers of the training-data operators: shared folders, materialised tables, Arrow rows."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid

import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where the setting is missing, a local session (tests) gets a temporary folder; on a cluster that is
    an error, as executors could not see it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "checkpoints")
    return base.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder, removed when the session ends.

    The driver picks it, so executors never invent names.
    """
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _place(spark, path, lambda fs, place: fs.deleteOnExit(place))
    return path


def _place(spark: SparkSession, path: str, act) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    act(place.getFileSystem(spark._jsc.hadoopConfiguration()), place)


def materialize(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(df: DataFrame) -> None:
    """Remove the files of a materialised table that nothing reads any more."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        _place(df.sparkSession, folder, lambda fs, place: fs.delete(place, True))


def give_back() -> None:
    """Give a Python worker's free memory back to the system: workers wait beside stages that need the executor's memory."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def column_or_null(df: DataFrame, name: str, kind: str):
    """``df[name]`` cast to ``kind``, or a typed null where the table has no such column."""
    return (F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)).alias(name)


def gather(items: Column, start: dict, step, kind: str, block: int = 256) -> Column:
    """Array of what ``step(state, item)`` gives along ``items``, in time in proportion to their number.

    ``start`` names the state's first values; ``step`` returns the next state, as a dictionary of the same
    names, and what to add, of type ``kind``. Results are appended to blocks, and blocks to a list.
    """
    empty = F.array().cast(f"array<{kind}>")
    zero = F.struct(*(v.alias(n) for n, v in start.items()), empty.alias("_block"), F.array().cast(f"array<array<{kind}>>").alias("_full"))

    def run(acc, item):
        state, result = step(acc, item)
        full = F.size(acc["_block"]) >= block
        return F.struct(
            *(state[n].alias(n) for n in start),
            F.when(full, F.array(result)).otherwise(F.array_append(acc["_block"], result)).alias("_block"),
            F.when(full, F.array_append(acc["_full"], acc["_block"])).otherwise(acc["_full"]).alias("_full"),
        )

    return F.aggregate(items, zero, run, lambda acc: F.flatten(F.array_append(acc["_full"], acc["_block"])))


def batch_of(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    """A record batch from row tuples in schema order."""
    columns = zip(*rows) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def text_slices(batches, max_rows: int = 1024, max_bytes: int = 4 << 20):
    """Cut Arrow batches of (…, text) rows into slices of bounded rows and text bytes."""
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index("text"))
        start, held = 0, 0
        sizes = pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_pylist()
        for i, n in enumerate(sizes):
            if i > start and (i - start >= max_rows or held + n > max_bytes):
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < batch.num_rows:
            yield batch.slice(start)
