"""A corpus cleaned and packed in five stages, each an operator of ``tracemill.llm``.

Every stage takes (spark, docs, sf_dir), works on all its predecessor kept and returns a DataFrame; ``run``
writes each as Parquet to the shared folder and reads it again for the next. All but the last return the
columns of ``documents``. Null texts, identifiers and other columns are handled as each operator states.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracemill.llm import decontamination, jaccard_join, packing, quality_classifier, secret_scan
from tracemill.llm.common import scratch_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality_classifier.keep_good(docs, quality_classifier.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the least identifier stays."""
    return jaccard_join.keep_one(docs)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark passages cover a twentieth of the words or more go; from others such passages are cut."""
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), max_span=decontamination.WINDOW - 1)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the texts."""
    words = secret_scan.corpus_words(docs)
    return secret_scan.redact(docs, secret_scan.train(secret_scan.labelled_findings(spark), words), words=words)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of at most 1024 token ids; the executors' memory is shared with what the stages before left in use."""
    return packing.pack(docs, cached_chunks=60_000)


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_free),
    ("secret scans", secrets),
    ("packing", packed),
]

#: SQL has no trained models and no tokenizer; tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        path = scratch_path(spark, f"stage{i}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
