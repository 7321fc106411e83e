"""The pipeline's stages over the smallest tables: columns, rows that stay, and whole packing."""

import random

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")
FOLDER = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id for r in docs.select("doc_id").collect()}
        stage(spark, docs, FOLDER).write.parquet(str(tmp_path / str(i)))
        after = spark.read.parquet(str(tmp_path / str(i)))
        assert {r.doc_id for r in after.select("doc_id").collect()} <= before
        if name != "packing":
            assert after.columns == columns
            assert 0 < after.count() <= docs.count()
            docs = after
    whole = after.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("tokens"))
    assert whole.where("n <> tokens").count() == 0
    assert whole.count() == docs.count()
    assert after.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 1024").count() == 0


def test_stages_on_planted_rows(spark, tmp_path):
    """Copies, benchmark passages and secrets in documents of known words; nulls, repeats and a clashing column."""
    rng = random.Random(3)
    words = lambda n: " ".join("".join(rng.choice("abcdeilnorst") for _ in range(rng.randint(2, 8))) for _ in range(n))
    item = words(30)
    spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    near = words(200)
    key = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(1000))
    rows = [(i, words(120)) for i in range(10)] + [(20, near), (21, near), (22, near + " tail"), (23, near[:-1]), (30, words(100) + " " + item), (31, words(2000) + " " + item + " " + words(10)), (40, f"{words(60)} token = \"{key}\" {words(60)}"), (50, None), (51, ""), (None, words(50))]
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, node string")
    stages = dict(corpus_pipeline.STAGES)
    once = stages["n-gram Jaccard join"](spark, docs, str(tmp_path))
    assert {r.doc_id for r in once.collect()} == {d for d, _ in rows} - {21, 22, 23} and once.columns == docs.columns
    free = {r.doc_id: r.text for r in stages["benchmark decontamination"](spark, docs, str(tmp_path)).collect()}
    assert {d for d, _ in rows} - free.keys() == {30}
    whole = dict(rows)[31].split()
    assert free.pop(31).split() == whole[:2000] + whole[2030:] and all(free[d] == dict(rows)[d] for d in free)
    clean = {r.doc_id: r.text for r in stages["secret scans"](spark, docs, str(tmp_path)).collect()}
    assert key[-20:] not in clean[40] and key[:20] not in clean[40] and all(clean[d] == t for d, t in rows if d not in (40,))
    packed = stages["packing"](spark, docs, str(tmp_path))
    assert packed.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("t")).where("n <> t").count() == 0
    none = docs.where("false")
    assert all(stages[n](spark, none, str(tmp_path)).count() == 0 for n, _ in corpus_pipeline.STAGES[1:])


def test_workers_keep_no_encoder_of_the_packing_stage(spark):
    from tracemill.llm import packing

    docs = spark.range(64).select(F.col("id").alias("doc_id"), F.concat(F.lit("some words "), F.col("id").cast("string")).alias("text")).repartition(4)
    assert packing.pack(docs, cached_chunks=777).groupBy().sum("length").first()[0] >= 64 * 4

    def held(batches):
        import pyarrow as pa

        from tracemill.llm import bpe

        for _ in batches:
            pass
        yield pa.RecordBatch.from_pydict({"n": pa.array([sum(size == 777 for _, size in bpe._LOADED)], pa.int64())})

    assert spark.range(0, 64, 1, 8).mapInArrow(held, "n long").groupBy().sum("n").first()[0] == 0
