"""Languages: held-out accuracy, the machines against a plain optimiser, odd rows."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracemill.llm import language_id
from tracemill.llm.language_id import LanguageModel, features_of, fit, fit_machine, fit_machines, predict

FOLDER = "/root/testdata/sf0.01"
KIND = "doc_id long, text string, lang string, source string"


def test_held_out_accuracy(spark):
    want = {r.doc_id: (r.lang, len(r.text or "")) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    rows = language_id.op12_language_id(spark, FOLDER).collect()
    assert {r.doc_id for r in rows} == set(want) and len(rows) == 1000
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out and r.lang_pred != "und"]
    assert np.mean([r.lang_pred == want[r.doc_id][0] for r in held]) >= 0.98
    short = [r for r in held if want[r.doc_id][1] < 100]
    assert np.mean([r.lang_pred == want[r.doc_id][0] for r in short]) >= 0.9
    sure, unsure = (np.mean([r.score for r in held if (r.lang_pred == want[r.doc_id][0]) == ok] or [0]) for ok in (True, False))
    assert sure > unsure


def test_labels_of_held_out_rows_teach_nothing(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    other = docs.withColumn("lang", F.when(language_id.held_out(), "xx").otherwise(F.col("lang"))).withColumn("source", F.lit("z"))
    left, right = (sorted(map(tuple, predict(d, fit(d)).collect())) for d in (docs, other))
    assert left == right


def test_machine_is_the_least(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 5))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    positive = x[:, 0] + 0.3 * rng.normal(size=60) > 0.2
    w = fit_machine(x, positive, 0.01)
    y, cost = np.where(positive, 1, -1), np.where(positive, 30 / positive.sum(), 30 / (~positive).sum())
    full = np.hstack([x, np.ones((60, 1))])
    loss = lambda v: (cost * np.maximum(0, 1 - y * (full @ v)) ** 2).sum() + 0.01 * 60 * (v @ v)
    assert all(loss(w) <= loss(w + rng.normal(size=6) * s) for s in (1e-3, 1e-2, 0.1, 1) for _ in range(50))


def test_family_then_one_against_one():
    rng = np.random.default_rng(2)
    letters = {"en": "abcde", "de": "abcdf", "nl": "abcdg", "fr": "vwxyz", "es": "vwxyq", "qq": "mnop"}
    texts = [("".join(rng.choice(list(s + " "), 60)), lang) for lang, s in letters.items() for _ in range(20)]
    x = np.asarray([features_of(t) for t, _ in texts])
    family = {"en": "g", "de": "g", "nl": "g", "fr": "r", "es": "r"}
    model = fit_machines(x, [lang for _, lang in texts], family)
    assert model.families == {"g": ("de", "en", "nl"), "r": ("es", "fr"), "only qq": ("qq",)}
    assert {k: v.shape[1] for k, v in model.pair_weights.items()} == {"g": 3, "r": 1}
    got = [lang for lang, _ in model.predict([t for t, _ in texts])]
    assert np.mean([a == b for a, (_, b) in zip(got, texts)]) >= 0.95


def test_odd_rows(spark):
    rows = [(i, "the of and to in " * (1 + i % 3), "en", "a") for i in range(20)] + [(100 + i, "der die und das ein ", "de", "b") for i in range(20)]
    rows += [(200, None, "en", "a"), (201, "", "en", None), (202, "1234 !? ½²", "de", "a"), (None, "the and of", None, "a"), (204, "the " * 200_000, None, "a")]
    rows += [(205, "der und", None, "a")] * 3 + [(206, "Привет", None, None)]
    docs = spark.createDataFrame(rows, KIND).withColumn("score", F.lit("clash")).withColumn("x", F.lit(0))
    got = [tuple(r) for r in predict(docs, fit(docs)).collect()]
    assert len(got) == len(rows)
    told = {r[0]: r for r in got}
    assert all(told[i][2:] == ("und", 0.0) for i in (200, 201, 202))
    assert told[204][2] == "en" and told[205][2] == "de" and told[206][2] in ("en", "de")
    assert told[None][1] is False and told[None][2] == "en" and sum(r[0] == 205 for r in got) == 3


def test_nothing_to_learn_and_empty_table(spark):
    unlabelled = spark.createDataFrame([(1, "the", None, "a")], KIND)
    assert [tuple(r) for r in predict(unlabelled, fit(unlabelled)).collect()] == [(1, False, "und", 0.0)]
    empty = spark.createDataFrame([], KIND)
    assert predict(empty, fit(empty)).collect() == []
    single = spark.createDataFrame([(i, "the", "en", "a") for i in range(4)] + [(4, "ab", None, "a"), (5, "7", None, "a")], KIND)
    assert {r.doc_id: r.lang_pred for r in predict(single, fit(single)).collect()}[4] == "en"


@pytest.mark.parametrize("size", [10, 1 << 20, (1 << 20) + 1, 3_000_000])
def test_long_texts_count_every_run_once(size, monkeypatch):
    rng = np.random.default_rng(size)
    text = "".join(rng.choice(list("abc é"), size))
    whole = features_of(text)
    monkeypatch.setattr(language_id, "STRIDE", 1 << 30)
    assert np.allclose(whole, features_of(text), atol=1e-6)


def test_sample_is_bounded_and_even(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    counts = {r.lang: r["count"] for r in language_id.training_sample(docs, 40).groupBy("lang").count().collect()}
    assert counts == {"en": 10, "de": 10, "fr": 10, "es": 10}


def test_model_without_languages():
    assert LanguageModel({}).predict(["a", None]) == [("und", 0.0)] * 2
