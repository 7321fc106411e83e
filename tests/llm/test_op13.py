"""Whitening against moments computed in plain fractions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracemill.llm import whitening
from tracemill.llm.whitening import Moments, whiten

KIND = "vec_id long, embedding array<float>, label int"


def plain(rows):
    kept = [(i, [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]) for i, v in rows if v is not None and v and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(v) for _, v in kept})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.asarray([[(n * a - s) / n for a, s in zip(v, sums)] for v in fit])
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)
    return n, sums, values[order], axes[:, order], kept


def compare(got, rows, components):
    n, sums, values, axes, kept = plain(rows)
    assert len(got) == len(kept) * components
    by = {}
    for r in got:
        by.setdefault(r.vec_id, {}).setdefault(r.component, []).append(r)
    signs = {}
    for i, v in kept:
        d = [n * a - s for a, s in zip(v, sums)]
        want = np.asarray([x / n for x in d]) @ axes / np.sqrt(np.maximum(values, 1e-300))
        for k in range(components):
            r = by[i][k + 1][0]
            assert (r.n, r.deviation) == (n, sum(x * x for x in d))
            assert r.explained == pytest.approx(values[k] / values.sum(), rel=1e-6) and 0 <= r.identity_error <= 1e-4
            if abs(want[k]) > 1e-3:
                signs.setdefault(k, set()).add(bool(r.whitened * want[k] > 0))
            assert abs(r.whitened) == pytest.approx(abs(want[k]), abs=1e-6)
    assert all(len(s) == 1 for s in signs.values())


def test_equals_plain_moments(spark):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    compare(whitening.op13_whitening(spark, "/root/testdata/sf0.001").collect(), rows, 16)


def test_repeated_and_odd_rows(spark):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(size=5) * [5, 3, 2, 1, 0.5]).astype(np.float32).tolist()) for i in range(60)]
    rows += [(100 + i, rows[0][1]) for i in range(300)]
    odd = [(900, None), (901, []), (902, [1.0, None, 1.0, 1.0, 1.0]), (903, [float("nan")] * 5), (904, [float("-inf")] + [0.0] * 4)]
    table = spark.createDataFrame([(i, v, 0) for i, v in rows + odd], KIND).withColumn("n", F.lit("clash")).withColumn("x", F.lit(b"x"))
    compare(whiten(table.repartition(7)).collect(), rows + odd, 5)
    nulls = whiten(spark.createDataFrame([(None, v, 0) for _, v in rows], KIND)).collect()
    assert len(nulls) == 5 * len(rows) and {r.vec_id for r in nulls} == {None}


def test_commonest_length_and_little_variance(spark):
    rows = [(1, [0.0, 1.0], 0), (2, [1.0, 2.0], 0), (3, [5.0, 6.0], 0), (4, [1.0, 2.0, 3.0], 0)]
    got = whiten(spark.createDataFrame(rows, KIND)).collect()
    assert {(r.vec_id, r.component) for r in got} == {(1, 1), (2, 1), (3, 1)} and got[0].explained == pytest.approx(1)
    assert whiten(spark.createDataFrame([(1, [0.5], 0), (2, [0.5], 0)], KIND)).collect() == []
    assert whiten(spark.createDataFrame([], KIND)).collect() == []
    assert whiten(spark.createDataFrame([(1, None, 0)], KIND)).collect() == []


def test_entries_beyond_longs(spark):
    got = whiten(spark.createDataFrame([(1, [3e38, 0.0], 0), (2, [-3e38, 1.0], 0), (3, [0.0, 2.0], 0)], KIND)).collect()
    assert {r.vec_id for r in got} == {1, 2, 3} and {r.deviation for r in got if r.vec_id < 3} == {None}


def test_merging_in_any_order():
    rng = np.random.default_rng(8)
    rows = rng.integers(-20, 20, size=(101, 6)) + 1_000_000
    parts = [Moments.of(rows[a:b]) for a, b in ((0, 1), (1, 1), (1, 40), (40, 101))]
    left = parts[0].merge(parts[1]).merge(parts[2]).merge(parts[3])
    right = parts[3].merge(parts[0].merge(parts[2].merge(parts[1])))
    for m in (left, right):
        assert m.n == 101 and m.sums == tuple(rows.sum(axis=0)) and np.allclose(m.covariance, np.cov(rows.T, bias=True), rtol=1e-12, atol=1e-9)
