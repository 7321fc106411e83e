"""Ball-tree clustering against Lloyd's rounds in plain integers."""

import hashlib
import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tracemill.llm import ball_tree
from tracemill.llm.ball_tree import BallTree

KIND = "vec_id long, embedding array<float>, label int"


def plain(rows, k=16, rounds=3, dim=64):
    kept = [(i, [math.floor(64 * float(np.float32(c))) for c in v]) for i, v in rows if v is not None and len(v) == dim and all(c is not None and math.isfinite(c) for c in v)]
    named = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in named[:k]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    nearest = lambda v: min(range(len(centroids)), key=lambda j: (far(v, centroids[j]), j))
    for _ in range(rounds):
        at = [nearest(v) for _, v in kept]
        for j in range(len(centroids)):
            members = [v for (_, v), a in zip(kept, at) if a == j]
            if members:
                centroids[j] = [sum(c) // len(members) for c in zip(*members)]
    last = [(i, nearest(v), v) for i, v in kept]
    of = [0] * len(centroids)
    for _, j, v in last:
        of[j] += far(v, centroids[j])
    return [(i, j, far(v, centroids[j]), of[j], sum(of), hashlib.sha256(",".join(map(str, centroids[j])).encode()).hexdigest()) for i, j, v in last]


def sortable(rows):
    return sorted(map(tuple, rows), key=lambda r: (r[0] is None, r))


def vectors(n, seed, spread=1.0):
    rng = np.random.default_rng(seed)
    heads = rng.normal(size=(6, 64)) * spread
    return [(i, (heads[i % 6] + rng.normal(size=64) * 0.1).astype(np.float32).tolist(), 0) for i in range(n)]


@pytest.mark.parametrize("block,leaf,spread", [(37, 2, 1.0), (1000, 8, 0.05), (64, 4, 0.3)])
def test_equals_plain_rounds(spark, block, leaf, spread):
    rows = vectors(300, 3, spread)
    got = ball_tree.cluster(spark.createDataFrame(rows, KIND), block=block, leaf=leaf).collect()
    assert sortable(got) == sortable(plain([r[:2] for r in rows]))


def test_odd_rows(spark):
    rows = vectors(40, 5)
    rows += [(0, rows[0][1], 1), (0, rows[7][1], 1), (None, rows[3][1], 2), (90, None, 0), (91, [], 0), (92, [1.0] * 63, 0), (93, [1.0] * 65, 0)]
    rows += [(94, [1.0] * 63 + [None], 0), (95, [float("nan")] + [0.0] * 63, 0), (96, [float("inf")] + [0.0] * 63, 0), (97, [0.0] * 64, 0), (98, [-0.001] * 64, 0)]
    table = spark.createDataFrame(rows, KIND).withColumn("cluster", F.lit("clash")).withColumn("x", F.lit(1))
    assert sortable(ball_tree.cluster(table).collect()) == sortable(plain([r[:2] for r in rows]))


def test_many_equal_and_few_vectors(spark):
    same = [(i, [0.5] * 64, 0) for i in range(200)] + vectors(20, 1)
    assert sortable(ball_tree.cluster(spark.createDataFrame(same, KIND), block=50).collect()) == sortable(plain([r[:2] for r in same]))
    few = vectors(5, 2)
    assert sortable(ball_tree.cluster(spark.createDataFrame(few, KIND)).collect()) == sortable(plain([r[:2] for r in few]))


def test_empty_table_and_large_entries(spark):
    assert ball_tree.cluster(spark.createDataFrame([], KIND)).collect() == []
    huge = [(i, [3e38 if i % 2 else -3e38] * 64, 0) for i in range(20)]
    rows = ball_tree.cluster(spark.createDataFrame(huge, KIND)).collect()
    assert len(rows) == 20 and {r.distance for r in rows} == {0}


def test_tree_nodes_and_whole_balls():
    x = np.asarray([[int(64 * c) for c in v] for _, v, _ in vectors(500, 9)], np.int64)
    tree, order = BallTree.build(x, 4)
    assert sorted(order) == list(range(500)) and (tree.x == x[order]).all()
    for level in range(tree.depth + 1):
        ends = BallTree.bounds(500, level)
        for j, (a, b) in enumerate(zip(ends, ends[1:])):
            node, part = (1 << level) - 1 + j, tree.x[a:b]
            assert b > a and (tree.sums[node] == part.sum(axis=0)).all()
            assert np.sqrt(((part - part.mean(axis=0)) ** 2).sum(axis=1)).max() == pytest.approx(tree.radius[node])
    assert BallTree.bounds(500, tree.depth)[1] <= 4
    labels, counts, sums, whole = tree.assign(np.asarray([x[i] for i in range(6)]))
    assert 450 <= whole < 500  # heads lie far apart: only leaves with rows of two heads are looked into
    assert (labels == ((tree.x[:, None] - x[:6]) ** 2).sum(axis=2).argmin(axis=1)).all()
    assert counts.sum() == 500 and (sums.sum(axis=0) == x.sum(axis=0)).all()


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_sql(spark, folder):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet'")
    got = ball_tree.op11_ball_tree(spark, folder)
    assert got.columns == [c[0] for c in con.execute(ball_tree.ORACLE_SQL).description]
    assert sortable(got.collect()) == sortable(con.execute(ball_tree.ORACLE_SQL).fetchall())
