"""Centroid clustering of embeddings that assigns whole balls of a metric tree at once.

Every partition cuts its vectors into blocks and builds a ball tree of each: a node has a count, the exact
integer sum of its vectors and the radius about their mean. The trees are written once to the shared folder;
each round walks them from the root. By the triangle inequality a centroid whose distance to a ball's centre,
less the radius, exceeds another's distance plus the radius is nearest to no vector in the ball: it is struck
off for the ball and all below. A ball with one centroid left goes to it whole, by its count and sum; the leaves
that stay undecided are settled by exact integer distances. Rounds return one count and sum for each task and
centroid, added by Spark; the driver sees k x dim numbers.

Entries become integers floor(64 * x), those of over 2**27 in size count as that size. Vectors of another length
than ``dim``, or with null or non-finite entries, go; repeated rows count each; a null identifier is kept, and
starts a centroid only where there are too few others; with fewer vectors than ``k`` each starts one; an empty
table gives no rows; other columns are ignored. A sum of distances beyond a long is null.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import materialize
from tracemill.llm.vectors import kept_vectors, scaled, vector_rows

DIM, K, ROUNDS = 64, 16, 3
#: Vectors of one tree and of one leaf at most.
BLOCK, LEAF = 16_384, 8
_LIMIT = 1 << 27
_EXACT = 1 << 53


@dataclass(frozen=True)
class BallTree:
    """A complete binary tree over rows in its own order.

    Level ``d`` has 2**d nodes, node ``j`` the rows from ``j * n >> d`` to ``(j + 1) * n >> d``; node 2**d - 1 + j
    of ``sums`` and ``radius`` is that one.
    """

    x: np.ndarray
    sums: np.ndarray
    radius: np.ndarray

    @staticmethod
    def bounds(n: int, level: int) -> np.ndarray:
        return (np.arange((1 << level) + 1) * n) >> level

    @staticmethod
    def depth_of(n: int, leaf: int) -> int:
        """Least depth at which no node has over ``leaf`` rows (two or more, so none is empty)."""
        return next(d for d in range(64) if -(-n >> d) <= max(2, leaf))

    @property
    def depth(self) -> int:
        return (len(self.radius) + 1).bit_length() - 2

    @staticmethod
    def build(x: np.ndarray, leaf: int = LEAF) -> tuple[BallTree, np.ndarray]:
        """The tree of the rows of ``x`` and the order in which it holds them."""
        n, depth = len(x), BallTree.depth_of(len(x), leaf)
        order = np.arange(n)
        for level in range(1, depth + 1):
            ends = BallTree.bounds(n, level)
            for a, middle, b in zip(ends[::2], ends[1::2], ends[2::2]):
                rows = x[order[a:b]]
                widest = int((rows.max(axis=0) - rows.min(axis=0)).argmax())
                order[a:b] = order[a:b][np.argpartition(rows[:, widest], middle - a)]
        x = x[order]
        sums, radius = [], []
        for level in range(depth + 1):
            ends = BallTree.bounds(n, level)
            total, counts = np.add.reduceat(x, ends[:-1], axis=0), np.diff(ends)
            gap = x - np.repeat(total / counts[:, None], counts, axis=0)
            sums.append(total)
            radius.append(np.sqrt(np.maximum.reduceat((gap * gap).sum(axis=1), ends[:-1])))
        return BallTree(x, np.concatenate(sums), np.concatenate(radius)), order

    def assign(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """Nearest centroid of each row, counts and sums by centroid, and how many rows went with a whole ball."""
        n, k = len(self.x), len(centroids)
        labels, counts, sums, whole = np.empty(n, np.int64), np.zeros(k, np.int64), np.zeros((k, self.x.shape[1]), np.int64), 0
        nodes, open_ = np.zeros(1, np.int64), np.ones((1, k), bool)
        for level in range(self.depth + 1):
            ends, first = BallTree.bounds(n, level), (1 << level) - 1
            a, b = ends[nodes], ends[nodes + 1]
            centre = self.sums[first + nodes] / (b - a)[:, None]
            far, radius = _distances(centre, centroids), self.radius[first + nodes][:, None]
            slack = 1e-6 * (1 + far.max(axis=1, keepdims=True) + np.abs(centre).max(axis=1, keepdims=True))
            nearest = np.where(open_, far + radius, np.inf).min(axis=1, keepdims=True)
            open_ = open_ & (far - radius <= nearest + slack)
            decided = open_.sum(axis=1) == 1
            for node, start, stop, j in zip(nodes[decided], a[decided], b[decided], open_[decided].argmax(axis=1)):
                labels[start:stop] = j
                counts[j] += stop - start
                sums[j] += self.sums[first + node]
                whole += int(stop - start)
            nodes, open_, a, b = nodes[~decided], open_[~decided], a[~decided], b[~decided]
            if level < self.depth:
                nodes, open_ = (2 * nodes[:, None] + np.arange(2)).ravel(), np.repeat(open_, 2, axis=0)
        if len(nodes):
            rows = np.concatenate([np.arange(s, t) for s, t in zip(a, b)])
            found = _nearest(self.x[rows], centroids)
            labels[rows] = found
            counts += np.bincount(found, minlength=k)
            for j in np.unique(found):
                sums[j] += self.x[rows[found == j]].sum(axis=0)
        return labels, counts, sums, whole


def _distances(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    c = centroids.astype(np.float64)
    squares = (points * points).sum(axis=1)[:, None] - 2 * points @ c.T + (c * c).sum(axis=1)
    return np.sqrt(np.maximum(squares, 0))


def _nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Nearest centroid of each row by exact squared distance, the smaller number of equal ones."""
    top = max(int(np.abs(x).max(initial=0)), int(np.abs(centroids).max(initial=0)))
    kind = np.float64 if 4 * x.shape[1] * top * top < _EXACT else np.int64  # sums of whole doubles are exact below
    x, c = x.astype(kind), centroids.astype(kind)
    return ((c * c).sum(axis=1) - 2 * (x @ c.T)).argmin(axis=1)


def build_trees(vectors: DataFrame, dim: int = DIM, block: int = BLOCK, leaf: int = LEAF) -> DataFrame:
    """A row for each tree: identifiers and rows in its order, sums and radius of its nodes."""
    schema = pa.schema([("vec_id", pa.list_(pa.int64())), ("x", pa.binary()), ("sums", pa.binary()), ("radius", pa.binary())])

    def row(ids: list, held: list) -> pa.RecordBatch:
        tree, order = BallTree.build(np.concatenate(held), leaf)
        named = pa.concat_arrays(ids).take(pa.array(order))
        parts = [pa.ListArray.from_arrays(pa.array([0, len(order)], pa.int32()), named)]
        parts += [pa.array([part.tobytes()], pa.binary()) for part in (tree.x.astype("<i4"), tree.sums.astype("<i8"), tree.radius.astype("<f8"))]
        return pa.RecordBatch.from_arrays(parts, schema=schema)

    def run(batches):
        ids, held, n = [], [], 0
        for named, matrix in kept_vectors(batches, dim):
            x = scaled(matrix, _LIMIT)
            while len(x):
                room = block - n
                ids.append(named.slice(0, room))
                held.append(x[:room])
                n += len(held[-1])
                named, x = named.slice(room), x[room:]
                if n == block:
                    yield row(ids, held)
                    ids, held, n = [], [], 0
        if n:
            yield row(ids, held)

    return vectors.mapInArrow(run, "vec_id array<long>, x binary, sums binary, radius binary")


def _trees(batches, dim: int):
    for batch in batches:
        for i in range(batch.num_rows):
            x = np.frombuffer(batch.column("x")[i].as_py(), "<i4").reshape(-1, dim).astype(np.int64)
            sums = np.frombuffer(batch.column("sums")[i].as_py(), "<i8").reshape(-1, dim)
            yield batch.column("vec_id")[i].values, BallTree(x, sums, np.frombuffer(batch.column("radius")[i].as_py(), "<f8"))


def first_centroids(vectors: DataFrame, k: int = K, dim: int = DIM) -> np.ndarray:
    """The kept vectors with the smallest hashes of ``1:<vec_id>``, in the order of the hashes."""

    def run(batches):
        for ids, matrix in kept_vectors(batches, dim):
            x = pa.array(scaled(matrix, _LIMIT).ravel())
            yield pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(pa.array(np.arange(0, len(x) + 1, dim, dtype=np.int32)), x)], ["vec_id", "x"])

    kept = vectors.mapInArrow(run, "vec_id long, x array<long>")
    named = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256)
    top = kept.orderBy(named.asc_nulls_last(), "x").limit(k).collect()  # k rows
    return np.asarray([r.x for r in top], np.int64).reshape(-1, dim)


def moments(trees: DataFrame, centroids: np.ndarray) -> tuple[list[int], list[list[int]], int]:
    """Counts and sums by centroid over all trees, and the rows that went with whole balls."""
    k, dim = centroids.shape

    def run(batches):
        counts, sums, whole = np.zeros(k, np.int64), np.zeros((k, dim), np.int64), 0
        for _, tree in _trees(batches, dim):
            _, c, s, w = tree.assign(centroids)
            counts, sums, whole = counts + c, sums + s, whole + w
        flat = np.concatenate([counts, [whole], sums.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)], ["at", "part"])

    rows = trees.mapInArrow(run, "at int, part long").groupBy("at").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("total")).collect()
    flat = [0] * (k + 1 + k * dim)
    for r in rows:
        flat[r["at"]] = int(r["total"])
    return flat[:k], [flat[k + 1 + j * dim : k + 1 + (j + 1) * dim] for j in range(k)], flat[k]


def refine(trees: DataFrame, centroids: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Centroids after rounds of assigning every vector and taking the floor of the means; empty ones stay."""
    for _ in range(rounds):
        counts, sums, _ = moments(trees, centroids)
        centroids = np.asarray([[s // n for s in total] if n else list(old) for n, total, old in zip(counts, sums, centroids.tolist())], np.int64)
    return centroids


def assigned(trees: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Rows (vec_id, cluster, distance) of all vectors."""
    dim = centroids.shape[1]

    def run(batches):
        for ids, tree in _trees(batches, dim):
            labels = tree.assign(centroids)[0]
            gap = tree.x - centroids[labels]
            yield pa.RecordBatch.from_arrays([ids, pa.array(labels.astype(np.int32)), pa.array((gap * gap).sum(axis=1))], ["vec_id", "cluster", "distance"])

    return trees.mapInArrow(run, "vec_id long, cluster int, distance long")


def cluster(table: DataFrame, k: int = K, rounds: int = ROUNDS, dim: int = DIM, block: int = BLOCK, leaf: int = LEAF) -> DataFrame:
    """Rows (vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of all kept vectors."""
    vectors = vector_rows(table)
    centroids = first_centroids(vectors, k, dim)
    kind = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not len(centroids):
        return table.sparkSession.createDataFrame([], kind)
    trees = materialize(build_trees(vectors, dim, block, leaf), "ball_trees")
    centroids = refine(trees, centroids, rounds)
    rows = assigned(trees, centroids)
    sums = {r.cluster: int(r.total) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}  # k rows
    long = lambda v: v if v < 1 << 63 else None
    about = [(j, long(sums.get(j, 0)), hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for j, c in enumerate(centroids.tolist())]
    named = table.sparkSession.createDataFrame(about, "cluster int, cluster_inertia long, centroid_sha256 string")  # k rows
    return rows.join(F.broadcast(named), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", F.lit(long(sum(sums.values()))).cast("long").alias("inertia"), "centroid_sha256")


def op11_ball_tree(spark, sf_dir: str) -> DataFrame:
    """Clusters of all embeddings of 64 entries."""
    return cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _round(before: str, after: str) -> str:
    return f"""
, near_{after} AS (SELECT r, c FROM (
    SELECT v.r, m.c, row_number() OVER (PARTITION BY v.r ORDER BY sum((v.x - m.x) * (v.x - m.x)), m.c) AS k FROM v JOIN {before} m ON v.i = m.i GROUP BY v.r, m.c) WHERE k = 1)
, sums_{after} AS (SELECT c, i, sum(x) AS s, count(*) AS n FROM near_{after} JOIN v USING (r) GROUP BY c, i)
, {after} AS (SELECT m.c, m.i, CASE WHEN s IS NULL THEN m.x ELSE ((s - ((s % n) + n) % n) // n)::BIGINT END AS x FROM {before} m LEFT JOIN sums_{after} USING (c, i))"""


ORACLE_SQL = f"""
WITH kept AS (
  SELECT row_number() OVER () AS r, vec_id, embedding FROM embeddings
  WHERE len(embedding) = {DIM} AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = {DIM})
, v AS (SELECT r, i, floor(64 * e::DOUBLE)::BIGINT AS x FROM (SELECT r, unnest(embedding) AS e, unnest(range({DIM})) AS i FROM kept))
, heads AS (SELECT r, row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS c FROM kept QUALIFY c < {K})
, m0 AS (SELECT c, i, x FROM heads JOIN v USING (r)){"".join(_round(f"m{i}", f"m{i + 1}") for i in range(ROUNDS))}
, far AS (SELECT v.r, m.c, sum((v.x - m.x) * (v.x - m.x)) AS d FROM v JOIN m{ROUNDS} m ON v.i = m.i GROUP BY v.r, m.c)
, last AS (SELECT r, c, d FROM far QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1)
, named AS (SELECT c, sha256(string_agg(x::VARCHAR, ',' ORDER BY i)) AS h FROM m{ROUNDS} GROUP BY c)
SELECT vec_id, c::INTEGER AS cluster, d::BIGINT AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, h AS centroid_sha256
FROM last JOIN kept USING (r) JOIN named USING (c)"""
