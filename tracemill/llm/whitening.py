"""Whitening of embeddings by moments that partitions compute and Chan's formula merges.

Entries become integers x = floor(64 * c) + 1,000,000. Every partition of the distinct vectors keeps a count,
exact integer sums, its local mean and the scatter about that mean; ``treeReduce`` merges two of them at a
time, so nothing is squared before it is centred. The covariance (one matrix of dim x dim) is decomposed on
the driver, a second pass over the distinct vectors computes the covariance of what whitening gives, by the
same merging, and a third writes the rows.

Rows whose vector is null or holds null or non-finite entries go. Vectors of another length than the table's
commonest (of equally common ones the longest) go as well, as do empty vectors. Repeated vectors count once in
the fit and each row gets its results; a null identifier is kept as null; entries of over 2**53 / 64 in size
count as that size. Components without variance (eigenvalue at most 1e-12 of the largest) are left out, so one
distinct vector, or an empty table, gives no rows. ``deviation`` is null where it exceeds a long. Other columns
are ignored.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import materialize
from tracemill.llm.vectors import SLICE_VALUES, kept_vectors, scaled, vector_rows

OFFSET = 1_000_000
COMPONENTS = 16
_LIMIT = 1 << 53
_LONG = (1 << 63) - 1


@dataclass(frozen=True)
class Moments:
    """Count, mean and scatter about the mean of some rows; sums are exact where rows are integers."""

    n: int
    sums: tuple[int, ...]
    mean: np.ndarray
    scatter: np.ndarray

    @staticmethod
    def of(rows: np.ndarray) -> Moments:
        n, dim = rows.shape
        mean = rows.mean(axis=0) if n else np.zeros(dim)
        centred = rows - mean
        whole = np.issubdtype(rows.dtype, np.integer)
        return Moments(n, _exact_sums(rows) if whole else (0,) * dim, mean, centred.T @ centred)

    def merge(self, other: Moments) -> Moments:
        """Chan, Golub and LeVeque's pairwise update."""
        if not self.n or not other.n:
            return self if self.n else other
        n, gap = self.n + other.n, other.mean - self.mean
        return Moments(
            n,
            tuple(a + b for a, b in zip(self.sums, other.sums)),
            self.mean + gap * (other.n / n),
            self.scatter + other.scatter + np.outer(gap, gap) * (self.n * other.n / n),
        )

    @property
    def covariance(self) -> np.ndarray:
        return self.scatter / max(1, self.n)


def _exact_sums(rows: np.ndarray) -> tuple[int, ...]:
    if len(rows) and len(rows) * max(int(rows.max()), -int(rows.min())) >= 1 << 62:
        rows = rows.astype(object)
    return tuple(int(v) for v in rows.sum(axis=0))


@dataclass(frozen=True)
class Whitening:
    """Count and sums of the fit list, eigenvectors as columns by falling eigenvalue, and what was checked."""

    n: int
    sums: tuple[int, ...]
    axes: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float = 0.0

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exact: longs where they fit, else Python integers."""
        near = np.asarray([s // self.n for s in self.sums])  # differences from here are small
        rest = [s - self.n * int(c) for s, c in zip(self.sums, near)]
        d = x - near
        if self.n * (int(np.abs(d).max(initial=0)) + 1) >= 1 << 62:
            d = d.astype(object)
        return d * self.n - np.asarray(rest, d.dtype)

    def project(self, deviations: np.ndarray) -> np.ndarray:
        return (deviations.astype(np.float64) / self.n) @ self.axes / np.sqrt(self.values)


def commonest_length(vectors: DataFrame) -> int:
    """Length of most vectors of (vec_id, embedding), 0 for an empty table."""
    lengths = vectors.where("embedding is not null and size(embedding) > 0").groupBy(F.size("embedding").alias("length")).count()
    top = lengths.orderBy(F.desc("count"), F.desc("length")).first()
    return top.length if top else 0


def distinct_vectors(vectors: DataFrame, dim: int) -> DataFrame:
    """Each distinct integer vector once, as the bytes of its longs, written to the shared folder."""

    def run(batches):
        for _, matrix in kept_vectors(batches, dim):
            x = np.ascontiguousarray(scaled(matrix, _LIMIT) + OFFSET, "<i8")
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary())], ["x"])

    return materialize(vectors.mapInArrow(run, "x binary").distinct(), "whitening_fit")


def merged_moments(distinct: DataFrame, dim: int, of, width: int) -> Moments:
    """Moments of ``of(rows)`` over all distinct vectors; ``width`` is the length of its rows."""

    def run(batches):
        found = Moments.of(np.zeros((0, width)))
        step = max(1, SLICE_VALUES // dim)
        for batch in batches:
            for start in range(0, batch.num_rows, step):
                rows = np.frombuffer(b"".join(batch.column(0).slice(start, step).to_pylist()), "<i8").reshape(-1, dim)
                found = found.merge(Moments.of(of(rows)))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(found)], pa.binary())], ["moments"])

    parts = distinct.mapInArrow(run, "moments binary").rdd.map(lambda row: pickle.loads(bytes(row.moments)))
    if not parts.getNumPartitions():
        return Moments.of(np.zeros((0, width)))
    return parts.treeReduce(Moments.merge)


def fit(distinct: DataFrame, dim: int, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of the distinct vectors, its second pass included; None where nothing varies."""
    found = merged_moments(distinct, dim, lambda x: x, dim)
    if found.n < 2:
        return None
    values, axes = np.linalg.eigh(found.covariance)
    order = np.argsort(-values, kind="stable")[:components]
    order = order[values[order] > 1e-12 * max(values.max(), 0.0)]
    if not len(order):
        return None
    model = Whitening(found.n, found.sums, axes[:, order], values[order], float(np.trace(found.covariance)))
    check = merged_moments(distinct, dim, lambda x: model.project(model.deviations(x)), len(order))
    error = float(np.abs(check.covariance - np.eye(len(order))).max())
    return Whitening(model.n, model.sums, model.axes, model.values, model.trace, error)


def _squares(deviations: np.ndarray) -> pa.Array:
    """Sums of squares of rows as longs, null where they exceed one."""
    top = max(abs(int(deviations.max(initial=0))), abs(int(deviations.min(initial=0))))
    if deviations.dtype != object and deviations.shape[1] * top * top <= _LONG:
        return pa.array((deviations * deviations).sum(axis=1), pa.int64())
    return pa.array([v if v <= _LONG else None for v in (sum(int(e) ** 2 for e in row) for row in deviations)], pa.int64())


def whiten(table: DataFrame, components: int = COMPONENTS, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """Rows (vec_id, component, n, deviation, whitened, explained, identity_error) of each kept row and component."""
    vectors = vector_rows(table, id_column, vector_column)
    kind = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    dim = commonest_length(vectors)
    model = fit(distinct_vectors(vectors, dim), dim, components) if dim else None
    if model is None:
        return table.sparkSession.createDataFrame([], kind)
    schema = pa.schema([("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()), ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64())])

    def run(batches):
        k = len(model.values)
        for ids, matrix in kept_vectors(batches, dim):
            d = model.deviations(scaled(matrix, _LIMIT) + OFFSET)
            rows = len(d)
            each = pa.array(np.repeat(np.arange(rows), k))
            columns = [
                ids.take(each),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                pa.array(np.full(rows * k, model.n, np.int64)),
                _squares(d).take(each),
                pa.array(model.project(d).ravel()),
                pa.array(np.tile(model.values / model.trace, rows)),
                pa.array(np.full(rows * k, model.identity_error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return vectors.mapInArrow(run, kind)


def op13_whitening(spark, sf_dir: str) -> DataFrame:
    """Whitened components of all embeddings."""
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
