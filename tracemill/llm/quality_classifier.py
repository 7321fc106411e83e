"""Quality scores by Bradley-Terry ranking of preference pairs.

A pair is a document labelled 1 and one labelled 0; the model is a weight vector whose logistic loss on
feature differences over the pairs is least, so a document's score is its strength in the Bradley-Terry
sense. The limit is the quantile of the training scores that parts the labels best; scores are shifted
and squashed so that it lies at 0.7.

The model is fitted on at most ``max_labelled`` labelled rows, those whose identifiers hash lowest, and
``pairs_each`` partners for every row of the rarer label. Inputs are figures of the text alone. Null or
empty texts get a score like any other; rows with a null identifier are never held out nor learned from; labels
that disagree on one identifier are averaged; without both labels every score is 0.7; other columns of
the table are kept by ``keep_good`` and ignored by ``score``.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import batch_of, text_slices

LIMIT = 0.7
MAX_LABELLED = 20_000
PAIRS_EACH = 16
_SYMBOL = re.compile(r"[#*$%&|<>{}\\^~=_@\[\]]")
FEATURES = ("log_words", "word_length", "symbols", "symbols_any", "marks", "capitals", "digits", "same_as_before", "repeated_triples", "distinct", "dup_lines", "letterless", "line_words", "stops", "longest_word")


def features_of(text: str | None) -> list[float]:
    """Figures of a whole text, all within a few units of 0."""
    if not text:
        return [0.0] * len(FEATURES)
    words, chars = text.split(), len(text)
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    upper = int(((points >= 65) & (points <= 90) | (points >= 192) & (points <= 222) & (points != 215)).sum())
    digits = int(((points >= 48) & (points <= 57)).sum())
    letters = int((((points | 32) >= 97) & ((points | 32) <= 122) | (points >= 192)).sum())
    symbols = len(_SYMBOL.findall(text))
    marks = text.count("!") + text.count("?")
    number: dict[str, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    same = float((ids[1:] == ids[:-1]).mean()) if n > 1 else 0.0
    triples = 0.0
    if n > 3:
        keys = (ids[:-2] * 1_000_003 + ids[1:-1]) * 1_000_003 + ids[2:]
        triples = 1 - len(np.unique(keys)) / len(keys)
    lines = [x for x in text.split("\n") if x.strip()]
    return [
        math.log1p(n) / 5,
        min(20.0, (chars - n) / n) / 5,
        5 * symbols / chars,
        math.log1p(1000 * symbols / chars) / 3,
        5 * marks / chars,
        upper / max(1, letters),
        5 * digits / chars,
        same,
        triples,
        len(number) / n / max(0.2, 1 - 0.05 * math.log1p(n)),
        1 - len(set(lines)) / max(1, len(lines)),
        max(0.0, 1 - letters / max(1, chars - n)),
        min(6.0, math.log1p(n / max(1, len(lines)))) / 3,
        min(1.0, 10 * (text.count(".") + text.count(",")) / n),
        min(60, max(map(len, number))) / 20,
    ]


@dataclass(frozen=True)
class RankingModel:
    """score = 1 / (1 + exp(-(sharpness * (weights . standard features) + shift)))."""

    mean: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]
    limit: float
    sharpness: float = 1.0

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - np.asarray(self.mean)) / np.asarray(self.scale), -8, 8) @ np.asarray(self.weights)

    def score(self, texts: list[str | None]) -> np.ndarray:
        x = np.asarray([features_of(t) for t in texts], float).reshape(len(texts), len(FEATURES))
        z = self.sharpness * (self.raw(x) - self.limit) + math.log(LIMIT / (1 - LIMIT))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


NEUTRAL = RankingModel((0.0,) * len(FEATURES), (1.0,) * len(FEATURES), (0.0,) * len(FEATURES), 0.0)


def fit_pairs(x: np.ndarray, good: np.ndarray, pairs_each: int = PAIRS_EACH, ridge: float = 1e-3, seed: int = 7) -> RankingModel:
    """Newton's method on the pairs' logistic loss; ``x`` holds one row of features for each label."""
    if good.all() or not good.any():
        return NEUTRAL
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    z = np.clip((x - mean) / scale, -8, 8)
    up, down, rng = np.flatnonzero(good), np.flatnonzero(~good), np.random.default_rng(seed)
    n = pairs_each * min(len(up), len(down))
    rare, other = (down, up) if len(down) <= len(up) else (up, down)
    left, right = np.repeat(rare, pairs_each), rng.choice(other, n)
    d = z[right] - z[left] if rare is down else z[left] - z[right]
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(np.clip(d @ w, -500, 500)))  # probability of the wrong order
        gradient = -(d * p[:, None]).mean(0) + ridge * w
        hessian = (d * (p * (1 - p))[:, None]).T @ d / n + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    s = z @ w
    order = np.argsort(s, kind="stable")
    below_bad, below_good = np.cumsum(~good[order]), np.cumsum(good[order])
    gain = below_bad / len(down) - below_good / len(up)  # by quantile of the score
    k = int(gain.argmax())
    limit = float((s[order[k]] + s[order[min(k + 1, len(s) - 1)]]) / 2)
    return RankingModel(tuple(mean), tuple(scale), tuple(w), limit, 1.0)


def held_out():
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> RankingModel:
    """Fit on labelled rows that are not held out."""
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("q")).where("doc_id is not null and q is not null")
    chosen = labels.groupBy("doc_id").agg((F.avg("q") >= 0.5).alias("good")).where(~held_out()).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = texts.join(F.broadcast(chosen), "doc_id")  # at most max_labelled rows

    def run(batches):
        out = pa.schema([("doc_id", pa.int64()), ("good", pa.bool_()), ("x", pa.list_(pa.float64()))])
        for part in text_slices(batches):
            yield batch_of(out, list(zip(part.column("doc_id").to_pylist(), part.column("good").to_pylist(), map(features_of, part.column("text").to_pylist()))))

    got = sorted(((r.doc_id, tuple(r.x), r.good) for r in rows.select("doc_id", "text", "good").mapInArrow(run, "doc_id long, good boolean, x array<double>").collect()))
    if not got:
        return NEUTRAL
    return fit_pairs(np.asarray([r[1] for r in got]), np.asarray([r[2] for r in got], bool))


def score(docs: DataFrame, model: RankingModel) -> DataFrame:
    """Rows (doc_id, held_out, score, predicted)."""
    out = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches):
        for part in text_slices(batches):
            yield batch_of(out, list(zip(part.column("doc_id").to_pylist(), model.score(part.column("text").to_pylist()).tolist())))

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= LIMIT).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: RankingModel, limit: float = LIMIT) -> DataFrame:
    """Rows of ``docs`` with a score of ``limit`` or more, all columns kept."""

    def run(batches):
        for part in text_slices(batches):
            yield part.filter(pa.array(model.score(part.column("text").to_pylist()) >= limit, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op10_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """Scores of all documents by a model of the labels that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
