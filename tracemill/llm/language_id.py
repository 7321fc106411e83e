"""Languages of texts, told apart in two steps: the family first, then the language within it.

A text is the square root of its counts of byte runs of one to four (lower case, all but letters as blanks),
hashed to 4096 places and scaled to length 1. Linear support vector machines (squared hinge) part each family
from the rest, and within a family each language from each other one; a family is taken by the greatest margin,
a language by votes, then by the sum of its margins, then by name. ``FAMILIES`` names the families; a language that it
does not name is a family of its own.

The machines are fitted on at most ``sample`` labelled texts in all, equally many of each language: those with
the lowest hash of (doc_id, lang). Every other step covers all rows. Rows without a lang, without a letter in
their text, without an identifier, or held out teach nothing; of rows with one identifier and lang the least text
counts. A null text and one without a letter are ``und`` with score 0, as are all texts where nothing
could be learned; with a single language all texts with a letter get it. A null identifier is kept and is not held
out; other columns are ignored. Whole texts are read, in slices of bounded bytes.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.llm.common import batch_of, column_or_null, text_slices

#: Families of languages by ISO 639-1 code.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "is", "lb", "nl", "no", "sv", "yi"),
    "romance": ("ca", "es", "fr", "gl", "it", "oc", "pt", "ro"),
    "slavic": ("be", "bg", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "baltic": ("lt", "lv"),
    "uralic": ("et", "fi", "hu"),
    "turkic": ("az", "kk", "tr", "uz"),
    "indic": ("bn", "gu", "hi", "mr", "ne", "pa", "ur"),
    "semitic": ("ar", "he", "mt"),
    "celtic": ("br", "cy", "ga", "gd"),
}
UNKNOWN = "und"
BITS = 12
PLACES = 1 << BITS
LONGEST = 4
SAMPLE = 2400
RIDGE = 1e-3
#: Bytes of a text that are hashed at a time; runs reach over the cuts.
STRIDE = 1 << 20
_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123], _FOLD[128:] = np.arange(97, 123), np.arange(128, 256)


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def features_of(text: str) -> np.ndarray:
    """Places of a whole text, of length 1."""
    raw = np.frombuffer(f" {text.lower()} ".encode("utf-8", "surrogatepass"), np.uint8)
    counts = np.zeros(PLACES)
    for start in range(0, len(raw), STRIDE):
        runs = symbols = _FOLD[raw[start : start + STRIDE + LONGEST - 1]].astype(np.uint32)
        for n in range(1, LONGEST + 1):
            if n > 1:
                runs = (runs[: len(runs) - 1] << np.uint32(8)) | symbols[n - 1 :]
            here = (runs[:STRIDE] * np.uint32(2_654_435_761) + np.uint32(40_503 * n)) >> np.uint32(32 - BITS)
            counts += np.bincount(here, minlength=PLACES)
    out = np.sqrt(counts)
    return (out / np.linalg.norm(out)).astype(np.float32)


def fit_machine(x: np.ndarray, positive: np.ndarray, ridge: float = RIDGE) -> np.ndarray:
    """Weights, the shift last, of least squared hinge loss plus ``ridge`` x n/2 x their squared length.

    Newton's method on the coefficients of the rows inside the margin; both classes weigh the same.
    """
    y = np.where(positive, 1.0, -1.0)
    cost = np.where(positive, len(y) / (2 * positive.sum()), len(y) / (2 * (~positive).sum()))
    kernel = (x @ x.T).astype(np.float64) + 1
    inside, coefficients = np.ones(len(y), bool), np.zeros(len(y))
    for _ in range(30):
        at = np.flatnonzero(inside)
        part = kernel[np.ix_(at, at)] + np.diag(ridge * len(y) / cost[at])
        coefficients = np.zeros(len(y))
        coefficients[at] = np.linalg.solve(part, y[at])
        now = y * (kernel @ coefficients) < 1
        if (now == inside).all() or not now.any():
            break
        inside = now
    return np.append(x.T.astype(np.float64) @ coefficients, coefficients.sum())


@dataclass(frozen=True)
class LanguageModel:
    """Machines as columns: one a family, and one a pair of languages of a family."""

    families: dict[str, tuple[str, ...]]
    family_weights: np.ndarray = field(default_factory=lambda: np.zeros((PLACES + 1, 0)))
    pair_weights: dict[str, np.ndarray] = field(default_factory=dict)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        out = [(UNKNOWN, 0.0)] * len(texts)
        told = [i for i, t in enumerate(texts) if has_letter(t)] if self.families else []
        if not told:
            return out
        x = np.hstack([np.asarray([features_of(texts[i]) for i in told]), np.ones((len(told), 1), np.float32)])
        names = list(self.families)
        margins = x @ self.family_weights if len(names) > 1 else np.ones((len(told), 1))
        best = margins.argmax(axis=1)
        chance = np.exp(3 * (margins - margins.max(axis=1, keepdims=True)))
        sure = 1 / chance.sum(axis=1)
        for f in np.unique(best):
            rows = np.flatnonzero(best == f)
            for row, (lang, share) in zip(rows, self._within(names[f], x[rows])):
                out[told[row]] = (lang, float(min(1.0, sure[row] * share)))
        return out

    def _within(self, family: str, x: np.ndarray):
        langs = self.families[family]
        if len(langs) == 1:
            return [(langs[0], 1.0)] * len(x)
        margins = x @ self.pair_weights[family]
        votes, total, share = (np.zeros((len(x), len(langs))) for _ in range(3))
        for k, (a, b) in enumerate(combinations(range(len(langs)), 2)):
            m = margins[:, k]
            votes[:, a] += m >= 0
            votes[:, b] += m < 0
            total[:, a] += m
            total[:, b] -= m
            p = 1 / (1 + np.exp(np.clip(-3 * m, -500, 500)))
            share[:, a] += p
            share[:, b] += 1 - p
        winner = np.lexsort((np.tile(-np.arange(len(langs)), (len(x), 1)), total, votes), axis=1)[:, -1]
        return [(langs[w], s[w] / (len(langs) - 1)) for w, s in zip(winner, share)]


def fit_machines(x: np.ndarray, langs: list[str], family_of: dict[str, str]) -> LanguageModel:
    """The machines of rows ``x`` (each of length 1) with their languages."""
    known, names = sorted(set(langs)), np.asarray(langs)
    families: dict[str, tuple[str, ...]] = {}
    for lang in known:
        key = family_of.get(lang, f"only {lang}")
        families[key] = (*families.get(key, ()), lang)
    of = np.asarray([family_of.get(v, f"only {v}") for v in langs])
    weights = np.stack([fit_machine(x, of == f) for f in families], axis=1) if len(families) > 1 else np.zeros((PLACES + 1, 0))
    pairs = {}
    for family, members in families.items():
        if len(members) > 1:
            chosen = [(np.isin(names, pair), pair[0]) for pair in combinations(members, 2)]
            pairs[family] = np.stack([fit_machine(x[rows], names[rows] == a) for rows, a in chosen], axis=1).astype(np.float32)
    return LanguageModel(families, weights.astype(np.float32), pairs)


def held_out() -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), column_or_null(docs, "lang", "string"))


def training_sample(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Rows (doc_id, lang, text) to learn from, at most ``sample``, equally many of each language."""
    usable = _documents(docs).where("doc_id is not null and lang is not null").where(~held_out())
    counts = {r.lang: r["count"] for r in usable.groupBy("lang").count().collect()}  # a row for each language
    if not counts:
        return usable.select("doc_id", "lang", "text").limit(0)
    each = max(1, sample // len(counts))
    # hashes up to a limit hold about twice as many rows of a language as needed, whatever its size
    limits = [min((1 << 64) - 1, (2 * each + 50) * (1 << 64) // n) - (1 << 63) for n in counts.values()]
    limit_of = F.element_at(F.create_map(*(F.lit(v) for pair in zip(counts, limits) for v in pair)), F.col("lang"))
    low = usable.withColumn("at", F.xxhash64("doc_id", "lang")).where(F.col("at") <= limit_of).where(F.col("text").rlike(r"\p{L}"))
    once = low.groupBy("doc_id", "lang", "at").agg(F.min("text").alias("text"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("at", "doc_id"))  # about 2 * each + 50 rows of a language
    return once.withColumn("place", place).where(F.col("place") <= each).select("doc_id", "lang", "text")


def fit(docs: DataFrame, sample: int = SAMPLE, families: dict[str, tuple[str, ...]] = FAMILIES) -> LanguageModel:
    """The machines of the labelled texts that are not held out."""
    out = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("x", pa.binary())])

    def run(batches):
        for part in text_slices(batches):
            yield batch_of(out, [(i, lang, features_of(t).tobytes()) for i, lang, t in zip(part.column("doc_id").to_pylist(), part.column("lang").to_pylist(), part.column("text").to_pylist())])

    rows = sorted((r.lang, r.doc_id, bytes(r.x)) for r in training_sample(docs, sample).mapInArrow(run, "doc_id long, lang string, x binary").collect())
    if not rows:
        return LanguageModel({})
    x = np.frombuffer(b"".join(r[2] for r in rows), np.float32).reshape(-1, PLACES)
    return fit_machines(x, [r[0] for r in rows], {lang: f for f, members in families.items() for lang in members})


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """Rows (doc_id, held_out, lang_pred, score) of all documents."""
    out = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches):
        for part in text_slices(batches):
            found = model.predict(part.column("text").to_pylist())
            yield batch_of(out, [(i, *f) for i, f in zip(part.column("doc_id").to_pylist(), found)])

    told = _documents(docs).select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")
    return told.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op12_language_id(spark, sf_dir: str) -> DataFrame:
    """Languages of all documents by machines of those that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return predict(docs, fit(docs))
