"""Quality rules whose limits come from mergeable quantile sketches for each language and source.

A sketch is a table of counts by logarithmic bin (relative error ``GAMMA``/2): counts add up, so the
sketch of a language, or of everything, is the sum of its sources' and the result does not depend on
how rows are split. Upper and lower fences are quartiles widened by ``WIDTH`` quartile distances; a
group with fewer than ``MIN_ROWS`` documents takes its language's fences, or those of all documents.
The fences join the per-document figures to give the verdict.

Null or empty texts have no words and fail; null languages and sources are groups of their own; repeated
rows are judged alike; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracemill.llm.common import batch_of, column_or_null, materialize, text_slices

GAMMA = 1.02
WIDTH = 6.0
MIN_ROWS = 200
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
_LINE_WORD = re.compile(r"[^ \t-\r]")

#: Metric: expression over the figures, slack added to the upper fence, whether it has a lower fence.
METRICS = {
    "symbol_ratio": (lambda: F.col("n_symbols") / F.greatest("word_chars", F.lit(1)), 0.05, False),
    "repeat_ratio": (lambda: F.col("n_repeat_words") / F.greatest("n_words", F.lit(1)), 0.4, False),
    "dup_line_ratio": (lambda: F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1)), 0.5, False),
    "word_length": (lambda: F.col("word_chars") / F.greatest("n_words", F.lit(1)), 1.0, True),
}


def figures_of(text: str | None) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines of a whole text."""
    if not text:
        return 0, 0, 0, 0, 0, 0
    words = text.encode("utf-8", "surrogatepass").split()  # ASCII blanks only
    n = len(words)
    seen, dup, lines = set(), 0, 0
    for line in text.split("\n"):
        if _LINE_WORD.search(line):
            lines += 1
            dup += line in seen
            seen.add(line)
    repeat = 0
    if n >= 3:
        number: dict[bytes, int] = {}
        ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
        v = len(number)
        pairs = ids[:-1] * v + ids[1:]
        if v > 2_000_000:  # three ids would not fit
            pairs, v = np.unique(pairs, return_inverse=True)[1], n
        _, inverse, counts = np.unique(pairs[: n - 2] * v + ids[2:], return_inverse=True, return_counts=True)
        twice = counts[inverse] > 1
        if twice.any():
            covered = np.zeros(n, bool)
            for k in range(3):
                covered[k : n - 2 + k] |= twice
            repeat = int(covered.sum())
    return n, len(text) - sum(map(text.count, BLANKS)), sum(map(text.count, SYMBOLS)), dup, repeat, lines


def figures(docs: DataFrame) -> DataFrame:
    """The figures of every document with its language and source."""
    out = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("source", pa.string()), *((n, pa.int64()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"))])

    def run(batches):
        for part in text_slices(batches):
            keys = (part.column(c).to_pylist() for c in ("doc_id", "lang", "source"))
            yield batch_of(out, [(*k, *figures_of(t)) for *k, t in zip(*keys, part.column("text").to_pylist())])

    picked = docs.select(column_or_null(docs, "doc_id", "long"), column_or_null(docs, "lang", "string"), column_or_null(docs, "source", "string"), column_or_null(docs, "text", "string"))
    return picked.mapInArrow(run, "doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long")


def sketch(rows: DataFrame) -> DataFrame:
    """Counts by (lang, source, metric, bin) of documents with words."""
    binned = lambda x: F.when(x > 0, F.floor(F.log(x) / math.log(GAMMA))).otherwise(F.lit(-1_000_000)).cast("int")
    values = F.array(*(F.struct(F.lit(name).alias("metric"), binned(f()).alias("bin")) for name, (f, _, _) in METRICS.items()))
    return rows.where("n_words > 0").select("lang", "source", F.inline(values)).groupBy("lang", "source", "metric", "bin").agg(F.count("*").alias("n"))


def merge(sketches: DataFrame, *by: str) -> DataFrame:
    return sketches.groupBy(*by, "metric", "bin").agg(F.sum("n").alias("n"))


def quantiles(sketches: DataFrame, *by: str) -> DataFrame:
    """Rows and first and third quartile by group and metric; the middle of the bin that holds the rank."""
    over = Window.partitionBy(*by, "metric")
    value = F.when(F.col("bin") == -1_000_000, 0.0).otherwise(F.pow(F.lit(GAMMA), F.col("bin") + 0.5))
    ranked = sketches.withColumns({"upto": F.sum("n").over(over.orderBy("bin")), "rows": F.sum("n").over(over), "value": value})
    at = lambda p: F.min(F.when(F.col("upto") >= p * F.col("rows"), F.col("value")))
    return ranked.groupBy(*by, "metric").agg(F.max("rows").alias("rows"), at(0.25).alias("q1"), at(0.75).alias("q3"))


def fences(sketches: DataFrame, min_rows: int = MIN_ROWS, width: float = WIDTH) -> DataFrame:
    """One row by (lang, source) with the limits of every metric."""
    by_lang, overall = merge(sketches, "lang"), merge(sketches)
    own = quantiles(sketches, "lang", "source")
    lang = quantiles(by_lang, "lang").select(F.col("lang").alias("l"), F.col("metric").alias("lm"), F.col("rows").alias("l_rows"), F.col("q1").alias("l_q1"), F.col("q3").alias("l_q3"))
    every = quantiles(overall).select(F.col("metric").alias("am"), F.col("q1").alias("a_q1"), F.col("q3").alias("a_q3"))
    joined = own.join(lang, F.col("lang").eqNullSafe(F.col("l")) & (F.col("metric") == F.col("lm"))).join(every, F.col("metric") == F.col("am"))
    pick = lambda q: F.when(F.col("rows") >= min_rows, F.col(q)).when(F.col("l_rows") >= min_rows, F.col(f"l_{q}")).otherwise(F.col(f"a_{q}"))
    picked = joined.select("lang", "source", "metric", pick("q1").alias("q1"), pick("q3").alias("q3"))
    limits = []
    for name, (_, slack, lower) in METRICS.items():
        mine = F.col("metric") == name
        limits.append(F.max(F.when(mine, F.col("q3") + width * (F.col("q3") - F.col("q1")) + slack)).alias(f"{name}_most"))
        if lower:
            limits.append(F.max(F.when(mine, F.col("q1") - width * (F.col("q3") - F.col("q1")) - slack)).alias(f"{name}_least"))
    return picked.groupBy("lang", "source").agg(*limits)


def judge(rows: DataFrame, limits: DataFrame) -> DataFrame:
    """Figures joined with their group's limits; ``base_failed`` and ``kept``."""
    limits = limits.withColumnsRenamed({"lang": "f_lang", "source": "f_source"})
    joined = rows.join(limits, F.col("lang").eqNullSafe(F.col("f_lang")) & F.col("source").eqNullSafe(F.col("f_source")), "left").drop("f_lang", "f_source")
    inside = F.lit(True)
    for name, (f, _, lower) in METRICS.items():
        inside &= F.coalesce(f() <= F.col(f"{name}_most"), F.lit(True))
        if lower:
            inside &= F.coalesce(f() >= F.col(f"{name}_least"), F.lit(True))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return joined.withColumns({"base_failed": failed, "kept": ~failed & inside})


def op5_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Figures, base verdict and adaptive verdict of all documents."""
    rows = materialize(figures(spark.read.parquet(f"{sf_dir}/documents.parquet")), "figures")
    return judge(rows, fences(sketch(rows))).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
