"""Scalar expressions on columns: rounding, ids, text display, secrets, splits and graders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed patterns of secret-like text, by label.
SECRET_PATTERNS = (
    ("openai_key", r"\bsk-[A-Za-z0-9]{16,}\b"),
    ("aws_access_key", r"\bAKIA[0-9A-Z]{16}\b"),
    ("github_token", r"\bgh[pousr]_[A-Za-z0-9]{20,}\b"),
    ("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    ("bearer_token", r"\b(?i:Bearer)\s+[A-Za-z0-9._\-]{24,}\b"),
)


def round_to(x: Column, places: int = 4) -> Column:
    """Half-up rounding on doubles by one formula, so that engines agree on ties."""
    scale = float(10**places)
    return F.floor(x.cast("double") * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def or_else(*xs: Column) -> Column:
    """First value that is neither null nor zero, as ``a or b`` does; the last one is taken as it is."""
    *first, last = xs
    return F.coalesce(*(F.nullif(x, F.lit(0)) for x in first), last)


def target_kind(ref: Column) -> Column:
    return F.when(F.contains(ref, F.lit(":")), F.substring_index(ref, ":", 1)).otherwise("")


def target_value(ref: Column) -> Column:
    return F.when(F.contains(ref, F.lit(":")), F.regexp_replace(ref, "^[^:]*:", "")).otherwise(ref)


def slug(x: Column) -> Column:
    cut = F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), "[^a-z0-9]+", "_")
    return F.coalesce(F.nullif(F.regexp_replace(cut, "^_+|_+$", ""), F.lit("")), F.lit("unknown"))


def slice_id(family: Column, kind: Column, taxonomy: Column) -> Column:
    digest = F.sha1(F.concat_ws("|", family, kind, F.coalesce(taxonomy, F.lit(""))))
    return F.concat_ws(".", F.lit("slice"), slug(family), slug(kind), F.substring(digest, 1, 8))


def shorten(x: Column, size: int = 240, mark: str = "...") -> Column:
    """White space collapsed; longer texts cut to ``size`` characters with the mark."""
    flat = F.trim(F.regexp_replace(x, r"[ \t\r\n]+", " "))
    return F.when(F.length(flat) > size, F.concat(F.rtrim(F.substring(flat, 1, size - len(mark))), F.lit(mark))).otherwise(flat)


def hash_percent(key: Column) -> Column:
    return F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("long") % 100


def hash_split(key: Column, train: int = 80, val: int = 90) -> Column:
    p = hash_percent(key)
    return F.when(p < train, "train").when(p < val, "val").otherwise("test")


def guard_key(**parts: Column) -> Column:
    """First non-empty of the named values as ``name:value``."""
    return F.coalesce(*(F.concat(F.lit(f"{name}:"), F.nullif(value, F.lit(""))) for name, value in parts.items()))


def secret_counts(x: Column) -> Column:
    """Counts of secret-like matches, one field for each label."""
    return F.struct(*(F.coalesce(F.regexp_count(x, F.lit(pattern)), F.lit(0)).alias(label) for label, pattern in SECRET_PATTERNS))


def redact(x: Column) -> Column:
    for label, pattern in SECRET_PATTERNS:
        x = F.regexp_replace(x, pattern, f"<redacted:{label}>")
    return x


def mask_headers(headers: Column) -> Column:
    """Map of headers with credentials masked."""
    return F.transform_values(headers, lambda k, v: F.when(F.lower(k).isin("authorization", "cookie", "set-cookie", "x-api-key", "proxy-authorization"), F.lit("***")).otherwise(v))


def normalized(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, r"[ \t\r\n]+", " "))


def exact_match(answer: Column, reference: Column) -> Column:
    return normalized(answer) == normalized(reference)


def contains_reference(answer: Column, reference: Column) -> Column:
    return F.contains(normalized(answer), normalized(reference))


def difficulty(requests: Column, branches: Column) -> Column:
    return F.when((requests <= 1) & (branches <= 1), "low").when((requests <= 3) & (branches <= 2), "medium").otherwise("high")


def humanize(x: Column) -> Column:
    return F.initcap(F.regexp_replace(x, "[_.-]+", " "))


def format_percent(x: Column) -> Column:
    return F.concat(F.floor(x * 100 + 0.5).cast("int").cast("string"), F.lit("%"))


def nearest_rank(rows: DataFrame, by: str, value: str, percent: float, name: str) -> DataFrame:
    """Per group the value at half-even rounded percent/100 * (n - 1) of the sorted ones, from counts by value."""
    counts = rows.groupBy(by, value).agg(F.count("*").alias("_n"))
    over = Window.partitionBy(by)
    ranked = counts.withColumns({"_upto": F.sum("_n").over(over.orderBy(value)), "_all": F.sum("_n").over(over)})
    reached = F.col("_upto") > F.bround((F.col("_all") - 1) * F.lit(percent / 100.0), 0)
    return ranked.groupBy(by).agg(F.min(F.when(reached, F.col(value))).alias(name))


def clamp(x: Column, default: float) -> Column:
    return F.when(x.isNull(), default).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), round_to(x))))
