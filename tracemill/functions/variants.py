"""Open JSON as VARIANT columns: typed access, text of irregular shapes, merging, canonical form and leaves."""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def parsed(text: Column) -> Column:
    """The value of JSON text; null where it does not parse."""
    return F.try_parse_json(text)


def at(value: Column, path: str) -> Column:
    return F.try_variant_get(value, path, "variant")


def items(value: Column, path: str = "$") -> Column:
    """Elements of a list as an array of variants; null for what is no list."""
    return F.when(F.startswith(F.schema_of_variant(at(value, path)), F.lit("ARRAY")), F.try_variant_get(value, path, "array<variant>"))


def members(value: Column, path: str = "$") -> Column:
    """Members of an object as a map of variants; null for what is no object."""
    return F.try_variant_get(value, path, "map<string,variant>")


def is_object(value: Column) -> Column:
    return F.coalesce(F.startswith(F.schema_of_variant(value), F.lit("OBJECT")), F.lit(False))


def is_null(value: Column) -> Column:
    """Missing, or JSON's null."""
    return value.isNull() | F.is_variant_null(value)


def string(value: Column, path: str = "$") -> Column:
    """A string as it is; null for numbers, truth values and all else."""
    found = at(value, path)
    return F.when(F.schema_of_variant(found) == "STRING", F.try_variant_get(value, path, "string"))


def named(value: Column, path: str) -> Column:
    """A string that is not empty."""
    return F.nullif(string(value, path), F.lit(""))


def number(value: Column, path: str = "$") -> Column:
    """A number as double; a truth value or a string of digits is none."""
    kind = F.schema_of_variant(at(value, path))
    return F.when(kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.try_variant_get(value, path, "double"))


def whole(value: Column, path: str = "$") -> Column:
    """An integer as long; a truth value, a fraction or a string is none."""
    kind = F.schema_of_variant(at(value, path))
    return F.when((kind == "BIGINT") | kind.rlike(r"^DECIMAL\(\d+,0\)$"), F.try_variant_get(value, path, "long"))


def truth(value: Column, path: str = "$") -> Column:
    """A truth value; a number or a string is none."""
    return F.when(F.schema_of_variant(at(value, path)) == "BOOLEAN", F.try_variant_get(value, path, "boolean"))


def fragment_of(value) -> str | None:
    """Text of a string, of the first text-like member of an object, or of a list's elements run together."""
    if isinstance(value, dict):
        return next((t for t in (fragment_of(value.get(k)) for k in ("text", "content", "value", "delta")) if t), None)
    if isinstance(value, list):
        return "".join(t for t in map(fragment_of, value) if t) or None
    return value if isinstance(value, str) else None


def _fragments(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for text in texts:
        yield text.map(lambda t: None if t is None else fragment_of(json.loads(t)))


def fragment(raw: Column) -> Column:
    """Text in nested JSON, given as JSON text: a Python function, for the few values that are no plain strings."""
    return F.pandas_udf(_fragments, "string")(raw)


def canonical(value: Column) -> Column:
    """One text for equal values: a VARIANT keeps the members of every object, at any depth, in order of their names."""
    return F.to_json(value)


def without(value: Column, *names: str) -> Column:
    """An object without the named members, in canonical form; null if nothing is left or it is no object."""
    kept = F.map_filter(members(value), lambda k, v: ~k.isin(*names))
    by_name = F.map_from_entries(F.array_sort(F.transform(F.map_entries(kept), lambda e: F.struct(e["key"].alias("key"), F.coalesce(F.to_json(e["value"]), F.lit("null")).alias("value")))))
    written = F.transform(F.map_entries(by_name), lambda e: F.concat(F.to_json(F.parse_json(_quoted(e["key"]))), F.lit(":"), e["value"]))
    return F.when(F.size(kept) > 0, F.concat(F.lit("{"), F.array_join(written, ","), F.lit("}")))


def _quoted(text: Column) -> Column:
    """A JSON string of any text."""
    return F.regexp_replace(F.regexp_extract(F.to_json(F.struct(text.alias("t"))), r"(?s)^\{\"t\":(.*)\}$", 1), "^$", "null")


def overlaid(first: Column, later: Column) -> Column:
    """Members of two maps, the later one winning."""
    return F.map_concat(F.map_filter(first, lambda k, v: ~F.map_contains_key(later, k)), later)


def merged(*values: Column) -> Column:
    """Members of several objects as a map to JSON text, the last of a name winning; those that end as null go."""
    none = F.create_map().cast("map<string,string>")
    maps = [F.coalesce(F.transform_values(members(v), lambda k, x: F.coalesce(F.to_json(x), F.lit("null"))), none) for v in values]
    return F.map_filter(functools.reduce(overlaid, maps), lambda k, v: v != "null")


def _entries(value: Column) -> Column:
    """Members or elements as (name, value), an element's position being its name; null for a leaf."""
    inside = F.transform(F.map_entries(members(value)), lambda e: F.struct(e["key"].alias("name"), e["value"].alias("value")))
    listed = F.transform(items(value), lambda x, i: F.struct(i.cast("string").alias("name"), x.alias("value")))
    return F.coalesce(inside, listed)


def leaves(value: Column, levels: int = 6, path: Column | None = None) -> Column:
    """Leaves of a value as an array of (path, text, is_string): names joined by dots, strings as they are, the rest as JSON.

    An empty object or list has no leaf. What lies deeper than ``levels`` is one leaf, as JSON.
    """
    here = F.array(F.struct((F.lit("") if path is None else path).alias("path"), F.coalesce(string(value), F.to_json(value)).alias("text"), F.coalesce(F.schema_of_variant(value) == "STRING", F.lit(False)).alias("is_string")))
    if not levels:
        return here
    step = lambda e: leaves(e["value"], levels - 1, e["name"] if path is None else F.concat(path, F.lit("."), e["name"]))
    return F.coalesce(F.flatten(F.transform(_entries(value), step)), F.when(value.isNotNull(), here))


def _strings_below(value) -> list[str]:
    if isinstance(value, (dict, list)):
        return [t for v in (value.values() if isinstance(value, dict) else value) for t in _strings_below(v)]
    return [value] if isinstance(value, str) else []


def strings(text: Column, levels: int = 6) -> Column:
    """All strings in a value given as JSON text, at any depth, each once: an array; null for what does not parse.

    Only text with more than ``levels`` opening brackets can nest deeper than the expression looks; a Python function
    reads it as well.
    """
    value = parsed(text)

    def below(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield batch.map(lambda t: None if t is None else _strings_below(json.loads(t)))

    deep = F.when(value.isNotNull() & (F.length(F.regexp_replace(text, r"[^\[{]", "")) > levels), text)
    near = F.transform(F.filter(leaves(value, levels), lambda x: x["is_string"]), lambda x: x["text"])
    return F.array_distinct(F.concat(near, F.coalesce(F.pandas_udf(below, "array<string>")(deep), F.array().cast("array<string>"))))
