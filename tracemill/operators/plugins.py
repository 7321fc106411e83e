"""Graders and builders that users bring: named by ``module:attribute``, checked, run over Arrow batches.

A grader is a function of (answer, reference) of one case that returns a truth value, a number, or a dictionary with
``pass`` and ``score``; anything else is an error that names the grader. Tasks import it by name, so its module must be
there on the executors. A builder is a callable of DataFrames that returns one with the columns it promises.
"""

from __future__ import annotations

import importlib
import importlib.metadata
import os
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.operators import builders

ENV, GROUP = "TRACEMILL_BUILDERS", "tracemill.builders"
GRADE = "array<struct<passed:boolean,score:double>>"


def load(reference: str) -> Callable:
    """The callable that ``module:attribute`` names; attributes may be dotted."""
    module, _, name = reference.partition(":")
    if not module or not name:
        raise ValueError(f"{reference!r} is not of the form module:attribute")
    found = importlib.import_module(module)
    for part in name.split("."):
        found = getattr(found, part)
    if not callable(found):
        raise TypeError(f"{reference} is no callable")
    return found


def normalized_grade(result, grader: str) -> dict:
    """``passed`` and ``score`` of a grader's result: a number passes from 1 on; a missing part follows from the other."""
    number = lambda v: isinstance(v, (int, float)) and not isinstance(v, bool)
    if isinstance(result, bool):
        return {"passed": result, "score": float(result)}
    if number(result):
        return {"passed": result >= 1, "score": float(result)}
    if isinstance(result, dict) and ("pass" in result or "score" in result):
        passed, score = result.get("pass"), result.get("score")
        if (passed is None or isinstance(passed, bool)) and (score is None or number(score)) and not (passed is None and score is None):
            return {"passed": passed if passed is not None else score >= 1, "score": float(score if score is not None else passed)}
    raise TypeError(f"grader {grader} returned {result!r}: it must be a truth value, a number, or have pass or score")


def grade_with(reference: str, answer: Column, expected: Column) -> Column:
    """(passed, score) of every case by a user's grader; cases without an answer are not shown to it and fail with 0."""
    load(reference)  # an unknown name fails here, not in a task

    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        grader = load(reference)
        for answers, references in parts:
            yield pd.Series([None if a is None else [normalized_grade(grader(a, r), reference)] for a, r in zip(answers, references)], dtype=object)

    graded = F.get(F.pandas_udf(run, GRADE)(answer, expected), 0)
    return F.struct(F.coalesce(graded["passed"], F.lit(False)).alias("passed"), F.coalesce(graded["score"], F.lit(0.0)).alias("score"))


def checked(builder: Callable[..., DataFrame], columns: tuple[str, ...]) -> Callable[..., DataFrame]:
    """A builder whose result must be a DataFrame with the columns that it promises."""

    def build(**tables: DataFrame) -> DataFrame:
        rows = builder(**tables)
        if not isinstance(rows, DataFrame):
            raise TypeError(f"builder {builder!r} returned {type(rows).__name__}, no DataFrame")
        if lacking := [c for c in columns if c not in rows.columns]:
            raise ValueError(f"builder {builder!r} left out {', '.join(lacking)}")
        return rows

    return build


def load_builders(environment: dict | None = None) -> list[str]:
    """Register the builders that the environment (``name=module:attribute``, by commas) and installed packages name.

    Returns their names; a name that is in use is an error.
    """
    listed = (environment if environment is not None else os.environ).get(ENV, "")
    named = [tuple(x.strip().split("=", 1)) for x in listed.split(",") if x.strip()]
    if wrong := [n for n in named if len(n) != 2]:
        raise ValueError(f"{ENV} must hold name=module:attribute, not {wrong[0][0]!r}")
    named += [(e.name, e.value) for e in importlib.metadata.entry_points(group=GROUP)]
    for name, reference in named:
        builders.register(name, checked(load(reference), ("run_id",)))
    return [n for n, _ in named]
