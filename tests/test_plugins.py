"""What users bring: graders and builders by name, and batches that are taken whole or not at all."""

import pytest
from pyspark.sql import functions as F

from tracemill.operators import builders, plugins
from tracemill.streaming import capture


def test_grades():
    good = {True: (True, 1.0), 0: (False, 0.0), 1.5: (True, 1.5)}
    assert all(tuple(plugins.normalized_grade(k, "g").values()) == v for k, v in good.items())
    assert plugins.normalized_grade({"pass": False}, "g") == {"passed": False, "score": 0.0} and plugins.normalized_grade({"score": 1}, "g") == {"passed": True, "score": 1.0}
    assert plugins.normalized_grade({"pass": True, "score": 0.2}, "g") == {"passed": True, "score": 0.2}
    for bad in (None, "yes", [], {}, {"pass": 1}, {"score": True}, {"pass": None, "score": None}):
        with pytest.raises(TypeError, match="grader g"):
            plugins.normalized_grade(bad, "g")


def test_graders_by_name(spark):
    df = spark.createDataFrame([("a b", "a c"), (None, "x"), ("", None)], "a string, r string")
    got = [tuple(r.g) for r in df.select(plugins.grade_with("tracemill.plans.exchanges:shared_words", F.col("a"), F.col("r")).alias("g")).collect()]
    assert got == [(True, 0.5), (False, 0.0), (False, 0.0)]
    with pytest.raises(Exception, match="operator:concat returned"):
        df.where("a is not null and r is not null").select(plugins.grade_with("operator:concat", F.col("a"), F.col("r")).alias("g")).collect()
    for wrong, error in (("nowhere", ValueError), ("no_such_module:x", ImportError), ("os:no_such", AttributeError), ("os:sep", TypeError)):
        with pytest.raises(error):
            plugins.load(wrong)


def test_builders_by_name(spark):
    assert plugins.load_builders({plugins.ENV: "longest=tracemill.plans.exchanges:longest_turns"}) == ["longest"] and "longest" in builders.names()
    try:
        turns = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "hello"), (1, 3, "assistant", "yo")], "conv_id long, turn long, role string, text string")
        assert [tuple(r) for r in builders.get("longest")(turns=turns).collect()] == [("chat_1_1", 5)]
        with pytest.raises(ValueError):
            plugins.load_builders({plugins.ENV: "longest=tracemill.plans.exchanges:longest_turns"})
    finally:
        builders.unregister("longest")
    with pytest.raises(ValueError):
        builders.get("longest")
    assert plugins.load_builders({}) == [] and builders.get("binary-rl") is builders.get("binary_rl")
    with pytest.raises(ValueError):
        plugins.load_builders({plugins.ENV: "nameless"})
    with pytest.raises(ValueError, match="left out run_id"):
        plugins.checked(lambda: spark.range(1), ("run_id",))()
    with pytest.raises(TypeError):
        plugins.checked(lambda: [], ())()


def test_batches_whole_or_not_at_all(spark, tmp_path):
    path, kinds = str(tmp_path / "facts"), ("request_started", "response_finished")
    rows = lambda *r: spark.createDataFrame([(i, run, "s", k, n) for n, (i, run, k) in enumerate(r)], "fact_id string, run_id string, session_id string, kind string, seq long").withColumn("ts", F.timestamp_seconds("seq"))
    write, stored = capture.append_facts(path, kinds), lambda: sorted((r.batch, r.fact_id) for r in spark.read.parquet(path).collect())
    one = rows(("a", "r", kinds[0]), ("b", "r", kinds[1]), ("a", "r", kinds[0]))
    write(one, 0)
    write(one, 0)  # comes again after a failure
    assert stored() == [(0, "a"), (0, "b")]
    with pytest.raises(ValueError, match="no_identifier|unknown_kind|no_scope"):
        write(rows(("c", "r", kinds[0]), ("d", "r", "unheard")), 1)
    assert stored() == [(0, "a"), (0, "b")]
    write(rows(("b", "r", kinds[0]), ("c", "r", kinds[0])), 2)
    assert stored() == [(0, "a"), (0, "b"), (2, "c")]
