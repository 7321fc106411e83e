"""Plans of the model: rows that lie by run stay there, and what is read many times is made once."""

import re

import pytest
from pyspark.sql import DataFrame

from tracemill.operators import branches, records, spans
from tracemill.plans.model import Model
from tracemill.plans.registry import QUERIES

FOLDER = "/root/testdata/sf0.001"


def _plan(df: DataFrame) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def joined(spark):
    """No side is small enough to be sent to all, as with large tables."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_joins_within_a_run_deal_nothing_anew(joined):
    m = Model.of(joined, FOLDER)
    for df in (spans.request_spans(m.facts), branches.assign(m.facts, m.spans)):
        assert "Join" in _plan(df)
        assert "Exchange" not in _plan(df)
    assert "hashpartitioning(request_fact_id" not in _plan(QUERIES["same_prompt_pairs"](joined, FOLDER))


def test_members_are_read_from_a_table(joined):
    plan = _plan(Model.of(joined, FOLDER).members)
    assert "Scan" in plan and "Window" not in plan and "Join" not in plan


def test_payloads_of_a_request_are_parsed_once(spark):
    m = Model.of(spark, FOLDER)
    plan = records.requests(m.exchange_facts, m.exchange_assigned)._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"parse_?json", plan, re.IGNORECASE)) == 3  # of the request, the response and the error


def test_streams_and_failures_keep_their_status(spark):
    facts = Model.of(spark, FOLDER).exchange_facts
    found = {(r["kind"], r["status_code"]) for r in facts.select("kind", "status_code").distinct().collect()}
    assert found == {("request_started", None), ("error_raised", 502), ("response_finished", 200)}
    assert facts.where("streamed <> (kind = 'response_finished' and payload like '%\"streamed\":true%')").count() == 0
