"""Event streams: lines over chunk ends, and deltas merged by what they name."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tracemill.operators import streams


def sse(*events, end=True, sep="\n\n"):
    return "".join(f"data: {e if isinstance(e, str) else json.dumps(e, ensure_ascii=False)}{sep}" for e in events) + ("data: [DONE]" + sep if end else "")


def cut(key, body, size, path="/v1/chat/completions"):
    raw = body.encode()
    return [(key, path, i, raw[a : a + size]) for i, a in enumerate(range(0, len(raw), size))]


def assembled(spark, bodies, size=7, path="/v1/chat/completions"):
    rows = [r for k, b in bodies.items() for r in cut(k, b, size, path)]
    random.Random(1).shuffle(rows)
    chunks = spark.createDataFrame(rows, "k string, path string, chunk_index int, chunk binary")
    events = streams.events(chunks, "k", "path")
    return {r.k: r for r in streams.assemble(events, "k", path="path").collect()}


def call(ident, name, arguments, call_id=None, kind="function"):
    return {"id": ident, "type": kind, "function": {"name": name, "arguments": arguments}, "call_id": call_id}


def message(row):
    return row.assistant_message.asDict(recursive=True) if row.assistant_message else None


def delta(**d):
    return {"choices": [{"index": 0, "delta": d}]}


def test_lines_and_chunk_ends(spark):
    body = 'event: x\r\ndata: {"a": "é€"}\r\n\r\ndata:not json\n\n: note\ndata:  \rdata: {"b": 1}\n\ndata: [DONE]\n\n'
    for size in (1, 2, 3, 1000):
        rows = streams.events(spark.createDataFrame(cut("r", body, size), "k string, path string, chunk_index int, chunk binary"), "k").orderBy("pos").collect()
        assert [(r.type, r.data) for r in rows] == [("json", '{"a": "é€"}'), ("text", "not json"), ("done", ""), ("json", '{"b": 1}'), ("done", "[DONE]")]


def test_chat_text_and_interleaved_calls(spark):
    piece = lambda i, **f: delta(tool_calls=[{"index": i, **f}])
    got = assembled(spark, {
        "text": sse(delta(role="assistant"), delta(content="He"), delta(content=[{"type": "text", "text": "l"}, {"text": {"value": "l"}}]), delta(content="o é"), delta(content="")),
        "calls": sse(
            delta(role="assistant", content="see"),
            piece(1, id="c1", type="function", function={"name": "no", "arguments": "{"}), piece(0, id="c0", function={"name": "look", "arguments": '{"q"'}),
            piece(1, function={"name": "te", "arguments": "}"}), delta(content=" it"), piece(0, type="custom", function={"name": "up", "arguments": ':"é"}'}),
        ),
        "nameless": sse(delta(tool_calls=[{"id": "a", "function": {"name": "f"}}, {"id": "b", "function": {"name": "g"}}]), delta(tool_calls=["junk", {"index": True, "id": "c", "function": {"name": "h", "arguments": "1"}}])),
        "whole": sse({"choices": [{"message": {"role": "critic", "content": "one"}}, {"delta": {"content": "two"}}]}),
        "silent": sse({"choices": []}, {"choices": [{"delta": {}}]}, "not json", end=False),
        "late": sse({"output_text": "first"}, {"output_text": "second"}),
    })
    none = {"tool_call_id": None, "name": None}
    assert message(got["text"]) == {"role": "assistant", "content": "Hello é", "tool_calls": None, **none}
    assert message(got["calls"]) == {"role": "assistant", "content": "see it", "tool_calls": [call("c0", "lookup", '{"q":"é"}', kind="custom"), call("c1", "note", "{}")], **none}
    assert message(got["nameless"])["tool_calls"] == [call("a", "f", ""), call("b", "g", ""), call("c", "h", "1")]
    assert message(got["whole"]) == {"role": "critic", "content": "onetwo", "tool_calls": None, **none}
    assert message(got["silent"]) is None and not got["silent"].complete and got["text"].complete
    assert message(got["late"])["content"] == "first" and got["late"].output is None


def test_responses_items_by_identifier(spark):
    added = lambda i, **item: {"type": "response.output_item.added", "output_index": i, "item": item}
    text = lambda ident, d: {"type": "response.output_text.delta", "item_id": ident, "delta": d}
    args = lambda d, **more: {"type": "response.function_call_arguments.delta", "delta": d, **more}
    got = assembled(spark, {
        "mixed": sse(
            added(0, id="m1", type="message", role="assistant"), added(1, id="f1", type="function_call", name="lookup", call_id="k1"), text("m1", "Need "),
            args('{"q":', item_id="f1"), text("m2", "to"), args('"w"}', item_id="f1"), args("{}", output_index=7, name="late", call_id="k2"), text("m1", " call"),
        ),
        "listed": sse({"type": "response.completed", "response": {"output": [
            {"id": "m", "type": "message", "content": [{"type": "output_text", "text": "whole"}]}, {"type": "function_call", "name": "f", "arguments": "{}"}, {"id": "r", "type": "reasoning"}]}}),
        "nameless": sse({"type": "response.output_text.delta", "text": "a"}, {"type": "response.output_text.delta", "delta": "b"}, args("1"), args("2")),
        "call only": sse(added(0, type="function_call", name="f", arguments="{}", call_id="z")),
        "silent": sse({"type": "response.created"}),
    }, path="/v1/responses")
    mixed = got["mixed"]
    assert mixed.output_text == "Need to call" and message(mixed)["content"] == "Need to call"
    assert [(o.id, o.type, o.text, o.name, o.arguments, o.call_id) for o in mixed.output] == [
        ("m1", "message", "Need  call", None, None, None), ("f1", "function_call", None, "lookup", '{"q":"w"}', "k1"),
        ("m2", "message", "to", None, None, None), ("output_7", "function_call", None, "late", "{}", "k2"),
    ]
    assert message(mixed)["tool_calls"] == [call("f1", "lookup", '{"q":"w"}', "k1"), call("output_7", "late", "{}", "k2")]
    assert [(o.id, o.type) for o in got["listed"].output] == [("m", "message"), ("output_1", "function_call")] and message(got["listed"])["content"] == "whole"
    assert message(got["nameless"])["content"] == "ab" and [(o.id, o.text, o.arguments) for o in got["nameless"].output] == [("output_message_0", "ab", None), ("output_function_call_0", None, "12")]
    assert message(got["call only"]) == {"role": "assistant", "content": None, "tool_calls": [call("output_0", "f", "{}", "z")], "tool_call_id": None, "name": None}
    assert message(got["silent"]) is None


@pytest.mark.parametrize("seed", range(3))
def test_any_interleaving_gives_the_same_message(spark, seed):
    rng = random.Random(seed)
    text, calls = "".join(rng.choice("aé \n\"\\{") for _ in range(200)), [(f"c{i}", f"tool_{i}", json.dumps({"x": "y" * i})) for i in range(4)]
    lanes = [[delta(content=text[a : a + 9]) for a in range(0, len(text), 9)]]
    for i, (ident, name, arguments) in enumerate(calls):
        lanes.append([delta(tool_calls=[{"index": i, "id": ident, "function": {"name": name}}])] + [delta(tool_calls=[{"index": i, "function": {"arguments": arguments[a : a + 3]}}]) for a in range(0, len(arguments), 3)])
    events = []
    while any(lanes):
        events.append(rng.choice([lane for lane in lanes if lane]).pop(0))
    got = assembled(spark, {"k": sse(*events)}, size=rng.randint(1, 50))["k"]
    assert message(got)["content"] == text and message(got)["tool_calls"] == [call(*c) for c in calls]


def test_no_chunks(spark):
    chunks = spark.createDataFrame([("a", 0, None)], "k string, chunk_index int, chunk binary")
    assert streams.assemble(streams.events(chunks, "k"), "k").collect() == []
    assert streams.assemble(streams.events(chunks.where(F.lit(False)), "k"), "k").collect() == []
