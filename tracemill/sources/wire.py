"""An adapter that maps a table of conversations to exchanges with bodies, as a capture would have kept them.

Every assistant turn with turns before it is a run of one exchange. Bodies come in five shapes, by conversation: chat,
responses, a chat stream, a responses stream, and chat bodies kept elsewhere. In every third conversation a first
attempt fails and is tried again with the same request, its members in another order. Every fourth turn calls tools.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.functions import variants as V
from tracemill.operators import messages, streams

SHAPES = ("chat", "responses", "chat_stream", "responses_stream", "kept_elsewhere")
_NO_TEXT = ("user_id", "thread_id", "task_id", "hinted_type", "hinted_parent", "semantic_kind", "target_fact_id", "target_request_id", "hint_branch_id", "hint_branch_type", "hint_status", "hint_parent_branch_id", "hint_parent_fact_id", "hint_parent_request_id")


def _json(**members: Column) -> Column:
    return F.to_json(F.struct(*(v.alias(k) for k, v in members.items())))


def _pieces(text: Column, size: int) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))


def exchanges(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, base, shape, path, retried, prior, text, calls) of assistant turns with turns before them."""
    earlier = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    rows = turns.withColumn("prior", F.collect_list(F.struct("role", F.col("text").alias("content"))).over(earlier)).where("role = 'assistant' and size(prior) > 0")
    shape = F.element_at(F.array(*map(F.lit, SHAPES)), (F.col("conv_id") % 5 + 1).cast("int"))
    key = F.concat_ws("_", "conv_id", "turn")
    call = lambda n, name, arguments: F.struct(F.concat(F.lit("call_"), key, F.lit(f"_{n}")).alias("id"), F.lit("function").alias("type"), F.struct(F.lit(name).alias("name"), arguments.alias("arguments")).alias("function"), F.lit(None).cast("string").alias("call_id"))
    calls = F.array(call(0, "lookup", _json(turn=F.col("turn"), of=F.col("conv_id"))), call(1, "note", _json(n=F.array(F.col("turn"), F.col("turn") + 1), deep=F.struct(F.lit("é").alias("x")))))
    return rows.select(
        "conv_id", "turn", ((F.col("conv_id") * (1 << 20) + F.col("turn")) * 4).alias("base"), shape.alias("shape"),
        F.when(shape.startswith("responses"), "/v1/responses").otherwise("/v1/chat/completions").alias("path"), (F.col("conv_id") % 3 == 0).alias("retried"),
        "prior", "text", F.when(F.col("turn") % 4 == 3, calls).otherwise(F.array().cast(f"array<{messages.CALL}>")).alias("calls"),
    )


def _request_body(again: bool) -> Column:
    """The body of a first attempt, or the same one as sent again: members turned round, another stream flag and identifier."""
    turn_round = (lambda *fields: F.struct(*reversed(fields))) if again else F.struct
    chat = F.transform("prior", lambda m: turn_round(m["role"].alias("role"), m["content"].alias("content")))
    inputs = F.transform("prior", lambda m: turn_round(F.lit("message").alias("type"), m["role"].alias("role"), F.array(turn_round(F.lit("input_text").alias("type"), m["content"].alias("text"))).alias("content")))
    stream = F.lit(again).alias("stream")
    about = [F.lit("m").alias("model"), F.struct(F.lit(0.5).alias("temperature")).alias("options")]
    mine = [stream, F.lit("again").alias("request_id")] if again else [stream]
    body = lambda name, items: F.to_json(turn_round(*about, items.alias(name), *mine))
    return F.when(F.col("path") == "/v1/responses", body("input", inputs)).otherwise(body("messages", chat))


def _items() -> Column:
    """Output items of a responses body."""
    said = F.array(_json(type=F.lit("message"), id=F.lit("msg_0"), role=F.lit("assistant"), content=F.array(F.struct(F.lit("output_text").alias("type"), F.col("text").alias("text")))))
    asked = F.transform("calls", lambda c: _json(type=F.lit("function_call"), id=c["id"], name=c["function"]["name"], arguments=c["function"]["arguments"]))
    return F.concat(F.lit("["), F.array_join(F.concat(said, asked), ","), F.lit("]"))


def _stream_events() -> Column:
    """Events of a streamed answer, those of text and calls interleaved."""
    at = lambda i, lane, event: F.struct((i * 10 + lane).alias("at"), event.alias("event"))
    delta = lambda **d: _json(choices=F.array(F.struct(F.lit(0).alias("index"), F.struct(*(v.alias(k) for k, v in d.items())).alias("delta"))))
    chat_call = lambda i, **f: delta(tool_calls=F.array(F.struct(i.alias("index"), *(v.alias(k) for k, v in f.items()))))
    split = lambda c: _pieces(c["function"]["arguments"], 7)
    chat = F.concat(
        F.array(at(F.lit(-2), 0, delta(role=F.lit("assistant")))),
        F.transform(_pieces(F.col("text"), 40), lambda t, i: at(i, 0, delta(content=t))),
        F.transform("calls", lambda c, n: at(F.lit(-1), n + 1, chat_call(n, id=c["id"], type=c["type"], function=F.struct(c["function"]["name"].alias("name"))))),
        F.flatten(F.transform("calls", lambda c, n: F.transform(split(c), lambda a, i: at(i, n + 1, chat_call(n, function=F.struct(a.alias("arguments"))))))),
    )
    added = lambda i, item: _json(type=F.lit("response.output_item.added"), output_index=i, item=item)
    responses = F.concat(
        F.array(at(F.lit(-2), 0, added(F.lit(0), F.struct(F.lit("msg_0").alias("id"), F.lit("message").alias("type"), F.lit("assistant").alias("role"))))),
        F.transform(_pieces(F.col("text"), 40), lambda t, i: at(i, 0, _json(type=F.lit("response.output_text.delta"), item_id=F.lit("msg_0"), delta=t))),
        F.transform("calls", lambda c, n: at(F.lit(-1), n + 1, added(n + 1, F.struct(c["id"].alias("id"), F.lit("function_call").alias("type"), c["function"]["name"].alias("name"))))),
        F.flatten(F.transform("calls", lambda c, n: F.transform(split(c), lambda a, i: at(i, n + 1, _json(type=F.lit("response.function_call_arguments.delta"), item_id=c["id"], delta=a))))),
    )
    return F.transform(F.array_sort(F.when(F.col("path") == "/v1/responses", responses).otherwise(chat)), lambda x: x["event"])


def stream_chunks(rows: DataFrame, size: int = 100) -> DataFrame:
    """Chunks (conv_id, turn, path, chunk_index, chunk) of the streamed answers, cut without regard to events."""
    body = F.concat(F.array_join(F.transform(_stream_events(), lambda e: F.concat(F.lit("data: "), e)), "\n\n"), F.lit("\n\ndata: [DONE]\n\n"))
    return rows.where(F.col("shape").endswith("_stream")).select("conv_id", "turn", "path", F.posexplode(_pieces(body, size)).alias("chunk_index", "chunk"))


def _body_ref(body: Column) -> Column:
    return F.struct(F.lit("local_file").alias("storage"), F.concat_ws("/", F.concat(F.lit("chat_"), "conv_id"), F.col("turn").cast("string"), F.lit("body.json.gz")).alias("relative_path"), F.lit("gzip").alias("encoding"), F.lit("application/json").alias("content_type"), F.octet_length(body).alias("byte_size"), F.sha2(body, 256).alias("sha256"))


def facts_from_conversations(turns: DataFrame) -> DataFrame:
    """Facts of all exchanges with their payloads as JSON text."""
    rows = exchanges(turns)
    merged = streams.assemble(streams.events(stream_chunks(rows), "conv_id", "turn", "path"), "conv_id", "turn", path="path").select("conv_id", "turn", "complete", "assistant_message")
    rows = rows.join(merged, ["conv_id", "turn"], "left").withColumns({"body": _request_body(False), "body_again": F.when(F.col("retried"), _request_body(True))})
    rows = rows.withColumns({f"{c}_print": messages.fingerprint(F.col(c)) for c in ("body", "body_again")})
    message = F.struct(F.lit("assistant").alias("role"), F.col("text").alias("content"), F.when(F.size("calls") > 0, F.col("calls")).alias("tool_calls"))
    elsewhere, shape = F.col("shape") == "kept_elsewhere", F.col("shape")
    request = lambda body: F.when(elsewhere, _json(path=F.col("path"), capture_truncated=F.lit(True), body_ref=_body_ref(F.col(body)), input_messages=F.col("prior"), request_fingerprint=F.col(f"{body}_print"))).otherwise(F.concat(F.lit('{"path":"'), F.col("path"), F.lit('","json":'), body, F.lit("}")))
    response = (
        F.when(shape == "chat", _json(status_code=F.lit(200), json=F.struct(F.array(F.struct(F.lit(0).alias("index"), message.alias("message"))).alias("choices"))))
        .when(shape == "responses", F.concat(F.lit('{"status_code":200,"json":{"output":'), _items(), F.lit("}}")))
        .when(elsewhere, _json(status_code=F.lit(200), capture_truncated=F.lit(True), body_ref=_body_ref(F.to_json(message)), canonical=F.struct(message.alias("assistant_message"))))
        .otherwise(_json(status_code=F.lit(200), streamed=F.lit(True), stream_complete=F.col("complete"), canonical=F.struct(F.col("assistant_message"))))
    )
    error = _json(status_code=F.lit(502), error=F.lit("upstream_failed"), json=F.struct(F.struct(F.col("turn").alias("turn")).alias("detail")))
    null = F.lit(None).cast("string")
    name = lambda j: F.concat(F.lit("w"), F.col("base") + j)

    def fact(j: int, kind: str, payload: Column, parent: Column = null, request_at: int | Column = 0, body: str | None = None) -> Column:
        asked = name(request_at if isinstance(request_at, int) else request_at)
        return F.struct((F.col("base") + j).alias("seq"), F.lit(kind).alias("kind"), F.lit("proxy" if kind == "error_raised" else "model").alias("actor"), parent.alias("parent_ref"), asked.alias("request_id"), payload.alias("payload"), (F.col(f"{body}_print") if body is not None else null).alias("fingerprint"))

    answered = F.when(F.col("retried"), 2).otherwise(0)
    built = F.array(
        fact(0, "request_started", request("body"), body="body"),
        F.when(F.col("retried"), fact(1, "error_raised", error, name(0))),
        F.when(F.col("retried"), fact(2, "request_started", request("body_again"), request_at=2, body="body_again")),
        fact(3, "response_finished", response, name(answered), answered),
    )
    flat = rows.select("conv_id", "turn", "path", "shape", F.explode(F.filter(built, lambda f: f.isNotNull())).alias("f"))
    value = V.parsed(F.when(F.col("kind") != "request_started", F.col("payload")))  # requests, the largest, have neither member
    whole = lambda x: x.cast("long")
    return flat.select(
        F.col("f.seq").alias("seq"), F.concat(F.lit("w"), "f.seq").alias("fact_id"), F.concat(F.lit("chat_"), "conv_id").alias("session_id"), F.concat_ws("_", F.lit("chat"), "conv_id", "turn").alias("run_id"),
        F.timestamp_seconds(1_700_000_000 + F.col("conv_id") * 1000 + F.col("turn") * 4 + F.col("f.seq") % 4).alias("ts"), "f.kind", "f.actor", "f.parent_ref", "f.request_id", "path", "f.payload", "f.fingerprint",
        F.lit("captured").alias("capture_source"), F.octet_length("f.payload").cast("long").alias("body_size"), whole(F.lit(0)).alias("chunk_count"),
        *(whole(F.lit(None)).alias(c) for c in ("latency_ms", "ttfb_ms", "stream_ms")), *(null.alias(c) for c in _NO_TEXT),
    ).withColumns({"status_code": V.whole(value, "$.status_code"), "streamed": F.coalesce(V.truth(value, "$.streamed"), F.lit(False))})


def artifacts_from_exchanges(rows: DataFrame) -> DataFrame:
    """External supervision with open payloads: a score or label on something of each exchange, preferences of retried ones."""
    run, number = F.concat_ws("_", F.lit("chat"), "conv_id", "turn"), F.col("conv_id") % 7
    pick = lambda *values: F.element_at(F.array(*values), (number % len(values) + 1).cast("int"))
    text = F.lit
    targets = [F.concat(text("fact:w"), F.col("base")), text("branch:br_main"), F.concat(text("run:"), run), F.concat(text("session:chat_"), "conv_id"), F.concat(text("slice:s"), "turn")]
    target = F.element_at(F.array(*targets), (F.col("conv_id") % 5 + 1).cast("int"))
    scored = pick(_json(score=F.col("turn") / 8), _json(label=F.col("turn") % 3 == 0), _json(reward=F.lit(True), value=F.col("turn")), _json(score=text("0.5")), _json(label=F.lit(1)), _json(score=F.lit(None).cast("double"), reward=F.lit(0.25)), text('{"note":"none"}'))
    preferred = F.element_at(F.array(_json(chosen=text("br_retry_1"), rejected=text("br_main"), reason=text("tried again")), _json(chosen_branch_id=text("br_retry_1"), rejected_branch_id=text("br_main")), text('{"ordered":["br_retry_1","br_gone",7,"br_main"],"reason":""}')), (F.col("conv_id") % 3 + F.col("turn") % 3 + 1).cast("int"))
    kind = F.when(preferred.contains("ordered"), "ranking").otherwise("preference")
    common = lambda prefix: [F.concat(text(prefix), run).alias("artifact_id"), F.concat(text("chat_"), "conv_id").alias("session_id"), F.when(F.col("turn") % 5 != 4, run).alias("run_id"), F.when(number == 6, "superseded").otherwise("active").alias("status"), (F.col("turn") / 10).alias("confidence")]
    scores = rows.select(*common("score_"), text("score").alias("artifact_type"), target.alias("target_ref"), scored.alias("payload"))
    preferences = rows.where("retried").select(*common("pref_"), kind.alias("artifact_type"), F.concat(text("run:"), run).alias("target_ref"), preferred.alias("payload"))
    return scores.unionByName(preferences)
