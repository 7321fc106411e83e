"""Event streams of model answers: lines cut from chunks, and deltas merged into whole messages.

Chunks of one response may end anywhere, inside a character too; they are joined in order before lines are cut.
Every event becomes parts (a role, a piece of text, a piece of a tool call, a piece of an output item), and parts are
merged by what they name: tool calls by their index, output items by their identifier. Groups are single responses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.functions import variants as V
from tracemill.operators.messages import MESSAGE

_PART = "struct<kind:string,slot:string,type:string,id:string,role:string,name:string,call_id:string,text:string,raw:string,needed:boolean,prefix:string>"
RESPONSES_PATHS = ("/v1/responses", "/responses")


def lines_of(body: Column) -> Column:
    """Data lines of an event stream's text: (type, data), type being ``json``, ``text`` or ``done``."""
    lines = F.filter(F.split(body, "\r\n|\n|\r"), lambda x: F.startswith(x, F.lit("data:")))
    data = F.transform(lines, lambda x: F.trim(F.substring(x, F.lit(6), F.length(x))))
    kind = lambda x: F.when((x == "") | (x == "[DONE]"), "done").when(V.parsed(x).isNotNull(), "json").otherwise("text")
    return F.transform(data, lambda x: F.struct(kind(x).alias("type"), x.alias("data")))


def events(chunks: DataFrame, *keys: str, order: str = "chunk_index", chunk: str = "chunk") -> DataFrame:
    """Rows (keys, pos, type, data) of the events of each response, from its chunks (text or bytes) in order."""
    held = F.sort_array(F.collect_list(F.struct(F.col(order).alias("at"), F.hex(F.col(chunk).cast("binary")).alias("hex"))))
    joined = chunks.where(F.col(chunk).isNotNull()).groupBy(*keys).agg(F.array_join(F.transform(held, lambda x: x["hex"]), "").alias("_hex"))
    body = F.make_valid_utf8(F.unhex("_hex").cast("string"))
    return joined.select(*keys, F.posexplode(lines_of(body)).alias("pos", "event")).select(*keys, "pos", "event.type", "event.data")


def _part(kind: str, **of: Column) -> Column:
    names = ("slot", "type", "id", "role", "name", "call_id", "text", "raw", "needed", "prefix")
    return F.struct(F.lit(kind).alias("kind"), *(of.get(n, F.lit(None)).cast("string").alias(n) for n in names)).cast(_PART)


def _said(value: Column) -> dict[str, Column]:
    """A string as ``text``; any other value as ``raw`` JSON, whose text is taken out later."""
    return {"text": V.named(value, "$"), "raw": F.when(~V.is_null(value) & (F.schema_of_variant(value) != "STRING"), F.to_json(value))}


def _some(*parts: tuple[Column, Column]) -> Column:
    """Those of (condition, part) that hold, as an array."""
    return F.filter(F.array(*(F.when(condition, part) for condition, part in parts)), lambda x: x.isNotNull())


def _many(values: Column, part) -> Column:
    return F.coalesce(F.transform(values, part), F.array().cast(f"array<{_PART}>"))


def _chat_parts(data: Column) -> Column:
    """Roles, texts and pieces of tool calls of a chat event, choice by choice."""

    def of_choice(choice: Column) -> Column:
        delta = F.when(V.is_object(V.at(choice, "$.delta")) & (F.size(V.members(choice, "$.delta")) > 0), V.at(choice, "$.delta")).otherwise(V.at(choice, "$.message"))
        role, content = V.named(delta, "$.role"), V.at(delta, "$.content")
        calls = F.filter(V.items(delta, "$.tool_calls"), V.is_object)
        piece = lambda c: _part("call", slot=V.whole(c, "$.index"), id=V.named(c, "$.id"), type=V.named(c, "$.type"), name=V.named(c, "$.function.name"), text=V.named(c, "$.function.arguments"))
        return F.concat(_some((role.isNotNull(), _part("role", role=role)), (~V.is_null(content), _part("delta", needed=F.lit(True), **_said(content)))), _many(calls, piece))

    return F.flatten(F.coalesce(F.transform(V.items(data, "$.choices"), of_choice), F.array().cast(f"array<array<{_PART}>>")))


def _whole_item(item: Column, fallback: Column) -> Column:
    """An output item as it was added, done or listed in a response; its text or arguments add to the pieces."""
    kind = F.coalesce(V.named(item, "$.type"), F.lit("message"))
    role = F.coalesce(V.named(item, "$.role"), F.lit("assistant"))
    call = kind == "function_call"
    return _part(
        "item",
        slot=F.coalesce(V.named(item, "$.id"), fallback), prefix=F.lit("output_"), type=kind,
        role=F.when(kind == "message", role), name=F.when(call, V.named(item, "$.name")), call_id=F.when(call, V.named(item, "$.call_id")),
        **_said(F.when(kind == "message", V.at(item, "$.content")).when(call, V.at(item, "$.arguments"))),
    )


def _first_filled(value: Column, *paths: str) -> Column:
    """The first of some members that is neither missing, null nor empty."""
    empty = lambda v: V.is_null(v) | F.to_json(v).isin('""', "[]", "{}", "0", "false")
    return F.coalesce(*(F.when(~empty(V.at(value, p)), V.at(value, p)) for p in paths))


def _item_parts(data: Column) -> Column:
    """Pieces of the output items of a responses event."""
    event = F.coalesce(V.named(data, "$.type"), F.lit(""))
    named = F.coalesce(V.named(data, "$.item_id"), V.named(data, "$.output_item_id"), F.concat(F.lit("output_"), V.whole(data, "$.output_index").cast("string")))
    text, arguments = _first_filled(data, "$.delta", "$.text"), _first_filled(data, "$.delta", "$.arguments")
    is_text, is_arguments = event == "response.output_text.delta", (event == "response.function_call_arguments.delta") & arguments.isNotNull()
    item = V.at(data, "$.item")
    response = V.at(data, "$.response")
    own, inner = _first_filled(data, "$.output_text", "$.output"), _first_filled(response, "$.output_text", "$.output")
    return F.concat(
        _some(
            (is_text & text.isNotNull(), _part("delta", needed=F.lit(True), **_said(text))),
            (is_text, _part("item", slot=F.coalesce(named, F.lit("output_message_0")), type=F.lit("message"), role=F.lit("assistant"), **_said(text))),
            (is_arguments, _part("item", slot=F.coalesce(named, F.lit("output_function_call_0")), type=F.lit("function_call"), name=V.named(data, "$.name"), call_id=V.named(data, "$.call_id"), needed=F.lit(True), **_said(arguments))),
            (event.isin("response.output_item.added", "response.output_item.done") & V.is_object(item), _whole_item(item, named)),
            (own.isNotNull(), _part("fallback", needed=F.lit(True), **_said(own))),
            (inner.isNotNull(), _part("fallback", needed=F.lit(True), **_said(inner))),
        ),
        _many(F.filter(V.items(response, "$.output"), V.is_object), lambda x: _whole_item(x, F.lit(None).cast("string"))),
    )


def parts(stream: DataFrame, *keys: str) -> DataFrame:
    """Rows (keys, at, kind, slot, ...) of the parts of all JSON events; nameless ones get the next free name.

    A nameless tool call or output item is numbered by the distinct ones of its response before it.
    """
    data = stream.where("type = 'json'").select(*keys, "pos", V.parsed(F.col("data")).alias("_data"))
    flat = data.select(*keys, "pos", F.posexplode(F.concat(_chat_parts(F.col("_data")), _item_parts(F.col("_data")))).alias("sub", "part"))
    said = flat.select(*keys, F.struct("pos", "sub").alias("at"), "part.*").withColumn("text", F.coalesce("text", V.fragment(F.col("raw")))).drop("raw")
    rows = said.where("text is not null or needed is null").drop("needed").repartition(*keys)
    one = Window.partitionBy(*keys, "kind")
    first = F.when(F.col("slot").isNull(), 1).otherwise((F.row_number().over(Window.partitionBy(*keys, "kind", "slot").orderBy("at")) == 1).cast("int"))
    before = F.coalesce(F.sum("_first").over(one.orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    named = F.coalesce("slot", F.when(F.col("kind").isin("call", "item"), F.concat(F.coalesce("prefix", F.lit("")), before.cast("string"))), F.lit(""))
    return rows.withColumn("_first", first).withColumn("slot", named).drop("_first", "prefix")


def assemble(stream: DataFrame, *keys: str, path: str | None = None) -> DataFrame:
    """One row (keys, complete, output_text, output, assistant_message) for each response with events.

    ``stream`` has rows as ``events`` returns them; its column ``path``, if named, tells responses bodies (text and
    output items) from chat ones (a message with tool calls). ``complete`` is whether an end mark came. A stream that
    says nothing has a null message.
    """
    latest = lambda name: F.max_by(name, F.when(F.col(name).isNotNull(), F.col("at"))).alias(name)
    pieces = F.sort_array(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("at", "text"))))
    slots = parts(stream, *keys).groupBy(*keys, "kind", "slot").agg(F.min("at").alias("first"), latest("type"), latest("id"), latest("role"), latest("name"), latest("call_id"), F.array_join(F.transform(pieces, lambda x: x["text"]), "").alias("text"), F.array_join(F.transform(F.sort_array(F.collect_list(F.when((F.col("kind") == "call") & F.col("name").isNotNull(), F.struct("at", "name")))), lambda x: x["name"]), "").alias("names"), F.min_by("text", F.when(F.col("text").isNotNull(), F.col("at"))).alias("first_text"))
    is_kind = lambda kind: F.col("kind") == kind
    only = lambda kind, value: F.max(F.when(is_kind(kind), value))
    call = F.struct(F.col("slot").cast("long").alias("at"), F.struct("id", F.coalesce("type", F.lit("function")).alias("type"), F.struct(F.col("names").alias("name"), F.col("text").alias("arguments")).alias("function"), F.lit(None).cast("string").alias("call_id")).alias("call"))
    item_type = F.coalesce("type", F.lit("message"))
    item = F.struct("first", F.struct(F.col("slot").alias("id"), item_type.alias("type"), F.when(item_type == "message", F.coalesce("role", F.lit("assistant"))).alias("role"), F.when(item_type == "message", F.col("text")).alias("text"), "name", F.when(item_type == "function_call", F.col("text")).alias("arguments"), "call_id").alias("item"))
    shown = is_kind("item") & ((item_type == "function_call") | ((item_type == "message") & (F.col("text") != "")))
    whole = slots.groupBy(*keys).agg(
        only("role", F.col("role")).alias("role"), F.nullif(only("delta", F.col("text")), F.lit("")).alias("delta"), only("fallback", F.col("first_text")).alias("fallback"),
        F.transform(F.sort_array(F.collect_list(F.when(is_kind("call"), call))), lambda x: x["call"]).alias("calls"),
        F.transform(F.sort_array(F.collect_list(F.when(shown, item))), lambda x: x["item"]).alias("output"),
    )
    ends = stream.groupBy(*keys).agg(F.bool_or(F.col("type") == "done").alias("complete"), (F.first(path) if path else F.lit("")).alias("_path"))
    rows = ends.join(whole, list(keys), "left")
    responses = F.coalesce(F.col("_path").isin(*RESPONSES_PATHS), F.lit(False))
    text = F.coalesce("delta", "fallback")
    spoken = F.nullif(F.array_join(F.transform(F.filter("output", lambda x: x["type"] == "message"), lambda x: x["text"]), "\n"), F.lit(""))
    asked = F.transform(F.filter("output", lambda x: x["type"] == "function_call"), lambda x: F.struct(x["id"].alias("id"), F.lit("function").alias("type"), F.struct(F.coalesce(x["name"], F.lit("")).alias("name"), x["arguments"].alias("arguments")).alias("function"), x["call_id"].alias("call_id")))
    content = F.when(responses, F.coalesce(text, spoken)).otherwise(text)
    calls = F.when(responses, asked).otherwise(F.col("calls"))
    message = F.struct(
        F.when(responses, F.lit("assistant")).otherwise(F.coalesce("role", F.lit("assistant"))).alias("role"),
        content.alias("content"),
        F.when(F.size(calls) > 0, calls).alias("tool_calls"),
        F.lit(None).cast("string").alias("tool_call_id"),
        F.lit(None).cast("string").alias("name"),
    ).cast(MESSAGE)
    told = content.isNotNull() | (F.size(calls) > 0)
    return rows.select(*keys, "complete", F.when(responses, text).alias("output_text"), F.when(responses, F.col("output")).alias("output"), F.when(told, message).alias("assistant_message"))
