"""Capture of streamed responses: chunks in, chunk facts and one closing fact out, with bounded facts and flags.

State is kept for each request: chunks wait until those before them have come, so the order of arrival does not matter.
At the end mark the first ``cap`` chunks become facts, the closing fact counts the others, and says whether the stream
ended with its mark and whether the client went away. A response of which nothing more comes is closed by an event-time
timer; what comes after the closing fact is ignored, and the last of the state goes at the next timer.
"""

from __future__ import annotations

import datetime
import json
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Columns of the input: a chunk has an index from 1 on and bytes, a mark (``end`` or ``disconnect``) the number of chunks.
CHUNKS = "request_fact_id string, run_id string, session_id string, request_id string, path string, status_code int, chunk_index long, chunk binary, mark string, chunks long, ts timestamp"
FACTS = (
    "kind string, request_fact_id string, run_id string, session_id string, request_id string, path string, status_code int, chunk_index long, chunk_size long, elapsed_ms long, "
    "fragments array<struct<type:string,data:string>>, body_size long, chunk_count long, stored_chunk_count long, omitted_chunk_count long, stream_duration_ms long, "
    "stream_complete boolean, client_disconnected boolean, expired boolean, capture_truncated boolean, preview string, ts timestamp"
)
_ABOUT = ("run_id", "session_id", "request_id", "path", "status_code")
_HEAD = "run_id string, session_id string, request_id string, path string, status_code int, next long, bytes long, first_ms long, last_ms long, pending binary, preview binary, complete boolean, mark string, chunks long, closed boolean, timer long"
_GAP = re.compile(rb"\r\n\r\n|\n\n|\r\r")


def fragments_of(block: bytes) -> list[tuple[str, str]]:
    """Data lines of whole events: (type, data)."""
    out = []
    for line in re.split(r"\r\n|\n|\r", block.decode("utf-8", "replace")):
        if line.startswith("data:"):
            data = line[5:].strip()
            kind = "done" if data in ("", "[DONE]") else "json"
            if kind == "json":
                try:
                    json.loads(data)
                except ValueError:
                    kind = "text"
            out.append((kind, data))
    return out


def _rows(fragments: list) -> list[dict]:
    return [{"type": kind, "data": data} for kind, data in fragments]


def _ms(ts: datetime.datetime) -> int:
    return round(ts.timestamp() * 1000)


class ResponseCapture(StatefulProcessor):
    """Chunks of one request in, its facts out once they are complete."""

    def __init__(self, cap: int = 32, preview_bytes: int = 65_536, idle_ms: int = 600_000):
        self.cap, self.preview_bytes, self.idle_ms = cap, preview_bytes, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.head = handle.getValueState("head", _HEAD)
        self.waiting = handle.getMapState("waiting", "chunk_index long", "chunk binary, at long")
        self.stored = handle.getListState("stored", "chunk_index long, size long, at long, fragments string")
        self.events = handle.getListState("events", "type string, data string")

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        head = self._head()
        for row in rows:
            if head["closed"]:
                continue
            head.update({n: row[n] for n in _ABOUT if row[n] is not None})
            at = _ms(row["ts"])
            head["last_ms"] = max(head["last_ms"] or at, at)
            if row["mark"]:
                head["mark"], head["chunks"] = row["mark"], row["chunks"]
            elif row["chunk_index"] is not None and row["chunk_index"] >= head["next"]:
                self.waiting.updateValue((row["chunk_index"],), (bytes(row["chunk"] or b""), at))
        if not head["closed"]:
            while self.waiting.containsKey((head["next"],)):
                chunk, at = self.waiting.getValue((head["next"],))
                self._take(head, bytes(chunk), at)
            if head["mark"] and (head["chunks"] is None or head["next"] > head["chunks"]):
                yield from self._finish(key[0], head, expired=False)
        self._wait(head)
        self._keep(head)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        head = self._head()
        if expiredTimerInfo.getExpiryTimeInMs() != head["timer"]:
            return
        if head["closed"]:
            self.head.clear()
            return
        for index in sorted(k[0] for k in self.waiting.keys()):  # what came after a gap
            chunk, at = self.waiting.getValue((index,))
            self._take(head, bytes(chunk), at)
        yield from self._finish(key[0], head, expired=True)
        self.head.clear()

    def _head(self) -> dict:
        if self.head.exists():
            return dict(zip((f.split()[0] for f in _HEAD.split(", ")), self.head.get()))
        return {f.split()[0]: None for f in _HEAD.split(", ")} | {"next": 1, "bytes": 0, "pending": b"", "preview": b"", "complete": False, "closed": False}

    def _keep(self, head: dict) -> None:
        self.head.update(tuple(head[f.split()[0]] for f in _HEAD.split(", ")))

    def _wait(self, head: dict) -> None:
        """One timer at a time, ``idle_ms`` after the newest row."""
        if head["last_ms"] is None:
            return
        due = head["last_ms"] + self.idle_ms
        if due != head["timer"]:
            if head["timer"] is not None:
                self.handle.deleteTimer(head["timer"])
            self.handle.registerTimer(due)
            head["timer"] = due

    def _take(self, head: dict, chunk: bytes, at: int) -> None:
        """The next chunk in order."""
        index = head["next"]
        self.waiting.removeKey((index,))
        *blocks, rest = _GAP.split(bytes(head["pending"]) + chunk)
        found = [f for b in blocks for f in fragments_of(b)]
        head.update(next=index + 1, bytes=head["bytes"] + len(chunk), pending=rest, first_ms=at if head["first_ms"] is None else head["first_ms"])
        head["preview"] = bytes(head["preview"]) + chunk[: self.preview_bytes - len(head["preview"])] if len(head["preview"]) < self.preview_bytes else head["preview"]
        head["complete"] = head["complete"] or any(kind == "done" for kind, _ in found)
        if found:
            self.events.appendList(found)
        if index <= self.cap:
            self.stored.appendValue((index, len(chunk), at, json.dumps(found)))

    def _finish(self, name: str, head: dict, expired: bool) -> Iterator[Row]:
        last = fragments_of(bytes(head["pending"]))
        count, first = head["next"] - 1, head["first_ms"] or head["last_ms"]
        fields = [f.split()[0] for f in FACTS.split(", ")]
        about = {n: head[n] for n in _ABOUT} | {"request_fact_id": name, "ts": datetime.datetime.fromtimestamp(head["last_ms"] / 1000)}
        fact = lambda **of: Row(**{f: (about | of).get(f) for f in fields})
        stored = sorted(self.stored.get(), key=lambda s: s[0]) if self.stored.exists() else []
        for index, size, at, found in stored:
            yield fact(kind="response_chunk", chunk_index=index, chunk_size=size, elapsed_ms=at - first, fragments=_rows(json.loads(found)))
        events = [tuple(e) for e in self.events.get()] if self.events.exists() else []
        complete = head["complete"] or any(kind == "done" for kind, _ in last)
        preview = bytes(head["preview"])
        yield fact(
            kind="response_finished", fragments=_rows(events + last), body_size=head["bytes"], chunk_count=count, stored_chunk_count=len(stored), omitted_chunk_count=count - len(stored), stream_duration_ms=head["last_ms"] - first,
            stream_complete=complete, client_disconnected=head["mark"] == "disconnect", expired=expired, capture_truncated=head["bytes"] > len(preview), preview=preview.decode("utf-8", "replace"),
        )
        for state in (self.stored, self.events, self.waiting):
            state.clear()
        head.update(closed=True, pending=b"", preview=b"")


def captured(chunks: DataFrame, cap: int = 32, preview_bytes: int = 65_536, idle: str = "10 minutes", lateness: str = "1 minute") -> DataFrame:
    """Facts of streamed responses (``FACTS``) from a stream of ``CHUNKS``; needs the RocksDB state store."""
    return (
        chunks.withWatermark("ts", lateness)
        .groupBy("request_fact_id")
        .transformWithState(ResponseCapture(cap, preview_bytes, interval_ms(idle)), outputStructType=FACTS, outputMode="append", timeMode="EventTime")
    )


def interval_ms(text: str) -> int:
    """Milliseconds of an interval such as ``10 minutes``."""
    number, unit = text.split()
    return int(number) * {"second": 1000, "minute": 60_000, "hour": 3_600_000, "day": 86_400_000}[unit.rstrip("s")]


def finished_events(facts: DataFrame) -> DataFrame:
    """Events of finished responses as ``operators.streams.assemble`` reads them."""
    rows = facts.where("kind = 'response_finished'").select("run_id", "request_fact_id", "path", F.posexplode("fragments").alias("pos", "event"))
    return rows.select("run_id", "request_fact_id", "path", "pos", "event.type", "event.data")
