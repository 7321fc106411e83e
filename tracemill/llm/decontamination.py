"""Benchmark decontamination with a generalised suffix automaton of the benchmark's words.

The automaton of all items is built once, broadcast, and every document's words run through it: at each
word it knows the longest match that ends there. A match of ``window`` words or more hits those words; an
item of fewer words is hit by its whole sequence. Items beyond ``block_bytes`` of text are split into
blocks with an automaton each, of which a task holds one at a time, so the broadcast stays bounded.

Null or empty texts have no words; a null identifier of a document is kept; items without text, words or
identifier are left out; repeated items and equal identifiers count once by identifier; an empty
benchmark hits nothing; an empty table gives no rows. Other columns stay untouched.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import batch_of, text_slices

#: Runs of characters other than ASCII signs and spaces; A-Z are lower-cased first.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
WINDOW = 13
COVERAGE = 0.05


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.translate(_LOWER) if not text.isascii() else text.lower()) if text else []


class SuffixAutomaton:
    """Generalised automaton of word sequences, with the items that reach each state."""

    def __init__(self, items: Iterable[tuple[str, list[str]]], window: int = WINDOW):
        self.window = window
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[tuple[int, str]] = []
        whole: list[tuple[int, str]] = []
        for item, words in items:
            last = 0
            for word in words:
                last = self._extend(last, word)
                ends.append((last, item))
            if 0 < len(words) < window:
                whole.append((last, item, len(words)))
        self._items(ends, whole)

    def _extend(self, last: int, word: str) -> int:
        nexts, link, length = self.next, self.link, self.length
        if word in nexts[last]:
            q = nexts[last][word]
            return q if length[q] == length[last] + 1 else self._split(last, q, word)
        new = len(nexts)
        nexts.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and word not in nexts[p]:
            nexts[p][word] = new
            p = link[p]
        if p >= 0:
            q = nexts[p][word]
            link[new] = q if length[q] == length[p] + 1 else self._split(p, q, word)
        return new

    def _split(self, p: int, q: int, word: str) -> int:
        copy = len(self.next)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        self.link[q] = copy
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        return copy

    def _items(self, ends, whole) -> None:
        """Only states that hold a string of ``window`` words need their items; short ones need their own."""
        n, link, length, window = len(self.next), self.link, self.length, self.window
        order = sorted(range(1, n), key=length.__getitem__)
        self.at = [-1] * n  # the suffix state that holds the last ``window`` words
        for s in order:
            if length[s] >= window:
                self.at[s] = s if length[link[s]] < window else self.at[link[s]]
        self.items: dict[int, set[str]] = {}
        for s, item in ends:
            if self.at[s] >= 0:
                self.items.setdefault(self.at[s], set()).add(item)
        self.short: list[list[tuple[int, str]]] = [[] for _ in range(n)]
        own: dict[int, list[tuple[int, str]]] = {}
        for s, item, size in whole:
            own.setdefault(s, []).append((size, item))
        for s in order:  # a suffix state's short items end wherever this state does
            self.short[s] = own.get(s, []) + self.short[link[s]] if own.get(s) or self.short[link[s]] else self.short[link[s]]

    def match(self, words: list[str]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged hit spans [start, end) over the words, and the items with occurring windows."""
        nexts, link, length, at, short, window = self.next, self.link, self.length, self.at, self.short, self.window
        state, size, root = 0, 0, nexts[0]
        spans: list[list[int]] = []
        found: set[str] = set()
        for i, word in enumerate(words):
            step = nexts[state].get(word)
            if step is None:
                if word not in root:
                    state = size = 0
                    continue
                while step is None:
                    state = link[state]
                    step = nexts[state].get(word)
                size = length[state]
            state = step
            size += 1
            start = i + 1
            if size >= window:
                start = i + 1 - window
                found |= self.items.get(at[state], set())
            for n, item in short[state]:
                if n <= size:
                    start = min(start, i + 1 - n)
                    found.add(item)
            if start <= i:
                while spans and spans[-1][1] >= start:
                    start = min(start, spans.pop()[0])
                spans.append([start, i + 1])
        return [tuple(x) for x in spans], found


def _blocks(spark, benchmark: DataFrame, block_bytes: int) -> list:
    """The items as broadcasts of about ``block_bytes`` of text each; the driver holds one at a time."""
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text"))
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = int(size // block_bytes) + 1
    out = []
    for i in range(n):
        rows = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == i) if n > 1 else items
        out.append(spark.sparkContext.broadcast(sorted((r.item, r.text) for r in rows.collect())))
    return out


_BUILT: dict = {}


def _automaton(block, window: int) -> SuffixAutomaton:
    """A worker keeps the automaton it used last."""
    key = (block.id if hasattr(block, "id") else id(block), len(block.value), window, hash(tuple(block.value[:50])))
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = SuffixAutomaton([(i, words_of(t)) for i, t in block.value], window)
    return _BUILT[key]


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


MATCH_SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, item_ids array<string>, spans array<struct<first:long,last:long>>, longest long"


def match(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = 16 << 20) -> DataFrame:
    """Per document: words, words hit, items, hit spans (in words, last excluded) and the longest span."""
    blocks = _blocks(docs.sparkSession, benchmark, block_bytes)
    out = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("item_ids", pa.list_(pa.string())), ("spans", pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))), ("longest", pa.int64())])

    def run(batches):
        for part in text_slices(batches):
            texts = part.column("text").to_pylist()
            spans: list[list] = [[] for _ in texts]
            items: list[set] = [set() for _ in texts]
            sizes = [0] * len(texts)
            for block in blocks:
                automaton = _automaton(block, window)
                for i, text in enumerate(texts):
                    words = words_of(text)
                    sizes[i] = len(words)
                    hit, found = automaton.match(words)
                    spans[i] += hit
                    items[i] |= found
            rows = []
            for doc_id, n, s, found in zip(part.column("doc_id").to_pylist(), sizes, spans, items):
                s = _merge(s) if s else s
                rows.append((doc_id, n, sum(e - b for b, e in s), len(found), sorted(found), [{"first": b, "last": e} for b, e in s], max((e - b for b, e in s), default=0)))
            yield batch_of(out, rows)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, MATCH_SCHEMA)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_span: int | None = None, max_coverage: float = COVERAGE, block_bytes: int = 16 << 20) -> DataFrame:
    """``docs`` without contaminated material, all columns kept.

    A document whose hit words reach ``max_coverage`` of its words goes. In the others, hit spans of more
    than ``max_span`` words (none, if it is None) are cut out of the text.
    """
    blocks = _blocks(docs.sparkSession, benchmark, block_bytes)
    schema = docs.schema

    def run(batches):
        for part in text_slices(batches):
            texts = part.column("text").to_pylist()
            found: list[list] = [[] for _ in texts]
            for block in blocks:
                automaton = _automaton(block, window)
                for i, text in enumerate(texts):
                    found[i] += automaton.match(words_of(text))[0]
            keep, new = [], []
            for text, spans in zip(texts, found):
                n, spans = len(words_of(text)) if spans else 0, _merge(spans)
                hit = sum(e - b for b, e in spans)
                keep.append(not hit or hit < max_coverage * n)
                cut = [s for s in spans if max_span is not None and s[1] - s[0] > max_span]
                new.append(_cut(text, cut) if cut else text)
            if any(a is not b for a, b in zip(new, texts)):
                i = part.schema.get_field_index("text")
                part = part.set_column(i, part.schema.field(i), pa.array(new, part.schema.field(i).type))
            yield part.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, schema)


def _cut(text: str, spans: list[tuple[int, int]]) -> str:
    places = [m.span() for m in WORD.finditer(text.translate(_LOWER))]
    out, at = [], 0
    for first, last in spans:
        out.append(text[at : places[first][0]])
        at = places[last - 1][1]
    return "".join(out) + text[at:]


def op2_decontamination(spark, sf_dir: str) -> DataFrame:
    """Contamination of all documents by 13-word windows of all benchmark items."""
    found = match(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items",
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


_CUT = r"coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), [])"

#: DuckDB SQL for the rows of ``op2_decontamination``.
ORACLE_SQL = f"""WITH d AS (SELECT doc_id, {_CUT} AS words FROM documents),
    b AS (SELECT item, words, CAST(least({WINDOW}, len(words)) AS BIGINT) AS w FROM (SELECT CAST(item_id AS VARCHAR) AS item, {_CUT} AS words FROM benchmark WHERE item_id IS NOT NULL) WHERE len(words) > 0),
    bw AS (SELECT DISTINCT item, w, array_to_string(words[i : i + w - 1], ' ') AS part FROM (SELECT *, unnest(range(1, len(words) - w + 2)) AS i FROM b)),
    dw AS (SELECT doc_id, i, w, array_to_string(words[i : i + w - 1], ' ') AS part FROM (SELECT doc_id, words, w, unnest(range(1, greatest(1, len(words) - w + 2))) AS i FROM d, (SELECT DISTINCT w FROM bw))),
    hits AS (SELECT doc_id, i, w, item FROM dw JOIN bw USING (w, part)),
    covered AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM (SELECT doc_id, i, unnest(range(w)) AS k FROM (SELECT DISTINCT doc_id, i, w FROM hits)) GROUP BY doc_id),
    items AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS names FROM hits GROUP BY doc_id)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * n_hit >= len(words) AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)"""


def items_digest(items: Iterable[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
