"""Repeats of ``LENGTH`` bytes or more across documents, from sparse suffix arrays of anchored contexts.

1. Anchors (see ``anchors``) of every text, with hashes of their contexts, go packed per bucket to
   reducers. There, occurrences of one anchor fall into classes of equal contexts. All but the least
   document of a class share its whole context with an earlier document.
2. What is left is to compare classes of one anchor: each sends the context of its least document. A
   reducer builds the enhanced suffix array of the contexts' right parts and scans it with a stack into
   the common-prefix interval tree. Every interval is a set of occurrences with one longest common
   right part; its members, sorted by their reversed left parts and scanned with a second stack, split
   wherever left extensions differ. So come all maximal repeats with all their occurrences, not just
   neighbours, and each occurrence learns the longest one that an earlier document takes part in.
3. Anchors with more than ``HOT`` classes skip the tree: their substrings of ``LENGTH`` bytes are grouped
   with their least document by a pre-aggregated groupBy and joined back, so no task holds such a group.
4. Documents get back the anchors that are covered, and find their places again in the text.

Texts are shuffled once. Null texts are empty; documents with a null identifier neither lose bytes nor
take any from others; rows of equal identifier are judged against other identifiers only; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm.anchors import GRAM, LEFT, LENGTH, anchors, key_of, mix
from tracemill.llm.common import batch_of, materialize, text_slices

BUCKET_BYTES = 32 << 20
FLUSH = 400_000  # anchors that a task packs at a time
HOT = 200_000  # classes of one anchor that a task compares, about 30 MB; beyond them see 3.
_U = np.uint64
_PACKED = "bucket int, docs binary, counts binary, anchor_high binary, anchor_low binary, context_high binary, context_low binary"


def _raw(texts: list[str | None]) -> list[bytes]:
    return [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]


def _pack(buckets: int):
    out = pa.schema([("bucket", pa.int32()), *((n, pa.binary()) for n in ("docs", "counts", "anchor_high", "anchor_low", "context_high", "context_low"))])

    def packed(held):
        doc, anchor, context = (np.concatenate(x) for x in zip(*held))
        bucket = (mix(anchor) % _U(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        doc, anchor, context, bucket = doc[order], anchor[order], context[order], bucket[order]
        first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])).tolist()
        rows = []
        for a, b in zip(first, [*first[1:], len(bucket)]):
            change = np.flatnonzero(np.concatenate([[True], doc[a + 1 : b] != doc[a : b - 1]]))
            counts = np.diff(np.concatenate([change, [b - a]]))
            h, c = anchor[a:b] >> _U(16), context[a:b] >> _U(16)
            rows.append((int(bucket[a]), doc[a:b][change].tobytes(), counts.astype(np.uint32).tobytes(), (h >> _U(32)).astype(np.uint16).tobytes(), h.astype(np.uint32).tobytes(), (c >> _U(32)).astype(np.uint16).tobytes(), c.astype(np.uint32).tobytes()))
        return batch_of(out, rows)

    def run(batches):
        held, count = [], 0
        for part in text_slices(batches, max_bytes=1 << 19):
            text, _, anchor, context = anchors(_raw(part.column("text").to_pylist()))
            if len(text):
                held.append((part.column("doc_id").to_numpy()[text], anchor, context))
                count += len(text)
            if count >= FLUSH:
                yield packed(held)
                held, count = [], 0
        if held:
            yield packed(held)

    return run


FULL, OPEN, CROWDED = 0, 1, 2


def _classes(hot: int):
    """Of one bucket: (doc_id, key, kind) of anchors that are covered whole, or whose class is to be compared."""

    def reduce(table: pa.Table) -> pa.Table:
        docs, anchor, context = [], [], []
        for r in table.to_pylist():
            docs.append(np.repeat(np.frombuffer(r["docs"], np.int64), np.frombuffer(r["counts"], np.uint32)))
            anchor.append(np.frombuffer(r["anchor_high"], np.uint16).astype(np.uint64) << _U(32) | np.frombuffer(r["anchor_low"], np.uint32))
            context.append(np.frombuffer(r["context_high"], np.uint16).astype(np.uint64) << _U(32) | np.frombuffer(r["context_low"], np.uint32))
        doc, h, c = np.concatenate(docs), np.concatenate(anchor), np.concatenate(context)
        del docs, anchor, context
        order = np.lexsort((doc, c, h))
        doc, h, c = doc[order], h[order], c[order]
        new_anchor = np.concatenate([[True], h[1:] != h[:-1]])
        new_class = new_anchor | np.concatenate([[True], c[1:] != c[:-1]])
        fresh = new_class | np.concatenate([[True], doc[1:] != doc[:-1]])  # a document once in a class
        start = np.flatnonzero(new_anchor)
        group = np.cumsum(new_anchor) - 1
        shared = (np.minimum.reduceat(doc, start) < np.maximum.reduceat(doc, start))[group]
        classes = np.add.reduceat(new_class.astype(np.int64), start)[group]
        kind = np.where(~new_class, FULL, np.where(classes > hot, CROWDED, OPEN))
        take = fresh & shared & (~new_class | (classes > 1))
        # the first row of a class is its least document; the same document again is not fresh
        return pa.table({"doc_id": doc[take], "key": key_of(h[take] << _U(16), c[take] << _U(16)), "kind": kind[take].astype(np.int32)})

    return reduce


def _lists(column: pa.ListArray, *fields: str) -> tuple[np.ndarray, list[np.ndarray]]:
    """Bounds by row and the fields of a column of lists of structs, null lists as empty."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    flat = pc.list_flatten(column)
    return np.concatenate([[0], np.cumsum(sizes)]), [flat.field(f).to_numpy(zero_copy_only=False) for f in fields]


def _places(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of keys, and where in it the run of each wanted one starts and ends; places of a run ascend."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    return order, np.searchsorted(ranked, wanted, side="left"), np.searchsorted(ranked, wanted, side="right")


_CONTEXT = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("anchor", pa.int64()), ("crowded", pa.bool_()), ("left", pa.binary()), ("right", pa.binary())])


def _contexts(batches):
    """Contexts of the classes to be compared, from the texts of their least documents."""
    for part in text_slices(batches, max_bytes=1 << 19):
        raws = _raw(part.column("text").to_pylist())
        text, pos, anchor, context = anchors(raws)
        keys, order = key_of(anchor, context), np.arange(len(raws))
        ids = part.column("doc_id").to_pylist()
        ends, (wanted, kind) = _lists(part.column("marks"), "key", "kind")
        bounds = np.searchsorted(text, [*order, len(raws)])
        rows = []
        for i in range(len(raws)):
            a, b = bounds[i], bounds[i + 1]
            mark, how = wanted[ends[i] : ends[i + 1]], kind[ends[i] : ends[i + 1]]
            mark, how = mark[how != FULL], how[how != FULL]
            found, start, stop = _places(keys[a:b], mark)
            for first, crowded in zip(found[start[start < stop]].tolist(), (how == CROWDED)[start < stop].tolist()):
                p = int(pos[a + first])
                rows.append((ids[i], int(keys[a + first]), int(anchor[a + first].view(np.int64)), crowded, raws[i][max(0, p - LEFT) : p], raws[i][p : p + LENGTH]))
        yield batch_of(_CONTEXT, rows)


def _matrix(parts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of bytes, padded with zeros, and their lengths."""
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    return np.frombuffer(b"".join(p.ljust(width, b"\0") for p in parts), np.uint8).reshape(len(parts), width), sizes


def _common(rows: np.ndarray, sizes: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Lengths of the common prefixes of rows i and j."""
    out = np.empty(len(i), np.int64)
    for a in range(0, len(i), 100_000):
        x, y = i[a : a + 100_000], j[a : a + 100_000]
        differ = rows[x] != rows[y]
        first = np.where(differ.any(1), differ.argmax(1), rows.shape[1])
        out[a : a + 100_000] = np.minimum(first, np.minimum(sizes[x], sizes[y]))
    return out


def _order(rows: np.ndarray, first: np.ndarray | None = None) -> np.ndarray:
    """Lexicographic order of rows, within ``first`` if given."""
    width = -(-rows.shape[1] // 8) * 8
    padded = np.zeros((len(rows), width), np.uint8)
    padded[:, : rows.shape[1]] = rows
    words = padded.view(">u8").astype(np.uint64)
    keys = [words[:, k] for k in range(words.shape[1] - 1, -1, -1)]
    return np.lexsort(keys + ([first] if first is not None else []))


def prefix_intervals(lcp: np.ndarray, least: int = 1) -> list[tuple[int, int, int]]:
    """(first, last, length) of the common-prefix interval tree of an enhanced suffix array, by a stack scan.

    ``lcp[i]`` is the common prefix of suffixes i - 1 and i; intervals shorter than ``least`` are left out.
    """
    out, stack = [], []
    for i, value in enumerate([*lcp.tolist()[1:], -1], 1):
        first = i - 1
        while stack and stack[-1][1] > value:
            first, length = stack.pop()
            out.append((first, i - 1, length))
        if value >= least and (not stack or stack[-1][1] < value):
            stack.append((first, value))
    return out


def earlier_extent(extent: np.ndarray, doc: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """For each occurrence, the longest left extension of a maximal repeat that an earlier document is in.

    ``extent[i]`` is the common left part of occurrences i - 1 and i (-1 between intervals) and ``bound[i]``
    the least that counts. A stack scan merges intervals from the longest extension to shorter ones; a
    stack entry keeps the least document below it and the occurrences of that document. When two meet,
    the occurrences of the later document get the extension that they meet at, and leave.
    """
    best = np.full(len(doc), -1, np.int64)
    docs, bounds = doc.tolist(), bound.tolist()
    stack: list[tuple[int, int, list[int]]] = []  # extension to the entry before, least document, its occurrences

    def merge() -> None:
        at, high_doc, high = stack.pop()
        before, low_doc, low = stack.pop()
        if low_doc == high_doc:
            longer, shorter = (low, high) if len(low) >= len(high) else (high, low)
            longer += shorter
            stack.append((before, low_doc, longer))
            return
        for i in high if high_doc > low_doc else low:
            if at >= bounds[i]:
                best[i] = at
        stack.append((before, low_doc, low) if low_doc < high_doc else (before, high_doc, high))

    for i, value in enumerate(extent.tolist()):
        while stack and stack[-1][0] > value:
            merge()
        if value < 0:
            stack.clear()
        stack.append((value, docs[i], [i]))
    while stack and stack[-1][0] >= 0:
        merge()
    return best


def _compare(table: pa.Table) -> pa.Table:
    """Of one bucket of contexts: (doc_id, key, before, after) of what an earlier document shares."""
    doc, anchor = table.column("doc_id").to_numpy(), table.column("anchor").to_numpy()
    right, right_size = _matrix(table.column("right").to_pylist(), LENGTH)
    left, left_size = _matrix([x[::-1] for x in table.column("left").to_pylist()], LEFT)
    order = _order(right, anchor)
    i, j = order[:-1], order[1:]
    lcp = np.concatenate([[0], np.where(anchor[i] == anchor[j], _common(right, right_size, i, j), 0)])
    intervals = prefix_intervals(lcp, GRAM)
    none = pa.table({"doc_id": pa.array([], pa.int64()), "key": pa.array([], pa.int64()), "before": pa.array([], pa.int32()), "after": pa.array([], pa.int32())})
    if not intervals:
        return none
    first, last, depth = (np.asarray(x, np.int64) for x in zip(*intervals))
    rank = np.empty(len(doc), np.int64)
    rank[_order(left)] = np.arange(len(doc))
    key, out = table.column("key").to_numpy(), []
    sizes = last - first + 1
    at, total = 0, np.cumsum(sizes)
    while at < len(sizes):  # about a million members at a time
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + 1_000_000)))
        n = sizes[at:end]
        interval = np.repeat(np.arange(at, end), n)
        member = order[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[at:end], n)]
        turn = np.lexsort((rank[member], interval))
        interval, member = interval[turn], member[turn]
        extent = np.full(len(member), -1, np.int64)
        extent[1:] = np.where(interval[1:] == interval[:-1], _common(left, left_size, member[:-1], member[1:]), -1)
        best = earlier_extent(extent, doc[member], LENGTH - depth[interval])
        hit = best >= 0
        out.append((doc[member][hit], key[member][hit], best[hit], depth[interval][hit]))
        at = end
    a, b, c, d = (np.concatenate(x) for x in zip(*out))
    return pa.table({"doc_id": a, "key": b, "before": c.astype(np.int32), "after": d.astype(np.int32)})


def _crowded(contexts: DataFrame) -> DataFrame:
    """The same for anchors of very many classes, by grouping substrings with their least document."""
    whole, size = F.concat("left", "right"), F.octet_length("left")
    offsets = F.when(F.octet_length(whole) >= LENGTH, F.sequence(F.lit(0), F.least(size, F.octet_length(whole) - LENGTH)))
    cut = contexts.select("doc_id", "key", size.alias("size"), whole.alias("whole"), F.explode(offsets).alias("at"))
    cut = cut.select("doc_id", "key", (F.col("size") - F.col("at")).alias("before"), F.substring("whole", F.col("at") + 1, F.lit(LENGTH)).alias("part"))
    least = cut.groupBy("part").agg(F.min("doc_id").alias("least"))
    return cut.join(least, "part").where("doc_id > least").select("doc_id", "key", F.col("before").cast("int"), (LENGTH - F.col("before")).cast("int").alias("after"))


_RESULT = "doc_id long, n_bytes long, n_removed long, spans array<struct<first:long,last:long>>, kept_sha256 string"


def _cover(batches):
    out = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))), ("kept_sha256", pa.string())])
    for part in text_slices(batches, max_bytes=1 << 19):
        ids, raws = part.column("doc_id").to_pylist(), _raw(part.column("text").to_pylist())
        mark_ends, (mark, kind) = _lists(part.column("marks"), "key", "kind")
        part_ends, (shared, before, after) = _lists(part.column("parts"), "key", "before", "after")
        touched = np.flatnonzero((np.diff(mark_ends) > 0) | (np.diff(part_ends) > 0)).tolist()
        text, pos, anchor, context = anchors([raws[i] for i in touched])
        keys, bounds = key_of(anchor, context), np.searchsorted(text, np.arange(len(touched) + 1))
        spans: dict[int, list] = {}
        for t, i in enumerate(touched):
            size, own, at = len(raws[i]), keys[bounds[t] : bounds[t + 1]], pos[bounds[t] : bounds[t + 1]]
            depth = np.zeros(size + 1, np.int64)
            m, k = slice(mark_ends[i], mark_ends[i + 1]), slice(part_ends[i], part_ends[i + 1])
            p = at[np.isin(own, mark[m][kind[m] == FULL])]
            np.add.at(depth, np.maximum(0, p - LEFT), 1)
            np.add.at(depth, np.minimum(size, p + LENGTH), -1)
            if k.start < k.stop:
                order, start, stop = _places(own, shared[k])
                n = stop - start
                q = at[order[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start, n)]]
                np.add.at(depth, q - np.repeat(before[k], n), 1)
                np.add.at(depth, q + np.repeat(after[k], n), -1)
            gone = np.cumsum(depth[:-1]) > 0
            edges = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8))).tolist()
            spans[i] = list(zip(edges[::2], edges[1::2]))
        rows = []
        for i, raw in enumerate(raws):
            digest, at, gone = hashlib.sha256(), 0, 0
            for a, b in spans.get(i, ()):
                digest.update(raw[at:a])
                at, gone = b, gone + b - a
            digest.update(raw[at:])
            rows.append((ids[i], len(raw), gone, [{"first": a, "last": b} for a, b in spans.get(i, ())], digest.hexdigest()))
        yield batch_of(out, rows)


def find_repeats(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """Per document: bytes, bytes and spans that an earlier document also has, digest of the rest."""
    spark = docs.sparkSession
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = plain.where("doc_id is not null")
    size = plain.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = max(int(size // BUCKET_BYTES) + 1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), int(size // (BUCKET_BYTES // 8)) + 1))
    packed = known.mapInArrow(_pack(buckets), _PACKED)
    classes = materialize(packed.groupBy("bucket").applyInArrow(_classes(hot), "doc_id long, key long, kind int"), "classes")

    by_doc = known.repartition("doc_id")  # read twice below, shuffled once
    marks = classes.groupBy("doc_id").agg(F.collect_list(F.struct("key", "kind")).alias("marks"))
    compared = marks.where(F.exists("marks", lambda m: m["kind"] != FULL))
    contexts = by_doc.join(compared, "doc_id").mapInArrow(_contexts, "doc_id long, key long, anchor long, crowded boolean, left binary, right binary")
    crowded = classes.where(F.col("kind") == CROWDED).limit(1).count() > 0
    if crowded:  # read by both ways below
        contexts = materialize(contexts, "contexts")
    trees = contexts.where("not crowded").groupBy(F.pmod("anchor", F.lit(8 * buckets)).alias("bucket")).applyInArrow(_compare, "doc_id long, key long, before int, after int")
    shares = trees.union(_crowded(contexts.where("crowded"))) if crowded else trees
    parts = shares.groupBy("doc_id").agg(F.collect_list(F.struct("key", "before", "after")).alias("parts"))
    joined = by_doc.join(marks, "doc_id", "left").join(parts, "doc_id", "left")
    if plain.where("doc_id is null").limit(1).count():
        joined = joined.unionByName(plain.where("doc_id is null"), allowMissingColumns=True)
    return joined.select("doc_id", "text", "marks", "parts").mapInArrow(_cover, _RESULT)


def op4_repeats(spark, sf_dir: str) -> DataFrame:
    """What is left of all documents without 50-byte strings of earlier ones."""
    found = find_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")
