"""Hierarchical multi-length packing of token ids.

Context tiers are powers of two up to the longest window. A document longer than the longest window is
cut into full windows of it; what is left is routed to the shortest tier that holds it. Tiers are packed
from long to short: a piece opens a window of its tier, and the gap is filled with whole pieces of
shorter tiers, best fit first, then with the cut front of one of them. What no longer fills a window of
its tier closes the partition as windows of shorter tiers, so at most one window per partition, shorter
than the least tier, is padded. Windows of a tier are dealt into step groups of equal token counts.

Each input partition is packed on its own in one pass: no shuffle, and memory is bounded by
``buffer_tokens``. The sequence number holds the partition, so it is unique; a repeated task reads the same
rows and makes the same windows. Null texts are empty (a document still has its end id); repeated rows
and equal identifiers are packed as they come; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm import bpe
from tracemill.llm.common import batch_of, give_back, text_slices

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"
_OUT = pa.schema([(n, pa.int32() if k == "int" else pa.int64()) for n, k in (x.split() for x in SCHEMA.split(", "))])
TIERS = (128, 256, 512, 1024)
STEP_TOKENS = 64 * 1024


class Packer:
    """Packs the documents of one partition; rows are pieces with their windows."""

    def __init__(self, partition: int, tiers=TIERS, step_tokens: int = STEP_TOKENS):
        self.tiers, self.step_tokens = sorted(tiers), step_tokens
        self.longest = self.tiers[-1]
        self.base = partition << 40
        self.sequences = 0
        self.windows: dict[int, int] = {}
        self.waiting: list[tuple[int, int, int, np.ndarray, int]] = []  # length, order, start, ids, document
        self.docs: list[tuple[int | None, int]] = []
        self.held = self.order = 0
        self.rows: list[tuple] = []

    def _emit(self, window: list[tuple[int, int, np.ndarray]], tier: int) -> None:
        """A window's pieces: (document, start, ids)."""
        number, offset = self.base + self.sequences, 0
        self.sequences += 1
        k = self.windows.get(tier, 0)
        self.windows[tier] = k + 1
        group = self.base + k // max(1, self.step_tokens // tier)
        for doc, start, ids in window:
            doc_id, total = self.docs[doc]
            self.rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4", copy=False).tobytes()), total, number, offset, tier, group))
            offset += len(ids)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        doc, n = len(self.docs), len(ids)
        self.docs.append((doc_id, n))
        full = n - n % self.longest
        for at in range(0, full, self.longest):
            self._emit([(doc, at, ids[at : at + self.longest])], self.longest)
        if n > full:
            self.waiting.append((n - full, self.order, full, ids[full:], doc))
            self.order += 1
            self.held += n - full

    def pack(self, last: bool = False) -> list[tuple]:
        """Pack what waits. Unless it is the last call, pieces that fill no window wait on."""
        pieces = sorted(self.waiting, key=lambda x: x[:2])
        lengths = [x[0] for x in pieces]

        def take(i: int):
            lengths.pop(i)
            return pieces.pop(i)

        def put(length, order, start, ids, doc):
            i = bisect.bisect_left(lengths, length)
            lengths.insert(i, length)
            pieces.insert(i, (length, order, start, ids, doc))

        left = self.held
        for level in range(len(self.tiers) - 1, -1, -1):
            tier, shorter = self.tiers[level], self.tiers[level - 1] if level else 0
            while pieces and lengths[-1] > shorter and left >= tier:
                window, gap = [], tier
                while gap:
                    i = bisect.bisect_right(lengths, gap) - 1
                    if i >= 0:
                        length, _, start, ids, doc = take(i)
                        window.append((doc, start, ids))
                        gap -= length
                    else:  # every piece is longer than the gap: cut the shortest
                        length, order, start, ids, doc = take(0)
                        window.append((doc, start, ids[:gap]))
                        put(length - gap, order, start + gap, ids[gap:], doc)
                        gap = 0
                self._emit(window, tier)
                left -= tier
        if last:
            for tier in reversed(self.tiers):  # the rest: shorter windows, filled by cutting
                while left >= tier or (pieces and tier == self.tiers[0]):
                    window, gap = [], tier
                    while gap and pieces:
                        length, order, start, ids, doc = take(-1)
                        window.append((doc, start, ids[:gap]))
                        if length > gap:
                            put(length - gap, order, start + gap, ids[gap:], doc)
                        gap -= min(gap, length)
                    self._emit(window, tier)
                    left = sum(lengths)
        self.waiting, self.held = pieces, sum(lengths)
        rows, self.rows = self.rows, []
        keep = {x[4]: i for i, x in enumerate(self.waiting)}
        renumbered = {doc: i for i, doc in enumerate(keep)}
        self.docs, self.waiting = [self.docs[d] for d in keep], [(*x[:4], renumbered[x[4]]) for x in self.waiting]
        return rows


def pack(docs: DataFrame, tokenizer_path: str | None = None, tiers=TIERS, step_tokens: int = STEP_TOKENS, end_id: int = 0, buffer_tokens: int = 1 << 20, cached_chunks: int | None = None) -> DataFrame:
    """Rows of pieces: document, place in it, crc32 of its ids, window, place in that, tier and step group.

    ``cached_chunks`` bounds the encoder's cache where tasks have little memory, and the encoder goes with its task; it changes no result.
    """
    path = tokenizer_path or bpe.default_path()

    def run(batches):
        packer = Packer(TaskContext.get().partitionId(), tiers, step_tokens)
        encoder = bpe.ChunkEncoder(path, cached_chunks) if cached_chunks else bpe.ChunkEncoder.load(path)
        end = np.asarray([end_id], np.uint32)
        for part in text_slices(batches, max_bytes=1 << 20 if cached_chunks else 4 << 20):
            for doc_id, ids in zip(part.column("doc_id").to_pylist(), encoder.encode(part.column("text").to_pylist())):
                packer.add(doc_id, np.concatenate([ids, end]))
                if packer.held >= buffer_tokens or len(packer.rows) >= 50_000:
                    yield batch_of(_OUT, packer.pack())
        yield batch_of(_OUT, packer.pack(last=True))
        if cached_chunks:
            del encoder, packer
            give_back()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def op3_packing(spark, sf_dir: str) -> DataFrame:
    """Pack all documents into windows of at most 1024 ids."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
