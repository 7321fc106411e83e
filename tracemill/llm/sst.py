"""Token-ID output as sorted-string-table shards.

Documents are range-partitioned and sorted by identifier; each partition becomes one shard of blocks.
A block keeps its keys prefix-compressed (bytes shared with the key before, rest of the key) beside the
ids; a sparse index has the first key and the place of each block; a Bloom filter answers for absent
keys; the footer has the places of both and the totals. ``lookup`` reads the footer, the filter and the
index, finds one block by binary search and scans it. No shard is ever whole in memory.

Shards go to a folder that driver and executors share, under a temporary name first and then renamed,
so that a repeated or speculative task leaves the same file. Null texts are empty; null identifiers sort
first; rows with equal identifiers are ordered by text and all kept; an empty table gives no shard.
"""

from __future__ import annotations

import bisect
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm import bpe
from tracemill.llm.common import batch_of, scratch_path, text_slices

MAGIC = b"TMSST002"
_FOOTER = struct.Struct("<QQQQQQ8s")  # index at, filter at, footer at, documents, ids, shard number, magic
_ENTRY = struct.Struct("<BBI")  # shared bytes, own bytes, ids
BLOCK_BYTES = 64 << 10
BLOOM_BITS_PER_KEY = 10
BLOOM_HASHES = 7
_PACK, _UNPACK = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def key_of(doc_id: int | None) -> bytes:
    """Bytes that sort as the identifiers do, null first."""
    return b"\0" if doc_id is None else b"\1" + (doc_id + (1 << 63)).to_bytes(8, "big")


def id_of(key: bytes) -> int | None:
    return None if key == b"\0" else int.from_bytes(key[1:], "big") - (1 << 63)


def _bloom_bits(key: bytes, bits: int) -> list[int]:
    a, b = zlib.crc32(key), zlib.crc32(key, 0x9E3779B9) | 1
    return [(a + i * b) % bits for i in range(BLOOM_HASHES)]


class ShardWriter:
    """Writes (identifier, uint32 ids) pairs, which come in key order, to a binary stream."""

    def __init__(self, out, number: int):
        self.out, self.number = out, number
        self.at = self.docs = self.ids = 0
        self.index: list[tuple[bytes, int, int]] = []
        self.keys: list[bytes] = []
        self.block, self.first, self.last = bytearray(), b"", b""
        self._put(MAGIC)

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        key = key_of(doc_id)
        if not self.block:
            self.first, self.last = key, b""
        shared = next((i for i, (x, y) in enumerate(zip(key, self.last)) if x != y), min(len(key), len(self.last)))
        self.block += _ENTRY.pack(shared, len(key) - shared, len(ids)) + key[shared:] + ids.astype("<u4").tobytes()
        self.last = key
        self.keys.append(key)
        self.docs += 1
        self.ids += len(ids)
        if len(self.block) >= BLOCK_BYTES:
            self._end_block()

    def _end_block(self) -> None:
        if self.block:
            data = _PACK.compress(bytes(self.block))
            self.index.append((self.first, self.at, len(data)))
            self._put(data)
            self.block = bytearray()

    def close(self) -> None:
        self._end_block()
        index_at = self.at
        for key, at, size in self.index:
            self._put(struct.pack("<B", len(key)) + key + struct.pack("<QI", at, size))
        filter_at, bits = self.at, max(64, BLOOM_BITS_PER_KEY * len(self.keys))
        bloom = np.zeros((bits + 7) // 8, np.uint8)
        for key in self.keys:
            for bit in _bloom_bits(key, bits):
                bloom[bit >> 3] |= 1 << (bit & 7)
        self._put(struct.pack("<Q", bits) + bloom.tobytes())
        self._put(_FOOTER.pack(index_at, filter_at, self.at, self.docs, self.ids, self.number, MAGIC))


class ShardReader:
    """Reads a shard from a seekable binary stream."""

    def __init__(self, stream, size: int):
        self.stream = stream
        stream.seek(size - _FOOTER.size)
        self.index_at, self.filter_at, self.footer_at, self.docs, self.ids, self.number, magic = _FOOTER.unpack(stream.read(_FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard")
        stream.seek(self.index_at)
        data, i, self.index = stream.read(self.filter_at - self.index_at), 0, []
        while i < len(data):
            n = data[i]
            self.index.append((data[i + 1 : i + 1 + n], *struct.unpack_from("<QI", data, i + 1 + n)))
            i += 1 + n + 12
        stream.seek(self.filter_at)
        data = stream.read(self.footer_at - self.filter_at)
        self.bits, self.bloom = struct.unpack_from("<Q", data)[0], data[8:]

    def block(self, at: int, size: int) -> Iterator[tuple[bytes, np.ndarray]]:
        self.stream.seek(at)
        data, i, key = _UNPACK.decompress(self.stream.read(size)), 0, b""
        while i < len(data):
            shared, own, n = _ENTRY.unpack_from(data, i)
            i += _ENTRY.size
            key = key[:shared] + data[i : i + own]
            i += own
            yield key, np.frombuffer(data, "<u4", n, i)
            i += 4 * n

    def scan(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for _, at, size in self.index:
            for key, ids in self.block(at, size):
                yield id_of(key), ids

    def may_hold(self, doc_id: int | None) -> bool:
        return all(self.bloom[b >> 3] >> (b & 7) & 1 for b in _bloom_bits(key_of(doc_id), self.bits))

    def lookup(self, doc_id: int | None) -> list[np.ndarray]:
        """Ids of every document with this identifier, by filter and binary search."""
        if not self.index or not self.may_hold(doc_id):
            return []
        key, found = key_of(doc_id), []
        first = max(0, bisect.bisect_left(self.index, key, key=lambda x: x[0]) - 1)
        for first_key, at, size in self.index[first:]:
            if first_key > key:
                break
            found += [ids for k, ids in self.block(at, size) if k == key]
        return found


def _folder(uri: str):
    """The file system and path of a folder that driver and executors share."""
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(uri)


def _write(uri: str, tokenizer_path: str, end_id: int) -> Callable:
    def write(batches):
        context = TaskContext.get()
        number, encoder = context.partitionId(), bpe.ChunkEncoder.load(tokenizer_path)
        fs, folder = _folder(uri)
        final = f"{folder}/shard-{number:08d}.sst"
        temporary = f"{folder}/.try-{number:08d}-{context.taskAttemptId()}"
        writer = stream = None
        end = np.asarray([end_id], np.uint32)
        for part in text_slices(batches, max_rows=4096, max_bytes=8 << 20):
            if writer is None:
                fs.create_dir(folder, recursive=True)
                stream = fs.open_output_stream(temporary)
                writer = ShardWriter(stream, number)
            for doc_id, ids in zip(part.column("doc_id").to_pylist(), encoder.encode(part.column("text").to_pylist())):
                writer.add(doc_id, np.concatenate([ids, end]))
        if writer is not None:
            writer.close()
            stream.close()
            fs.move(temporary, final)
            yield batch_of(_SHARDS, [(number, final.rsplit("/", 1)[1], writer.docs, writer.ids, id_of(writer.keys[0]), id_of(writer.keys[-1]))])

    return write


_SHARDS = pa.schema([("shard", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("first_doc", pa.int64()), ("last_doc", pa.int64())])


def write_shards(docs: DataFrame, uri: str, tokenizer_path: str | None = None, end_id: int = 0) -> list[dict]:
    """Write ``docs`` as shards under ``uri``; the manifest has one small row per shard, in key order."""
    rows = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        .repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id", "text")
        .mapInArrow(_write(uri, tokenizer_path or bpe.default_path(), end_id), "shard int, file string, n_docs long, n_ids long, first_doc long, last_doc long")
    )
    return sorted((r.asDict() for r in rows.collect()), key=lambda x: x["shard"])


def _read(uri: str) -> Callable:
    out = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("shard", pa.int32())])

    def read(batches):
        fs, folder = _folder(uri)
        for batch in batches:
            for row in batch.to_pylist():
                path, at, rows = f"{folder}/{row['file']}", row["first_id"], []
                with fs.open_input_file(path) as stream:
                    for doc_id, ids in ShardReader(stream, stream.size()).scan():
                        rows.append((doc_id, at, len(ids), zlib.crc32(ids.tobytes()), row["shard"]))
                        at += len(ids)
                        if len(rows) == 10_000:
                            yield batch_of(out, rows)
                            rows = []
                yield batch_of(out, rows)

    return read


def read_shards(spark, uri: str, manifest: list[dict]) -> DataFrame:
    """One row per document of the shards: place, number and crc32 of its ids, read back from the files."""
    placed, first = [], 0
    for x in manifest:
        placed.append((x["shard"], x["file"], first))
        first += x["n_ids"]
    shards = spark.createDataFrame(placed, "shard int, file string, first_id long")
    shards = shards.repartition(max(1, len(placed)), "shard") if placed else shards
    return shards.mapInArrow(_read(uri), "doc_id long, start long, n_tokens long, ids_crc32 long, shard int")


def lookup(spark, uri: str, manifest: list[dict], doc_ids: DataFrame) -> DataFrame:
    """Rows (doc_id, ids) of the asked identifiers: the manifest names the shards (one row each), filter and index do the rest."""

    def probe(batches):
        out = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int64()))])
        fs, folder = _folder(uri)
        readers: dict = {}
        for batch in batches:
            rows = []
            for x in batch.to_pylist():
                if x["file"] not in readers:
                    readers.clear()
                    stream = fs.open_input_file(f"{folder}/{x['file']}")
                    readers[x["file"]] = ShardReader(stream, stream.size())
                rows += [(x["doc_id"], ids.tolist()) for ids in readers[x["file"]].lookup(x["doc_id"])]
            yield batch_of(out, rows)

    shards = spark.createDataFrame([(x["file"], x["first_doc"], x["last_doc"]) for x in manifest], "file string, first_doc long, last_doc long")
    asked = doc_ids.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    inside = F.coalesce(shards.first_doc <= asked.doc_id, F.lit(True)) & F.coalesce(asked.doc_id <= shards.last_doc, asked.doc_id.isNull())
    return asked.join(F.broadcast(shards), inside).select("doc_id", "file").sortWithinPartitions("file").mapInArrow(probe, "doc_id long, ids array<long>")


def op8_sst_output(spark, sf_dir: str) -> DataFrame:
    """Encode all documents, write them as shards and read the shards back."""
    uri = scratch_path(spark, "sst")
    manifest = write_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"), uri)
    return read_shards(spark, uri, manifest)
