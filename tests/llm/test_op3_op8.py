import io
import os
import random
import subprocess
import sys
import zlib
from collections import Counter, defaultdict

import numpy as np
from tokenizers import Tokenizer

from tracemill.llm import bpe, packing, sst

TEXTS = ["", None, "a  b", "a \n b", " a", "  a  ", "\n\n b\n", "a\t b", "é  ü x", "<|endoftext|> a", "it's ' s", "x\x1c y", " \t x", "a,  b!!  c\r\n\r\n d", "tab\t", "word " * 3000, "ok"]


def expected(text):
    t = Tokenizer.from_file(bpe.default_path())
    return (t.encode(text, add_special_tokens=False).ids if text else []) + [0]


def table(spark, tmp_path, texts=TEXTS):
    rows = [(i if i != 3 else None, t, "clash") for i, t in enumerate(texts)] + [(5, "again", "c")]
    spark.createDataFrame(rows, "doc_id long, text string, start string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    return rows


def test_chunks_equal_whole_texts():
    rng = random.Random(3)
    alphabet = [" ", "\n", "\t", "a", "Bc", "é", "1", "!", "'s", " ", "   ", "\r\n", "ß,"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for _ in range(600)]
    encoder = bpe.ChunkEncoder(bpe.default_path(), max_chunks=200)
    got = [list(x) for i in range(0, 600, 50) for x in encoder.encode(texts[i : i + 50])]
    assert got == [e.ids for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_plain_chunks_are_cut_by_the_library_rule():
    rng = random.Random(5)
    alphabet = [*map(chr, range(32, 127)), *"éßüÀÖöøʯ", *" \n" * 9, "'s", "'ll", " 've", "word", " Über"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 25))) for _ in range(2000)]
    encoder = bpe.ChunkEncoder(bpe.default_path(), max_chunks=300)
    rule = encoder.tokenizer.pre_tokenizer
    assert [bpe._PIECES(t) for t in texts] == [[t[a:b] for _, (a, b) in rule.pre_tokenize_str(t)] for t in texts]
    whole, asked = encoder.tokenizer.encode_batch(texts, add_special_tokens=False), []
    library = encoder._library
    encoder._library = lambda part, *tokenizer: (asked.extend([] if tokenizer else part), library(part, *tokenizer))[1]
    got = [list(x) for i in range(0, 2000, 40) for x in encoder.encode(texts[i : i + 40])]
    assert got == [e.ids for e in whole]
    assert all(not t.strip() for t in asked)  # all else is spelt here
    assert [list(x) for x in encoder.encode(["", None, " a", "ab", "日本 語 x²", "<|endoftext|> a"])] == [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in ("", "", " a", "ab", "日本 語 x²", "<|endoftext|> a")]


def test_packing(spark, tmp_path):
    rows = table(spark, tmp_path)
    pieces = packing.op3_packing(spark, str(tmp_path)).collect()
    windows, documents = defaultdict(list), defaultdict(list)
    for p in pieces:
        windows[p.sequence_id].append(p)
        documents[p.doc_id, p.doc_tokens].append(p)
    padded = 0
    for w in windows.values():
        at = 0
        for p in sorted(w, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 1024
        padded += at & (at - 1) != 0
    assert padded <= 3  # one for each partition
    ids = Counter((d, len(expected(t))) for d, t, _ in rows)
    assert {k for k in documents} == set(ids)
    for d, t, _ in rows:
        e = expected(t)
        if ids[d, len(e)] > 1:
            continue
        at = 0
        for p in sorted(documents[d, len(e)], key=lambda p: p.start):
            assert p.start == at and zlib.crc32(np.asarray(e[at : at + p.length], "<u4").tobytes()) == p.ids_crc32
            at += p.length
        assert at == len(e)


def test_packer_buffers_and_step_groups():
    rng = np.random.default_rng(1)
    p, rows, total = packing.Packer(2, step_tokens=4096), [], 0
    for i in range(1500):
        n = int(rng.lognormal(5, 1.3)) + 1
        total += n
        p.add(i, rng.integers(0, 50_000, n).astype(np.uint32))
        if p.held > 20_000:
            rows += p.pack()
    rows += p.pack(last=True)
    sizes, tier, group = Counter(), {}, defaultdict(set)
    for r in rows:
        sizes[r[5]] += r[2]
        tier[r[5]] = r[7]
        group[r[7], r[8]].add(r[5])
    assert sum(sizes.values()) == total
    assert sum(sizes[s] != tier[s] for s in sizes) <= 1
    full = [sum(sizes[s] for s in x) for (t, _), x in group.items()]
    assert sum(x == 4096 for x in full) >= len(full) - 2 * len(packing.TIERS)
    assert p.pack(last=True) == []


def test_shards(spark, tmp_path):
    rows = table(spark, tmp_path)
    got = sst.op8_sst_output(spark, str(tmp_path)).collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    want, at = [], 0
    for d, t, _ in order:
        e = expected(t)
        want.append((d, at, len(e), zlib.crc32(np.asarray(e, "<u4").tobytes())))
        at += len(e)
    assert sorted(map(str, want)) == sorted(str(tuple(r)[:4]) for r in got)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    uri = f"file://{tmp_path}/shards"
    manifest = sst.write_shards(docs, uri)
    found = sst.lookup(spark, uri, manifest, spark.createDataFrame([(5,), (99,), (None,), (15,)], "doc_id long")).collect()
    assert Counter(r.doc_id for r in found) == {5: 2, None: 1, 15: 1}
    assert next(r.ids for r in found if r.doc_id == 15) == expected("word " * 3000)
    assert sst.read_shards(spark, f"file://{tmp_path}/none", sst.write_shards(docs.where("false"), f"file://{tmp_path}/none")).count() == 0


def test_blocks_and_filter():
    out = io.BytesIO()
    w = sst.ShardWriter(out, 4)
    for i in range(-3000, 3000, 3):
        w.add(i, np.arange(i % 50, dtype=np.uint32))
    w.close()
    r = sst.ShardReader(out, len(out.getvalue()))
    assert len(r.index) > 1 and r.docs == 2000
    assert [d for d, _ in r.scan()] == list(range(-3000, 3000, 3))
    assert all(len(r.lookup(i)) == (i % 3 == 0) for i in range(-3000, 3000, 7))
    assert sum(r.may_hold(i) for i in range(10_000, 20_000)) < 400


def test_encoder_starts_no_threads_and_learns_plain_chunks_alike():
    texts = ["erha, esti.\nRentsh it's 12a3! don't ' s a\n\n b x\ny z.", "Ñarezas, señor.\nHola ja.\nÍ, a\n  b", "erha. erha! x,,y"]
    encoder = bpe.ChunkEncoder(bpe.default_path())
    assert [[*ids.tolist(), 0] for ids in encoder.encode(texts)] == list(map(expected, texts))
    code = """
import os
from tracemill.llm import bpe
encoder = bpe.ChunkEncoder(bpe.default_path())
before = len(os.listdir("/proc/self/task"))
encoder.encode([" ".join(f"w{i}" for i in range(5000)) + " \u4e00\u4e8c"])
assert len(os.listdir("/proc/self/task")) == before
"""
    env = {k: v for k, v in os.environ.items() if k not in ("TOKENIZERS_PARALLELISM", "RAYON_NUM_THREADS")}
    subprocess.run([sys.executable, "-c", code], check=True, env=env)
