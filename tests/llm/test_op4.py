import hashlib
import random

import numpy as np
import pytest

from tracemill.llm import anchors as an
from tracemill.llm import repeats as r


def brute(rows):
    raws = [(d, (t or "").encode()) for d, t in rows]
    first = {}
    for d, raw in raws:
        if d is not None:
            for i in range(len(raw) - 49):
                s = raw[i : i + 50]
                first[s] = min(first.get(s, d), d)
    out = []
    for d, raw in raws:
        gone = np.zeros(len(raw), bool)
        if d is not None:
            for i in range(len(raw) - 49):
                if first[raw[i : i + 50]] < d:
                    gone[i : i + 50] = True
        kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
        edges = np.diff(np.concatenate([[0], gone.astype(int), [0]]))
        out.append((d, len(raw), int(gone.sum()), int((edges == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(seed):
    rng = random.Random(seed)
    letters = "abcé \n" if seed % 2 else "ab"
    make = lambda n: "".join(rng.choice(letters + "xyz"[: rng.randint(0, 3)]) for _ in range(n))
    passages = [make(rng.choice([40, 49, 50, 51, 70, 120, 300])) for _ in range(10)]
    rows = []
    for i in range(110):
        text = make(rng.randint(0, 80))
        for _ in range(rng.randint(0, 4)):
            p = rng.choice(passages)
            a, b = sorted((rng.randint(0, len(p)), rng.randint(0, len(p))))
            text += (p if rng.random() < 0.6 else p[a:b]) + make(rng.choice([0, 1, 3, 30]))
        rows.append(text)
    for i in range(20):  # near copies
        t = list(rng.choice(rows))
        for _ in range(rng.randint(0, 4)):
            if t:
                t[rng.randrange(len(t))] = "q"
        rows.append("".join(t))
    rows += [None, "", "a" * 49, "a" * 50, "a" * 400, "a" * 120 + "b", "\0" * 60, "\0" * 70, rows[0], rows[1], passages[4] * 3]
    ids = list(range(len(rows)))
    rng.shuffle(ids)
    return list(zip(ids, rows)) + [(None, passages[0]), (ids[3], passages[5] + "!"), (ids[4], rows[4]), (ids[4], rows[4])]


@pytest.mark.parametrize("seed,hot", [(1, r.HOT), (2, r.HOT), (3, 2), (4, 1)])
def test_against_brute_force(spark, tmp_path, seed, hot):
    rows = corpus(seed)
    spark.createDataFrame([(*x, "clash") for x in rows], "doc_id long, text string, marks string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    if hot == r.HOT:
        got = r.op4_repeats(spark, str(tmp_path))
    else:
        got = r.find_repeats(spark.read.parquet(f"{tmp_path}/documents.parquet"), hot).selectExpr("doc_id", "n_bytes", "n_removed", "cast(size(spans) as long) n_spans", "kept_sha256")
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_empty(spark):
    assert r.find_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert r.find_repeats(spark.createDataFrame([(None, None)], "doc_id long, text string")).first().n_bytes == 0


def test_anchors_do_not_depend_on_place():
    rng = random.Random(4)
    make = lambda n: bytes(rng.choice(b"abcdef") for _ in range(n))
    text = make(5000)
    raws = [text, make(77) + text[100:4000] + make(3), b"", b"x" * 30, text[:50]]
    doc, pos, anchor, _ = an.anchors(raws)
    one, two = set(pos[doc == 0].tolist()), set(pos[doc == 1].tolist())
    assert {p - 23 for p in one if 100 <= p - 34 and p + 50 <= 4000} <= two
    for d, raw in enumerate(raws):
        own = pos[doc == d]
        for i in range(len(raw) - 49):
            assert ((own >= i) & (own <= i + 34)).any()
    an_chunk, an._CHUNK = an._CHUNK, 1000
    try:
        a = an.anchors(raws)
    finally:
        an._CHUNK = an_chunk
    assert {*zip(*(x.tolist() for x in a))} == {*zip(*(x.tolist() for x in an.anchors(raws)))}


def test_interval_tree_against_brute_force():
    rng = random.Random(6)
    for _ in range(100):
        text = "".join(rng.choice("ab") for _ in range(rng.randint(2, 40)))
        suffixes = sorted(range(len(text)), key=lambda i: text[i:])
        common = lambda a, b: next((k for k in range(len(text)) if text[a + k : a + k + 1] != text[b + k : b + k + 1] or not text[a + k : a + k + 1]), 0)
        lcp = np.asarray([0] + [common(a, b) for a, b in zip(suffixes, suffixes[1:])])
        want = set()
        for i in range(len(lcp)):
            for j in range(i + 1, len(lcp)):
                low = lcp[i + 1 : j + 1].min()
                if low >= 1 and lcp[i] < low and (j + 1 == len(lcp) or lcp[j + 1] < low):
                    want.add((i, j, int(low)))
        assert set(r.prefix_intervals(lcp)) == want


def test_earlier_extent_against_brute_force():
    rng = random.Random(7)
    for _ in range(300):
        n = rng.randint(1, 12)
        extent = np.asarray([-1] + [rng.choice([-1, 0, 1, 2, 3, 5]) for _ in range(n - 1)])
        doc, bound = np.asarray([rng.randint(0, 5) for _ in range(n)]), np.full(n, rng.choice([0, 2]))
        want = []
        for i in range(n):
            best = max((int(extent[min(i, k) + 1 : max(i, k) + 1].min()) for k in range(n) if k != i and doc[k] < doc[i]), default=-1)
            want.append(best if best >= bound[i] else -1)
        assert r.earlier_extent(extent, doc, bound).tolist() == want
