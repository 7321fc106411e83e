import random
import re
from itertools import combinations

import numpy as np
import pytest

from tracemill.llm import components as cc
from tracemill.llm import jaccard_join as j
from tracemill.llm.shingles import shingle_sets

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def brute_set(text):
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)])


def brute_components(rows):
    sets = [brute_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            parent[find(a)] = find(b)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        least[r] = d if least.get(r) is None else least[r] if d is None else min(least[r], d)
    return sorted(((d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows)), key=str)


def corpus(seed, families=12, unrelated=40):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghij") + rng.choice("klmnop") + str(rng.randint(0, 9))
    passage = [word() for _ in range(30)]
    rows = []
    for _ in range(families):
        base = [word() for _ in range(rng.choice([3, 8, 30, 60, 200]))]
        for _ in range(rng.choice([1, 2, 5, 14])):
            text = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 25))):
                text[rng.randrange(len(text))] = word()
            if rng.random() < 0.3:
                text = text[: int(len(text) * rng.uniform(0.7, 1))]
            rows.append(" ".join(text))
    for _ in range(unrelated):
        own = [word() for _ in range(rng.randint(1, 80))]
        at = rng.randint(0, len(own))
        rows.append(" ".join(own[:at] + passage + own[at:]) if rng.random() < 0.6 else " ".join(own))
    rows += [None, "", " \n\t", "One two", "one TWO", rows[0].upper(), rows[0], "é É " * 10, " tab\x1fled one"]
    rng.shuffle(rows)
    return [(i * 3 + 1, t) for i, t in enumerate(rows)]


def test_shingles_against_brute_force():
    rng = random.Random(8)
    texts = ["".join(rng.choice(["a", "B", "é", " ", "\n", "\x0b", " ", "\x1f", "b"]) for _ in range(rng.randint(0, 80))) for _ in range(400)] + [None, "", "x " * 400_000, "longword" * 200_000 + " b c d e f"]
    assert [len(s) for s in shingle_sets(texts)] == [len(brute_set(t)) for t in texts]
    sets = shingle_sets(texts[:60])
    for a, b in combinations(range(60), 2):
        assert len(np.intersect1d(sets[a], sets[b])) == len(brute_set(texts[a]) & brute_set(texts[b]))


@pytest.mark.parametrize("seed", [1, 2])
def test_join_against_brute_force(spark, tmp_path, seed, monkeypatch):
    rows = corpus(seed)
    rows += [(None, rows[3][1]), (None, "only here " * 20), (rows[5][0], rows[6][1]), rows[7]]
    spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, node string").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = j.op9_jaccard_join(spark, str(tmp_path)) if seed == 1 else j.join_components(spark.read.parquet(f"{tmp_path}/documents.parquet"), chunk=100)
    assert sorted(map(tuple, got.collect()), key=str) == brute_components(rows)


def test_keep_one(spark):
    rows = corpus(5)
    docs = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, label int")
    kept = j.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, _, c in brute_components(rows)})
    assert j.join_components(docs.where("false")).count() == 0


def test_keep_one_of_null_and_repeated_identifiers(spark):
    one, two, alone = "a b c d e f g h i j", "k l m n o p q r s t", "u v w x y z"
    rows = [(5, one, "x"), (1, one, "x"), (5, two, "y"), (5, two, "y"), (None, alone, "z"), (None, alone.upper(), "z"), (None, one, "x"), (7, None, "n"), (7, " ", "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node string")
    got = sorted(map(tuple, j.keep_one(docs).collect()), key=str)
    assert [(r[0], (r[1] or "").lower()) for r in got] == sorted([(1, one), (5, two), (None, alone), (7, ""), (7, " ")], key=str)


def test_hot_shingles_and_large_homes(spark, monkeypatch):
    """A family that fills salted buckets and several chunks, and half of it only linked by a chain."""
    monkeypatch.setattr(j, "HOT", 20)
    rng = random.Random(9)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(120):
        text = list(base)
        for _ in range(rng.randint(0, 3)):
            text[rng.randrange(60)] = f"x{rng.randint(0, 999)}"
        rows.append((i, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, j.join_components(docs, chunk=400).collect()), key=str) == brute_components(rows)


def test_tree_finds_every_similar_pair():
    rng = np.random.default_rng(3)
    base = rng.poisson(4, (6, j.DIMENSIONS))
    points = np.concatenate([np.maximum(0, b + rng.integers(-1, 2, (60, j.DIMENSIONS))) for b in base])
    sizes, label = points.sum(1), np.arange(360) % 50
    got = {(min(a, b), max(a, b)) for i, k in j.CountTree(points, sizes).pairs(label) for a, b in zip(i.tolist(), k.tolist())}
    want = {(a, b) for a, b in combinations(range(360), 2) if label[a] != label[b] and j.similar(np.minimum(points[a], points[b]).sum(), sizes[a], sizes[b])}
    assert got == want and want


def test_screen_keeps_every_similar_pair():
    rng = np.random.default_rng(5)
    make = lambda n: rng.integers(0, 1 << 62, n).astype(np.uint64)
    sets = [np.unique(make(n)) for n in (1, 20, 350, 380, 400, 470, 760, 800, 6000, 30_000)]
    sets += [np.unique(np.concatenate([s[: int(len(s) * 0.92)], make(int(len(s) * f))])) for s in sets[1:] for f in (0.02, 0.2)] + [np.unique(make(n)) for n in (390, 5000)]
    sizes = np.asarray([len(s) for s in sets])
    kept = j.screen(sizes, [j.counts_of(s, j.groups_for(len(s))) for s in sets])
    linked = {x for a, b in combinations(range(len(sets)), 2) if j.similar(len(np.intersect1d(sets[a], sets[b])), sizes[a], sizes[b]) for x in (a, b)}
    assert linked and linked <= set(np.flatnonzero(kept).tolist()) and not kept[0] and not kept[-2:].any()


@pytest.mark.parametrize("seed", range(6))
def test_links_of_a_home_connect_what_is_linked(seed):
    """Sets of mixed sizes; chains of near copies whose ends are not linked; labels given before."""
    rng = np.random.default_rng(seed)
    make = lambda n: rng.integers(0, 1 << 62, n).astype(np.uint64)
    sets = [np.unique(make(n)) for n in (1, 5, 80, 350, 380, 400, 470, 6000)]
    for _ in range(150):
        s = sets[rng.integers(len(sets))]
        sets.append(np.unique(np.concatenate([s[rng.random(len(s)) < rng.choice([0.97, 0.9, 0.85])], make(int(len(s) * rng.choice([0, 0.02, 0.1])))])))
    sets = [s for s in sets if len(s)]
    label = np.arange(len(sets)) if seed % 2 else np.where(rng.random(len(sets)) < 0.2, 0, np.arange(len(sets)))
    want, merged = label.copy(), label.copy()
    for a, b in combinations(range(len(sets)), 2):
        if j.similar(len(np.intersect1d(sets[a], sets[b])), len(sets[a]), len(sets[b])):
            want[want == want[b]] = want[a]
    found = j.connect(sets, merged)
    assert all(j.similar(len(np.intersect1d(sets[a], sets[b])), len(sets[a]), len(sets[b])) for a, b in found)
    assert len(found) == len(set(label.tolist())) - len(set(want.tolist())) > 0
    assert len({*zip(want.tolist(), merged.tolist())}) == len(set(want.tolist())) == len(set(merged.tolist()))


@pytest.mark.parametrize("small,large", [(3000, 40_000), (300, 40_000), (50, 600_000)])
def test_large_sets_among_many_small_ones_are_linked(small, large):
    """Hash groups are chosen for the small sets, so that each holds many shingles of the large ones."""
    rng = np.random.default_rng(small)
    make = lambda n: rng.integers(0, 1 << 62, n).astype(np.uint64)
    one = np.unique(make(large))
    two, apart = np.unique(np.concatenate([one[: int(large * 0.9)], make(large // 20)])), np.unique(np.concatenate([one[: int(large * 0.8)], make(large // 5)]))
    sets = [np.unique(make(10)) for _ in range(small)] + [one, two, apart]
    assert j.similar(len(np.intersect1d(one, two)), len(one), len(two)) and not j.similar(len(np.intersect1d(one, apart)), len(one), len(apart))
    assert [sorted(x) for x in j.connect(sets, np.arange(len(sets)))] == [[small, small + 1]]


def test_components_of_a_long_path(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (101, 100), (7, 7)]
    got = {tuple(r) for r in cc.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {(i, 0) for i in range(61)} | {(100, 100), (101, 100)}
