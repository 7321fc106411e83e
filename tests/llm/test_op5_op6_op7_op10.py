import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np

from tracemill.llm import license_scan, quality_classifier, quality_rules, token_counts

BLANK = re.compile(r"[^\x20\x09-\x0D]+")


def brute_figures(text):
    words = BLANK.findall(text or "")
    lines = [x for x in (text or "").split("\n")]
    dup = sum(bool(BLANK.search(x)) and x in lines[:i] for i, x in enumerate(lines))
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = {i + k for i in range(len(words) - 2) for k in range(3) if windows[tuple(words[i : i + 3])] > 1}
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), dup, len(hit)


def test_figures_against_brute_force():
    rng = random.Random(2)
    for _ in range(500):
        text = "".join(rng.choice(["a", "b", " ", "\n", "\t", "#", "|", "é", " ", "\x1f", "\x0b"]) for _ in range(rng.randint(0, 60)))
        assert quality_rules.figures_of(text)[:5] == brute_figures(text)


def test_quality_rules(spark, tmp_path):
    rng = random.Random(4)
    rows = []
    for i in range(600):
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 7))) for _ in range(rng.randint(60, 120))]
        text = " ".join(words) + (" " + "$$$ &&& ### " * 30 if i % 20 == 0 else "")
        rows.append((i, text, ["en", None][i % 2], ["hot", "hot", "hot", f"s{i % 7}", None][i % 5], i))
    rows += [(1000, None, "en", "hot", 0), (1001, "", None, None, 0), (None, "few words", "en", "hot", 0), (3, "same same " * 100, "xx", "solo", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, kept long").write.parquet(f"{tmp_path}/documents.parquet")
    got = quality_rules.op5_quality_rules(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    texts = {(r[0], len(BLANK.findall(r[1] or ""))): r[1] for r in rows}
    for r in got:
        n = brute_figures(texts[r.doc_id, r.n_words])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == n
        assert r.base_failed == (n[0] < 50 or 100 * n[4] > 50 * n[0])
        if r.doc_id is not None and r.doc_id < 600 and not r.base_failed:
            assert r.kept == (r.doc_id % 20 != 0)
        assert not (r.base_failed and r.kept)
    empty = spark.read.parquet(f"{tmp_path}/documents.parquet").where("false")
    rows = quality_rules.figures(empty)
    assert quality_rules.judge(rows, quality_rules.fences(quality_rules.sketch(rows))).count() == 0


def test_sketch_is_mergeable_and_close(spark):
    values = np.random.default_rng(1).lognormal(0, 1, 3000)
    rows = spark.createDataFrame([("a" if i % 3 else "b", "s", int(1000 * v), 1000, 0, 0, 0, 1) for i, v in enumerate(values)], "lang string, source string, word_chars long, n_words long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long")
    whole = {r.metric: r for r in quality_rules.quantiles(quality_rules.merge(quality_rules.sketch(rows))).collect()}["word_length"]
    assert abs(whole.q1 / np.quantile(values, 0.25) - 1) < 0.03 and abs(whole.q3 / np.quantile(values, 0.75) - 1) < 0.03
    a = {tuple(r) for r in quality_rules.merge(quality_rules.sketch(rows)).collect()}
    assert a == {tuple(r) for r in quality_rules.merge(quality_rules.sketch(rows.repartition(7))).collect()}


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def test_license_base(spark, tmp_path):
    rng = random.Random(9)
    parts = ["GNU General Public License", "gnu", "Apache-License", "CC BY", "cc", "by", "MIT license", "é", "\n", "2.0", "licensed under the", "all rights reserved", "spdx-license-identifier: BSD-3-clause"]
    rows = [(i, " ".join(rng.choice(parts) for _ in range(rng.randint(0, 25))), "clash") for i in range(150)] + [(1000, None, ""), (1001, "", ""), (None, "cc by cc by", ""), (7, "MIT License", "")]
    spark.createDataFrame(rows, "doc_id long, text string, labels string").write.parquet(f"{tmp_path}/documents.parquet")
    got = license_scan.op6_license_scan(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)

    def want(text):
        words = WORD.findall((text or "").lower())
        at = [(i, label) for phrase, label in license_scan.BASE.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
        places = [i for i, _ in at]
        return len(words), len(at), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in at}))

    assert Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got) == Counter((d, *want(t)) for d, t, _ in rows)
    for r in got:
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
        assert r.labels == ",".join(sorted(set(filter(None, r.labels.split(",")))))


def test_license_suppression(spark):
    docs = spark.createDataFrame([(1, "Licensed under the Apache License, Version 2.0."), (2, "SPDX-License-Identifier: MPL-2.0"), (3, "Creative Commons Attribution-ShareAlike 4.0 International"), (4, "x " * 50_000 + "all rights reserved")], "doc_id long, text string")
    got = {r.doc_id: r.labels for r in license_scan.scan(docs).collect()}
    assert got == {1: "apache,apache-2", 2: "mpl", 3: "cc-by-sa", 4: "proprietary"}
    table = [("low", 1, "a", "a b c", 0.5), ("high", 3, "a", "a b", 0.9), ("inner", 0, "a", "b", 0.2)]
    assert license_scan.scan(spark.createDataFrame([(1, "a b c b")], "doc_id long, text string"), table).first().labels == "high,inner,low"
    assert len(license_scan.rules()) > 300


def sample(pattern, rng):
    """A text that a rule's pattern matches."""
    out = []
    for op, arg in pattern:
        match str(op):
            case "LITERAL":
                out.append(chr(arg))
            case "IN":
                kind, value = rng.choice(arg)
                out.append(chr(value if str(kind) == "LITERAL" else rng.randint(*value)))
            case "BRANCH":
                out.append(sample(rng.choice(arg[1]), rng))
            case "SUBPATTERN":
                out.append(sample(arg[3], rng))
            case _:
                low, high, inner = arg
                out += [sample(inner, rng) for _ in range(rng.randint(low, min(high, 2)))]
    return "".join(out)


def test_license_keywords_and_gates_switch_no_rule_off(spark):
    """All rules tried on all texts give the same as the rules behind keywords and gates."""
    rng = random.Random(5)
    table = license_scan.rules()
    texts = [sample(re._parser.parse(r[3]), rng) for r in table for _ in range(2)]
    texts += ["Redistribution and use in source and binary forms, with or without modification", "BSD-3-Clause", "MPL-2.0 or later", "EPL 2.0 only", "CDDL-1.0 only", "gfdl version 1.2", "plain words", ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.labels, r.score) for r in license_scan.scan(docs).collect()}
    assert got == {r.doc_id: (r.labels, r.score) for r in license_scan.scan(docs, [(label, p, "", pattern, w) for label, p, _, pattern, w in table]).collect()}
    named = ["bsd", "bsd-3", "mpl-2", "epl-2", "cddl-1", "fdl-1.2"]
    assert [want in got[i][0].split(",") for i, want in enumerate(named, len(texts) - 8)] == [True] * 6 and not got[len(texts) - 2][0]


def brute_count(scores, text):
    total = 0
    for word in (text or "").encode().split():
        w = token_counts.MARK + word.decode()
        best = [(0.0, 0)]
        for i in range(1, len(w) + 1):
            n = len(w[i - 1].encode())
            options = [(best[i - 1][0] + token_counts.BYTE_SCORE * n, -(-best[i - 1][1] + n))]
            options += [(best[j][0] + scores[w[j:i]], -(-best[j][1] + 1)) for j in range(i) if w[j:i] in scores]
            top = max(options, key=lambda o: (o[0], o[1]))
            best.append(top)
        total += -best[-1][1]
    return total


def test_token_counts(spark, tmp_path):
    scores = token_counts.vocabulary(token_counts.default_path())
    rng = random.Random(3)
    texts = ["".join(rng.choice(["th", "e", " ", "ing", "é", "漢", "\n", "z", "qx", "the "]) for _ in range(40)) for _ in range(120)] + [None, "", "a " * 3000]
    small = token_counts.TrieCounter(scores, max_nodes=60, max_words=40)
    want = [brute_count(scores, t) for t in texts]
    assert list(itertools.chain(*(small.count(texts[i : i + 5]) for i in range(0, len(texts), 5)))) == want
    spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int").write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted((r.doc_id, r.n_tokens) for r in token_counts.op7_token_counts(spark, str(tmp_path)).collect()) == list(enumerate(want))


def test_classifier(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    odd = spark.createDataFrame([(10**6, None, "en", "s", 0), (10**6 + 1, "", "en", "s", 0), (None, "x", "en", "s", 0), (10**6 + 2, "#" * 500_000, None, None, 0)], docs.schema)
    docs.union(odd).write.parquet(f"{tmp_path}/documents.parquet")
    labels.union(labels.limit(5)).union(spark.createDataFrame([(None, 1, 0), (5, None, 0)], labels.schema)).write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.doc_id: r for r in quality_classifier.op10_quality_classifier(spark, str(tmp_path)).collect()}
    assert len(got) == 1004
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 4 == 2) for d, r in got.items() if d is not None) and not got[None].held_out
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got.values())
    held = [(r.quality, got[r.doc_id].predicted) for r in labels.collect() if got[r.doc_id].held_out]
    assert np.mean([a == b for a, b in held]) > 0.95
    model = quality_classifier.fit(docs, labels)
    kept = quality_classifier.keep_good(spark.read.parquet(f"{tmp_path}/documents.parquet"), model)
    assert kept.columns == docs.columns
    assert kept.count() == sum(r.predicted for r in got.values())
    assert quality_classifier.fit(docs, labels.where("false")) == quality_classifier.NEUTRAL
    assert quality_classifier.score(docs.where("false"), model).count() == 0
    assert all(math.isclose(x, 0.7) for x in quality_classifier.NEUTRAL.score(["any", None]))


def test_token_counts_of_very_long_words(monkeypatch):
    rng = random.Random(12)
    scores = {"▁": -1.0, "a": -2.0, "b": -2.5, "ab": -2.7, "aba": -3.0, "bbb": -4.0, "é": -5.0, "▁ab": -2.0}
    text = "".join(rng.choice("aabbé😀") for _ in range(5000))
    whole = token_counts.TrieCounter(scores, max_nodes=100_000)
    monkeypatch.setattr(token_counts, "SHARED", 100_000)
    want = whole.count([text, text[:1500]])
    monkeypatch.setattr(token_counts, "SHARED", 7)
    short = token_counts.TrieCounter(scores)
    assert short.count([text, text[:1500]]) == want and short.nodes < 20


def test_license_scan_of_many_detections(spark):
    """A text of detections only: places and words are counted along it, in time in proportion to its length."""
    n = 8_000
    text = "MIT License, gnu general public license. " * n
    docs = spark.createDataFrame([(1, text), (2, text + "x")], "doc_id long, text string").repartition(2)
    got = {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in license_scan.scan(docs).collect()}
    assert got == {1: (6 * n, 2 * n, 0, 6 * n - 4, "gpl,mit"), 2: (6 * n + 1, 2 * n, 0, 6 * n - 4, "gpl,mit")}
