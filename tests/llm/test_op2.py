import duckdb
import random

from tracemill.llm import decontamination as d


def brute(items, words, window=13):
    hit, found = [False] * len(words), set()
    for item, own in items:
        n = min(window, len(own))
        if not n:
            continue
        grams = {tuple(own[i : i + n]) for i in range(len(own) - n + 1)}
        for i in range(len(words) - n + 1):
            if tuple(words[i : i + n]) in grams:
                found.add(item)
                hit[i : i + n] = [True] * n
    return hit, found


def test_automaton_against_brute_force():
    rng = random.Random(5)
    for _ in range(400):
        window = rng.choice([3, 4, 13])
        vocabulary = "abcd"[: rng.randint(1, 4)]
        items = [(str(i), [rng.choice(vocabulary) for _ in range(rng.randint(0, 18))]) for i in range(rng.randint(0, 6))]
        words = [rng.choice(vocabulary) for _ in range(rng.randint(0, 60))]
        for item, own in items[:2]:
            at = rng.randint(0, len(words))
            words[at:at] = own
        spans, found = d.SuffixAutomaton(items, window).match(words)
        hit = [any(a <= i < b for a, b in spans) for i in range(len(words))]
        assert (hit, found) == brute(items, words, window)


def test_query_and_removal(spark, tmp_path):
    long = " ".join(f"w{i}" for i in range(30))
    docs = [(1, long.upper(), "x"), (2, None, None), (3, "", "y"), (4, "only these three words here", "z"), (None, "tiny item", "n"), (4, "only these three words here", "z"), (5, ("pad " * 500) + " ".join(f"w{i}" for i in range(14)), "p")]
    spark.createDataFrame(docs, "doc_id long, text string, item_id string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, long), (11, "Tiny item"), (12, None), (None, "three words"), (7, long), (13, "!!")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = sorted((r.asDict() for r in d.op2_decontamination(spark, str(tmp_path)).collect()), key=str)
    by = {r["doc_id"]: r for r in rows}
    assert len(rows) == 7
    assert (by[1]["n_words"], by[1]["n_hit"], by[1]["n_items"], by[1]["contaminated"]) == (30, 30, 1, True)
    assert by[1]["items_sha256"] == d.items_digest(["7"])
    assert (by[2]["n_words"], by[2]["contaminated"], by[2]["items_sha256"]) == (0, False, d.items_digest([]))
    assert (by[None]["n_hit"], by[None]["contaminated"]) == (2, True)
    assert (by[5]["n_hit"], by[5]["contaminated"]) == (14, False)
    table = spark.read.parquet(f"{tmp_path}/documents.parquet")
    benchmark = spark.read.parquet(f"{tmp_path}/benchmark.parquet")
    kept = d.decontaminate(table, benchmark, max_span=13)
    assert kept.columns == table.columns
    texts = {r.doc_id: r.text for r in kept.collect()}
    assert set(texts) == {2, 3, 4, 5} and "w5" not in texts[5] and texts[5].count("pad") == 500
    one = sorted(map(str, d.match(table, benchmark).collect()))
    assert one == sorted(map(str, d.match(table, benchmark, block_bytes=40).collect()))
    assert d.match(table, benchmark.where("false")).where("n_hit > 0").count() == 0
    assert d.match(table.where("false"), benchmark).count() == 0


def test_query_against_sql(spark):
    """The registered SQL on the smallest tables."""
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    result = con.execute(d.ORACLE_SQL)
    got = d.op2_decontamination(spark, folder).select([c[0] for c in result.description])
    assert sorted(map(tuple, got.collect())) == sorted(result.fetchall())
