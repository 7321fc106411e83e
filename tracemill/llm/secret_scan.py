"""Secret scans: candidates by pattern, false positives removed by a random forest; DataFrame functions only.

A candidate is a run of 16 key-like characters or more, a key with a provider's mark, a private key from
its head to its end line (or as far as its lines go), or the value after a word such as ``password`` or ``token``
with ``=`` or ``:``, whole at any length. Its features are length, shares of character classes, character transitions, dictionary coverage, signs of a path around
it and neighbouring words. A random forest of labelled findings (Spark ML, on DataFrames) gives the
share of trees that call it a secret; the fitted trees become one SQL expression, so that a scan is a
single pass within rows: no shuffle, no join, no Python.

Null or empty texts have no candidates; repeated rows give repeated findings; an empty table gives no
rows; ``redact`` keeps all other columns, whatever their names, and null texts.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.llm.common import gather

THRESHOLD = 0.5
AROUND = 60
#: Marks of well-known keys.
PROVIDER = r"(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{20,}|github_pat_[A-Za-z0-9_]{20,}|glpat-[A-Za-z0-9_-]{16,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{30,}|sk[-_](?:live|test|ant|proj)?[-_]?[A-Za-z0-9_-]{16,}|npm_[A-Za-z0-9]{30,}|eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_.-]{8,}"
NAMES = r"password|passwd|pwd|secret|token|api[_-]?key|apikey|access[_-]?key|auth|credential|private[_-]?key"
HEAD = r"-----BEGIN [A-Z0-9 ]{0,20}PRIVATE KEY(?: BLOCK)?-----"
#: What may stand between a key's head and its end: header lines, then base64 characters, blanks and line ends (as two characters, too).
_ABOUT = r"(?:\s*+(?:Proc-Type|DEK-Info|Key-Info|Version|Comment|Hash|Charset|MessageID|X-[A-Za-z-]{1,40}):[^\n\\]*+){0,6}"
_LINE = r"(?:\s|\\[nrt]){0,6}+[A-Za-z0-9+/=]{32,}+"
#: Repeats are possessive and unbounded: a candidate is a whole value, run or private key, and none runs into a private key.
CANDIDATE = (
    rf"{HEAD}{_ABOUT}(?:[A-Za-z0-9+/=\s\\]*+{HEAD.replace('BEGIN', 'END')}|(?:{_LINE})++)"
    rf"|(?<![A-Za-z0-9])(?:{PROVIDER})(?:[A-Za-z0-9_+/]|-(?!{HEAD[1:]}))*+={{0,2}}"
    rf"|(?<=[=: \"'])(?<=(?i:{NAMES})[\"']?[ ]{{0,2}}[=:][ ]{{0,2}}[\"']?)(?:(?!{HEAD})[^\s\"'<>,;]){{8,}}+"
    rf"|(?<![A-Za-z0-9_+/=-])(?=[A-Za-z0-9_+/-]{{16}})(?=[_+/-]*+[A-Za-z0-9])(?:[A-Za-z0-9_+/]|-(?!{HEAD[1:]})){{16,}}+={{0,2}}"
)
GATE = rf"[0-9]|[A-Za-z_+/-]{{16}}|PRIVATE KEY|(?i:{NAMES})[\"']?[ ]{{0,2}}[=:]|AKIA|ASIA|gh[pousr]_|github_pat_|glpat-|xox|AIza|sk[-_]|npm_|eyJ"
#: Words for the labelled findings, and the dictionary where no corpus is given.
DICTIONARY = "about account after all and any app are base been book but can changeme city client code color config connection content country data database date default demo department description document domain download dummy east email error event example field file first folder for from group has have home host http image index info item key last letter level line link list local log login long main manager map market master message model module money month name new news not number object of office open option order other page paper part party password path people person phone picture place placeholder plan point policy power product program project public question read record release report request result right river room sample school screen secret section server service session set settings short side site source south start state station status step store story street string student style system table team test that the this time title token total town tree type update url user value version video view water way web week west with word work world www year your".split()
_PAIRS = "th|he|in|er|an|re|on|at|en|nd|ti|es|or|te|of|ed|is|it|al|ar|st|to|nt|ng|se|ha|as|ou|io|le|ve|co|me|de|hi|ri|ro|ic|ne|ea|ra|ce"
FEATURES = ("length", "digits", "upper", "lower", "switches", "pairs", "vowels", "distinct", "dictionary", "hexadecimal", "provider", "assigned", "named", "path", "placeholder", "digest", "parts", "runs")


def features(token: Column, left: Column, right: Column, words=DICTIONARY) -> list[Column]:
    """Feature columns of a candidate with the text before and after it; ``words`` are those of the dictionary."""
    n = F.greatest(F.length(token), F.lit(1)).cast("double")
    count = lambda pattern, x=token: F.regexp_count(x, F.lit(pattern)).cast("double")
    flag = lambda pattern, x: F.when(x.rlike(pattern), 1.0).otherwise(0.0)
    lower = F.lower(token)
    covered = F.aggregate(F.regexp_extract_all(lower, F.lit("|".join(sorted((w for w in words if len(w) > 2), key=lambda w: (-len(w), w)))), F.lit(0)), F.lit(0), lambda acc, w: acc + F.length(w))
    return [
        F.least(n, F.lit(100.0)),
        count("[0-9]") / n,
        count("[A-Z]") / n,
        count("[a-z]") / n,
        count("(?<=[a-z])(?=[0-9A-Z])|(?<=[A-Z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])") / n,
        2 * count(_PAIRS, lower) / n,
        count("[aeiou]", lower) / n,
        F.size(F.array_distinct(F.split(token, ""))) / F.least(n, F.lit(40.0)),
        covered / n,
        flag("^[0-9a-fA-F]+$", token),
        flag(rf"^(?:{PROVIDER})|PRIVATE KEY", token),
        flag(r"[=:][ ]{0,2}[\"']?$", left),
        flag(rf"(?i)(?:{NAMES}|bearer)[^\n]{{0,25}}$", left),
        F.when(left.rlike(r"(?:/|\\|://|\.)$") | right.rlike(r"^(?:/|\.[a-z]{2,4}\b)") | token.rlike("/[^/]*/"), 1.0).otherwise(0.0),
        flag(r"(?i)example|sample|dummy|changeme|placeholder|your[_-]|xxxx|\*\*\*|<|test|1234", token),
        flag(r"(?i)(?:commit|sha-?[0-9]*|md5|checksum|digest|hash|uuid|rev|revision|etag|id)[\"' ]{0,2}[=:]?[\"' ]{0,3}$", left),
        count("[-_/]") / n,
        flag(r"(.)\1{4}", token),
    ]


def corpus_words(docs: DataFrame, n: int = 400) -> list[str]:
    """The ``n`` most frequent lower-case words of three to twelve letters in all texts: a dictionary.

    Words are counted once, where they lie, before they are shuffled; ties go by the word. A corpus without
    such words gets ``DICTIONARY``.
    """
    words = docs.select(F.explode(F.split(F.lower(F.col("text").cast("string")), "[^\\p{L}0-9]+")).alias("word"))
    top = words.where(F.col("word").rlike(r"^\p{L}{3,12}$")).groupBy("word").count().orderBy(F.desc("count"), "word").limit(n).collect()
    return [r.word for r in top] or DICTIONARY


def labelled_findings(spark: SparkSession, n: int = 4000) -> DataFrame:
    """Findings (token, before, after, label, template) made by rule from hashes and word lists: half are secrets."""
    words = F.array(*map(F.lit, DICTIONARY))
    pick = lambda k: F.get(words, F.pmod(F.xxhash64("id", F.lit(k)), F.lit(len(DICTIONARY))).cast("int"))
    hexa = lambda k, size: F.substring(F.sha2(F.concat(F.col("id").cast("string"), F.lit(f":{k}")), 256), 1, size)
    b64 = lambda k, size: F.substring(F.base64(F.unhex(F.sha2(F.concat(F.col("id").cast("string"), F.lit(f"/{k}")), 512))), 1, size)
    base36 = lambda k, size: F.upper(F.substring(F.translate(b64(k, 86), "+/=", "7q2"), 1, size))
    uuid = F.concat_ws("-", hexa(1, 8), F.substring(hexa(2, 64), 3, 4), F.substring(hexa(3, 64), 5, 4), F.substring(hexa(4, 64), 7, 4), hexa(5, 12))
    chained = lambda k, n, size, end: F.array_join(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.substring(F.base64(F.unhex(F.sha2(F.concat(F.col("id").cast("string"), F.lit(f"/{k}/"), i.cast("string")), 512))), 1, size)), end)
    long = lambda k, size: F.substring(chained(k, -(-size // 86), 86, ""), 1, size)
    body = lambda k, lines, end: chained(k, lines, 64, end)
    key = lambda kind, k, lines, end="\n": F.concat(F.lit(f"-----BEGIN {kind}PRIVATE KEY-----{end}"), body(k, lines, end), F.lit(f"{end}-----END {kind}PRIVATE KEY-----"))
    phrase = lambda *k: F.concat_ws("_", *(pick(i) for i in k))
    letters = lambda k, size: F.substring(F.regexp_replace(chained(k, 2, 86, ""), "[^A-Za-z]", ""), 1, size)
    pairs = F.array(*map(F.lit, _PAIRS.split("|")))
    syllables = lambda k, n: F.array_join(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.get(pairs, F.pmod(F.xxhash64("id", F.lit(k), i), F.lit(len(_PAIRS.split("|")))).cast("int"))), "")
    # fmt: off
    cases = [  # token, before, after, secret
        (hexa(1, 40), 'token = "', '" ', 1), (hexa(2, 18), "password=", " and", 1),
        (F.concat(F.lit("AKIA"), base36(3, 16)), "the key ", " in", 1), (b64(4, 40), "aws_secret_access_key = ", "\n", 1),
        (F.concat(F.lit("ghp_"), F.translate(b64(5, 36), "+/", "aB")), "use ", " for", 1), (F.concat(F.lit("sk-"), F.translate(b64(6, 44), "+/", "cD")), "key: ", "\n", 1),
        (F.translate(b64(7, 24), "+/", "eF"), 'secret: "', '"', 1), (hexa(8, 32), "api_key=", "&x", 1),
        (F.concat(pick(1), b64(9, 8)), "password: ", "\n", 1), (F.translate(b64(10, 64), "+/", "-_"), "Authorization: Bearer ", "\n", 1),
        (long(1, 320), 'token = "', '"', 1), (long(2, 900), "credentials: ", "\n", 1), (F.translate(long(3, 500), "+/", "-_"), "Authorization: Bearer ", "\n", 1), (F.concat(hexa(20, 64), hexa(21, 64), hexa(22, 64)), "secret=", "\n", 1),
        (key("RSA ", 4, 12), "\n", "\n", 1), (key("", 5, 20), "the key is ", " here", 1), (key("", 6, 16, "\\n"), '"private_key": "', '"', 1), (F.concat(F.lit("-----BEGIN EC PRIVATE KEY-----\n"), body(7, 3, "\n")), "\n", "", 1),
        (letters(9, 40), "the key ", " in", 1), (letters(10, 24), "use ", " for", 1), (F.lower(letters(11, 40)), "see ", " there", 1), (letters(12, 32), 'secret = "', '"', 1), (F.concat_ws("_", letters(13, 12), letters(14, 12)), "with ", ".", 1),
        (hexa(11, 40), "commit ", "\n", 0), (hexa(12, 64), "sha256: ", "\n", 0), (uuid, "id: ", ",", 0), (uuid, "see ", " there", 0),
        (F.concat(phrase(1, 2, 3), F.lit("_2")), "call ", "(", 0), (F.concat_ws("/", pick(4), pick(5), pick(6), hexa(13, 7)), "https://www.site.com/", ".html", 0),
        (F.lit("your_password_here1"), 'password="', '"', 0), (F.concat(F.lit("example_token_"), hexa(14, 4)), 'token = "', '"', 0),
        (F.concat(F.lit("xxxxxxxxxxxx"), hexa(15, 4)), "api_key: ", "\n", 0), (F.conv(hexa(16, 13), 16, 10), "number ", ".", 0),
        (F.concat(F.lit("2024-0"), F.pmod("id", F.lit(9)).cast("string"), F.lit("-11T10-20-30")), "at ", " the", 0), (F.concat_ws("-", pick(7), pick(8), pick(9), F.lit("2020")), "a ", " one", 0),
        (F.concat(phrase(1, 4), F.lit("()")), "password = ", ";", 0), (hexa(17, 32), "md5 = ", "\n", 0),
        (F.concat_ws("/", F.lit("usr"), pick(2), pick(8), F.lit("v2")), "open /", "/x", 0), (hexa(18, 40), "/objects/", "/a", 0),
        (long(8, 700), "data:image/png;base64,", '"', 0), (F.concat(hexa(23, 64), hexa(24, 64)), "sha512: ", "\n", 0), (F.concat_ws("/", phrase(30, 31, 32), phrase(33, 34, 35), phrase(36, 37, 38), hexa(25, 7)), "https://www.site.com/", ".html", 0),
        (phrase(3, 9, 2), "auth: ", ",", 0), (F.conv(hexa(19, 15), 16, 10), "id=", "&", 0),
        (phrase(40, 41, 42), "call ", "(", 0), (F.concat(pick(43), pick(44), pick(45), pick(46)), "the ", " is", 0), (F.concat_ws("-", pick(47), pick(48), pick(49), pick(50)), "a ", " one", 0), (F.array_join(F.transform(F.array(pick(51), pick(52), pick(53), pick(54)), F.initcap), ""), "new ", "(", 0),
        (F.concat_ws("/", pick(55), pick(56), pick(57), pick(58)), "in ", " there", 0), (syllables(59, 8), "the ", " and", 0), (F.initcap(syllables(60, 10)), "with ", ".", 0), (F.upper(syllables(61, 9)), "see ", ",", 0), (F.array_join(F.array_repeat(F.lit("ha"), 12), ""), "and ", " he", 0),
    ]
    # fmt: on
    cases = [(*c, i) for i, c in enumerate(cases)]
    yes, no = [c for c in cases if c[3]], [c for c in cases if not c[3]]
    half, turn = F.pmod("id", F.lit(2)), F.floor(F.col("id") / 2)
    row = lambda c: F.struct(c[0].alias("token"), F.lit(c[1]).alias("before"), F.lit(c[2]).alias("after"), F.lit(c[3]).alias("label"), F.lit(c[4]).alias("template"))
    one = lambda group: F.get(F.array(*map(row, group)), F.pmod(turn, F.lit(len(group))).cast("int"))
    return spark.range(n).select(F.when(half == 1, one(yes)).otherwise(one(no)).alias("f")).select("f.*").repartition(2)  # dealt here, so that no feature holds these expressions


_NODE = re.compile(r"^ *(?:(If|Else) \(feature (\d+) (<=|>|in|not in) (.+)\)|Predict: ([-0-9.eE]+))$")


def _trees(description: str) -> list:
    """Nested (feature, limit, left, right) or a class, from the text form of a fitted forest."""
    trees: list[list[str]] = []
    for line in description.split("\n"):
        if re.match(r"^ *Tree \d+", line):
            trees.append([])
        elif trees and line.strip():
            trees[-1].append(line)

    def read(lines: list[str], at: int):
        m = _NODE.match(lines[at])
        if m[5] is not None:
            return float(m[5]), at + 1
        left, after = read(lines, at + 1)
        right, after = read(lines, after + 1)  # skips the Else line
        return (int(m[2]), float(m[4]), left, right), after

    return [read(t, 0)[0] for t in trees]


def train(findings: DataFrame, words=DICTIONARY, trees: int = 25, depth: int = 6, seed: int = 11) -> list:
    """Fit a random forest on rows (token, before, after, label)."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import array_to_vector

    rows = findings.where("token is not null and label is not null")
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    x = array_to_vector(F.array(*features(F.col("token"), blank("before"), blank("after"), words)))
    rows = rows.select(x.alias("features"), F.col("label").cast("double").alias("label"))
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="onethird")
    return _trees(forest.fit(rows).toDebugString)


def _tree(node, x) -> Column:
    if isinstance(node, float):
        return F.lit(node)
    feature, limit, left, right = node
    return F.when(x[FEATURES[feature]] <= limit, _tree(left, x)).otherwise(_tree(right, x))


def _found(text: Column, forest: list, words=DICTIONARY) -> Column:
    """Array of findings of a text: first character, token, the piece of text before it, and score."""
    pieces, tokens = F.split(text, CANDIDATE, -1), F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0))
    shifted = F.concat(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), F.array(F.lit("")))
    near = F.zip_with(F.zip_with(pieces, shifted, lambda a, b: F.struct(a.alias("before"), b.alias("after"))), tokens, lambda p, t: F.struct(p["before"].alias("before"), p["after"].alias("after"), t.alias("token")))
    near = F.filter(near, lambda x: x["token"].isNotNull())

    def step(acc, x):
        first = acc["at"] + F.length(x["before"])
        got = F.struct(first.alias("first"), x["token"].alias("token"), x["before"].alias("piece"), F.left(x["after"], F.lit(AROUND)).alias("after"))
        return {"at": first + F.length(x["token"])}, got

    placed = gather(near, {"at": F.lit(0)}, step, "struct<first:int,token:string,piece:string,after:string>")
    figures = lambda x: F.struct(*(f.alias(n) for n, f in zip(FEATURES, features(x["token"], F.right(x["piece"], F.lit(AROUND)), x["after"], words))))
    measured = F.transform(placed, lambda x: F.struct(x["first"].alias("first"), x["token"].alias("token"), x["piece"].alias("piece"), figures(x).alias("x")))
    votes = lambda x: sum((_tree(t, x) for t in forest), F.lit(0.0)) / max(1, len(forest))
    return F.transform(measured, lambda m: F.struct(m["first"].alias("first"), m["token"].alias("token"), m["piece"].alias("piece"), votes(m["x"]).alias("score")))


def scan(docs: DataFrame, forest: list, words=DICTIONARY) -> DataFrame:
    """One row per candidate: place, length, digest of the token, score and verdict."""
    gated = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.col("text").rlike(GATE))
    rows = gated.select("doc_id", F.inline(_found(F.col("text"), forest, words)))
    return rows.select("doc_id", F.col("first").cast("long").alias("start"), F.length("token").cast("long").alias("length"), F.sha2("token", 256).alias("token_sha256"), "score", (F.col("score") >= THRESHOLD).alias("is_secret"))


def redact(docs: DataFrame, forest: list, mark: str = "<redacted:secret>", words=DICTIONARY) -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by ``mark``; all columns kept."""
    text = F.col("text")

    def joined(found):
        shown = F.transform(found, lambda x: F.concat(x["piece"], F.when(x["score"] >= THRESHOLD, F.lit(mark)).otherwise(x["token"])))
        last = F.try_element_at(found, F.lit(-1))
        end = F.coalesce(last["first"] + F.length(last["token"]), F.lit(0))
        return F.concat(F.array_join(shown, ""), F.substring(text, end + 1, F.length(text)))

    cut = F.get(F.transform(F.array(_found(text, forest, words)), joined), 0)  # findings are computed once
    return docs.withColumn("text", F.when(text.rlike(GATE), cut).otherwise(text).cast(docs.schema["text"].dataType))


def op1_secret_scan(spark, sf_dir: str) -> DataFrame:
    """Candidates of all documents with the forest's verdicts."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    words = corpus_words(docs)
    return scan(docs, train(labelled_findings(spark), words), words)
