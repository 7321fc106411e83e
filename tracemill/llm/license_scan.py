"""License scans by ordered signature rules, in DataFrame functions only.

Texts are reduced to lower-case words with one blank between. A rule has a label, a priority, a keyword
and a regular expression over that form. Rules whose keyword is absent are never tried, and texts without
any of the gate words, of which every keyword holds one, skip all of them. Detections are sorted by start and, backwards, by end; one that
lies inside an earlier one of the same or a higher priority is suppressed (running maximum of the ends
for each priority). Everything happens within a row: no shuffle, no Python.

Null or empty texts have no words and no labels; repeated rows give the same; an empty table gives no
rows; other columns are ignored. ``score`` is the largest weight of a detection left, else 0.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import gather

#: Fixed phrases and labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Families: label stem, keyword that each of the titles holds, titles in words, versions, identifier in words. Rules are made from these.
FAMILIES = (
    ("gpl", "gnu general public licen", "gnu general public licen[cs]e", "1 2 3", "gpl"),
    ("gpl", " gpl ", "gnu gpl|gpl", "1 2 3", "gpl"),
    ("lgpl", "general public licen", "gnu (?:lesser|library) general public licen[cs]e", "2 2.1 3", "lgpl"),
    ("lgpl", "lgpl", "gnu lgpl|lgpl", "2 2.1 3", "lgpl"),
    ("agpl", "affero general public licen", "(?:gnu )?affero general public licen[cs]e", "1 3", "agpl"),
    ("agpl", "agpl", "gnu agpl|agpl", "1 3", "agpl"),
    ("fdl", "free documentation licen", "gnu free documentation licen[cs]e", "1.1 1.2 1.3", "gfdl"),
    ("fdl", "gfdl", "gfdl", "1.1 1.2 1.3", "gfdl"),
    ("apache", "apache", "apache(?: software)? licen[cs]e|apache", "1 1.1 2", "apache"),
    ("mit", "mit licen", "mit licen[cs]e", "0", "mit"),
    ("mit", "expat licen", "expat licen[cs]e", "0", "mit"),
    ("bsd", "bsd licen", "(?:new |modified |simplified |original )?bsd licen[cs]e", "0 1 2 3 4", "bsd"),
    ("bsd", "bsd style licen", "bsd style licen[cs]e", "0 1 2 3 4", "bsd"),
    ("mpl", "mozilla public licen", "mozilla public licen[cs]e", "1 1.1 2", "mpl"),
    ("epl", "eclipse public licen", "eclipse public licen[cs]e", "1 2", "epl"),
    ("cddl", "common development and distribution licen", "common development and distribution licen[cs]e", "1 1.1", "cddl"),
    ("cpl", "common public licen", "common public licen[cs]e", "0.5 1", "cpl"),
    ("eupl", "european union public licen", "european union public licen[cs]e", "1 1.1 1.2", "eupl"),
    ("isc", "isc licen", "isc licen[cs]e", "1", "isc"),
    ("artistic", "artistic licen", "artistic licen[cs]e", "1 2", "artistic"),
    ("bsl", "boost software licen", "boost software licen[cs]e", "1", "bsl"),
    ("zlib", "zlib licen", "zlib licen[cs]e", "1", "zlib"),
    ("zlib", "zlib libpng licen", "zlib libpng licen[cs]e", "1", "zlib"),
    ("unlicense", "unlicen", "unlicen[cs]e|the unlicen[cs]e", "1", "unlicense"),
    ("wtfpl", "public licen", "do what the fuck you want to public licen[cs]e", "1 2", "wtfpl"),
    ("wtfpl", "wtfpl", "wtfpl", "1 2", "wtfpl"),
    ("psf", "python software foundation licen", "python software foundation licen[cs]e", "2 3", "psf"),
    ("psf", "psf licen", "psf licen[cs]e", "2 3", "psf"),
    ("psf", "python licen", "python licen[cs]e", "2 3", "psf"),
    ("php", "php licen", "php licen[cs]e", "3 3.01", "php"),
    ("ruby", "ruby licen", "ruby licen[cs]e", "1 2", "ruby"),
    ("ofl", "open font licen", "sil open font licen[cs]e|open font licen[cs]e", "1 1.1", "ofl"),
    ("odbl", "open database licen", "open database licen[cs]e", "1", "odbl"),
    ("odbl", "odbl", "odbl", "1", "odbl"),
    ("odc-by", "open data commons attribution licen", "open data commons attribution licen[cs]e", "1", "odc by"),
    ("pddl", "public domain dedication and licen", "public domain dedication and licen[cs]e", "1", "pddl"),
    ("ms-pl", "microsoft public licen", "microsoft public licen[cs]e", "1", "ms pl"),
    ("ms-rl", "microsoft reciprocal licen", "microsoft reciprocal licen[cs]e", "1", "ms rl"),
    ("osl", "open software licen", "open software licen[cs]e", "1 2 2.1 3", "osl"),
    ("afl", "academic free licen", "academic free licen[cs]e", "1.1 2 2.1 3", "afl"),
    ("ncsa", "ncsa open source licen", "university of illinois ncsa open source licen[cs]e", "1", "ncsa"),
    ("ncsa", "ncsa licen", "ncsa licen[cs]e", "1", "ncsa"),
    ("openssl", "openssl licen", "openssl licen[cs]e", "1", "openssl"),
    ("x11", "x11 licen", "x11 licen[cs]e", "1", "x11"),
    ("llama", "community licen", "llama(?: [0-9]+)? community licen[cs]e", "2 3 3.1", "llama"),
    ("openrail", "openrail", "openrail(?: m| pp m)? licen[cs]e|creative ?ml openrail m", "1", "openrail"),
    ("cecill", "cecill", "cecill(?: [bc])? licen[cs]e|cecill", "1 2 2.1", "cecill"),
    ("qpl", "q public licen", "q public licen[cs]e", "1", "qpl"),
    ("vim", "vim licen", "vim licen[cs]e", "1", "vim"),
    ("postgresql", "postgresql licen", "postgresql licen[cs]e", "1", "postgresql"),
    ("curl", "curl licen", "curl licen[cs]e", "1", "curl"),
    ("blueoak", "blue oak model licen", "blue oak model licen[cs]e", "1", "blueoak"),
)
CREATIVE = ("by", "by sa", "by nd", "by nc", "by nc sa", "by nc nd")
CREATIVE_WORDS = {"by": "attribution", "sa": "sharealike|share alike", "nd": "noderivatives|noderivs|no derivatives", "nc": "noncommercial|non commercial"}
GATES = ("licen", "copyright", "gnu", "spdx", "cc by", "cc0", "creative commons", "public domain", "all rights reserved", "gpl", "apache", "wtfpl", "gfdl", "odbl", "cecill", "openrail")
LEVELS = 5


def rules() -> list[tuple[str, int, str, str, float]]:
    """(label, priority, keyword, pattern, weight), highest priority first; patterns run between blanks."""
    out = []
    for label, keyword, title, versions, identifier in FAMILIES:
        title = f"(?:{title})"
        out.append((label, 4, "spdx", rf"spdx licen[cs]e identifier {identifier}(?: [0-9]+)*(?: only| or later| clause)*", 1.0))
        for v in versions.split():
            words = v.replace(".", " ")
            tail = r"(?: 0)?" if "." not in v else ""
            out.append((f"{label}-{v}", 3, keyword, rf"{title},? ?(?:as published by the free software foundation )?(?:either )?(?:version |v ?){words}{tail}(?: or (?:any )?later(?: version)?)?", 0.95))
            out.append((f"{label}-{v}", 3, f" {identifier} ", rf"{identifier} (?:v ?)?{words}{tail} (?:only|or later|clause)", 0.9))
        out.append((label, 2, keyword, rf"(?:licen[cs]ed|released|distributed|available|published|covered|provided) under (?:the )?(?:terms of )?(?:the )?{title}", 0.9))
        out.append((label, 1, keyword, rf"{title}" if label not in ("gpl", "apache") else rf"(?:{title.strip('(?:)').split('|')[0]})", 0.7))
        out.append((label, 1, f"e {identifier} ", rf"licen[cs]e {identifier}(?: [0-9]+)*", 0.6))
    for parts in CREATIVE:
        label, spelled = f"cc-{parts.replace(' ', '-')}", " ".join(f"(?:{CREATIVE_WORDS[p]})" for p in parts.split())
        out.append((label, 3, "cc by", rf"cc {parts}(?: (?:[1-4] [05]|[1-4]))?(?: international| unported)?", 0.9))
        out.append((label, 3, "creative commons", rf"creative commons {spelled}(?: (?:[1-4] [05]))?(?: international| unported)?(?: public)?(?: licen[cs]e)?", 0.95))
        out.append((label, 3, "creativecommons", rf"creativecommons org licenses {parts}(?: [1-4] [05])?", 1.0))
        for v in ("1 0", "2 0", "2 5", "3 0", "4 0"):
            out.append((f"{label}-{v.replace(' ', '.')}", 4, "cc by", rf"cc {parts} {v}", 0.95))
    out += [
        ("cc0", 3, "cc0", r"cc0(?: 1 0)?(?: universal)?", 0.9),
        ("cc0", 3, "creative commons", r"creative commons zero", 0.95),
        ("public-domain", 2, "public domain", r"(?:released into|dedicated to|placed in|in) the public domain", 0.7),
        ("proprietary", 1, "all rights reserved", r"all rights reserved", 0.5),
        ("proprietary", 2, "licen", r"(?:proprietary|commercial) licen[cs]e", 0.6),
        ("mit", 2, "permission is hereby granted", r"permission is hereby granted free of charge to any person obtaining a copy of this software", 0.95),
        ("isc", 2, "permission to use", r"permission to use copy modify and or distribute this software for any purpose", 0.9),
        ("bsd", 2, "redistribution and use", r"redistribution and use in source and binary forms with or without modification", 0.9),
        ("copyright", 0, "copyright", r"copyright (?:c )?(?:19|20)[0-9]{2}", 0.3),
    ]
    return sorted(set(out), key=lambda r: (-r[1], r[0], r[3]))


def _gates(table) -> set[str]:
    """Words of which every rule's keyword holds one: a text without them has none of the keywords."""
    return {next((g for g in GATES if g in r[2]), r[2]) for r in table}


def _words(text: Column) -> Column:
    """Lower-case words, a blank before, between and after. Lower-casing other letters parts no word."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ")), F.lit(" "))


def _spaces(x: Column) -> Column:
    return F.length(x) - F.length(F.replace(x, F.lit(" ")))


def _places(canon: Column, pattern: Column) -> Column:
    """Array of (first, last) characters, and the word of the first, of all places of a pattern between blanks."""
    bounded = F.concat(F.lit("(?<= )(?:"), pattern, F.lit(")(?= )"))

    def step(acc, x):
        first, blanks = acc["at"] + F.length(x["piece"]), acc["blanks"] + _spaces(x["piece"])
        last = first + F.length(x["found"])
        place = F.struct(first.alias("first"), last.alias("last"), (blanks - 1).alias("word"))
        return {"at": last, "blanks": blanks + _spaces(x["found"])}, place

    found, pieces = F.regexp_extract_all(canon, bounded, F.lit(0)), F.split(canon, bounded, F.lit(-1))
    pairs = F.filter(F.zip_with(pieces, found, lambda p, f: F.struct(p.alias("piece"), f.alias("found"))), lambda x: x["found"].isNotNull())
    return gather(pairs, {"at": F.lit(0), "blanks": F.lit(0)}, step, "struct<first:int,last:int,word:int>")


def _rule_array(table) -> Column:
    """The rules as one literal."""
    names = ("label", "priority", "keyword", "pattern", "weight")
    return F.from_json(F.lit(json.dumps([dict(zip(names, r)) for r in table])), "array<struct<label:string,priority:int,keyword:string,pattern:string,weight:double>>")


def _keep(found: Column) -> Column:
    """Labels and largest weight of the detections that no earlier one of their priority or more contains."""
    ends = [f"m{p}" for p in range(LEVELS)]
    start = F.struct(*(F.lit(-1).alias(m) for m in ends), F.array().cast("array<string>").alias("labels"), F.lit(0.0).alias("weight"))

    def step(acc, d):
        over = F.greatest(*(F.when(d["priority"] <= p, acc[m]).otherwise(F.lit(-1)) for p, m in enumerate(ends)))
        free = over < d["last"]
        return F.struct(
            *(F.when(d["priority"] == p, F.greatest(acc[m], d["last"])).otherwise(acc[m]).alias(m) for p, m in enumerate(ends)),
            F.when(free, F.array_union(acc["labels"], F.array(d["label"]))).otherwise(acc["labels"]).alias("labels"),
            F.when(free, F.greatest(acc["weight"], d["weight"])).otherwise(acc["weight"]).alias("weight"),
        )

    return F.aggregate(found, start, step, lambda acc: F.struct(acc["labels"].alias("labels"), acc["weight"].alias("weight")))


def scan(docs: DataFrame, table=None) -> DataFrame:
    """Per document: n_words, base places with first and last word, labels and score."""
    table = rules() if table is None else table
    gates, table = _gates(table), _rule_array(table)
    canon = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _words(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("canon"))
    gated = F.lit(False)
    for g in (*gates, *BASE):
        gated |= F.contains("canon", F.lit(g))
    cut = canon.select("doc_id", F.when(F.length(F.trim("canon")) == 0, F.lit(0)).otherwise(_spaces(F.col("canon")) - 1).cast("long").alias("n_words"), F.when(gated, F.col("canon")).alias("canon"))
    sorted_found = F.array_sort(
        F.flatten(
            F.transform(
                F.filter(table, lambda r: F.contains("canon", r["keyword"])),
                lambda r: F.transform(
                    _places(F.col("canon"), r["pattern"]),
                    lambda x: F.struct(x["first"].alias("first"), (-x["last"]).alias("back"), (-r["priority"]).alias("rank"), r["label"].alias("label"), r["weight"].alias("weight"), x["last"].alias("last"), r["priority"].alias("priority")),
                ),
            )
        )
    )
    bases = F.flatten(
        F.transform(
            F.filter(F.array(*(F.struct(F.lit(p).alias("phrase"), F.lit(n).alias("label")) for p, n in BASE.items())), lambda b: F.contains("canon", b["phrase"])),
            lambda b: F.transform(_places(F.col("canon"), b["phrase"]), lambda x: F.struct(x["word"].alias("word"), b["label"].alias("label"))),
        )
    )
    seen = cut.select("doc_id", "n_words", F.when(F.col("canon").isNotNull(), _keep(sorted_found)).alias("own"), F.when(F.col("canon").isNotNull(), bases).alias("base"))
    words, labels = F.transform("base", lambda b: b["word"]), F.array_distinct(F.transform("base", lambda b: b["label"]))
    none = F.array().cast("array<string>")
    return seen.select(
        "doc_id", "n_words",
        F.coalesce(F.size("base"), F.lit(0)).cast("long").alias("n_base"),
        F.array_min(words).cast("long").alias("first_word"),
        F.array_max(words).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.coalesce(labels, none)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(F.coalesce(labels, none), F.coalesce(F.col("own.labels"), none))), ",").alias("labels"),
        F.coalesce(F.col("own.weight"), F.lit(0.0)).cast("double").alias("score"),
    )


def op6_license_scan(spark, sf_dir: str) -> DataFrame:
    """License labels of all documents."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
