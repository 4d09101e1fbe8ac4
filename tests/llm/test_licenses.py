import random
import re

from pyspark.sql import functions as F

from pathlore.llm import licenses
from pathlore.llm.queries import op12_licenses

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain_places(words, phrases):
    out = []
    for p in phrases:
        own = p.words.split()
        out += [(i, i + len(own) - 1, p.label, p.base) for i in range(len(words) - len(own) + 1) if words[i : i + len(own)] == own]
    return out


def descent(tokens):
    """(value, labels, place behind) by recursive descent, None where the whole list is no expression."""

    def primary(i):
        if i < len(tokens) and tokens[i] == "(":
            if (got := level(i + 1, "or")) is None or got[2] >= len(tokens) or tokens[got[2]] != ")":
                return None
            return got[0], got[1], got[2] + 1
        if i >= len(tokens) or tokens[i] in ("or", "and", "with", ")"):
            return None
        label = licenses.label_of(tokens[i])
        return licenses.permission(label), [label], i + 1

    def excepted(i):
        if (got := primary(i)) is None:
            return None
        value, labels, i = got
        while i < len(tokens) and tokens[i] == "with":
            if i + 1 >= len(tokens) or tokens[i + 1] in ("or", "and", "with", "(", ")"):
                return None
            value, i = value if value in (0.0, licenses.UNKNOWN) else max(value, licenses.EXCEPTION), i + 2
        return value, labels, i

    def level(i, op):
        below = excepted if op == "and" else lambda j: level(j, "and")
        if (got := below(i)) is None:
            return None
        value, labels, i = got
        while i < len(tokens) and tokens[i] == op:
            if (got := below(i + 1)) is None:
                return None
            value, labels, i = (max if op == "or" else min)(value, got[0]), labels + got[1], got[2]
        return value, labels, i

    return got if (got := level(0, "or")) is not None and got[2] == len(tokens) else None


def test_parser_against_recursive_descent():
    rng = random.Random(3)
    ids = ["MIT", "GPL-2.0-only", "Apache-2.0", "CC-BY-NC-4.0", "LicenseRef-own", "LGPL-2.1+", "all-rights-reserved"]

    def made(depth):
        k = rng.random()
        if depth == 0 or k < 0.3:
            return [rng.choice(ids).lower()] + (["with", "classpath-exception-2.0"] if rng.random() < 0.3 else [])
        if k < 0.5:
            return ["(", *made(depth - 1), ")"]
        return [*made(depth - 1), rng.choice(["or", "and"]), *made(depth - 1)]

    for _ in range(2000):
        tokens = made(4)
        want, got = descent(tokens), licenses.parse(tokens)
        assert got.valid and (got.permission, got.labels) == (want[0], want[1])
        assert list(licenses.tokens(got.text, 0, len(got.text))) == tokens
    for _ in range(2000):
        tokens = [rng.choice([*ids, "or", "and", "with", "(", ")"]).lower() for _ in range(rng.randint(0, 6))]
        got = licenses.parse(tokens)
        if (want := descent(tokens)) is not None:
            assert got.valid and (got.permission, got.labels) == want[:2]
        elif got is not None and got.valid:  # what was read is an expression, and what follows can't go on with it
            read = list(licenses.tokens(got.text, 0, len(got.text)))
            assert read == tokens[: len(read)] and tokens[len(read)] not in ("or", "and", "with")


def test_all_documents_against_plain_search(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = op12_licenses(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        words = plain_words(texts[r.doc_id])
        base = plain_places(words, licenses.BASE)
        starts = [p[0] for p in base]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(words), len(base), min(starts, default=None), max(starts, default=None))
        assert r.base_labels == ",".join(sorted({p[2] for p in base}))
        every = [p for p in plain_places(words, licenses.BASE + licenses.NOTICES) if p[3] or not any(q != p and q[0] <= p[0] and p[1] <= q[1] for q in plain_places(words, licenses.BASE + licenses.NOTICES))]
        assert r.labels == ",".join(sorted({p[2] for p in every})) and 0 <= r.score <= 1
    assert sum(r.n_base > 0 for r in rows) > 10 and {"gpl-3", "all-rights-reserved"} <= {r.labels for r in rows}


def scanned(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = licenses.scan(df).select("doc_id", *licenses.digest(F.col("_licenses")))
    return [r for r in sorted(out.collect())]


def test_statements(spark):
    got = scanned(spark, [
        "// SPDX-License-Identifier: (MIT OR Apache-2.0) AND GPL-2.0-only WITH Classpath-exception-2.0 */\ncode",
        "Under either the MIT License or the Apache License, Version 2.0.",
        "Licensed under CC BY-NC-SA 4.0, cc-by-nc, CC BY NC",
        "GNU General Public License, version 3. All rights reserved.",
        "SPDX-License-Identifier: MIT OR\nSPDX-License-Identifier: (GPL-3.0+ AND SPDX-License-Identifier: )",
        "mit licensed apache license version 20 cc bync",
        "ſpdx K İ under the mit license\x00under\x85the mit license under the MIT license",
    ])
    assert got[0].expressions == "(mit or apache-2.0) and gpl-2.0-only with classpath-exception-2.0" and got[0].score == 0.7 and got[0].labels == "apache-2,gpl-2,mit" and got[0].n_base == 0
    assert got[1].expressions == "mit or apache-2" and got[1].score == 1.0
    assert got[2].n_base == 3 and got[2].base_labels == "cc-by-nc" and got[2].labels == "cc-by-nc,cc-by-nc-sa" and (got[2].first_word, got[2].last_word, got[2].score) == (2, 11, 0.2)
    assert got[3].labels == "all-rights-reserved,gpl-3" and got[3].score == 0.4
    assert got[4].n_malformed == 2 and got[4].labels == "gpl-3,mit" and got[4].score == 0.4
    assert got[5].labels == "" and got[5].score == 0 and got[5].n_words == 8
    assert got[6].n_base == 1 and got[6].first_word == 3


def test_odd_rows(spark):
    many = "under the mit license " * 200_000
    tags = "SPDX-License-Identifier: MIT AND ( " * 50_000
    got = scanned(spark, [None, "", " \t--", many, tags, "x" * 3_000_000])
    assert [(r.n_words, r.n_base, r.first_word, r.base_labels, r.labels, r.score) for r in got[:3]] == [(0, 0, None, "", "", 0.0)] * 3
    assert (got[3].n_words, got[3].n_base, got[3].first_word, got[3].last_word, got[3].score) == (800_000, 200_000, 0, 799_996, 1.0)
    assert got[4].n_malformed == 50_000 and got[4].labels == "mit" and got[5].n_words == 1
    schema = "doc_id long, text string, score double, `_Licenses` int, n_words string"
    rows = [(1, "under the MIT license", 5.0, 3, "x"), (1, "under the MIT license", 5.0, 3, "x"), (None, None, None, None, None)]
    out = licenses.scan(spark.createDataFrame(rows, schema))
    assert out.columns == ["doc_id", "text", "score", "n_words", "_licenses"]
    assert sorted((r.doc_id or 0, r.score or 0, r._licenses.score) for r in out.collect()) == [(0, 0, 0.0), (1, 5.0, 1.0), (1, 5.0, 1.0)]
    assert licenses.scan(spark.createDataFrame([], schema)).count() == 0
