import hashlib
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from pathlore.llm import substring
from pathlore.llm.queries import op7_substring

SF = "/root/testdata/sf0.001"


def brute(docs, window=20):
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in docs}
    first, out = {}, {}
    for i in sorted(words):
        for s in range(len(words[i]) - window + 1):
            first.setdefault(tuple(words[i][s : s + window]), (i, s))
    for i, ws in words.items():
        gone = set()
        for s in range(len(ws) - window + 1):
            if first[tuple(ws[s : s + window])] != (i, s):
                gone |= set(range(s, s + window))
        out[i] = (len(ws), len(gone), " ".join(w for k, w in enumerate(ws) if k not in gone))
    return out


def test_whole_table(spark):
    want = brute([(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()])
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in op7_substring(spark, SF).collect()}
    assert got == {i: (n, g, hashlib.sha256(t.encode()).hexdigest()) for i, (n, g, t) in want.items()}
    assert sum(g for _, g, _ in got.values()) > 0


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from(["a", "b", "é"]), max_size=30).map(" ".join), min_size=1, max_size=6))
def test_small_alphabet(spark, texts):
    rows = list(enumerate(texts))
    want = brute(rows, 4)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()}
    assert got == want


def test_edges(spark):
    long = " ".join(f"w{i}" for i in range(30))
    rows = [(5, long, "x"), (None, long, "y"), (7, None, None), (8, " \n", "z"), (9, "w", "z"), (5, long, "x"), (6, "x " * 50 + "y" * 100_000, "q")]
    got = sorted((r.doc_id or -1, r.n_words, r.n_removed) for r in substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string, id string")).collect())
    assert got == [(-1, 30, 0), (5, 30, 30), (5, 30, 30), (6, 51, brute([(6, "x " * 50 + "y")])[6][1]), (7, 0, 0), (8, 0, 0), (9, 1, 0)]
    assert substring.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_more_levels_and_small_batches(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = {i: v for i, v in brute([(r.doc_id, r.text) for r in docs.collect()]).items()}
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(name)
    for least, rows in ((5, old), (10, "3")):
        spark.conf.set(name, rows)
        try:
            got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in substring.remove_repeats(docs, 20, least).collect()}
        finally:
            spark.conf.set(name, old)
        assert got == want


def test_levels():
    assert substring.levels(20, 5) == [5, 10] and substring.levels(20, 10) == [10] and substring.levels(16, 1) == [1, 2, 4, 8]
    with pytest.raises(ValueError):
        substring.levels(20, 3)


def test_no_survivors_end_the_search(spark):
    df = spark.createDataFrame([(i, " ".join(f"w{i}_{j}" for j in range(40))) for i in range(5)], "doc_id long, text string")
    assert {r.n_removed for r in substring.remove_repeats(df, 20, 5).collect()} == {0}
