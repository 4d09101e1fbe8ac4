import random
import re
import unicodedata

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pathlore.llm import quality
from pathlore.llm.queries import op3_quality

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    ws = WORD.findall(text)
    places = {}
    for i in range(len(ws) - 7):
        places.setdefault(tuple(ws[i : i + 8]), []).append(i)
    cover = {j for p in places.values() if len(p) > 1 for i in p for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(cover)


def test_whole_table(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = op3_quality(spark, SF).collect()
    assert {r.doc_id: tuple(r[1:6]) for r in rows} == {d: brute(t) for d, t in docs.items()}
    for r in rows:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.kept and r.base_failed) and (r.base_failed or r.kept == (r.probability >= 0.5))
    good = [r.kept for r in rows if label.get(r.doc_id) == 1 and not r.base_failed]
    bad = [r.kept for r in rows if label.get(r.doc_id) == 0]
    assert sum(good) / len(good) > 0.99 and sum(bad) / len(bad) < 0.1


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from(["a", "b", "\n", "é#", "\t", "\x1c"]), max_size=60).map(" ".join), min_size=20, max_size=40))
def test_figures_of_random_texts(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = {r.i: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality.judged(df, quality.estimate([], len(quality.RULES))).select("i", "_quality.*").collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts)}


def test_edges(spark):
    long = " ".join("w" + "".join(chr(97 + i // 26**k % 26) for k in range(4)) for i in range(100_000))
    rows = [(None, None, True), (1, "", True), (1, "", True), (2, "a " * 5000, True), (3, long, False)]
    out = quality.judged(spark.createDataFrame(rows, "doc_id long, text string, kept boolean"), quality.estimate([], len(quality.RULES))).select("doc_id", "kept", "_quality.n_words", "_quality.base_failed", F.col("_quality.kept").alias("k"))
    assert sorted((r.doc_id or 0, r.n_words, r.base_failed, r.k) for r in out.collect()) == [(0, 0, True, False), (1, 0, True, False), (1, 0, True, False), (2, 5000, True, False), (3, 100_000, False, True)]
    assert quality.keep_good(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_estimates_accuracies():
    rng, counts, true = random.Random(1), {}, [0.95, 0.9, 0.7, 0.85]
    for _ in range(20000):
        good = rng.random() < 0.85
        pattern = tuple((1 if (rng.random() < a) == good else -1) if rng.random() < 0.8 else 0 for a in true)
        counts[pattern] = counts.get(pattern, 0) + 1
    prior, (good, bad) = quality.estimate(sorted(counts.items()), 4)
    assert prior == pytest.approx(0.85, abs=0.03)
    for a, g, b in zip(true, good, bad, strict=True):
        assert g[2] / (g[0] + g[2]) == pytest.approx(a, abs=0.04) and b[0] / (b[0] + b[2]) == pytest.approx(a, abs=0.07)


def plain_votes(text):
    """The eight votes of a text by plain counts over its characters."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    if not words:
        return (0,) * 8
    chars, n = "".join(words), len(words)
    letters, upper = sum(c.isalpha() for c in chars), sum(unicodedata.category(c) == "Lu" for c in chars)
    digits = sum(unicodedata.category(c) in ("Nd", "Nl", "No") for c in chars)

    def vote(value, good, bad):
        worse, better = (value >= bad, value <= good) if bad > good else (value <= bad, value >= good)
        return -1 if worse else 1 if better else 0

    length = -1 if len(chars) < 2 * n or len(chars) > 15 * n else 1 if 3 * n <= len(chars) <= 11 * n else 0
    wordless = sum(not any(c.isalpha() for c in w) for w in words)
    shares = [(sum(c in "#*$%&|<>" for c in chars) / n, 0.02, 0.1), (letters / len(chars), 0.85, 0.7), (upper / max(letters, 1), 0.2, 0.5), (chars.count("!") / n, 0.05, 0.25), (digits / len(chars), 0.1, 0.3), (sum(c in "{}=;" for c in chars) / n, 0.02, 0.2), (wordless / n, 0.05, 0.25)]
    return (length, *(vote(*s) for s in shares))


def test_posteriors_against_a_plain_estimation(spark):
    """Votes, expectation-maximisation and verdicts of the smallest table again, in plain Python over the rows."""
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    votes = {d: plain_votes(t) for d, t in docs.items()}
    start = (0.9, [(0.01, 0.09, 0.9), (0.4, 0.2, 0.4)])
    prior, table = start[0], [[start[1][y]] * 8 for y in (0, 1)]

    def chance(v):
        good, bad = prior, 1 - prior
        for i, x in enumerate(v):
            good, bad = good * table[0][i][x + 1], bad * table[1][i][x + 1]
        return good / (good + bad)

    for _ in range(200):
        p = {d: chance(v) for d, v in votes.items()}
        sums = [[[10.0 * c for c in start[1][y]] for _ in range(8)] for y in (0, 1)]
        for d, v in votes.items():
            for i, x in enumerate(v):
                sums[0][i][x + 1] += p[d]
                sums[1][i][x + 1] += 1 - p[d]
        before, table = table, [[tuple(c / sum(r) for c in r) for r in of] for of in sums]
        prior = min(0.99, max(0.5, (10 * start[0] + sum(p.values())) / (10 + len(p))))
        if max(abs(a - b) for y in (0, 1) for r, s in zip(table[y], before[y], strict=True) for a, b in zip(r, s, strict=True)) < 1e-9:
            break
    for r in op3_quality(spark, "/root/testdata/sf0.001").collect():
        p = chance(votes[r.doc_id])
        assert abs(r.probability - p) < 1e-6 and r.kept == (not r.base_failed and r.probability >= 0.5)


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a b", 5, "q")], "doc_id long, text string, _facts int, _quality string")
    out = quality.judged(df, quality.estimate([], len(quality.RULES)))
    assert out.columns == ["doc_id", "_facts", "_quality"] and out.first()._facts == 5 and out.first()._quality.n_words == 2
    assert [tuple(r) for r in quality.keep_good(df).collect()] == []
