"""Stems, ranks and snippets against a full-text engine that has them (SQLite's, of the standard library)."""

import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from pathlore.functions import stems
from pathlore.operators import search

#: Examples of the published rules.
PUBLISHED = """caresses caress ponies poni ties ti cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing conflated conflat troubled troubl sized size hopping hop
tanned tan falling fall hissing hiss fizzed fizz failing fail filing file happy happi sky sky relational relat conditional condit rational ration valenci valenc hesitanci hesit digitizer digit
conformabli conform radicalli radic differentli differ vileli vile analogousli analog vietnamization vietnam predication predic operator oper feudalism feudal decisiveness decis hopefulness hope
callousness callous formaliti formal sensitiviti sensit sensibiliti sensibl triplicate triplic formative form formalize formal electriciti electr electrical electr hopeful hope goodness good
revival reviv allowance allow inference infer airliner airlin gyroscopic gyroscop adjustable adjust defensible defens irritant irrit replacement replac adjustment adjust dependent depend
adoption adopt homologou homolog communism commun activate activ angulariti angular homologous homolog effective effect bowdlerize bowdler probate probat rate rate cease ceas controll control
roll roll yes ye y y by by yellow yellow ing ing""".split()


def test_published_stems(spark):
    pairs = list(zip(PUBLISHED[::2], PUBLISHED[1::2], strict=True))
    df = spark.createDataFrame(pairs, "word string, want string")
    wrong = [(r.word, r.got, r.want) for r in df.withColumn("got", stems.stem(F.col("word"))).collect() if r.got != r.want]
    assert wrong == []


@pytest.fixture(scope="module")
def engine():
    con = sqlite3.connect(":memory:")
    try:
        con.execute("CREATE VIRTUAL TABLE t USING fts5(content, tokenize='porter unicode61 remove_diacritics 0')")
    except sqlite3.OperationalError:
        pytest.skip("SQLite without full-text search")
    return con


def test_stems_against_an_engine(spark, engine):
    rng = random.Random(6)
    ends = [*stems.SECOND, *stems.THIRD, *stems.FOURTH, "s", "es", "sses", "ies", "ed", "ing", "eed", "y", "ion", "e", "ll", ""]
    words = sorted({"".join(rng.choices("abcdefghijklmnopqrstuvwxyz", weights=[6, 2, 2, 2, 8, 1, 1, 1, 6, 1, 1, 4, 2, 3, 6, 2, 1, 3, 3, 4, 4, 1, 1, 1, 4, 2], k=rng.randrange(1, 7))) + rng.choice(ends) for _ in range(3000)})
    engine.execute("DELETE FROM t")
    engine.executemany("INSERT INTO t(rowid, content) VALUES (?, ?)", list(enumerate(words, 1)))
    engine.execute("CREATE VIRTUAL TABLE IF NOT EXISTS v USING fts5vocab(t, instance)")
    want = {words[doc - 1]: term for term, doc in engine.execute("SELECT term, doc FROM v")}
    got = {r.word: r.stem for r in spark.createDataFrame([(w,) for w in words], "word string").select("word", stems.stem(F.col("word")).alias("stem")).collect()}
    assert {w: (got[w], want[w]) for w in words if got[w] != want[w]} == {}


def test_ranks_against_an_engine(spark, engine):
    rng = random.Random(7)
    vocab = ["open", "opens", "opening", "window", "windows", "close", "closed", "menu", "the", "the", "setting", "settings", "ünder"]
    docs = [(i, " ".join(rng.choices(vocab, k=rng.randrange(0, 60))) + rng.choice(["", ".", " OPEN!"])) for i in range(1, 80)] + [(80, None)]
    engine.execute("DELETE FROM t")
    engine.executemany("INSERT INTO t(rowid, content) VALUES (?, ?)", docs)
    df = spark.createDataFrame(docs, "id long, text string")
    queries = {1: ["open", "windows"], 2: ["closing"], 3: ["the", "menu", "settings"], 4: ["nothing"], 5: ["ünder"]}
    asked = spark.createDataFrame([(q, w) for q, ws in queries.items() for w in ws], "q int, word string").select("q", stems.stem(F.col("word")).alias("term")).distinct()
    tokens = search.search_tokens(F.col("text"))
    hits = search.token_hits(df, "id", tokens, search.stemmed_words(df, tokens, asked))
    got = {(r.q, r.id): r.score for r in search.ranked(hits, "id", asked, search.engine_idf).collect()}
    want = {(q, i): -score for q, ws in queries.items() for i, score in engine.execute("SELECT rowid, bm25(t) FROM t WHERE t MATCH ?", [" ".join(f'"{w}"' for w in ws)])}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want) and len(want) > 60


def test_snippets(spark):
    long = " ".join(["filler"] * 50 + ["alpha"] + ["x"] * 40 + ["Alpha", "beta,", "x", "BETA"] + ["y"] * 60 + ["beta", "alpha"] + ["z"] * 31)
    docs = [(1, long), (2, "beta only"), (3, None), (4, "alpha " * 5000)]
    df = spark.createDataFrame(docs, "id long, text string")
    asked = spark.createDataFrame([(1, "alpha"), (1, "beta")], "q int, term string")
    hits = search.token_hits(df, "id", search.search_tokens(F.col("text")), asked.select("term", F.col("term").alias("word")).distinct())
    assert search.collection(hits).first().n == 4
    found = search.ranked(hits, "id", asked, search.engine_idf, every=False)
    windows = search.best_windows(hits, "id", found, asked)
    rows = windows.join(df, "id").select("id", "start", search.snippet(search.shown(F.col("text")), F.col("start"), F.col("places")).alias("s")).collect()
    got = {r.id: (r.start, r.s) for r in rows}
    assert got[1] == (91, "...>>>Alpha<<< >>>beta<<< x >>>BETA<<< " + " ".join(["y"] * 28) + "...")
    assert got[2] == (0, ">>>beta<<< only") and got[4] == (0, " ".join([">>>alpha<<<"] * 32) + "...") and set(got) == {1, 2, 4}


def test_one_pass_over_the_texts(spark, tmp_path):
    df = spark.createDataFrame([(1, "a b a"), (2, ""), (3, "b")], "id long, text string")
    df.write.parquet(str(tmp_path / "d"))
    own = spark.read.parquet(str(tmp_path / "d"))
    hits = search.token_hits(own, "id", search.search_tokens(F.col("text")), spark.createDataFrame([("a", "a")], "word string, term string"))
    assert sorted((r.id, r.size, r.pos, r.term) for r in hits.where("term is not null").collect()) == [(1, 3, 0, "a"), (1, 3, 2, "a")]
    assert tuple(search.collection(hits).first()) == (3, 4 / 3)
    plan = search.ranked(hits, "id", spark.createDataFrame([(1, "a")], "q int, term string"))._jdf.queryExecution().executedPlan().toString()
    assert str(tmp_path / "d") not in plan


def test_each_distinct_word_is_stemmed_once(spark, monkeypatch):
    calls = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def plain(word):
        calls.add(1)
        return word.rstrip("s")

    monkeypatch.setattr(search, "stem", plain)
    docs = spark.createDataFrame([(i, "cats dogs cat " * 50) for i in range(20)], "id long, text string")
    terms = spark.createDataFrame([("cat",)], "term string")
    got = {tuple(r) for r in search.stemmed_words(docs, search.search_tokens(F.col("text")), terms).collect()}
    assert got == {("cats", "cat"), ("cat", "cat")} and calls.value == 3
