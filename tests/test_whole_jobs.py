"""Queries do the whole job: on tables of their own that tell a part of it from all."""

import duckdb
import pytest

from pathlore.plans import registry

registry.load()


@pytest.fixture
def parts(spark, tmp_path):
    """Parts of four names, of whose first keys none is divisible by 100."""
    rows = [(k, ["red bolt", "blue bolt", "bolt", "hot plate"][k % 4], f"Brand#{k % 3}", "t", k % 50, 1.0) for k in range(1, 200)]
    df = spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double")
    df.coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(1, "BUILDING")], "c_custkey long, c_mktsegment string").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    return str(tmp_path)


def by_sql(name, folder, *tables):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    return sorted(con.execute(registry.ORACLES[name]).fetchall())


def test_every_name_is_ranked_by_context(spark, parts):
    got = sorted(tuple(r) for r in registry.QUERIES["ranked_by_context"](spark, parts).collect())
    assert {r[0] for r in got} == {"red bolt", "blue bolt", "bolt", "hot plate"} and len(got) == 16
    assert got == by_sql("ranked_by_context", parts, "part")


def test_every_name_is_held_against_every_name(spark, parts):
    got = sorted(tuple(r) for r in registry.QUERIES["fuzzy_names"](spark, parts).collect())
    assert {r[0] for r in got} == {"red bolt", "blue bolt", "bolt", "hot plate", "building", "rd wdgt"} and len(got) == 24
    assert got == by_sql("fuzzy_names", parts, "part", "customer")


def test_positions_meet_once(spark, monkeypatch):
    """However many clicks and elements share positions, as many pairs meet as there are positions; ties go to the smallest key."""
    from pathlore.operators import screen

    pairs, within = [], screen.within

    def counted(*args):
        out = within(*args)
        pairs.append(out.count())
        return out

    monkeypatch.setattr(screen, "within", counted)
    clicks = spark.createDataFrame([(i, 10 * (i % 2), 0) for i in range(300)] + [(900, 500, 500), (901, None, 0)], "click long, x long, y long")
    places = spark.createDataFrame([(k, float(k % 3), 0.0) for k in range(1, 200)], "key long, px double, py double")
    near = {r.click: (r.key, r.distance) for r in screen.nearest(clicks, places, 20, "click", "key").collect()}
    assert near == {i: (2, 8.0) if i % 2 else (3, 0.0) for i in range(300)} and pairs == [6]
    counts = {r.click: (r.n, r.first) for r in screen.count_within(clicks, places, 20, "click", "key").collect()}
    assert counts == {i: (199, 1) for i in range(300)} and pairs == [6, 6]


def test_messages_of_one_text_are_scored_once(spark, tmp_path, monkeypatch):
    """No more rows than 16 for each message meet at the end, and they are what SQL gives, the session's own memory left out."""
    import datetime

    from pathlore.plans import learning_queries

    at = datetime.datetime(2024, 1, 1)
    rows = [(i, at + datetime.timedelta(minutes=i), i // 22 % 40, "click", 1.0, "{}") for i in range(6000)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    df.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    sizes, top = [], learning_queries.retrieval.top

    def counted(df, *args):
        sizes.append(df.count())
        return top(df, *args)

    monkeypatch.setattr(learning_queries.retrieval, "top", counted)
    got = sorted(tuple(r) for r in registry.QUERIES["predicted_memories"](spark, str(tmp_path)).collect())
    assert got == by_sql("predicted_memories", str(tmp_path), "events") and {r[0] for r in got} == set(range(0, 6000, 100))
    assert sizes[0] <= 16 * 60


def test_nearest_vectors_in_blocks(spark, monkeypatch):
    """As cosine and top tell them, with odd vectors and many ties, and with at most k rows for each query and block."""
    from pyspark.sql import functions as F

    from pathlore.operators import retrieval

    monkeypatch.setattr(retrieval, "VECTORS", 64)
    monkeypatch.setattr(retrieval, "QUERIES", 4)
    monkeypatch.setattr(retrieval, "AT_ONCE", 2)
    vectors = [[float((i * 7 + j * j) % 11 - 5) for j in range(6)] for i in range(200)] + [[1.0, 2.0, 3.0, 4.0, 5.0, 6.0]] * 60
    vectors += [None, [0.0] * 6, [1.0, None, 2.0, 3.0, 4.0, 5.0], [1.0, 2.0], [float("nan")] * 6, []]
    e = spark.createDataFrame(list(enumerate(vectors)), "id long, embedding array<float>")
    q = e.where("id % 20 = 0 or id > 258").select(F.col("id").alias("q"), F.col("embedding").alias("v"))
    want = retrieval.against_blocks(e, q, F.col("id") != F.col("q")).select("q", "id", F.round(retrieval.cosine(F.col("embedding"), F.col("v")), 9).alias("s"))
    near = retrieval.nearest_vectors(e, q, "id", 5)
    shown = lambda df: sorted(map(str, retrieval.top(df, "id", "s", 5).collect()))
    assert shown(near) == shown(want) and near.count() <= 5 * q.count() * 5
    assert retrieval.nearest_vectors(e.limit(0), q, "id", 5).count() == 0


def test_duplicates_are_compared_by_few_pairs(spark, monkeypatch):
    """As all pairs tell them; copies meet once, and texts that share rare words but are unlike aren't compared word by word."""
    from pathlore.operators import retrieval

    word = lambda i: f"word{i}"
    texts = {i: " ".join(word(i // 4 * 40 + j) for j in range(30 if i % 4 else 29)) for i in range(80)}
    texts |= {100 + i: "copies of one text that many rows have" for i in range(40)}
    texts |= {200 + i: " ".join([f"shared{i // 10}", *(f"own{i}x{j}" for j in range(30))]) for i in range(40)}
    d = spark.createDataFrame(list(texts.items()), "id long, text string")
    e, c = d.where("id % 2 = 0"), d.where("id % 2 = 1")
    sizes, written = [], retrieval.written

    def counted(df, name):
        out = written(df, name)
        sizes.extend([out.count()] * (name == "pairs"))
        return out

    monkeypatch.setattr(retrieval, "written", counted)
    got = {tuple(r) for r in retrieval.duplicates_above(e, c, "id", "text").collect()}
    want = {tuple(r) for r in retrieval.duplicates(e, c, "id", "text").where("similarity >= 0.9").collect()}
    assert got == want and len(got) == 60 and {r[1] for r in got if 100 <= r[0] < 200} == {100} and sizes[-1] <= 81


def test_near_copies_are_written_by_texts_and_blocks(spark, monkeypatch):
    """Near copies that are all like each other give few rows, in many blocks too; a text that is null counts as a document."""
    from pathlore.operators import retrieval

    monkeypatch.setattr(retrieval, "TEXTS", 32)
    monkeypatch.setattr(retrieval, "ROWS", 16)
    base = " ".join(f"base{j}" for j in range(150))
    texts = {i: f"{base} own{i}" for i in range(200)} | {200 + i: f"far{i} other{i % 7} more{i % 3}" for i in range(300)} | {500 + 2 * i: None for i in range(40)}
    d = spark.createDataFrame(list(texts.items()), "id long, text string")
    e, c = d.where("id % 2 = 0"), d.where("id % 2 = 1")
    sizes, written = [], retrieval.written

    def counted(df, name):
        out = written(df, name)
        sizes.extend([out.count()] * (name == "pairs"))
        return out

    monkeypatch.setattr(retrieval, "written", counted)
    for least in (0.5, 0.83):
        got = {tuple(r) for r in retrieval.duplicates_above(e, c, "id", "text", least).collect()}
        want = {tuple(r) for r in retrieval.duplicates(e, c, "id", "text").where(f"similarity >= {least}").collect()}
        assert got == want and {(i, 0) for i in range(1, 200, 2)} <= {r[:2] for r in got}
        assert sizes[-1] <= 100 * 15 + 300


def test_few_reflections_are_ranked(spark, tmp_path, monkeypatch):
    """Only rows that reach a query's least score are ranked, and they are what SQL gives, ties by key among them."""
    import datetime

    from pathlore.operators import retrieval

    at = datetime.datetime(2024, 1, 1)
    rows = [(i, at + datetime.timedelta(hours=i * 7919 % 6000 // 9), i % 40, ["click", "view", "error"][i % 3], float(i % 7 * 30 - 10), "{}") for i in range(6000)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    df.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    sizes, top = [], retrieval.top

    def counted(df, *args):
        sizes.append(df.count())
        return top(df, *args)

    monkeypatch.setattr(retrieval, "top", counted)
    got = sorted(tuple(r) for r in registry.QUERIES["reflection_search"](spark, str(tmp_path)).collect())
    assert got == by_sql("reflection_search", str(tmp_path), "events") and len(got) == 105
    assert sizes[0] <= 6000
