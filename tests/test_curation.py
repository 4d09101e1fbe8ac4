import random

from pyspark.sql import functions as F

from pathlore.functions import lessons as ls
from pathlore.operators import curation, retrieval


def texts(rng, n):
    words = ["common", "often", "usual"] + [f"rare{i}" for i in range(60)]
    return [" ".join(rng.choices(words, weights=[20, 15, 10] + [1] * 60, k=rng.randrange(0, 14))) for _ in range(n)]


def test_duplicates_above_equal_the_whole_search(spark):
    rng = random.Random(3)
    old = list(enumerate(texts(rng, 80)))
    new = [(100 + i, t) for i, t in enumerate([*texts(rng, 30), *[t for _, t in old[:15]], *[t + " more" for _, t in old[15:30]], None, "", "unseen words"])]
    a, b = (spark.createDataFrame(rows, "id long, text string") for rows in (old, new))
    for least in (0.5, 0.9):
        got = {tuple(r) for r in retrieval.duplicates_above(a, b, "id", "text", least).collect()}
        want = {tuple(r) for r in retrieval.duplicates(a, b, "id", "text").where(F.col("similarity") >= least).collect()}
        assert got == want and want
    assert retrieval.duplicates_above(a.limit(0), b, "id", "text").count() == 0


def test_ingest(spark):
    old = spark.createDataFrame([(1, "press the first button before the menu opens"), (2, "wait until the window has closed")], "id long, text string")
    rows = [
        (10, "real", True, "press the first button before the menu opens"),
        (11, "made up", True, "something else entirely"),
        (12, None, True, "something else entirely"),
        (13, "her", False, "wait until the window has closed"),
        (14, "her", True, "something else entirely"),
        (15, "webrl", True, "something else entirely"),
        (16, "real", None, "x"),
        (17, "real", True, None),
    ]
    new = spark.createDataFrame(rows, "id long, source string, good boolean, text string")
    got = {r.id: (r.disposition, r.match) for r in curation.ingest(old, new).collect()}
    assert got == {10: ("duplicate", 1), 11: ("source", None), 12: ("source", None), 13: ("quality", None), 14: ("accepted", None), 15: ("accepted", None), 16: ("quality", None), 17: ("accepted", None)}
    after = curation.stored(old, new.where("id in (14, 15)").select("id", "text"), 3, F.desc("id")).collect()
    assert [r.id for r in after] == [15, 14, 2]


def test_quality_of_distinct_lessons(spark):
    rows = [(1, ["Click the first button before you press enter"], "success", [], ["y"]), (2, None, None, None, None), (3, [], "failure", ["x"], None), (4, ["Click the first button before you press enter"], "success", [], ["z"]), (5, [None, "avoid errors"], "failure", None, [])]
    df = spark.createDataFrame(rows, "id long, lessons array<string>, outcome string, failures array<string>, strategies array<string>")
    got = {r.id: r.quality for r in curation.with_quality(df).collect()}
    want = {r.id: r.q for r in df.select("id", ls.quality(F.col("lessons"), F.col("outcome"), F.col("failures"), F.col("strategies")).alias("q")).collect()}
    assert got == want and len(got) == 5
