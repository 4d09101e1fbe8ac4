import random
import re

import pytest
from pyspark.sql import functions as F

from pathlore.sources import store
from pathlore.streaming import logs


@pytest.fixture
def own(spark, tmp_path):
    s = store.Store(spark, "own_store", str(tmp_path / "db"), buckets=8)
    yield s
    s.drop()


def test_one_bucket_is_read(spark, own):
    rows = spark.createDataFrame([(f"t{i}", i, None) for i in range(200)], "taskId string, duration long, finalText string")
    own.append("runs", rows)
    own.append("runs", rows.where("duration < 3").withColumn("success", F.lit(True)))
    got = own.of("runs", "t2")
    assert {(r.duration, r.success) for r in got.collect()} == {(2, None), (2, True)} and got.count() == 2
    settings = {"spark.sql.sources.bucketing.autoBucketedScan.enabled": "false", "spark.sql.maxMetadataStringLength": "10000"}
    for name, value in settings.items():
        spark.conf.set(name, value)  # the plan tells of buckets only then; they are pruned all the same
    plan = own.of("runs", "t2")._jdf.queryExecution().executedPlan().toString()
    for name in settings:
        spark.conf.unset(name)
    assert re.search(r"SelectedBucketsCount: 1 out of 8", plan)
    # what is grouped by the key needs no shuffle
    plan = own.table("runs").groupBy("taskId").count()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_schemas_are_pinned_and_rows_stay(spark, own, tmp_path):
    own.append("messages", spark.createDataFrame([("hello", 7, 1)], "text string, session int, turn int"))
    again = store.Store(spark, "own_store", str(tmp_path / "db"))
    assert [tuple(r) for r in again.table("messages").collect()] == [(7, 1, None, "hello")]
    with pytest.raises(ValueError):
        own.append("messages", spark.createDataFrame([(1, "x")], "session long, other string"))
    assert own.table("messages").count() == 1 and own.table("memories").count() == 0
    assert own.of("messages", 8).count() == 0


def plain_changes(parts):
    out, before = [], {}
    for log, place, text in sorted(parts):
        if found := re.findall(r"https?://[^\s\x22<>']+", text):
            if before.get(log) != found[-1]:
                out.append((log, place, found[-1]))
            before[log] = found[-1]
    return sorted(out)


def test_watched_files_written_in_parts(spark, tmp_path):
    rng = random.Random(1)
    urls = ["https://a.org/x", "http://b.org", "https://c.org/?q=1"]
    parts = [(log, n, "\n".join(rng.choice(["noise", "up at " + rng.choice(urls), "<" + rng.choice(urls) + "> é"]) for _ in range(rng.randrange(0, 4)))) for n in range(8) for log in ("tunnel", "other")]
    (tmp_path / "in").mkdir()
    stream = logs.changes(logs.read_parts(spark, str(tmp_path / "in")))
    for upto in (3, 8):
        for log, n, text in parts:
            if upto - 5 <= n < upto and not (tmp_path / "in" / f"{log}.{n:03}.log").exists():
                (tmp_path / "in" / f"{log}.{n:03}.log").write_text(text)
        (tmp_path / "in" / "notes.txt").write_text("https://not.a/part")
        run = stream.writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state"))
        run.trigger(availableNow=True).start().awaitTermination()
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("log", "place", "found").collect())
    assert got == plain_changes(parts) and len(got) > 4


def test_vectors_follow_the_store(spark):
    from pathlore.operators.vectors import hashed
    from pathlore.sources import memories

    rows = lambda *r: spark.createDataFrame(r, "id string, content string")
    first = memories.with_vectors(rows(("a", "alpha beta"), ("b", "beta gamma"), ("c", ""), ("d", "gone away")))
    marked = first.withColumn("value", F.col("value") + 5)  # so that kept vectors are told from new ones
    store = rows(("a", "alpha beta"), ("b", "changed text"), ("c", "now here"), ("e", "alpha beta"))
    got = {(r.id, r.place): r.value for r in memories.with_vectors(store, marked).collect()}
    want = {(r.id, r.place): r.value + (5 if r.id == "a" else 0) for r in hashed(store, "id", "content").collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want) and {k[0] for k in got} == {"a", "b", "c", "e"}


def test_texts_are_dealt_once(spark):
    """However many sums a vector takes, only the texts pass from task to task."""
    from pathlore.operators.vectors import hashed

    docs = spark.createDataFrame([(i, f"alpha beta{i} beta{i}") for i in range(9)], "id long, content string")
    plan = hashed(docs, "id", "content")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    made = hashed(docs, "id", "content").groupBy("id").agg(F.sum(F.col("value") * F.col("value")).alias("s")).collect()
    assert len(made) == 9 and all(abs(r.s - 1) < 1e-9 for r in made)
