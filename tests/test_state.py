"""State that outlives a run: streams that are restarted, an index whose writer is killed, tasks admitted one after the other, a log of runs."""

import random

from pyspark.sql import functions as F

from pathlore.functions.registry import ToolRegistry
from pathlore.operators import memory, sequences
from pathlore.streaming import recovery, topics
from pathlore.streaming.index import IndexWriter

STEPS = "task long, ts long, id long, state string, picture long, acted boolean, expectation string, observed string, navigated boolean, given double, checkpoint boolean"


def fed(spark, df, parts, start, tmp_path):
    """Runs a stream over the parts' files, a file a trigger, with a restart before the last one; what it put out."""
    for n, part in enumerate(parts):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        if n >= len(parts) - 2:
            stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
            with recovery.with_store(spark):
                run = start(stream).writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out"))
                run.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(str(tmp_path / "out"))


def test_recovery_over_three_triggers_and_a_restart(spark, tmp_path):
    rng = random.Random(11)
    words = ["window", "open", "settings", "close", "menu", "no"]
    say = lambda: rng.choice([None, " ".join(rng.choices(words, k=3))])
    rows = [(t, i // 2, i, rng.choice(["a", "b", "c", "d", "e", None]), rng.choice([*range(9), None]), rng.random() < 0.8, say(), say(), rng.random() < 0.1, rng.choice([None] * 9 + [0.7, 2.0]), rng.random() < 0.05) for i in range(130) for t in (1, 2, 3)]
    df = spark.createDataFrame(rows, STEPS)
    parts = [df.where((F.col("id") >= a) & (F.col("id") < b)) for a, b in ((0, 41), (41, 90), (90, 130))]
    out = fed(spark, df, parts, recovery.monitored, tmp_path)
    got = {r.task: tuple(r) for r in recovery.latest(out).collect()}
    whole = sequences.flags(df.withColumn("idx", F.col("id")), "task", "state", "picture", F.col("acted"))
    whole = sequences.surprises(whole, "task", "expectation", F.col("observed"), F.col("navigated"), F.col("given"))
    want = {r.task: tuple(r) for r in sequences.recovery(whole, "task", F.col("checkpoint")).collect()}
    assert got == want and len({w[8] for w in want.values()} | {w[5] for w in want.values()}) > 1
    flags = sorted((r.task, r.idx, r.stagnation, r.loop_at or -1, r.loop_by or "") for r in out.collect())
    assert flags == sorted((r.task, r.idx, r.stagnation, r.loop_at or -1, r.loop_by or "") for r in whole.collect())


def test_a_missing_own_score_is_none(spark):
    df = spark.createDataFrame([(1, 0, 0, "a", None, True, None, None, False, None, False), (1, 1, 1, "b", None, True, None, None, False, 3.0, False)], STEPS).withColumn("idx", F.col("id"))
    out = sequences.surprises(sequences.flags(df, "task", "state"), "task", "expectation", F.col("observed"), F.col("navigated"), F.col("given")).orderBy("idx").collect()
    assert [(r.surprise, r.surprised) for r in out] == [(None, False), (1.0, True)]


def test_topics_with_late_rows_and_a_restart(spark, tmp_path):
    minute = 60_000
    rows = [
        # in order; the third message is older than the second but not late
        [("s", 0, 1, "Alpha beta42 the gamma"), ("s", 9 * minute, 2, "beta42 delta"), ("t", 0, 1, "x y z")],
        [("s", 5 * minute, 3, "gamma gamma"), ("u", 25 * minute, 1, " ".join(f"word{i:02}" for i in range(30)))],
        # the first of these is over ten minutes behind the watermark: dropped; the last opens a session, and ends those of s and t
        [("s", 1 * minute, 4, "dropped"), ("u", 26 * minute, 2, "word29 word00"), ("s", 31 * minute, 5, "again"), ("v", 45 * minute, 1, "last one")],
    ]
    schema = "session string, at long, id long, text string"
    ts = F.timestamp_millis(F.col("at") + 10**12)
    df = spark.createDataFrame([r for part in rows for r in part], schema).withColumn("ts", ts)
    parts = [spark.createDataFrame(part, schema).withColumn("ts", ts) for part in rows]
    out = fed(spark, df, parts, topics.ended_sessions, tmp_path).collect()
    own = sorted((r["rank"], r.topic, r.n, (r.seen - 10**12) // minute) for r in out if r.session == "s")
    assert own == [(1, "alpha", 1, 0), (2, "beta42", 2, 9), (3, "gamma", 3, 5), (4, "delta", 1, 9)]
    assert {(r.session, r.started, r.messages) for r in out} == {("s", 10**12, 3), ("t", 10**12, 1)}
    assert [(r.topic, r["rank"]) for r in out if r.session == "t"] == [(None, 0)]


def test_topics_keep_the_last_seen():
    rng = random.Random(2)
    for _ in range(50):
        known = {}
        seen, count, order = {}, {}, []
        for ms in range(12):
            message = [f"t{rng.randrange(40)}" for _ in range(rng.randrange(12))]
            known = topics.with_message(known, message, ms, 8)
            for t in message:
                if t not in seen:
                    order.append(t)
                    count[t] = 0
                seen[t], count[t] = ms, count[t] + 1
            if len(seen) > 8:
                order = sorted(order, key=lambda t: -seen[t])[:8]
                seen, count = {t: seen[t] for t in order}, {t: count[t] for t in order}
        assert list(known.items()) == [(t, [count[t], seen[t]]) for t in order]


class Killed(Exception):
    pass


class Dying(IndexWriter):
    """A writer that is killed before its n-th write, or in the middle of it."""

    left = 10**9
    half = False

    def _step(self, write):
        self.left -= 1
        if not self.left:
            if self.half:
                write()
            raise Killed
        write()

    def save(self, df, name):
        self._step(lambda: super(Dying, self).save(df, name))

    def put(self, spark, name, text, to):
        self._step(lambda: super(Dying, self).put(spark, name, text, to))

    def remove(self, spark, name):
        self._step(lambda: super(Dying, self).remove(spark, name))


BATCHES = [
    [("a", "alpha beta alpha"), ("b", "beta")],
    [("a", "gamma"), ("c", "delta delta")],
    [("b", None), ("d", "late one"), ("d", "zeta")],
    [("b", "back again"), ("c", None)],
]
NEWEST = {("a", "gamma", 1), ("d", "zeta", 1), ("b", "back", 1), ("b", "again", 1)}


def test_index_of_a_killed_writer(spark, tmp_path):
    """Killed before one of its writes or right after it, a new writer goes on with the batch and ends with the same index."""
    frames = [spark.createDataFrame(rows, "task string, text string") for rows in BATCHES]
    kill, killed = 1, True
    while killed:
        path, n, killed = str(tmp_path / f"i{kill}"), 0, False
        writer = Dying(path, adds=4, seconds=1e9)
        writer.left, writer.half = kill, kill % 2 == 0
        while n < len(frames):
            try:
                writer(frames[n], n)
                n += 1
            except Killed:
                killed, writer = True, IndexWriter(path, adds=4, seconds=1e9)
        assert {tuple(r) for r in writer.read(spark).collect()} == NEWEST, kill
        if kill % 6 == 1:
            fresh = IndexWriter(path)
            assert {tuple(r) for r in fresh.read(spark).collect()} == NEWEST
            fresh.rebuild(spark)
            assert {tuple(r) for r in IndexWriter(path).read(spark).collect()} == NEWEST
        kill += 1
    assert kill > 12


def test_index_takes_the_newest_text(spark, tmp_path):
    w = IndexWriter(str(tmp_path / "i"))
    w(spark.createDataFrame([("a", "zulu", 1), ("a", "alpha", 2), (None, "nobody", 1)], "task string, text string, at int"), 7)
    assert {tuple(r) for r in w.read(spark).collect()} == {("a", "alpha", 1)}
    w(spark.createDataFrame([("a", "older batch", 9)], "task string, text string, at int"), 6)
    assert w.read(spark).count() == 1


def plain_admission(rows, most, active):
    made, out = [], {}
    for k, creator, s, sig in sorted(rows, key=lambda r: (r[2], r[0])):
        if sum(m[0] == creator and m[1] > s - 3600 for m in made) >= most:
            out[k] = "rate_limit"
        elif len(made) >= active:
            out[k] = "full"
        elif sig in {m[2] for m in made}:
            out[k] = "deduplicated"
        else:
            made.append((creator, s, sig))
            out[k] = "created"
    return out


def admitted(spark, rows, **limits):
    df = spark.createDataFrame(rows, "id long, creator string, s long, sig string")
    return {r.id: r.outcome for r in memory.admitted(df, "creator", "s", "sig", "id", **limits).collect()}


def test_refused_tasks_free_the_hour(spark):
    rows = [(i, "u", i, f"s{i}") for i in range(100)] + [(200, "u", 3602, "s100"), (201, "u", 3603, "s60"), (202, "u", 3599, "s101"), (203, "u", 3600, "s102")]
    got = admitted(spark, rows)
    assert got == plain_admission(rows, 50, 200)
    assert [got[i] for i in (49, 50, 99, 200, 201, 202, 203)] == ["created", "rate_limit", "rate_limit", "created", "created", "rate_limit", "created"]


def test_admission_against_a_loop(spark):
    rng = random.Random(9)
    rows = [(i, rng.choice(["u", "v", None]), rng.randrange(20_000), f"s{rng.randrange(60)}") for i in range(400)]
    for most, active, step in ((3, 30, 1000), (5, 200, 7), (50, 10, 1000), (1, 1000, 50)):
        got = admitted(spark, rows, most=most, active=active, step=step)
        assert got == plain_admission(rows, most, active) and len(set(got.values())) >= 3
    assert admitted(spark, []) == {}


def test_reading_the_log_runs_no_tool(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def loud(x):
        calls.add(1)
        return x.upper() if x else None

    r = ToolRegistry(folder=str(tmp_path / "tools"))
    r.forge("loud", "loud", loud, {"t": "string"})
    r.forge("quiet", "quiet", F.lower, {"t": "string"})
    df = spark.createDataFrame([("x",), (None,), ("y",)], "t string").repartition(2)
    out = r.run(df, "loud", "t")
    r.run(df, "quiet", "t")
    before = calls.value
    assert before == 3 and sorted(x.result or "" for x in out.collect()) == ["", "X", "Y"]
    r.update("loud", F.upper)
    r.run(df.limit(1), "loud", "t")
    assert {tuple(x) for x in r.statistics(spark).select("tool", "version", "n").collect()} == {("loud", 1, 3), ("loud", 2, 1), ("quiet", 1, 3)}
    assert all(x.at > 0 and x.ms >= 0 for x in r.runs(spark).collect()) and calls.value == before
    r.delete("loud")
    assert {x.tool for x in r.runs(spark).collect()} == {"quiet"} and calls.value == before


def test_a_session_is_one_value():
    """A trigger reads and writes a session's state once, however many topics it has."""
    import pandas as pd

    calls, kept = [], []

    class Value:
        def get(self):
            calls.append("get")
            return kept[-1] if kept else None

        def update(self, value):
            calls.append("update")
            kept.append(value)

    class Handle:
        def getValueState(self, *_):
            return Value()

        def registerTimer(self, ms):
            calls.append("timer")

    own = topics.SessionTopics()
    own.init(Handle())
    rows = pd.DataFrame({"ms": [0, 1], "id": [1, 2], "terms": [[f"word{i}" for i in range(15)], ["word3", "last"]]})
    assert [len(x) for x in own.handleInputRows((7,), iter([rows]), None)] == [0] and sorted(calls) == ["get", "timer", "update"]
    later = pd.DataFrame({"ms": [5], "id": [3], "terms": [["last"]]})
    list(own.handleInputRows((7,), iter([later]), None))
    started, messages, names, n, seen = kept[-1]
    assert (started, messages, len(names)) == (0, 3, 16) and n[names.index("word3")] == 2 and n[names.index("last")] == 2 and seen[names.index("last")] == 5
