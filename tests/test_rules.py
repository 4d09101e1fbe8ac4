"""Bounds, ties, nulls and empty inputs of operators that a table's rows may not reach."""

import datetime
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pathlore.functions import device, lessons, parsers, scalar, text, variables
from pathlore.functions.registry import MOST_TOOLS, ToolRegistry, tool_name
from pathlore.operators import coverage, evidence, memory, relabel, retrieval, screen, selection, sequences, vectors
from pathlore.sources import files, memories, runs
from pathlore.streaming import steps as stream_steps
from pathlore.streaming.index import IndexWriter


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def lits(*values):
    return [F.lit(v) for v in values]


def test_lessons_at_their_bounds(spark):
    few = F.array(*lits("one two three four"))
    five, thirteen = F.array(*lits("one two three four five")), F.array(F.lit(" ".join(["w"] * 13)))
    none = F.array().cast("array<string>")
    got = one(spark, lessons.novelty(few), lessons.novelty(five), lessons.novelty(thirteen), lessons.novelty(none), lessons.specificity(F.lit(None).cast("array<string>")))
    assert [round(x, 6) for x in got] == [0.3, 0.5, 0.6, 0, 0]
    # a mean of .6 passes; "é" is no word character beside a boundary
    q = lessons.quality(F.array(F.lit("Click the first button before you press enter")), F.lit("success"), none, F.array(F.lit("y")))
    assert one(spark, q.quality)[0] >= 0.6 and one(spark, q.is_valid)[0]
    assert one(spark, lessons.matches(F.lit("éclick now"), r"\bclick\b"), lessons.matches(F.lit("clicks"), r"\bclick\b"), lessons.matches(F.lit("CLICK"), r"\bclick\b")) == (True, False, True)


def test_types_difficulty_and_costs(spark):
    assert one(spark, lessons.request_type(F.lit(None).cast("string")), lessons.request_type(F.lit("see the apps on screen")), lessons.demo_type(F.lit("")), lessons.goal_type(F.lit("press the button"))) == ("general", "vision", "general_interaction", "ui_interaction")
    hard = F.lit("if all exact nested menu items in the center or else retry then next")
    assert one(spark, F.round(lessons.difficulty(F.lit(None).cast("string")), 6), lessons.difficulty(hard) <= 1.0) == (0.3, True)
    mode = lambda *x: one(spark, lessons.failure_mode(*lits(*x)))[0]
    assert [mode("failure", 1, 1, 30), mode("failure", 0, 1, 30), mode("failure", 0, 0, 21), mode("failure", 0, 0, 20), mode("success", 1, 1, 1)] == ["loop", "stagnation", "complexity", "execution_error", "unknown"]
    dear = lambda kind, cost: one(spark, F.exists(lessons.rule_lessons(F.lit(kind), F.lit("success"), F.lit(5), F.lit(cost), F.array(F.lit("a")), F.lit(None).cast("string")), lambda x: x.startswith("High cost")))[0]
    assert not dear("vision", 1.5) and dear("vision", 1.51) and not dear("other", 0.2) and dear("other", 0.21)
    # a count of 0 is an unknown one: it isn't few
    zero = lessons.rule_lessons(F.lit("x"), F.lit("success"), F.lit(0), F.lit(0.0), F.array(F.lit("a")), F.lit(None).cast("string"))
    assert one(spark, F.size(zero)) == (0,)


def test_steps_beyond_the_cap_and_at_distances(spark):
    def flags(rows):
        df = spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], "task int, idx long, state string, picture string, acted boolean")
        out = sequences.flags(df, "task", "state", "picture", F.col("acted")).orderBy("idx").collect()
        return [(r.stagnation, r.loop_at, r.loop_by) for r in out]

    a, b, c = ("a", None, True), ("b", None, True), ("c", None, True)
    assert flags([a, a]) == [(False, None, None), (True, None, None)]  # at distance 1 it is no loop
    assert flags([a, b, a])[-1] == (False, 0, "exact")
    assert flags([a, ("a", None, False)])[-1] == (False, None, None)  # nothing was done
    assert flags([("a", "p", True), b, ("c", "p", True)])[-1] == (False, 0, "perceptual")
    assert flags([a, b, (None, None, True), c, (None, None, True)])[-1] == (False, None, None)
    rows = [(f"s{i}", None, True) for i in range(100)]
    rows[39] = rows[90] = ("same", None, True)
    assert flags(rows)[90][1] is None  # 51 back, the cap is 50
    rows[40] = ("same", None, True)
    assert flags(rows)[90][1] == 40


def test_surprise_counts_parts_as_half(spark):
    s = lambda e, o: one(spark, sequences.surprise(F.array(*lits(*e)) if e else F.array().cast("array<string>"), F.array(*lits(*o))))[0]
    assert s(["login", "page"], ["login", "page"]) == 0 and s(["login", "page"], ["pages", "x"]) == 0.75 and s([], ["x"]) is None and s(["a"], ["zz"]) == 1
    rows = [(1, 0, "expect a dialog here", "x"), (1, 1, None, "nothing of it"), (1, 2, None, "y"), (2, 0, "some login", "x"), (2, 1, None, "login")]
    df = spark.createDataFrame(rows, "task int, idx long, expectation string, seen string").withColumn("loop_at", F.lit(None).cast("long")).withColumn("stagnation", F.lit(False))
    got = {(r.task, r.idx): (r.surprise, r.surprised) for r in sequences.surprises(df, "task", "expectation", F.col("seen")).collect()}
    assert got[1, 1] == (1, True) and got[1, 0] == (None, False) and got[2, 1] == (None, False)  # a task's last step is open


def test_recovery_levels(spark):
    def level(issues, checkpoint=None):
        df = spark.createDataFrame([(1, i, x) for i, x in enumerate(issues)], "task int, idx long, stagnation boolean").withColumn("loop_at", F.lit(None).cast("long"))
        return sequences.recovery(df, "task", None if checkpoint is None else F.col("idx") == checkpoint).first()

    assert level([False] * 9).recovery_level == 0
    assert level([True] * 9).recovery_level == 3 and level([True] * 9, 8).issue_run == 0
    assert level([False] * 20 + [True]).recovery_level == 1


def test_bisection():
    for first in range(1, 41):
        found, probes, sure = sequences.bisect_probes(0, 40, lambda i, f=first: i >= f)
        assert (found, sure) == (first, "high") and len(probes) <= 8
    assert sequences.bisect_probes(3, 4, lambda i: True) == (3, [3], "low") and sequences.bisect_probes(3, 4, lambda i: False) == (None, [3, 4], "none")
    with pytest.raises(ValueError):
        sequences.bisect_probes(4, 4, lambda i: True)


def test_coverage_bounds(spark):
    df = spark.createDataFrame([("a",)] * 5 + [("b",)] * 4 + [(None,)], "kind string")
    assert {tuple(r) for r in coverage.gaps(df, "kind").collect()} == {("b", 4, 1), ("unknown", 1, 4)}
    r = coverage.report(df, "kind").first()
    assert r.converged == 1 and r.top == ["a", "b", "unknown"] and r.gaps == ["unknown", "b"]
    assert coverage.report(df.limit(0), "kind").first().total == 0


@pytest.mark.parametrize("values", [[], [5], [1, 2], [3, 3, 3, 9], list(range(-50, 51)), [0, 10**15, 10**15 + 1], [random.Random(1).randrange(-(10**12), 10**12) for _ in range(501)]])
def test_exact_median(spark, values):
    want = None if not values else float(np.median(np.array(values)))
    assert selection.median(spark.createDataFrame([(v,) for v in values], "v long"), "v").first()[0] == want


def test_screen_at_its_radii(spark):
    p = spark.createDataFrame([(1, 0, 0), (2, 500, 500)], "click long, x long, y long")
    e = spark.createDataFrame([(1, 50.0, 0.0), (2, 0.0, -50.0), (3, -50.001, 0.0), (4, 500.0, 540.0)], "key long, px double, py double")
    near = {r.click: (r.key, r.distance) for r in screen.nearest(p, e, 50, "click", "key").collect()}
    assert near == {1: (1, 50), 2: (4, 40)}
    verdict = lambda far, hits, terms: one(spark, screen.step_verdict(F.lit(float(far)), F.lit(hits).cast("int"), F.lit(terms).cast("int")))[0]
    assert [verdict(80, None, None), verdict(80.1, 9, 9), verdict(40, None, None), verdict(40.1, None, None), verdict(1, 1, 2), verdict(1, 1, 3), verdict(1, 0, 0)] == ["partial", "incorrect", "correct", "partial", "correct", "incorrect", "incorrect"]
    sure = lambda d, label, actions: round(one(spark, screen.confidence(F.lit(d).cast("double"), F.lit(label).cast("string"), F.array(*lits(*actions))))[0], 6)
    assert [sure(4.9, "x", ["AXPress"]), sure(5, "", ["a"]), sure(15, None, ["a"]), sure(30, None, ["a"]), sure(None, None, ["a"])] == [1, 0.8, 0.65, 0.55, 0.5]


def test_patterns_merge_in_order(spark):
    rows = [(1, "t", "alpha -> beta -> gamma", "success", 2, 1.0), (2, "t", "alpha -> beta", "failure", 4, 3.0), (3, "t", "beta -> gamma", "success", 1, 0.0), (4, "u", "alpha -> beta", "success", 1, 0.0), (5, "t", "", "success", 1, 0.0), (6, "t", "zeta", "success", 9, 9.0)]
    df = spark.createDataFrame(rows, "id long, kind string, sig string, outcome string, iterations long, cost double")
    got = {(r.kind, r.pattern): (r.occurrences, round(r.success_rate, 6), r.iterations) for r in evidence.merged(df, "kind", "sig", "id").collect()}
    assert got == {("t", "alpha -> beta -> gamma"): (3, 0.666667, 7 / 3), ("u", "alpha -> beta"): (1, 1, 1), ("t", "zeta"): (1, 1, 9)}
    assert evidence.merged(df.limit(0), "kind", "sig", "id").count() == 0
    many = spark.createDataFrame([("a", i % 50, i) for i in range(500)], "k string, s int, i int")
    assert [r.i for r in evidence.top_per_group(many, ["k"], [F.col("s").desc(), F.col("i")], 3).orderBy("i").collect()] == [49, 99, 149]


def test_duplicates_against_plain_vectors(spark):
    rng, words = random.Random(2), ["one", "two", "three", "four", "five", "sixth"]
    texts = {i: " ".join(rng.choices(words, k=rng.randrange(0, 7))) for i in range(16)}
    old, new = {i: t for i, t in texts.items() if i < 9}, {i: t for i, t in texts.items() if i >= 9}

    def brute(c):
        docs = [t.split() for t in old.values()] + [c.split()]
        df = {w: sum(w in d for d in docs) for w in words}
        vec = lambda d: {w: d.count(w) / len(d) * math.log(len(docs) / df[w]) for w in set(d)} if d else {}
        a, best = vec(docs[-1]), 0
        for d in docs[:-1]:
            b = vec(d)
            na, nb = (math.sqrt(sum(x * x for x in v.values())) for v in (a, b))
            best = max(best, sum(a[w] * b.get(w, 0) for w in a) / (na * nb) if na and nb else 0)
        return best

    df = spark.createDataFrame(sorted(texts.items()), "i long, text string")
    got = {r.i: r.similarity for r in retrieval.duplicates(df.where("i < 9"), df.where("i >= 9"), "i", "text").collect()}
    for i, t in new.items():
        assert abs(got.get(i, 0) - brute(t)) < 1e-6


def test_queries_in_blocks(spark):
    rows, q = spark.range(20).withColumnRenamed("id", "a"), spark.range(7).withColumnRenamed("id", "b")
    got = sorted(map(tuple, retrieval.against_blocks(rows, q, F.col("a") % 7 == F.col("b"), block=2).collect()))
    assert got == sorted((a, a % 7) for a in range(20))


def test_fuzzy_names(spark):
    f = lambda q, t: round(one(spark, text.fuzzy(F.lit(q).cast("string"), F.lit(t).cast("string")))[0], 6)
    assert [f("red", "a red ring"), f("red xx", "a red ring"), f("rn", "ring x"), f("xq", "ring"), f("", "x"), f(None, "x")] == [1, 0.7, 0.1, 0.05, 0, 0]


def test_layouts_that_do_not_fit(spark):
    n = lambda kind, count: one(spark, F.size(parsers.layout(F.lit(kind), F.lit(count), F.lit(100.0), F.lit(90.0))))[0]
    assert [n("split-left", 1), n("split-left", 4), n("stack", 3), n("thirds", 3)] == [1, 4, 3, 3] and one(spark, parsers.layout(F.lit("quarters"), F.lit(3), F.lit(1.0), F.lit(1.0)), parsers.layout(F.lit("x"), F.lit(3), F.lit(1.0), F.lit(1.0))) == (None, None)


def test_scalars_of_nulls_and_zeros(spark):
    assert one(spark, scalar.clip(F.lit(None).cast("string")), scalar.composite(F.lit(None).cast("int"), F.lit(float("nan")), F.lit(None).cast("int"))) == ("", 0.35)
    assert one(spark, device.iterations(F.lit(0.0)), device.iterations(F.lit(0.4)), device.iterations(F.lit(0.7))) == (8, 8, 18)
    assert one(spark, parsers.next_run(F.lit("interval"), F.lit(None).cast("long"), F.lit(0), F.lit(100)), memory.importance(F.lit(0.0), F.lit(0), F.lit(0))) == (160, 0)
    assert one(spark, device.replay_delay(F.lit(50.0), F.lit(1)), device.replay_delay(F.lit(99_999.0), F.lit(2))) == (100, 5000)


def test_documents_that_are_missing_or_broken(spark, tmp_path):
    assert runs.read_runs(spark, str(tmp_path / "none")).count() == 0
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "1.json").write_text('{"taskId": "x",\n "nodes": [{"id": "n0", "index": 0, "flags": ["loop"], "action": {"raw": "go"}}], "branches": [{"status": "failed"}], "startTime": 5, "extra": 1}')
    (tmp_path / "a" / "2.json").write_text("{ no document")
    (tmp_path / "a" / "3.json").write_text('[{"taskId": "y", "startTime": 9}, {"taskId": "z", "startTime": 9}]')
    docs = files.read_documents(spark, str(tmp_path / "a"), runs.RUN)
    assert files.broken(docs).count() == 1
    own = runs.read_runs(spark, str(tmp_path / "a"))
    assert [(r.taskId, r.branches, r.failedBranches, r.surprisesDetected) for r in runs.summaries(own).collect()] == [("y", 0, 0, 0), ("z", 0, 0, 0), ("x", 1, 1, 0)]
    runs.save_runs(runs.load_run(own, "x"), str(tmp_path / "b"))
    back = spark.read.json(str(tmp_path / "b")).first()
    assert back.narrative[0].action == "go" and back.narrative[0].state == "unknown" and back.totalSteps == 1
    assert runs.rendered(runs.load_run(own, "x")).first().text == "  n0 (+0.0s): go [loop]"
    log = str(tmp_path / "log")
    assert files.rotate_log(spark, log, "d") is None and files.tail_log(spark, log, "a long", "a").count() == 0


def test_reflections_defaults(spark):
    df = spark.createDataFrame([("1", None, None, None), ("2", "her", 0.0, "s"), ("3", "", 0.5, "")], "id string, source string, confidence double, sourceId string")
    assert [tuple(r) for r in runs.with_defaults(df).orderBy("id").collect()] == [("1", "real", 1, "1"), ("2", "her", 1, "s"), ("3", "real", 0.5, "3")]


def test_memory_store_rules(spark):
    rows = spark.createDataFrame([("1", "fact", None, None, None, "s", None), ("2", "odd", "t", "c", ["x"], "s", None), ("1", "fact", "again", "c", [], "s", None)], "id string, type string, title string, content string, tags array<string>, source string, created timestamp")
    new = memories.new_entries(rows)
    assert new.count() == 2 and memories.rejected(rows).count() == 1
    store = memories.add(new.limit(0), new)
    assert store.count() == 1 and memories.add(store, new).count() == 1 and memories.delete(store, store.select("id")).count() == 0
    assert memories.update(store, spark.createDataFrame([("1", None, "new")], "id string, title string, content string")).first().content == "new"
    assert memories.markdown(spark.createDataFrame([], "memory_type string, content string, importance_score double, access_count long"), ["semantic"]).count() == 0


def test_clusters_of_vectors(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(4, 8))
    x = np.concatenate([base + rng.normal(scale=s, size=(4, 8)) for s in (0, 0.1, 0.2, 0.5, 1.0)])
    rows = [(i, "e", f"m{i}", 0.1 * i, i % 3, x[i].tolist()) for i in range(20)]
    df = spark.createDataFrame(rows, "id long, kind string, content string, importance double, accessed_at long, embedding array<double>")

    def cos(a, b):
        return float(x[a] @ x[b] / np.linalg.norm(x[a]) / np.linalg.norm(x[b]))

    order, used, want = sorted(range(20), key=lambda i: (-(i % 3), i)), set(), []
    for n, i in enumerate(order):
        if i in used:
            continue
        own = [i]
        used.add(i)
        for j in order[n + 1 :]:
            if j not in used and sum(cos(m, j) for m in own) / len(own) >= 0.85:
                own.append(j)
                used.add(j)
        if len(own) > 1:
            want.append(own)
    got = vectors.consolidated(df, "kind").collect()
    assert sorted(r.ids for r in got) == sorted(want) and want
    assert all(r.content == " | ".join(f"m{i}" for i in r.ids) and abs(r.importance - np.mean([0.1 * i for i in r.ids])) < 1e-9 for r in got)
    assert vectors.consolidated(df.limit(0), "kind").count() == 0
    v = vectors.dense(vectors.hashed(spark.createDataFrame([(1, "alpha beta alpha"), (2, ""), (3, None)], "k long, t string"), "k", "t"), "k").collect()
    assert len(v) == 1 and len(v[0].embedding) == 384 and abs(sum(y * y for y in v[0].embedding) - 1) < 1e-6


def test_waves_with_circles(spark):
    plan = spark.createDataFrame([(i,) for i in range(7)], "step int")
    needs = spark.createDataFrame([(1, 0), (2, 1), (2, 0), (3, 4), (4, 3), (5, 3), (6, 99)], "step int, needed int")
    assert {tuple(r) for r in relabel.waves(plan, needs).collect()} == {(0, 0), (1, 1), (2, 2)}
    assert relabel.waves(plan.limit(0), needs).count() == 0


def test_branches_and_lessons(spark):
    lesson = lambda names, n, steps: one(spark, F.array_join(relabel.prefix_lessons(F.array(*lits(*names)), F.lit(n), F.lit(steps), F.lit("g")), "|"))[0]
    assert lesson(["a"], 1, 3).startswith("Single action type (a)") and "Efficient completion: 3" in lesson(["a"], 1, 3)
    assert lesson(["a", "b"], 2, 4).split("|") == ["Multi-step procedure: a, b", "Successfully achieved: g"] and "Complex sub-goal requiring 11" in lesson(["a"], 1, 11)


def test_variables_are_named_and_put_back(spark):
    assert variables.spans("a@b.org http://a@b.org/2024-01-01 2024-01-01") == [(0, 7, "email", "a@b.org"), (8, 33, "url", "http://a@b.org/2024-01-01"), (34, 44, "date_iso", "2024-01-01")]
    texts = ["a.x@b.org a.x@b.org", "a_x@c.org on 2024-01-01 or 1/2/24", None, "/tmp/f-1.txt"]
    names = [x[5] for x in variables.named(texts)]
    assert names == ["a_x_email", "a_x_email", "a_x_email_1", "date", "date_1", "f_1_txt_path"]
    df = spark.createDataFrame([(1, texts), (2, None)], "id long, texts array<string>")
    m = {r.id: r for r in variables.parameterised(df).collect()}
    assert m[1].texts == ["{{a_x_email}} {{a_x_email}}", "{{a_x_email_1}} on {{date}} or {{date_1}}", None, "{{f_1_txt_path}}"] and m[2].texts == []
    assert m[1].variables["date_1"] == "1/2/24" and variables.extracted(df.limit(0)).count() == 0


def test_tools(spark):
    r = ToolRegistry()
    assert tool_name("My  Tool--é!" + "x" * 60) == ("my_tool_" + "x" * 60)[:50]
    r.forge("a", "A", F.upper, {"text": "string"})
    with pytest.raises(ValueError):
        r.forge("A", "again", F.upper, {})
    df = spark.createDataFrame([("x",), (None,)], "t string")
    assert [x.result for x in r.run(df, "a", "t").collect()] == ["X", None]
    r.toggle("a", False)
    with pytest.raises(ValueError):
        r.run(df, "a", "t")
    assert r.schemas(spark).count() == 0 and r.catalogue(spark).first().enabled is False
    assert r.update("a", F.lower).version == 2 and [tuple(x) for x in r.statistics(spark).collect()] == [("a", 1, 2, 1)]
    r.delete("a")
    assert r.statistics(spark).count() == 0
    with pytest.raises(KeyError):
        r.update("a")
    for i in range(MOST_TOOLS):
        r.forge(f"t{i}", "", F.upper, {})
    with pytest.raises(ValueError):
        r.forge("one more", "", F.upper, {})


def test_streamed_flags_over_many_triggers(spark, tmp_path):
    rng = random.Random(5)
    rows = [(t, i, i, rng.choice(["a", "b", "c", None]), rng.choice([1, 2, 3, 4, 5, 6, None]), rng.random() < 0.8) for i in range(70) for t in (1, 2)]
    schema = "task long, ts long, id long, state string, picture long, acted boolean"
    df = spark.createDataFrame(rows, schema)
    for n in range(5):
        df.where((F.col("id") >= n * 14) & (F.col("id") < n * 14 + 14)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = stream_steps.flag_stream(stream).writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    out.awaitTermination()
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("task", "idx", "stagnation", F.coalesce("loop_at", F.lit(-1)).alias("l"), F.coalesce("loop_by", F.lit("")).alias("b")).collect())
    whole = sequences.flags(df.withColumn("idx", F.col("id")), "task", "state", "picture", F.col("acted"))
    assert got == sorted(tuple(r) for r in whole.select("task", "idx", "stagnation", F.coalesce("loop_at", F.lit(-1)), F.coalesce("loop_by", F.lit(""))).collect())


def test_index_is_rebuilt_when_due(spark, tmp_path):
    now = [0.0]
    w = IndexWriter(str(tmp_path / "i"), adds=3, seconds=100, clock=lambda: now[0])
    batch = lambda *rows: spark.createDataFrame(rows, "task string, text string")
    assert w.read(spark).count() == 0
    w(batch(("a", "alpha beta alpha")), 0)
    w(batch(("a", "alpha beta alpha")), 0)  # the same batch after a restart
    assert w.rebuilds == 0 and {tuple(r) for r in w.read(spark).collect()} == {("a", "alpha", 2), ("a", "beta", 1)}
    w(batch(("b", "gamma"), ("c", "gamma delta")), 1)
    assert w.rebuilds == 1 and w.read(spark).count() == 5
    now[0] = 101.0
    w(batch(("d", "late")), 2)
    assert w.rebuilds == 2 and w.read(spark).count() == 6


def test_graduation_limits(spark):
    p = spark.createDataFrame([("t", "a", 3, 0.9), ("t", "b", 2, 1.0), ("t", "c", 9, 0.5)], "kind string, pattern string, occurrences long, success_rate double")
    assert [r.pattern for r in evidence.graduates(p, 4).collect()] == ["a"]


def test_ties_take_the_smallest_key(spark):
    df = spark.createDataFrame([(1, i, 0.5) for i in (7, 3, 5)], "q long, k long, s double")
    assert [(r.k, r["rank"]) for r in retrieval.top(df, "k", "s", 2).orderBy("rank").collect()] == [(3, 1), (5, 2)]


def test_quiet_hours_around_midnight(spark):
    at = lambda h: F.lit(datetime.datetime(2024, 1, 1, h, 0))
    assert one(spark, *[memory.quiet(at(h), 22, 7) for h in (21, 22, 6, 7)], *[memory.quiet(at(h), 1, 3) for h in (0, 1, 3)]) == (False, True, True, False, False, True, False)


def test_waves_are_not_broadcast(spark, monkeypatch):
    plans, written = [], relabel.written

    def seen(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return written(df, name)

    monkeypatch.setattr(relabel, "written", seen)
    plan = spark.range(300).select(F.col("id").alias("step"))
    needs = plan.where("step >= 5").selectExpr("step", "step div 5 AS needed")
    got = {r.step: r.wave for r in relabel.waves(plan, needs).collect()}
    assert len(got) == 300 and all(got[i] == (got[i // 5] + 1 if i >= 5 else 0) for i in got)
    assert len(plans) > 8 and not any("Broadcast" in p for p in plans)
