import random

import numpy as np
from pyspark.sql import functions as F

from pathlore.operators import evidence, merging, vectors


def made(rng, n, words, sizes=(0, 1, 2, 3, 4, 6)):
    return [" ".join(rng.choice(words) for _ in range(rng.choice(sizes))) for _ in range(n)]


def jaccard(a, b):
    return len(a & b) / len(a | b) if a and b else 0.0


def tokens(text):
    return {w for w in text.split() if len(w) > 2}


def test_similar_sets_against_all_pairs(spark):
    rng = random.Random(1)
    words = [f"word{i}" for i in range(12)]
    rows = [(i, i * 7 % 101, rng.choice("xy"), sorted(set(rng.choices(words, k=rng.choice([0, 1, 2, 3, 5, 8]))))) for i in range(100)]
    df = spark.createDataFrame(rows, "id long, place long, scope string, words array<string>")
    for above in (0.3, 0.5, 2 / 3, 0.8):
        for scope in (None, "scope"):
            got = {(r.a, r.b): r.similarity for r in merging.similar_sets(df, above, scope).collect()}
            want = {(a[0], b[0]): jaccard(set(a[3]), set(b[3])) for a in rows for b in rows if a[1] < b[1] and (not scope or a[2] == b[2]) and jaccard(set(a[3]), set(b[3])) > above}
            assert got == want and want


def greedy(texts, above):
    """The sequential rule: (first text of the entry) for each text, by one or more names."""
    entries, out = [], {}
    for t in texts:
        if t not in out:
            hit = next((e for e in entries if any(jaccard(tokens(a), tokens(b)) > above for a, b in zip(e, t, strict=True))), None)
            if hit is None:
                entries.append(t)
            out[t] = hit or t
    return out


def test_merging_equals_the_sequential_rule(spark):
    for seed in range(4):
        rng = random.Random(seed)
        words = [f"w{i:02}" for i in range(9)]
        texts = list(zip(made(rng, 150, words), made(rng, 150, words[:6] + ["qqq"] * 2), strict=True))
        df = spark.createDataFrame([(i, *t) for i, t in enumerate(texts)], "i long, label string, post string")
        own = df.groupBy("label", "post").agg(F.min("i").alias("first"))
        for names, above in ((["label"], 0.5), (["label", "post"], 0.6)):
            part = own.groupBy(*names).agg(F.min("first").alias("first"))
            got = {tuple(r[n] for n in names): tuple(r[f"entry_{n}"] for n in names) for r in merging.merge_texts(part, names, "first", above, evidence.distinct_tokens).collect()}
            assert got == greedy([t[: len(names)] for t in texts], above)


def test_a_long_chain_and_no_pairs(spark):
    """Each set is like the next one only: every second one makes an entry."""
    rows = [(i, i, [f"w{i}", f"w{i + 1}", f"w{i + 2}"]) for i in range(9)]
    df = spark.createDataFrame(rows, "id long, place long, words array<string>")
    pairs = merging.similar_sets(df, 0.4)
    assert {(r.a, r.b) for r in pairs.collect()} == {(i, i + 1) for i in range(8)}
    assert {r.id: r.entry for r in merging.first_alike(df, pairs).collect()} == {i: i - i % 2 for i in range(9)}
    assert merging.first_alike(df, pairs.limit(0)).count() == 9 and merging.similar_sets(df.limit(0), 0.5).count() == 0


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([("t", "aaa -> bbb", 1), ("t", "aaa -> bbb ccc", 2)], "kind string, sig string, i long")
    plan = evidence.pattern_of(df, "kind", "sig", "i")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def plain_clusters(rows, least=0.85):
    left = sorted((r for r in rows if np.linalg.norm(r[2])), key=lambda r: (-r[1], r[0]))
    unit = {r[0]: np.array(r[2]) / np.linalg.norm(r[2]) for r in left}
    used, out = set(), []
    for i, a in enumerate(left):
        if a[0] in used:
            continue
        own = [a[0]]
        used.add(a[0])
        for b in left[i + 1 :]:
            if b[0] not in used and np.mean([unit[m] @ unit[b[0]] for m in own]) >= least:
                own.append(b[0])
                used.add(b[0])
        if len(own) > 1:
            out.append(own)
    return sorted(out)


def test_clusters_without_a_group(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 6))
    vs = [*(centres[rng.integers(12)] + rng.normal(size=6) * 0.35 for _ in range(160)), *[centres[0]] * 20, np.zeros(6)]
    rows = [(i, int(rng.integers(50)), [float(v) for v in x]) for i, x in enumerate(vs)]
    df = spark.createDataFrame(rows, "id long, accessed_at long, embedding array<double>").withColumn("content", F.col("id").cast("string")).withColumn("importance", F.lit(0.5))
    want = plain_clusters(rows)
    assert sorted(r.ids for r in vectors.consolidated(df).collect()) == want and len(want) > 5 and vectors.consolidated(df.limit(0)).count() == 0
    units = df.where("id < 180").select("id", F.expr("transform(embedding, x -> x / sqrt(aggregate(embedding, 0D, (s, v) -> s + v * v)))").alias("unit"))
    for block in (16, 2048):
        links = {(r.a, r.b) for r in merging.near_vectors(units, 0.85, block=block).collect()}
        root = {i: i for i in range(180)}

        def find(i, root=root):
            while root[i] != i:
                i = root[i]
            return i

        for a, b in links:
            root[max(find(a), find(b))] = min(find(a), find(b))
        unit = {r[0]: np.array(r[2]) / np.linalg.norm(r[2]) for r in rows[:180]}
        whole = {i: i for i in range(180)}
        for a in range(180):
            for b in range(a):
                if unit[a] @ unit[b] >= 0.85:
                    whole[max(find(a, whole), find(b, whole))] = min(find(a, whole), find(b, whole))
        assert [find(i) for i in range(180)] == [find(i, whole) for i in range(180)]


def test_clusters_in_rounds(spark, monkeypatch):
    """As one after the other makes them, though no task meets more vectors than a round has, all of them being near to others."""
    for name, n in (("ROUND", 24), ("CLUSTERS", 4), ("KEPT", 2)):
        monkeypatch.setattr(vectors, name, n)
    rng = np.random.default_rng(7)
    x = rng.normal(size=(150, 5)) * 0.5 + 0.6
    rows = [(i, i % 40, [float(v) for v in y]) for i, y in enumerate([*x, *[x[3]] * 20])]
    df = spark.createDataFrame(rows, "id long, accessed_at long, embedding array<double>").withColumns({"content": F.col("id").cast("string"), "importance": F.lit(0.5), "kind": F.col("id") % 2})
    sizes, settled = spark.sparkContext.accumulator(0), vectors._settled

    def counted(least):
        run = settled(least)

        def count(key, part):
            sizes.add(int((part["kind"] == 0).sum() > 24))
            return run(key, part)

        return count

    monkeypatch.setattr(vectors, "_settled", counted)
    got = vectors.consolidated(df).collect()
    assert sorted(r.ids for r in got) == plain_clusters(rows) and len(got) > 10 and max(r.size for r in got) > 20 and sizes.value == 0
    assert all(np.allclose(r.embedding, np.mean([rows[i][2] for i in r.ids], axis=0)) and r.first == r.ids[0] and r.size == len(r.ids) for r in got)
    by_kind = sorted(plain_clusters(rows[::2]) + plain_clusters(rows[1::2]))
    assert sorted(r.ids for r in vectors.consolidated(df, "kind").collect()) == by_kind


def test_components_of_chains(spark):
    pairs = [(i, i + 1) for i in range(0, 40)] + [(100, 90), (95, 90), (95, 99)]
    got = {r.id: r.root for r in merging.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 90 for i in (90, 95, 99, 100)}}
