import re

import numpy as np

import corpus_pipeline
from pathlore.llm import nearcopies

SF = "/root/testdata/sf0.01"


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute(texts):
    """The smallest id of each document's component, over links of exact Jaccard 0.8 or more."""
    root, sets = {i: i for i in texts}, {i: shingles(t) for i, t in texts.items()}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(texts)
    for i in ids:
        for j in ids:
            if i < j and 4 * max(len(sets[i]), len(sets[j])) <= 5 * min(len(sets[i]), len(sets[j])):
                shared = len(sets[i] & sets[j])
                if 5 * shared >= 4 * (len(sets[i]) + len(sets[j]) - shared):
                    a, b = find(i), find(j)
                    root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_stage_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)["simhash_near_duplicates"]
    got = sorted(r.doc_id for r in stage(spark, docs, SF).select("doc_id").collect())
    comp = brute({r.doc_id: r.text for r in docs.collect()})
    assert got == sorted(set(comp.values()))


def test_edges(spark):
    long = [f"w{i}" for i in range(60)]
    near, far = [*long], [*long]
    near[30], far[10], far[30], far[50] = "x", "x", "x", "x"
    rows = [(5, " ".join(long)), (4, " ".join(near).upper()), (3, " ".join(far)), (2, "a b c"), (1, "A  b\tc"), (7, None), (6, ""), (8, "a b")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in nearcopies.keep_one(df).collect()) == [1, 3, 4, 6, 8]
    assert nearcopies.keep_one(df.limit(0)).count() == 0


def test_forest_of_a_large_group():
    rng = np.random.default_rng(5)
    base = np.arange(200, dtype=np.uint64)
    sets = [np.unique(np.concatenate([rng.choice(base, 180, False), rng.integers(1000, 2**60, int(n), dtype=np.uint64)])) for n in rng.integers(0, 60, 150)]

    def parts(edges):
        root = list(range(len(sets)))

        def find(i):
            while root[i] != i:
                i = root[i]
            return i

        for a, b in edges:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
        return [find(i) for i in range(len(sets))]

    own = [set(s.tolist()) for s in sets]
    want = [(i, j) for i in range(150) for j in range(i) if 5 * len(own[i] & own[j]) >= 4 * len(own[i] | own[j])]
    assert 1 < len(set(parts(want))) < 150 and parts(nearcopies.forest(sets)) == parts(want)


def test_rows_without_own_ids(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(None, a, 1), (None, a, 2), (1, b, 3), (1, b, 4), (2, b, 5), (2, "other text of id two", 6), (None, b, 7)]
    got = nearcopies.keep_one(spark.createDataFrame(rows, "doc_id long, text string, n int")).collect()
    assert sorted((r.doc_id or 0, r.text) for r in got) == sorted([(0, a), (1, b), (2, "other text of id two")])


def test_large_groups_in_parts(spark, monkeypatch):
    """Chains, stars and strangers in groups that are dealt out, with many pivots and with few, against a plain search."""
    rng = np.random.default_rng(11)
    base = [f"w{i}" for i in range(120)]
    texts = {}
    for i in range(150):
        words = list(base)
        for at in rng.choice(120, int(rng.integers(0, 9)), False):
            words[at] = f"x{int(rng.integers(0, 40))}"
        texts[i] = " ".join(words)
    chain = [f"c{i}" for i in range(100)]
    for i in range(30):  # each is like the next, the ends are not
        texts[200 + i] = " ".join(chain[i:] + [f"d{k}" for k in range(i)])
    df = spark.createDataFrame([(7 if i < 200 else 8, i, t) for i, t in texts.items()], "grp long, key long, text string")
    sizes = df.groupBy("grp").count().withColumnRenamed("count", "n")
    want = brute(texts)
    assert 1 < len(set(want.values())) < len(texts)
    for part, block, picked in ((512, 256, 8), (16, 8, 2)):
        monkeypatch.setattr(nearcopies, "PART", part)
        monkeypatch.setattr(nearcopies, "BLOCK", block)
        monkeypatch.setattr(nearcopies, "PICKED", picked)
        root = {i: i for i in texts}

        def find(i, root=root):
            while root[i] != i:
                i = root[i]
            return i

        for r in nearcopies.links_of_large(df, sizes).collect():
            a, b = find(r.a), find(r.b)
            root[max(a, b)] = min(a, b)
        assert {i: find(i) for i in texts} == want


def test_stage_is_the_same_with_large_groups_dealt_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    one, two = ({r.doc_id: r.component for r in nearcopies.with_components(docs, members).collect()} for members in (1, 10**6))
    groups = lambda c: {frozenset(i for i in c if c[i] == v) for v in c.values()}
    assert groups(one) == groups(two)


def test_simhash_brings_candidates(spark, monkeypatch):
    """Near fingerprints are candidates without any shared band, and what they bring is verified."""
    monkeypatch.setattr(nearcopies, "ties", lambda folded: folded.selectExpr("key AS a", "key AS b").limit(0))
    one, two = [f"a{i}" for i in range(2000)], [f"b{i}" for i in range(2000)]
    near = [*one]
    near[7] = "x"
    df = spark.createDataFrame([(1, " ".join(one)), (2, " ".join(near)), (3, " ".join(two)), (4, "a b"), (5, "")], "doc_id long, text string")
    assert sorted(r.doc_id for r in nearcopies.keep_one(df).collect()) == [1, 3, 4, 5]
    monkeypatch.setattr(nearcopies, "RADIUS", 62)
    monkeypatch.setattr(nearcopies.simhash, "links", lambda distinct, radius: distinct.selectExpr("fp AS a").join(distinct.selectExpr("fp AS b")))
    assert sorted(r.doc_id for r in nearcopies.keep_one(df).collect()) == [1, 3, 4, 5]
