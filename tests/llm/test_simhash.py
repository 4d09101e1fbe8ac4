import re
import time

import numpy as np
import xxhash
from pyspark.sql import functions as F

from pathlore.llm import simhash
from pathlore.llm.queries import op10_simhash

SF = "/root/testdata/sf0.001"


def brute_fp(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    root = {i: i for i in fps}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(fps)
    for i in ids:
        for j in ids:
            if i < j and (fps[i] ^ fps[j]).bit_count() <= 2:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_whole_table(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    fps = {i: brute_fp(t) for i, t in docs.items()}
    comp = brute_components(fps)
    got = {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in op10_simhash(spark, SF).collect()}
    assert got == {i: (fps[i], comp[i]) for i in docs}


def test_edges(spark):
    rows = [(1, None, "x"), (2, "", "y"), (3, "a b c d", None), (3, "a b c d", None), (None, "A B\tC d", "z"), (4, "É é", "q")]
    got = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, fp string")).collect()}
    assert got == {(1, 1), (2, 1), (3, 3), (None, 3), (4, 4)}
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_links_by_both_ways(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    fp = np.unique(np.concatenate([base, *[base ^ (np.uint64(1) << rng.integers(0, 64, 40, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 40, dtype=np.uint64)) for _ in range(4)]]))

    def parts(edges):
        root = list(range(len(fp)))

        def find(i):
            while root[i] != i:
                i = root[i]
            return i

        for a, b in edges:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
        return [find(i) for i in range(len(fp))]

    want = parts([(i, j) for i in range(len(fp)) for j in range(i) if int(fp[i] ^ fp[j]).bit_count() <= 2])
    assert parts(simhash.forest(fp)) == want
    at = {int(v): i for i, v in enumerate(fp.view(np.int64))}
    for members in (2048, 3):  # whole blocks, and blocks split by all pivots' cells
        got = simhash.links(spark.createDataFrame([(int(v),) for v in fp.view(np.int64)], "fp long"), members=members).collect()
        assert parts([(at[r.a], at[r.b]) for r in got]) == want


def test_large_block_is_split(spark):
    start = time.time()
    fp = np.unique(np.random.default_rng(1).integers(0, 2**40, 30000, dtype=np.uint64))
    blocks = spark.createDataFrame([(1, int(v)) for v in fp], "key long, fp long")
    rows = simhash.split_blocks(blocks)
    assert rows.groupBy("key").count().agg({"count": "max"}).first()[0] <= simhash.TABLE_MEMBERS
    assert time.time() - start < 120


def test_linked_fingerprints_share_a_cell_of_each_pivot(spark):
    rng = np.random.default_rng(4)
    a = rng.integers(0, 2**63, 500, dtype=np.uint64)
    b = a ^ (np.uint64(1) << rng.integers(0, 63, 500, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 63, 500, dtype=np.uint64))
    df = spark.createDataFrame([(int(x), int(y)) for x, y in zip(a, b, strict=True)], "a long, b long")
    for p in range(simhash.PIVOTS):
        assert df.where(F.size(F.array_intersect(simhash.cells("a", p), simhash.cells("b", p))) == 0).count() == 0


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a b c d", 1, 2, 3, 4), (2, "a b c d", 1, 2, 3, 4)], "doc_id long, text string, fp long, component_id long, n long, low long")
    assert sorted((r.doc_id, r.component_id) for r in simhash.near_duplicates(df).collect()) == [(1, 1), (2, 1)]


def test_blocks_that_pivots_do_not_split(spark):
    """Fingerprints that fill all values of some bits: the pivots' distances hardly tell them apart, the bits do."""
    fp = np.arange(1 << 13, dtype=np.uint64) << np.uint64(20)
    blocks = spark.createDataFrame([(1, int(v), int(0xFFFFFFFF << 20)) for v in fp], "key long, fp long, free long")
    rows = simhash.split_blocks(blocks, members=64)
    assert rows.groupBy("key").count().agg({"count": "max"}).first()[0] <= 64
    got = simhash.links(spark.createDataFrame([(int(v),) for v in fp[:600]], "fp long"), members=16).collect()
    root = {int(v): int(v) for v in fp[:600]}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for r in got:
        assert (r.a ^ r.b).bit_count() <= 2
        root[max(find(r.a), find(r.b))] = min(find(r.a), find(r.b))
    assert {find(int(v)) for v in fp[:600]} == {0}


def test_a_very_long_text(spark):
    long = " ".join(f"w{i % 977}" for i in range(400_000))
    rows = [(1, long), (2, long + " end"), (3, "x" * 2_000_000)]
    got = {r.doc_id: (r.fp & 0xFFFFFFFFFFFFFFFF, r.component_id) for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: f for i, (f, _) in got.items()} == {i: brute_fp(t) for i, t in rows} and {i: c for i, (_, c) in got.items()} == brute_components({i: brute_fp(t) for i, t in rows})
