import numpy as np
from pyspark.sql import functions as F

from pathlore.llm import whitening
from pathlore.llm.queries import op13_whitening

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>"


def plain(vectors, k=16):
    """n, deviations, whitened and explained of whole numbers, by one dense matrix."""
    x = np.array(vectors, dtype=object)
    fitted = np.array(sorted({tuple(v) for v in vectors}), dtype=object)
    n, sums = len(fitted), fitted.sum(axis=0)
    deviation = [int(sum((n * c - s) ** 2 for c, s in zip(v, sums, strict=True))) for v in x]
    own = ((n * fitted - sums) / n).astype(float)
    variance, q = np.linalg.eigh(own.T @ own / n)
    variance, q = variance[::-1][:k], q[:, ::-1][:, :k]
    total = sum(int((n * c - s) ** 2) for v in fitted for c, s in zip(v, sums, strict=True)) / n**3
    return n, deviation, ((n * x - sums) / n).astype(float) @ q / np.sqrt(variance), variance / total


def test_all_rows_against_one_dense_matrix(spark):
    rows = {}
    for r in op13_whitening(spark, SF).collect():
        rows.setdefault(r.vec_id, []).append(r)
    vectors = {r.vec_id: [int(np.floor(64 * float(c))) + 1_000_000 for c in r.embedding] for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    ids = sorted(vectors)
    n, deviation, white, explained = plain([vectors[i] for i in ids])
    assert sorted(rows) == ids
    got = []
    for i, want in zip(ids, deviation, strict=True):
        own = sorted(rows[i], key=lambda r: r.component)
        assert [r.component for r in own] == list(range(1, 17)) and {(r.n, r.deviation) for r in own} == {(n, want)}
        assert np.allclose([r.explained for r in own], explained, rtol=1e-10) and own[0].identity_error < 1e-10
        got.append([r.whitened for r in own])
    sign = np.sign((np.array(got) * white).sum(axis=0))
    assert np.abs(np.array(got) - white * sign).max() < 1e-9


def whitened(spark, rows, schema=SCHEMA, scale=64, offset=1_000_000):
    df = spark.createDataFrame(rows, schema)
    df = df.where(whitening.usable(F.col("embedding"))).withColumn("x", whitening.quantised(F.col("embedding"), scale, offset)).drop("embedding")
    model = whitening.fit(df)
    return model, whitening.whiten(df, model)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 3.0]), (None, [2.0, 2.0]), (3, None), (4, [None, 1.0]), (5, [nan, 1.0]), (6, [1.0, -inf]), (7, []), (8, [1.0]), (9, [1.0, 2.0, 3.0])]
    model, out = whitened(spark, rows)
    got = out.collect()
    assert model.n == 3 and model.sums == (3_000_000 + 192, 3_000_000 + 320)
    assert sorted((r.vec_id is None, r.vec_id) for r in got) == [(False, 1), (False, 1), (False, 2), (True, None)]
    n, deviation, white, explained = plain([[1_000_064, 1_000_000], [1_000_000, 1_000_192], [1_000_128, 1_000_128]], 2)
    by_id = {r.vec_id: r for r in got}
    assert [int(by_id[i].deviation) for i in (1, 2, None)] == deviation and np.allclose(model.explained, explained)
    assert np.allclose(np.abs([by_id[i].whitened for i in (1, 2, None)]), np.abs(white)) and model.identity_error < 1e-10


def test_nothing_to_fit(spark):
    for rows in ([], [(1, None)], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, []), (2, [])]):
        model, out = whitened(spark, rows)
        assert out.count() == 0 and len(model.variances) == 0 and whitening.by_component(out, model).count() == 0
        assert whitening.by_component(out, model).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_rank_ties_of_lengths_and_large_entries(spark):
    rows = [(i, [float(i), 2.0 * i, -1.0 * i]) for i in range(20)]
    model, out = whitened(spark, rows)
    assert len(model.variances) == 1 and abs(model.explained[0] - 1) < 1e-12 and out.count() == 20
    model, out = whitened(spark, [(1, [1.0]), (2, [2.0]), (3, [1.0, 2.0]), (4, [5.0, 2.0])])
    assert model.dimensions == 2 and sorted(r.vec_id for r in out.collect()) == [3, 4]
    model, out = whitened(spark, [(1, [1e30, 1.0]), (2, [-1e30, 2.0]), (3, [0.0, 3.0])])
    top = whitening.LIMIT
    want = plain([[top, 1_000_064], [-top + 2_000_000, 1_000_128], [1_000_000, 1_000_192]], 1)
    assert [int(r.deviation) for r in sorted(out.collect())] == want[1] and len(model.variances) == 1


def test_deviations_are_exact_however_large():
    rng = np.random.default_rng(5)
    for top in (100, 1 << 20, 1 << 50):
        x = rng.integers(-top, top, (50, 8))
        n, sums = 1_000_003, [int(v) for v in rng.integers(-top, top, 8) * 999_983]
        want = [sum((n * int(c) - s) ** 2 for c, s in zip(v, sums, strict=True)) for v in x]
        assert whitening.Centre(n, tuple(sums)).deviations(x) == want


def test_clashing_columns(spark):
    rows = [(1, [1.0, 0.0], 7.0, "a", 5, "at", 1.5), (2, [0.0, 1.0], 8.0, "b", 6, "at", 2.5)]
    model, out = whitened(spark, rows, "vec_id long, embedding array<float>, deviation double, Whitened string, n int, _at string, explained double")
    assert out.columns == ["vec_id", "n", "_at", "explained", "deviation", "whitened"]
    each = whitening.by_component(out, model)
    assert each.columns == ["vec_id", "_at", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert {(r.vec_id, r._at, r.n, r.component) for r in each.collect()} == {(1, "at", 2, 1), (2, "at", 2, 1)}
