import random
import re
from collections import Counter

from pathlore.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
SCHEMA = "lang string, source string, text string"


def plain(rows, least=3, k=200):
    """The whole audit by loops over all terms and all pairs."""
    docs = [(a or "", b or "", TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))) for a, b, t in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        seen = Counter(t for d in own for t in set(d[2]))
        kept = sorted(t for t in seen if seen[t] >= least)

        def table(counts, kept=kept):
            n = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 1) // (n + len(kept)) for t in kept}

        counts = {s: Counter(t for d in own if d[1] == s for t in d[2]) for s in {d[1] for d in own}}
        p, q = {s: table(c) for s, c in counts.items()}, table(sum(counts.values(), Counter()))
        for s in counts:
            pair = [(sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o) for o in counts if o != s]
            term = [((p[s][t] - q[t]) ** 2 // q[t], t) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, values, most in (("pair", pair, None), ("term", term, k)):
                ranked = sorted(values, key=lambda v: (-v[0], v[1].encode()))[:most]
                out += [(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(ranked)]
    return sorted(out)


def audited(spark, rows, schema=SCHEMA, **more):
    return sorted(tuple(r) for r in divergence.audit(spark.createDataFrame(rows, schema), **more).collect())


def made(seed, docs, langs, sources, words):
    rng = random.Random(seed)
    vocab = [f"w{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}{'é' * (i // 100)}" for i in range(words)]
    rows = []
    for _ in range(docs):
        s = rng.choice(sources + sources[:1] * 3)
        tilt = vocab[ord(s) % 7 :: 3] if rng.random() < 0.5 else vocab
        rows.append((rng.choice(langs), s, " ".join(rng.choice(tilt)[: rng.randint(2, 9)].capitalize() + rng.choice([",", "", "1", "-x"]) for _ in range(rng.randint(0, 120)))))
    return rows


def test_against_loops(spark):
    rows = made(1, 150, ["en", "de"], ["a", "b", "c", "ü"], 300)
    got = audited(spark, rows)
    assert got == plain(rows) and len(got) > 500


def test_rounds_until_bounds_are_below(spark):
    """A small k, so that groups end in several rounds, with ties at the k-th value."""
    rows = made(2, 200, ["en"], ["a", "b", "c", "d", "e"], 250) + [("en", "f", "tie tied tier tien")] * 4
    for k in (1, 3, 10):
        assert audited(spark, rows, k=k) == plain(rows, k=k)


def test_odd_rows(spark):
    assert audited(spark, []) == []
    rows = [(None, None, None), (None, "a", ""), ("en", "a", "12 -- \x00"), ("en", "b", "one two"), ("fr", "x", None), ("en", None, "One TWO two")]
    assert audited(spark, rows) == plain(rows)
    rows = [("en", "a", "word Word wörd É é")] * 3 + [("en", "b", "other")] * 2 + [("en", "c", None), ("en", "b", "word " * 200_000 + "x" * 300_000), ("de", "a", "word")]
    got = audited(spark, rows)
    assert got == plain(rows) and ("en", "c", "pair", "a") in {r[:4] for r in got}
    wide = [(*r, 1, "t", "p") for r in rows]
    assert audited(spark, wide, SCHEMA + ", rank int, term string, part string") == got


def test_probability_is_exact(spark):
    rng = random.Random(4)
    cases = [(c, size) for size in (2, 7, 10**9, 10**12 + 39, 9 * 10**15) for c in (0, 1, size // 3, size - 1, rng.randrange(size))]
    df = spark.createDataFrame(cases, "n long, size long")
    for r in df.withColumn("p", divergence.probability(df.n, df.size)).collect():
        assert r.p == 1 + 10**9 * (r.n + 1) // r.size


def test_buckets_rise_with_counts(spark):
    got = [r[0] for r in spark.range(1, 5000).orderBy("id").select(divergence.bucket(divergence.F.col("id"))).collect()]
    assert got == sorted(got) and got[:64] == list(range(1, 65)) and max(got) < 64 + 60
