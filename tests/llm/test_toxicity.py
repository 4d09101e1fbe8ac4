import collections
import itertools
import math
import re
import unicodedata
import zlib

import numpy as np

from pathlore.llm import toxicity
from pathlore.llm.queries import op5_toxicity

SF = "/root/testdata/sf0.1"


def test_held_out_quality(spark):
    label = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = op5_toxicity(spark, SF).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    held = [(r.predicted, label[r.doc_id]) for r in rows if r.held_out and r.doc_id in label]
    hit = sum(p and y for p, y in held)
    assert hit / sum(y for _, y in held) > 0.9 and hit / max(1, sum(p for p, _ in held)) > 0.9


def test_label_model_knows_copies():
    """A voter that copies another hangs on it in the tree and adds nothing; accuracies are those that votes were drawn with."""
    rng = np.random.default_rng(2)
    y = rng.random(20000) < 0.2
    v = np.stack([np.where(rng.random(20000) < 0.6, np.where(y == (rng.random(20000) < a), 1, -1), 0) for a in (0.9, 0.85, 0.8, 0.9)], axis=1).astype(np.int8)

    def fit(v):
        patterns, at = np.unique(v, axis=0, return_inverse=True)
        model = toxicity.label_model(patterns, np.stack([np.bincount(at, y == k) for k in (0, 1)], axis=1))
        return model, model.posterior(patterns)[at]

    alone, p = fit(v)
    double, q = fit(np.hstack([v, v[:, :1]]))
    assert abs(alone.prior - 0.2) < 0.05 and double.parent[4] == 0 and np.abs(p - q).max() < 0.02
    for i, a in enumerate((0.9, 0.85, 0.8, 0.9)):
        given = alone.chances[:, i].mean(1)  # over the parent's votes, of which none matters here
        assert abs(given[1, 2] / (given[1, 0] + given[1, 2]) - a) < 0.05


def brute_posterior(patterns, n):
    """One round of the label model from the labels, by plain sums over all rows, with the tree that the operator found."""
    model = toxicity.label_model(patterns, n, rounds=0)
    parent, out = model.parent, []
    rows = [(tuple(p), y) for p, c in zip(patterns.tolist(), n.tolist(), strict=True) for y in (0, 1) for _ in range(int(c[y]))]

    def chance(i, votes, y):
        same = [r for r, z in rows if z == y and (i == 0 or r[parent[i]] == votes[parent[i]])]
        hit = sum(r[i] == votes[i] for r in same)
        k = 3 if i == 0 else 1  # the root's half counts come from three empty rows of its table
        return (hit + 0.5 * k) / (len(same) + 1.5 * k)

    share = sum(z for _, z in rows) / len(rows)
    for votes in map(tuple, patterns.tolist()):
        odds = math.log(share / (1 - share)) + sum(math.log(chance(i, votes, 1) / chance(i, votes, 0)) for i in range(len(votes)))
        out.append(1 / (1 + math.exp(-odds)))
    return model, np.array(out)


def test_posterior_against_plain_sums():
    rng = np.random.default_rng(7)
    y = rng.random(300) < 0.4
    v = np.stack([np.where(rng.random(300) < 0.7, np.where(y == (rng.random(300) < a), 1, -1), 0) for a in (0.9, 0.7, 0.8)], axis=1).astype(np.int8)
    patterns, at = np.unique(v, axis=0, return_inverse=True)
    model, want = brute_posterior(patterns, np.stack([np.bincount(at, y == k) for k in (0, 1)], axis=1))
    assert np.abs(model.posterior(patterns) - want).max() < 1e-9


def test_tree_is_the_best_of_all():
    rng = np.random.default_rng(9)
    v = rng.integers(-1, 2, (500, 4)).astype(np.int8)
    v[:, 2] = np.where(rng.random(500) < 0.8, v[:, 1], v[:, 2])
    v[:, 3] = np.where(rng.random(500) < 0.6, v[:, 2], v[:, 3])
    hot = np.stack([v == k for k in (-1, 0, 1)], axis=2).astype(float)
    tables = toxicity._tables(hot, np.stack([np.ones(500), np.zeros(500)], axis=1))

    def shared(a, b):
        p = tables[0, a, b] / 500
        return sum(p[i, j] * math.log(p[i, j] / (p[i].sum() * p[:, j].sum())) for i in range(3) for j in range(3) if p[i, j])

    best = max(sum(shared(i, q) for i, q in enumerate(parent, 1)) for parent in itertools.product(range(4), repeat=3) if _spans((0, *parent)))
    got = toxicity.dependence_tree(tables)
    assert abs(sum(shared(i, got[i]) for i in range(1, 4)) - best) < 1e-6


def _spans(parent):
    def rooted(i, seen=()):
        return i == 0 or i not in seen and rooted(parent[i], (*seen, i))

    return all(rooted(i) for i in range(len(parent)))


def test_scores_against_a_plain_reading(spark):
    """Each score of the smallest table again, word by word in plain Python, from the model's weights."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    model = toxicity.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    edge = ".,;:!?()[]{}\"'«»|#*$%&<>-_"

    def plain(text):
        words, found = re.findall(r"[^\x20\x09-\x0D]+", text or ""), collections.Counter()
        for w in words:
            w = w.lower().strip(edge)
            for t in {w, *("^" + w[:k] for k in (4, 5, 6) if len(w) > k)} - {""}:
                if t in model.terms:
                    found[t] += 1
        strength = {model.terms[t]: min(1.0, n / (1 + len(words) / toxicity.SPARSE)) for t, n in found.items()}
        vote = [0] * (toxicity.THEMES + 4)
        for t, s in strength.items():
            if s >= 0.5:
                vote[model.themes[t]] = 1
        total, size = sum(strength.values()), max(1, len(text or ""))
        vote[-4] = -1 if total < 0.3 else 1 if total >= 1 else 0
        vote[-3] = 1 if total >= 2 else -1 if total < 1 else 0
        vote[-2] = int((text or "").count("!") > 0.02 * size)
        vote[-1] = int(sum(unicodedata.category(c) == "Lu" for c in text or "") > 0.4 * size)
        odds = model.intercept + sum(model.weights[t] * s for t, s in strength.items()) + sum(w * x for w, x in zip(model.weights[len(model.terms) :], vote, strict=True))
        return 1 / (1 + math.exp(-max(-500, min(500, odds))))

    assert model.terms
    for d in toxicity.score(docs, model).join(docs, "doc_id").collect():
        assert abs(d.score - plain(d.text)) < 1e-6 and d.predicted == int(d.score >= 0.5)


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a", 9.0, "x", "y")], "doc_id long, text string, score double, predicted string, votes string")
    out = toxicity.score(docs, toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int")))
    assert out.columns == ["doc_id", "votes", "score", "predicted"] and [tuple(r) for r in out.collect()] == [(1, "y", 0.5, 1)]


def test_edges(spark):
    docs = spark.createDataFrame([(i, ("you idiot " if i % 4 == 0 else "fine day ") * 3 + f"w{i}", 0.5) for i in range(80)] + [(None, None, 0.5), (100, "", 0.5), (101, "idiot " * 100_000, 0.5), (101, "idiot " * 100_000, 0.5)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, int(i % 4 == 0), 1) for i in range(80)] + [(None, 1, 1), (3, None, 1), (4, 0, 1)], "doc_id long, toxic int, quality int")
    model = toxicity.fit(docs, labels)
    out = {r.doc_id: r.predicted for r in toxicity.score(docs.select("doc_id", "text"), model).collect()}
    assert out[101] == 1 and out[None] == 0 and out[100] == 0 and all(out[i] == (i % 4 == 0) for i in range(80))
    none = toxicity.fit(docs, labels.limit(0))
    assert {r.score for r in toxicity.score(docs.select("doc_id", "text"), none).collect()} == {0.5}
    assert toxicity.score(docs.select("doc_id", "text").limit(0), model).count() == 0
