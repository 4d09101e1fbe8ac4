"""Toxicity by weak supervision.

Terms (lower-case words, and word beginnings of 4 to 6 letters) that toxic learning rows hold far more
often than others become a lexicon. Terms that occur together are a theme, and each of up to
``THEMES`` themes is a lexicon voter; pattern voters look at exclamation marks, capitals and the
absence or number of lexicon terms. A generative label model estimates each voter's accuracy and
the voters' correlations: under either label the voters form a tree, in which each depends on the
one it shares most information with given the label, and the chances of each vote given the label
and that voter's vote are fitted by expectation-maximisation over vote patterns. The posterior
labels train a logistic regression on terms and votes, whose probability is the score.

Learning uses at most about ``SAMPLE`` labelled rows, chosen by hash (a documented bound); a term
must occur in ``SUPPORT`` of their toxic ones (and in ``LEAST_ROWS`` rows) and ``LIFT`` times (as a
logarithm) as often there as elsewhere. Scoring reads every whole text, of any length. Nulls: a
null text is an empty one and is scored from the intercept; labels that are null are left out; of
several labels of one document the highest counts. With no toxic or no other learning row every
score is the share of toxic ones. Rows are scored alone, so repeats don't matter. An empty table
gives an empty result. Other columns are passed on; input columns named score or predicted are
replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, checkpoint, slices, small

SAMPLE, SUPPORT, LEAST_ROWS, LIFT, THEMES, ANCHOR = 20_000, 0.01, 4, 2.5, 10, 1.0
PREFIXES, SPARSE = (4, 5, 6), 300
_EDGE = ".,;:!?()[]{}\"'«»|#*$%&<>-_"


class Model(NamedTuple):
    terms: dict[str, int]
    themes: np.ndarray
    weights: np.ndarray
    intercept: float


def terms_of(word: str) -> list[str]:
    """The terms of a word: itself and its beginnings (with a caret)."""
    w = word.lower().strip(_EDGE)
    return [w, *("^" + w[:k] for k in PREFIXES if len(w) > k)] if w else []


def hits(texts: pa.Array, terms: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term number, strength), each pair once: occurrences over one and a further one for each ``SPARSE`` words, at most 1."""
    words = Words(texts)
    code, term = [], []
    for c, w in enumerate(words.vocab.to_pylist()):
        for t in terms_of(w):
            if (n := terms.get(t)) is not None:
                code.append(c)
                term.append(n)
    if not code:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    code, term = np.array(code), np.array(term)
    hot = np.zeros(len(words.vocab), bool)
    hot[code] = True
    at = np.flatnonzero(hot[words.codes])
    row, found = np.searchsorted(words.offsets, at, side="right") - 1, words.codes[at]
    first, last = np.searchsorted(code, found, side="left"), np.searchsorted(code, found, side="right")
    n = last - first
    index = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
    pairs, times = np.unique(np.stack([np.repeat(row, n), term[index]]), axis=1, return_counts=True)
    length = np.diff(words.offsets)[pairs[0]]
    return pairs[0], pairs[1], np.minimum(1.0, times / (1 + length / SPARSE))


#: Signs that a pattern voter looks at: exclamation marks, capitals.
SIGNS = [(r"!", 0.02), (r"\p{Lu}", 0.4)]


def signs(texts: pa.Array) -> np.ndarray:
    """Whether each text has more of each sign than its share of characters."""
    text = pc.fill_null(texts, "")
    size = np.maximum(pc.utf8_length(text).to_numpy(zero_copy_only=False), 1)
    return np.stack([pc.count_substring_regex(text, p).to_numpy(zero_copy_only=False) > share * size for p, share in SIGNS], axis=1)


def themes_of(row: np.ndarray, term: np.ndarray, terms: int, themes: int = THEMES) -> np.ndarray:
    """The theme of each term: seeds are terms that occur least with earlier seeds, the others go to the seed they occur with most."""
    held = np.zeros((int(row.max(initial=-1)) + 1, terms), np.float32)
    held[row, term] = 1
    size = np.sqrt(np.maximum(held.sum(0), 1))
    near = (held.T @ held) / np.outer(size, size)
    seeds = [0] if terms else []
    while len(seeds) < min(themes, terms):
        nearest = near[seeds].max(0)
        nearest[seeds] = np.inf
        seeds.append(int(np.argmin(nearest)))
    out = np.argmax(near[seeds], axis=0) if terms else np.zeros(0, np.int64)
    out[seeds] = np.arange(len(seeds))
    return out


def votes(n: int, row: np.ndarray, term: np.ndarray, strength: np.ndarray, seen: np.ndarray, themes: np.ndarray) -> np.ndarray:
    """Votes (1 toxic, -1 not, 0 abstain) of the theme and pattern voters on each of n texts."""
    out = np.zeros((n, THEMES + 2 + len(SIGNS)), np.int8)
    strong = strength >= 0.5
    out[row[strong], themes[term[strong]]] = 1
    total = np.bincount(row, strength, n)
    out[:, THEMES] = np.where(total < 0.3, -1, np.where(total >= 1, 1, 0))
    out[:, THEMES + 1] = np.where(total >= 2, 1, np.where(total < 1, -1, 0))
    out[:, THEMES + 2 :] = seen
    return out


def _mine(labelled: DataFrame, counts: dict[int, int]) -> dict[str, int]:
    """The lexicon: term -> rank."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in slices(batches, "text"):
            words, toxic = Words(s.column("text")), s.column("toxic").to_numpy()
            tally: dict[str, list[int]] = {}
            vocab = [terms_of(w) for w in words.vocab.to_pylist()]
            for i, y in enumerate(toxic.tolist()):
                own = np.unique(words.codes[words.offsets[i] : words.offsets[i + 1]])
                for t in {t for c in own.tolist() for t in vocab[c]}:
                    tally.setdefault(t, [0, 0])[y] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(tally)), *(pa.array([v[y] for v in tally.values()], pa.int64()) for y in (0, 1))], ["term", "other", "toxic"])

    tally = labelled.select("text", "toxic").mapInArrow(run, "term string, other long, toxic long").groupBy("term").agg(F.sum("other").alias("o"), F.sum("toxic").alias("t"))
    lift = F.log((F.col("t") + 0.5) / (counts[1] + 1)) - F.log((F.col("o") + 0.5) / (counts[0] + 1))
    best = tally.where(F.col("t") >= max(LEAST_ROWS, SUPPORT * counts[1])).withColumn("lift", lift).where(F.col("lift") > LIFT)
    return {r[0]: i for i, r in enumerate(best.orderBy((F.col("t") * F.col("lift")).desc(), "term").select("term").collect())}


class LabelModel(NamedTuple):
    prior: float
    #: The voter that each voter depends on, itself for the root.
    parent: np.ndarray
    #: chances[label, voter, parent's vote + 1, vote + 1]
    chances: np.ndarray

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """The chance of label 1 for each pattern of votes."""
        voter = np.arange(patterns.shape[1])
        own = np.log(self.chances[:, voter, patterns[:, self.parent] + 1, patterns + 1]).sum(2)
        odds = math.log(self.prior / (1 - self.prior)) + own[1] - own[0]
        return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))


def _tables(one_hot: np.ndarray, by_label: np.ndarray) -> np.ndarray:
    """Weighted counts [label, voter a, voter b, vote of a, vote of b]."""
    n, voters, kinds = one_hot.shape
    flat = one_hot.reshape(n, voters * kinds)
    return np.stack([(flat * q[:, None]).T @ flat for q in by_label.T]).reshape(2, voters, kinds, voters, kinds).transpose(0, 1, 3, 2, 4)


def dependence_tree(tables: np.ndarray) -> np.ndarray:
    """Each voter's parent in the spanning tree of most information between voters given the label; the first voter is the root."""
    joint = tables + 1e-9
    total = joint.sum((3, 4), keepdims=True)
    p = joint / total
    shared = (p * np.log(p / (p.sum(3, keepdims=True) * p.sum(4, keepdims=True)))).sum((3, 4))
    weight = total[:, :, :, 0, 0] / total[:, :, :, 0, 0].sum(0)
    shared = (weight * shared).sum(0)
    parent, inside = np.zeros(len(shared), np.int64), [0]
    while len(inside) < len(shared):
        best = shared[inside].copy()
        best[:, inside] = -np.inf
        a, b = np.unravel_index(int(np.argmax(best)), best.shape)
        parent[b] = inside[a]
        inside.append(int(b))
    return parent


def label_model(patterns: np.ndarray, n: np.ndarray, rounds: int = 100) -> LabelModel:
    """The label model by expectation-maximisation.

    ``n`` has the number of learning rows with each vote pattern and label (0, 1). The labels set
    where estimation starts and the tree, and count as ``ANCHOR`` votes a row beside the posterior's.
    """
    one_hot = np.stack([patterns == k for k in (-1, 0, 1)], axis=2).astype(float)
    total, voter = n.sum(1), np.arange(patterns.shape[1])
    parent = dependence_tree(_tables(one_hot, n.astype(float)))

    def fitted(by_label: np.ndarray, prior: float) -> LabelModel:
        c = _tables(one_hot, by_label)[:, parent, voter] + 0.5
        root = c[:, 0].sum(1, keepdims=True)  # the root's table has its own vote as condition
        c[:, 0] = root
        return LabelModel(float(np.clip(prior, 1e-3, 0.999)), parent, c / c.sum(3, keepdims=True))

    model = fitted(n.astype(float), n[:, 1].sum() / total.sum())
    for _ in range(rounds):
        p = model.posterior(patterns)
        new = fitted(np.stack([total * (1 - p), total * p], axis=1) + ANCHOR * n, ((total * p).sum() + ANCHOR * n[:, 1].sum()) / ((1 + ANCHOR) * total.sum()))
        moved, model = np.abs(new.chances - model.chances).max(), new
        if moved < 1e-8:
            break
    return model


def logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Weights (intercept last) of a ridge logistic regression on soft labels, by Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (n * p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(penalty), x.T @ (n * (y - p)) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _features(votes_: np.ndarray, row: np.ndarray, term: np.ndarray, strength: np.ndarray, terms: int) -> np.ndarray:
    x = np.zeros((len(votes_), terms + votes_.shape[1]))
    x[row, term] = strength
    x[:, terms:] = votes_
    return x


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """The model from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic), learning rows only."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    total = known.count()
    chosen = checkpoint(known.where(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30)) < min(1 << 30, int((1 << 30) * sample / max(total, 1)) + 1)))
    # the sample's ids go to the texts, and only the texts of the sample are written, once
    labelled = checkpoint(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(small(chosen, 4 * sample), "doc_id").select("text", "toxic"))
    counts = {0: 0, 1: 0} | {r[0]: r[1] for r in labelled.groupBy("toxic").count().collect()}
    if not counts[0] or not counts[1]:
        share = (counts[1] + 0.5) / (counts[0] + counts[1] + 1)
        return Model({}, np.zeros(0, np.int64), np.zeros(THEMES + 2 + len(SIGNS)), math.log(share / (1 - share)))
    terms = _mine(labelled, counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in slices(batches, "text"):
            row, term, strength = hits(s.column("text"), terms)
            cut = np.searchsorted(row, np.arange(s.num_rows + 1)).astype(np.int32)
            seen = signs(s.column("text")).view(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([bytes(x) for x in seen]), pa.ListArray.from_arrays(pa.array(cut), pa.array(term.astype(np.int32))), pa.ListArray.from_arrays(pa.array(cut), pa.array(strength.astype(np.float32))), s.column("toxic")], ["signs", "terms", "strengths", "toxic"])

    found = labelled.mapInArrow(run, "signs binary, terms array<int>, strengths array<float>, toxic int").groupBy("signs", "terms", "strengths")
    rows = found.agg(F.count_if(F.col("toxic") == 0).alias("other"), F.count_if(F.col("toxic") == 1).alias("toxic")).orderBy("signs", "terms", "strengths").collect()
    seen = np.array([np.frombuffer(r[0], np.uint8) for r in rows])
    n = np.array([r[3:5] for r in rows], float)
    row = np.repeat(np.arange(len(rows)), [len(r[1]) for r in rows])
    term, strength = (np.array([t for r in rows for t in r[i]], kind) for i, kind in ((1, np.int64), (2, float)))
    themes = themes_of(row, term, len(terms))
    v = votes(len(rows), row, term, strength, seen, themes)
    y = label_model(v, n).posterior(v)
    w = logistic(_features(v, row, term, strength, len(terms)), y, n.sum(1))
    return Model(terms, themes, w[:-1], float(w[-1]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` less text, with score and predicted as last columns."""
    kept = [c for c in docs.columns if c.lower() not in ("text", "score", "predicted")]
    kinds = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in slices(batches, "text"):
            row, term, strength = hits(s.column("text"), model.terms)
            odds = votes(s.num_rows, row, term, strength, signs(s.column("text")), model.themes) @ model.weights[len(model.terms) :] + model.intercept
            odds += np.bincount(row, model.weights[term] * strength, len(odds))
            p = 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
            yield pa.RecordBatch.from_arrays([*(s.column(c) for c in kept), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], [*kept, "score", "predicted"])

    return docs.select(*[F.col(f"`{c}`") for c in kept], "text").mapInArrow(run, f"{kinds}score double, predicted int")
