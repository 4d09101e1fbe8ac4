"""Whitening of embeddings by a distributed singular value decomposition.

Vectors are whole numbers (``quantised`` makes them from floats), so that counts, sums and deviations
are exact. The fit list has each distinct vector once and is written. One pass gives n and the sums S.
Rows are centred at S / n before anything is multiplied: x less the whole part of the mean is exact, and
less its fraction is rounded once. MLlib's ``computeSVD`` on the centred rows gives the right singular
vectors, the components, and singular values s; a component's variance is e = s * s / n. All
singular values are asked for, so the decomposition is LAPACK's of the Gram matrix, to double
precision, not ARPACK's to a tolerance. The total variance isn't taken from it: it is the sum over the
fit list of the exact deviations (over dimensions, of (n * x - S) squared), over n to the third.

Only the Gram matrix, the sums and the components come to the driver; they have the size of the vector's
length (squared), not of the table. Components with a singular value under ``R_COND`` of the
largest are noise of the rank and left out, so a table of rank r has at most r of them.

Nulls: rows whose vector is null, or holds a null, a NaN or an infinity are left out. Of vectors of
several lengths those of the commonest length count (of the distinct ones; the longer of equally
common lengths), others are left out. Entries whose whole number is beyond ``LIMIT`` count as
``LIMIT``. Repeated rows are fitted once and each whitened. A table without rows, with one
distinct vector only or with empty vectors has no components and gives an empty result. Deviations
beyond 38 digits are null. Other columns are passed on; those named like the results are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, written

SCALE, OFFSET, COMPONENTS, R_COND = 64, 1_000_000, 16, 1e-6
#: Largest size of a whole number: doubles and differences are exact up to there.
LIMIT = 1 << 51
#: Entries that one step in a task works on.
_ENTRIES = 1 << 20
_LOW = (1 << 26) - 1


class Model(NamedTuple):
    n: int
    sums: tuple[int, ...]
    components: np.ndarray  # a column for each
    variances: np.ndarray
    explained: np.ndarray
    identity_error: float

    @property
    def dimensions(self) -> int:
        return len(self.sums)


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its entries are finite numbers."""
    finite = F.forall(vector, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    return F.coalesce(finite, F.lit(False))


def quantised(vector: Column, scale: int = SCALE, offset: int = OFFSET) -> Column:
    """floor(scale * c) + offset of each entry, as a double, cut to ``LIMIT``."""
    most = float(LIMIT - abs(offset))
    return F.transform(vector, lambda c: F.floor(F.greatest(F.least(c.cast("double") * scale, F.lit(most)), F.lit(-most))) + offset)


def _matrix(column: pa.Array, d: int) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, whole numbers) of pieces of a column of vectors of one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
    step = max(1, _ENTRIES // d)
    for a in range(0, len(flat), step):
        yield a, flat[a : a + step]


class Centre:
    """What a vector is less the mean S / n, and how far it is from it."""

    def __init__(self, n: int, sums: tuple[int, ...]):
        self.n = n
        self.whole = np.array([s // n for s in sums], np.int64)
        self.rest = [s % n for s in sums]
        self.fraction = np.array([r / n for r in self.rest])
        self.square = sum(r * r for r in self.rest)
        self.most = max([*self.rest, 1])

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole).astype(np.float64) - self.fraction

    def deviations(self, x: np.ndarray) -> list[int]:
        """Sum over dimensions of (n * x - S) squared, exact: with n * x - S = n * y - r it is n * n * sum(y * y) - 2 * n * sum(y * r) + sum(r * r)."""
        y = x - self.whole
        d, top = y.shape[1], max(int(np.abs(y).max(initial=0)), 1)
        if d * top * max(top, self.most) < 1 << 62:
            squares, mixed = (y * y).sum(axis=1).tolist(), (y @ np.array(self.rest, np.int64)).tolist()
        else:
            wide = y.astype(object)
            squares, mixed = (wide * wide).sum(axis=1).tolist(), (wide @ np.array(self.rest, object)).tolist()
        return [self.n * (self.n * a - 2 * b) + self.square for a, b in zip(squares, mixed, strict=True)]


def _decimals(values: list[int]) -> pa.Array:
    kind = pa.decimal128(38, 0)
    if all(v < 1 << 63 for v in values):
        return pa.array(values, pa.int64()).cast(kind)
    return pa.array([Decimal(v) if v < 10**38 else None for v in values], kind)


def _lists(values: np.ndarray) -> pa.Array:
    n, d = values.shape
    return pa.ListArray.from_arrays(np.arange(0, n * d + 1, d, dtype=np.int32), np.ascontiguousarray(values).ravel())


def _projected(vectors: DataFrame, centre: Centre, components: np.ndarray | None) -> DataFrame:
    """(v): centred vectors ``x``, projected if components are given."""
    d = len(centre.rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, x in _matrix(b.column("x"), d):
                y = centre.centred(x)
                yield pa.RecordBatch.from_arrays([_lists(y if components is None else y @ components)], ["v"])

    return vectors.select("x").mapInArrow(run, "v array<double>")


def _rows(vectors: DataFrame, n: int, d: int) -> RowMatrix:
    ml = vectors.select(array_to_vector("v").alias("v"))
    return RowMatrix(MLUtils.convertVectorColumnsFromML(ml, "v"), n, d)


def _total(vectors: DataFrame, centre: Centre) -> int:
    """Sum of all exact deviations."""
    d = len(centre.rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, x in _matrix(b.column("x"), d):
                yield pa.RecordBatch.from_arrays([_decimals([sum(centre.deviations(x))])], ["deviation"])

    return int(vectors.select("x").mapInArrow(run, "deviation decimal(38,0)").agg(F.sum("deviation")).first()[0] or 0)


def fit(vectors: DataFrame, components: int = COMPONENTS) -> Model:
    """Fits the distinct vectors ``x`` (arrays of longs without nulls)."""
    distinct = written(vectors.select("x").distinct(), "vectors")
    top = distinct.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    nothing = Model(0, (), np.zeros((0, 0)), np.zeros(0), np.zeros(0), 0.0)
    if top is None or not top["d"]:
        return nothing
    d, n = top["d"], top["count"]
    distinct = distinct.where(F.size("x") == d)
    # high and low parts apart, so that neither sum leaves a long
    parts = distinct.select(F.posexplode("x").alias("i", "c")).groupBy("i").agg(F.sum(F.shiftright("c", 26)).alias("high"), F.sum(F.col("c").bitwiseAND(F.lit(_LOW))).alias("low"))
    sums = tuple((r["high"] << 26) + r["low"] for r in sorted(parts.collect()))
    centre = Centre(n, sums)
    total = _total(distinct, centre)
    if not total:
        return nothing._replace(n=n, sums=sums)
    svd = _rows(_projected(distinct, centre, None), n, d).computeSVD(d, computeU=False, rCond=R_COND)
    singular, right = svd.s.toArray()[:components], svd.V.toArray()[:, :components]
    variances = singular * singular / n
    model = Model(n, sums, right, variances, variances * (n**3 / total), 0.0)
    white = _projected(distinct, centre, right / np.sqrt(variances))
    covariance = _rows(white, n, len(variances)).computeGramianMatrix().toArray() / n
    return model._replace(identity_error=float(np.abs(covariance - np.eye(len(variances))).max()))


def whiten(rows: DataFrame, model: Model) -> DataFrame:
    """``rows`` whose vector ``x`` has the model's length, without x, plus deviation decimal(38,0) and whitened array<double>."""
    kept = [c for c in rows.columns if c.lower() not in ("x", "deviation", "whitened")]
    kinds = "".join(f"`{c}` {rows.schema[c].dataType.simpleString()}, " for c in kept)
    d, k = model.dimensions, len(model.variances)
    centre, weights = Centre(max(model.n, 1), model.sums), model.components / np.sqrt(model.variances)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a, x in _matrix(b.column("x"), d):
                own = [b.column(c).slice(a, len(x)) for c in kept]
                yield pa.RecordBatch.from_arrays([*own, _decimals(centre.deviations(x)), _lists(centre.centred(x) @ weights)], [*kept, "deviation", "whitened"])

    wanted = rows.where(F.size("x") == d) if k else rows.limit(0)
    return wanted.select(*[F.col(f"`{c}`") for c in kept], "x").mapInArrow(run, f"{kinds}deviation decimal(38,0), whitened array<double>")


def by_component(whitened: DataFrame, model: Model) -> DataFrame:
    """A row for each whitened row and component, numbered from 1, with the model's figures."""
    at, value = fresh(whitened, "_at"), fresh(whitened, "_value")
    kept = [F.col(f"`{c}`") for c in whitened.columns if c.lower() not in ("whitened", "component", "n", "explained", "identity_error", "deviation")]
    each = whitened.select(*kept, "deviation", F.posexplode("whitened").alias(at, value))
    explained = F.array(*[F.lit(float(v)) for v in model.explained]).cast("array<double>")
    results = [(F.col(at) + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), F.col("deviation"), F.col(value).alias("whitened"), explained[F.col(at)].alias("explained"), F.lit(model.identity_error).alias("identity_error")]
    return each.select(*kept, *results)
