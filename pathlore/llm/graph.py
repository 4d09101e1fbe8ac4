"""Connected components of an edge list, by alternating stars within tasks and across them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import checkpoint

#: Edges that a task holds at once.
HELD = 1 << 20


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of these edges that isn't its component's smallest, and that smallest node."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while (root[a] != root[b]).any():
        one, two = root[a], root[b]
        np.minimum.at(root, np.maximum(one, two), np.minimum(one, two))
        while (root[root] != root).any():
            root = root[root]
    own = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[own], nodes[root[own]]


def _contracted(edges: DataFrame) -> DataFrame:
    """(u, v): the edges of each task as stars, which join what the edges join and are no more than them."""
    kind = edges.schema["u"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def close(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(stars(u, v), schema.types, strict=True)], ["u", "v"])

        for b in batches:
            schema = b.schema
            for at in range(0, b.num_rows, HELD):
                held.append([x.to_numpy(zero_copy_only=False) for x in b.slice(at, HELD).columns])
                n += len(held[-1][0])
                if n >= HELD:
                    u, v = (np.concatenate(x) for x in zip(*held, strict=True))
                    end = int(np.flatnonzero(u != u[-1]).max(initial=-1)) + 1  # what is sorted keeps a node's rows together
                    if end:
                        yield close(u[:end], v[:end])
                    held, n = [[u[end:], v[end:]]], len(u) - end
        if n:
            yield close(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return edges.mapInArrow(run, f"u {kind}, v {kind}")


def components(edges: DataFrame) -> DataFrame:
    """(u, v): each node with an edge, other than a component's smallest, beside that smallest node.

    ``edges`` has two orderable columns of one type, in either direction; loops and repeats are
    ignored, an edge with a null too. An empty input gives an empty result. Each task turns its edges into stars, so
    that a node has few rows for each task however many edges it has. A round ties each node to its parents'
    smallest parents and makes stars of what meets at a node; it costs four small shuffles and cuts the lineage with
    checkpoints. The sum of all edges' ends falls until no parent has one, and each node has one; rounds grow
    with the logarithm of the diameter. Nothing but a count comes to the driver.
    """
    a, b = (F.col(c) for c in edges.columns[:2])
    e = checkpoint(_contracted(edges.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))))
    while True:
        ends = e.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.col("v").alias("p")), F.struct(F.col("v").alias("x"), F.lit(None).alias("p")))).alias("end")).select("end.*")
        parents = ends.groupBy("x").agg(F.min("p").alias("low"), F.max("p").alias("high"), F.bool_or(F.col("p").isNull()).alias("has"))
        # written, so that the join can split the edges of a hub
        open_ends = Observation()
        low = checkpoint(parents.where("low is not null").observe(open_ends, F.count_if(F.expr("has or low != high")).alias("n")))
        if not open_ends.get["n"]:
            return low.select(F.col("x").alias("u"), F.col("low").alias("v"))
        jumped = e.join(low.select(F.col("x").alias("v"), "low"), "v", "left").select("u", F.coalesce("low", "v").alias("v"))
        e = checkpoint(_contracted(_contracted(jumped).repartition("u").sortWithinPartitions("u")))
