"""SimHash near-duplicates with pivot distance tables.

A document's fingerprint has 64 bits; two documents link where at most ``radius`` (2) bits differ.
Exact copies of a fingerprint are folded first. The rest meet in blocks of equal bits: the 64 bits
are cut into ``radius + 2`` parts, and fingerprints within the radius agree on all bits of at least
two parts, so each pair of parts is one block key and no link is missed. Within a block every
member has a row in a table of Hamming distances to reference fingerprints (pivots). By the
triangle inequality a pair is discarded if any coordinate differs by more than the radius; the
survivors are verified bit by bit. A search along links gives a spanning forest of the block, so
it puts out fewer edges than it has members, never its pairs. A block with more than
``TABLE_MEMBERS`` members is first split by the cells of ``CELL`` distances to ``SPLIT_PIVOTS`` pivots: linked
fingerprints share a cell of each. What is still that large is split by bits: those that the block leaves
open are cut into ``radius + 1`` parts, of which linked fingerprints share one, and again. Each time a third of the open
bits goes, and k open bits have 2^k members at most, so no block of any group stays larger.

Nulls: a null text is an empty one, with fingerprint zero. A null id takes part in links but is
never a component's name (null only if the component has no other id). Rows with equal ids are
rows of their own. Texts of any length are read whole. Empty tables give empty results. Other
columns don't matter, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, slices, small
from .graph import components

SHINGLE, SEED, RADIUS, PIVOTS, SPLIT_PIVOTS, TABLE_MEMBERS = 3, 42, 2, 16, 4, 2048
#: Distances in a cell of a pivot: one more than the radius, so that linked fingerprints lie in the same cell or adjacent ones.
CELL = RADIUS + 1

#: Reference fingerprints of the distance tables.
REFERENCES = np.array([xxhash.xxh64_intdigest(f"pivot {i}", SEED) for i in range(PIVOTS)], np.uint64)
_ROWS = 1 << 15


def fingerprints(texts: list[str | None], shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """The 64-bit fingerprint of each whole text: a bit is set if it is in over half of the shingles' hashes."""
    digest, hashes, counts = xxhash.xxh64_intdigest, [], []
    for text in texts:
        words = (text or "").encode().lower().split()  # bytes: A-Z and the ASCII separators only
        joined = b" ".join(words)
        n = len(words)
        if n <= shingle:
            hashes += [digest(joined, seed)] * (n > 0)
            counts.append(int(n > 0))
            continue
        size = np.fromiter(map(len, words), np.int64, n)
        end = np.cumsum(size + 1) - 1
        hashes += [digest(joined[a:b], seed) for a, b in zip((end - size)[: n - shingle + 1].tolist(), end[shingle - 1 :].tolist(), strict=True)]
        counts.append(n - shingle + 1)
    flat, total = np.array(hashes, np.uint64), np.array(counts, np.int64)
    ends = np.cumsum(total)
    ones = np.zeros((len(texts), 64), np.int64)
    owner = np.repeat(np.arange(len(texts)), total)
    for a in range(0, len(flat), _ROWS):
        part, who = flat[a : a + _ROWS], owner[a : a + _ROWS]
        first = np.flatnonzero(np.diff(who, prepend=-1))
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones[who[first]] += np.add.reduceat(bits, first, axis=0, dtype=np.int64)
    assert not len(ends) or ends[-1] == len(flat)
    return np.packbits(2 * ones > total[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def with_fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, fp long): the fingerprint's bits as a signed number."""
    kind = docs.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 1 << 20):
            fp = fingerprints(b.column("text").to_pylist(), shingle, seed)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind.simpleString()}, fp long")


def block_masks(radius: int = RADIUS) -> list[int]:
    """Pairs of the radius + 2 parts of 64 bits, as bit masks."""
    cuts = [64 * i // (radius + 2) for i in range(radius + 3)]
    parts = [sum(1 << i for i in range(a, b)) for a, b in zip(cuts, cuts[1:], strict=False)]
    return [a | b for a, b in combinations(parts, 2)]


def pivot_table(fp: np.ndarray) -> np.ndarray:
    """Hamming distances of each fingerprint to the references, a row for each reference."""
    return np.bitwise_count(fp[None, :] ^ REFERENCES[:, None]).astype(np.int8)


def forest(fp: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Spanning edges (positions) of the links among distinct fingerprints, by the pivot table."""
    table, left, edges = pivot_table(fp), np.arange(len(fp)), []
    while len(left):
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            x, near = queue.pop(), left
            for row in table:  # discard by coordinate, then verify what is left
                near = near[np.abs(row[near] - row[x]) <= radius]
                if not len(near):
                    break
            near = near[np.bitwise_count(fp[near] ^ fp[x]) <= radius]
            if len(near):
                edges += [(x, int(y)) for y in near]
                queue += near.tolist()
                left = np.setdiff1d(left, near, assume_unique=True)
    return edges


def cells(fp, pivot: int):
    """The cells of ``CELL`` distances to a pivot in which a fingerprint may meet another: its own, and the one below where its border is within the radius."""
    ref = int(REFERENCES[pivot].view(np.int64))
    d = F.bit_count(F.col(fp).bitwiseXOR(F.lit(ref)))
    own = F.floor(d / CELL)
    return F.when(d % CELL < RADIUS, F.array(own, own - 1)).otherwise(F.array(own))


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def cuts(free: int, radius: int = RADIUS) -> list[int]:
    """Open bits cut into ``radius + 1`` parts, as masks."""
    bits = [i for i in range(64) if free >> i & 1]
    ends = [len(bits) * i // (radius + 1) for i in range(radius + 2)]
    return [sum(1 << i for i in bits[a:b]) for a, b in zip(ends, ends[1:], strict=False)]


def split_blocks(blocks: DataFrame, members: int = TABLE_MEMBERS, radius: int = RADIUS) -> DataFrame:
    """(key, fp) of blocks, those with over ``members`` members split by the cells of pivots, then by bits.

    ``blocks`` has (key, fp) and ``free``, the mask of the bits that a block leaves open (without it: all). Two linked
    fingerprints differ by the radius at most in each pivot's distance, so they share a cell of each,
    and in the open bits, so they share one of ``radius + 1`` parts: no link is lost. A pivot more costs two
    thirds of a row for each member, a cut by bits ``radius`` rows.
    """
    spark, every = blocks.sparkSession, (1 << 64) - 1
    blocks = blocks.select("key", "fp", F.col("free") if "free" in blocks.columns else F.lit(signed(every)).cast("long").alias("free"))
    out, pivots = None, False
    while True:
        sizes = blocks.groupBy("key", "free").count().where((F.col("count") > members) & (F.bit_count("free") > radius))
        large = checkpoint(sizes.select("key", "free"))
        if large.isEmpty():
            return (blocks if out is None else out.unionByName(blocks)).select("key", "fp")
        keys = small(large.select("key"))
        done = blocks.join(keys, "key", "left_anti")
        out = done if out is None else out.unionByName(done)
        blocks = blocks.join(keys, "key", "left_semi")
        if not pivots:
            for p in range(SPLIT_PIVOTS):
                blocks = blocks.withColumn("cell", F.explode(cells("fp", p))).select(F.xxhash64("key", "cell").alias("key"), "fp", "free")
            pivots = True
            continue
        # masks, not blocks: radius + 1 for each before, and no more rounds than a third less bits each time allow
        frees = [r[0] & every for r in large.select("free").distinct().collect()]
        parts = [(signed(f), signed(part), signed(f & ~part & every)) for f in frees for part in cuts(f, radius)]
        table = F.broadcast(spark.createDataFrame(parts, "free long, part long, open long"))
        blocks = blocks.join(table, "free").select(F.xxhash64("key", "part", F.col("fp").bitwiseAND(F.col("part"))).alias("key"), "fp", F.col("open").alias("free"))


def links(distinct: DataFrame, radius: int = RADIUS, members: int = TABLE_MEMBERS) -> DataFrame:
    """(a, b): edges of a forest whose components are those of all links among the distinct ``fp``."""
    masks = block_masks(radius)
    keys = [F.struct(F.xxhash64(F.lit(k), F.col("fp").bitwiseAND(F.lit(signed(m)))).alias("key"), F.lit(signed(~m & (1 << 64) - 1)).cast("long").alias("free")) for k, m in enumerate(masks)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_key, held = None, []

        def close():
            fp = np.concatenate(held).view(np.uint64)
            if len(fp) < 2:
                return None
            if not (e := forest(fp, radius)):
                return None
            at = np.array(e, np.int64)
            return pa.RecordBatch.from_arrays([pa.array(fp[at[:, i]].view(np.int64)) for i in (0, 1)], ["a", "b"])

        for b in batches:
            key, fp = (b.column(i).to_numpy() for i in range(2))
            if not len(fp):
                continue
            cut = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(fp)]
            for i, j in zip(cut, cut[1:], strict=False):
                if key[i] != open_key:
                    if held and (out := close()):
                        yield out
                    open_key, held = key[i], []
                held.append(fp[i:j])
        if held and (out := close()):
            yield out

    blocks = distinct.select(F.explode(F.array(*keys)).alias("k"), "fp").select("k.key", "fp", "k.free")
    dealt = split_blocks(blocks, members, radius).repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp long, component_id): a row for each document; see the module for nulls and ties."""
    fps = checkpoint(with_fingerprints(docs, shingle, seed))
    folded = fps.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count("*").alias("n"))
    roots = components(links(folded.select("fp"), radius))
    named = folded.join(roots, folded.fp == roots.u, "left").select("fp", "low", "n", F.coalesce("v", "fp").alias("root"))
    lows = named.where("root != fp").groupBy("root").agg(F.min("low").alias("others"))
    # the root's own id competes too: roots are the smallest fingerprints, not the smallest ids
    best = lows.join(folded.select(F.col("fp").alias("root"), "low"), "root").select("root", F.least("others", "low").alias("best"))
    # only fingerprints with a partner need a name; written, so that the join can split those that many rows have
    of = checkpoint(named.join(best, "root", "left").where("n > 1 or best is not null").select("fp", F.coalesce("best", "low").alias("component_id"), F.lit(True).alias("found")))
    named_rows = fps.join(small(of), "fp", "left")
    return named_rows.select("doc_id", "fp", F.when(F.col("found"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def fingerprint_hex(fp):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
