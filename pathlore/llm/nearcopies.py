"""Near copies: texts whose five-word shingles have a Jaccard similarity of 0.8 or more.

Texts with equal sets of shingles are folded first. The rest meet by SimHash: fingerprints of the
sets of shingles that differ in ``RADIUS`` bits at most are tied (blocks of equal bits and pivot
tables, see ``simhash``), equal ones to the smallest of their keys. A pair at similarity 0.8 may differ in more bits, so
texts meet by ``BANDS`` bands of ``ROWS`` min-hashes, too: such a pair shares none of them with a probability of 5 in a
million, one above that with less. Within a band each text is tied to one other only, and the components of
both kinds of ties are the candidate groups, so that every text is sent once, to its group. A group is
searched along links, which puts out fewer links than it has members: Jaccard distances of all
members to the first texts of the search are a table of pivots; by the triangle inequality a pair
is discarded if any coordinate differs by more than 0.2, and survivors are verified by their exact
similarity.

A group of over ``MEMBERS`` texts is dealt out in parts. All parts are compared with ``PICKED`` of the
group's texts as pivots. Texts that the pivots link to the group's largest component needn't be
compared with each other any more; what is left is a set of queries, which go in blocks against all
parts, with the distances to the pivots as their table. So no task holds more than a part, a block
and the pivots, and no link is lost.

Words are lower-cased (A-Z) and end at ASCII separators; a text of fewer than five words is one
shingle. Nulls: a null text is an empty one; all empty texts are copies of each other. Texts of any
length are read whole. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import simhash
from .common import Words, checkpoint, fresh, rolling, slices, small
from .graph import components

SHINGLE, BANDS, ROWS, PIVOTS, RADIUS = 5, 40, 6, 16, simhash.RADIUS
MEMBERS, PART, BLOCK, PICKED = 1024, 512, 256, 16
#: Least similarity, as a fraction of whole numbers.
LEAST = (4, 5)

_XOR = np.array([xxhash.xxh64_intdigest(f"xor {i}", 42) for i in range(BANDS * ROWS)], np.uint64)
_ODD = np.array([xxhash.xxh64_intdigest(f"odd {i}", 42) | 1 for i in range(BANDS * ROWS)], np.uint64)
_COLUMNS = 1 << 10


def shingles(texts: pa.Array) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's shingles."""
    words = Words(pc.ascii_lower(pc.fill_null(texts, "")))
    h = words.hashes()[words.codes]
    rolled, out = rolling(h, SHINGLE), []
    for a, b in zip(words.offsets.tolist(), words.offsets[1:].tolist(), strict=False):
        out.append(np.unique(rolled[a : b - SHINGLE + 1]) if b - a >= SHINGLE else rolling(h[a:b], b - a) if b > a else h[:0])
    return out


def band_keys(s: np.ndarray) -> np.ndarray:
    """A hash for each band of min-hashes of a set."""
    low = np.full(BANDS * ROWS, ~np.uint64(0))
    for a in range(0, len(s), _COLUMNS):
        low = np.minimum(low, ((s[None, a : a + _COLUMNS] ^ _XOR[:, None]) * _ODD[:, None]).min(axis=1))
    raw = low.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(row.tobytes(), i) for i, row in enumerate(raw)], np.uint64)


def fingerprint(s: np.ndarray) -> np.uint64:
    """The SimHash of a set: a bit is set if it is in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for a in range(0, len(s), _COLUMNS):
        ones += np.unpackbits(s[a : a + _COLUMNS].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(s), bitorder="little").view(np.uint64)[0]


def with_keys(docs: DataFrame) -> DataFrame:
    """(doc_id, t, key, fp, bands): hashes of the text and of its set of shingles, the set's fingerprint and its bands."""
    kind = docs.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 1 << 20):
            sets = shingles(b.column("text"))
            key = np.array([xxhash.xxh64_intdigest(s.tobytes(), 42) for s in sets], np.uint64).view(np.int64)
            bands = pa.array([band_keys(s).view(np.int64) for s in sets], pa.list_(pa.int64()))
            fp = pa.array(np.array([fingerprint(s) for s in sets], np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("t"), pa.array(key), fp, bands], ["doc_id", "t", "key", "fp", "bands"])

    return docs.select("doc_id", text_key().alias("t"), "text").mapInArrow(run, f"doc_id {kind.simpleString()}, t long, key long, fp long, bands array<long>")


def text_key():
    return F.xxhash64(F.coalesce("text", F.lit("")))


def to_first(held: DataFrame) -> DataFrame:
    """(a, b): each key beside the first key that has the same ``band``, from (band, key)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, head = None, None
        for b in batches:
            band, key = (b.column(i).to_numpy() for i in range(2))
            if not len(band):
                continue
            new = np.concatenate([[band[0] != last if last is not None else True], band[1:] != band[:-1]])
            at = np.maximum.accumulate(np.where(new, np.arange(len(band)), -1))
            first = np.where(at >= 0, key[at], head if head is not None else 0)
            last, head = band[-1], first[-1]
            if len(own := np.flatnonzero(~new)):
                yield pa.RecordBatch.from_arrays([pa.array(first[own]), pa.array(key[own])], ["a", "b"])

    return held.repartition("band").sortWithinPartitions("band", "key").mapInArrow(run, "a long, b long")


def ties(folded: DataFrame) -> DataFrame:
    """(a, b): ties of the keys that share a band, each to the band's first key."""
    return to_first(folded.select(F.explode("bands").alias("band"), "key"))


def simhash_ties(folded: DataFrame) -> DataFrame:
    """(a, b): ties of the keys whose fingerprints differ in ``RADIUS`` bits at most, a forest of these links."""
    heads = checkpoint(folded.groupBy("fp").agg(F.min("key").alias("head")))
    near = simhash.links(heads.select("fp"), RADIUS)
    for end in ("a", "b"):
        near = near.join(heads.select(F.col("fp").alias(end), F.col("head").alias(f"head_{end}")), end)
    same = to_first(folded.select(F.col("fp").alias("band"), "key"))
    return same.unionByName(near.select(F.col("head_a").alias("a"), F.col("head_b").alias("b")))


def forest(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Spanning edges (positions) of the links among distinct sets, by a table of pivots."""
    num, den = LEAST
    size = np.array([len(s) for s in sets])
    if not size.all():  # an empty set is like no other
        at = np.flatnonzero(size)
        return [(int(at[a]), int(at[b])) for a, b in forest([sets[i] for i in at])]
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1] if sets else np.zeros(0, np.int64)
    begin = np.concatenate([[0], np.cumsum(size)])
    mark = np.zeros(int(codes.max(initial=-1)) + 1, bool)

    def common(x: int, others: np.ndarray) -> np.ndarray:
        mark[codes[begin[x] : begin[x + 1]]] = True
        own = codes if len(others) == len(sets) else np.concatenate([codes[begin[y] : begin[y + 1]] for y in others])
        out = np.add.reduceat(mark[own], np.cumsum(size[others]) - size[others], dtype=np.int64)
        mark[codes[begin[x] : begin[x + 1]]] = False
        return out

    table, everyone, left, edges = [], np.arange(len(sets)), np.arange(len(sets)), []
    while len(left):
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = left[den * np.minimum(size[left], size[x]) >= num * np.maximum(size[left], size[x])]
            for row in table:
                near = near[np.abs(row[near] - row[x]) <= 1 - num / den + 1e-9]
            if not len(near):
                continue
            if len(table) < PIVOTS and len(sets) > PIVOTS:
                shared = common(x, everyone)
                table.append(1 - shared / (size + size[x] - shared))
                shared = shared[near]
            else:
                shared = common(x, near)
            near = near[den * shared >= num * (size[near] + size[x] - shared)]
            if len(near):
                edges += [(x, int(y)) for y in near]
                queue += near.tolist()
                left = np.setdiff1d(left, near, assume_unique=True)
    return edges


def links(grouped: DataFrame) -> DataFrame:
    """(a, b): keys of verified links, a forest of each group, from (grp, key, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, keys, sets = None, [], []

        def close() -> pa.RecordBatch | None:
            if not (edges := forest(sets)):
                return None
            at = np.array(edges, np.int64)
            own = np.array(keys, np.int64)
            return pa.RecordBatch.from_arrays([pa.array(own[at[:, i]]) for i in (0, 1)], ["a", "b"])

        for b in slices(batches, "text", 1 << 20):
            for g, k, s in zip(b.column("grp").to_pylist(), b.column("key").to_pylist(), shingles(b.column("text")), strict=True):
                if g != group:
                    if sets and (out := close()):
                        yield out
                    group, keys, sets = g, [], []
                keys.append(k)
                sets.append(s)
        if sets and (out := close()):
            yield out

    return grouped.select("grp", "key", "text").repartition("grp").sortWithinPartitions("grp", "key").mapInArrow(run, "a long, b long")


def _similar(one: np.ndarray, sizes: np.ndarray, shared: np.ndarray) -> np.ndarray:
    num, den = LEAST
    return den * shared >= num * (sizes + len(one) - shared)


def _shared(one: np.ndarray, sets: list[np.ndarray]) -> np.ndarray:
    """How many hashes a sorted set shares with each of several."""
    if not sets or not len(one):
        return np.zeros(len(sets), np.int64)
    flat = np.concatenate(sets)
    at = np.minimum(np.searchsorted(one, flat), len(one) - 1)
    ends = np.concatenate([[0], np.cumsum(one[at] == flat)])
    cut = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    return ends[cut[1:]] - ends[cut[:-1]]


def with_sets(grouped: DataFrame) -> DataFrame:
    """(grp, key, set binary) from (grp, key, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 1 << 20):
            own = pa.array([s.tobytes() for s in shingles(b.column("text"))], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("grp"), b.column("key"), own], ["grp", "key", "set"])

    return grouped.select("grp", "key", "text").mapInArrow(run, "grp long, key long, set binary")


def _parts(batches: Iterator[pa.RecordBatch], close) -> Iterator[pa.RecordBatch]:
    """What ``close`` makes of the rows (dicts) of each part, from rows sorted by their part."""
    part, rows = None, []
    for b in batches:
        for at in range(0, b.num_rows, 64):
            for r in b.slice(at, 64).to_pylist():
                if r["part"] != part and rows:
                    if (out := close(rows)) is not None:
                        yield out
                    rows = []
                part = r["part"]
                rows.append(r)
    if rows and (out := close(rows)) is not None:
        yield out


def _to_pivots(rows: list[dict]) -> pa.RecordBatch:
    """(grp, key, near, far): each member's pivots that are like it, and its distances to all of them by number."""
    pivots = sorted((r for r in rows if r["number"] is not None), key=lambda r: r["number"])
    members = [r for r in rows if r["number"] is None]
    sets = [np.frombuffer(r["set"], np.uint64) for r in members]
    size = np.array([len(s) for s in sets])
    near, far = [[] for _ in members], []
    for p in pivots:
        one = np.frombuffer(p["set"], np.uint64)
        shared = _shared(one, sets)
        far.append(1 - shared / np.maximum(size + len(one) - shared, 1))
        for i in np.flatnonzero(_similar(one, size, shared)).tolist():
            if members[i]["key"] != p["key"]:
                near[i].append(p["key"])
    table = np.array(far).T if far else np.zeros((len(members), 0))
    columns = [pa.array([r["grp"] for r in members], pa.int64()), pa.array([r["key"] for r in members], pa.int64()), pa.array(near, pa.list_(pa.int64())), pa.array(table.tolist(), pa.list_(pa.float64()))]
    return pa.RecordBatch.from_arrays(columns, ["grp", "key", "near", "far"])


def _to_queries(rows: list[dict]) -> pa.RecordBatch | None:
    """(a, b): links of a block of queries with the members of a part."""
    queries, members = ([r for r in rows if r["asks"] == k] for k in (True, False))
    sets = [np.frombuffer(r["set"], np.uint64) for r in members]
    size, table = np.array([len(s) for s in sets]), np.array([r["far"] for r in members])
    out, limit = [], 1 - LEAST[0] / LEAST[1] + 1e-9
    for q in queries if members else []:
        one = np.frombuffer(q["set"], np.uint64)
        at = np.flatnonzero((np.abs(table - np.array(q["far"])) <= limit).all(axis=1))
        good = at[_similar(one, size[at], _shared(one, [sets[i] for i in at]))]
        out += [(q["key"], members[i]["key"]) for i in good.tolist() if members[i]["key"] != q["key"]]
    if not out:
        return None
    pairs = np.array(out, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, i]) for i in (0, 1)], ["a", "b"])


def _largest(rows: pd.DataFrame) -> pd.DataFrame:
    """(grp, main): a group's pivots in the component that most of its members are linked to, from (grp, near, n) of distinct lists of pivots."""
    root: dict[int, int] = {}

    def find(k: int) -> int:
        while root.setdefault(k, k) != k:
            k = root[k]
        return k

    for near in rows["near"]:
        for k in near[1:]:
            a, b = find(near[0]), find(k)
            root[max(a, b)] = min(a, b)
    count: dict[int, int] = {}
    for near, n in zip(rows["near"], rows["n"], strict=True):
        count[find(near[0])] = count.get(find(near[0]), 0) + n
    best = min(count, key=lambda k: (-count[k], k))
    return pd.DataFrame({"grp": [rows["grp"].iloc[0]], "main": [[k for k in list(root) if find(k) == best]]})


def links_of_large(grouped: DataFrame, sizes: DataFrame) -> DataFrame:
    """(a, b): keys of verified links that join the same components as all links do, from (grp, key, text) of large groups and their sizes (grp, n)."""
    parts = F.ceil(F.col("n") / PART).cast("long")
    members = with_sets(grouped).join(sizes.select("grp", parts.alias("parts")), "grp")
    members = checkpoint(members.withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts"))))
    # the first few of each part by hash, then of each group: what meets is bounded
    few = members.select("grp", "part", "key", F.xxhash64("key", F.lit("pivot")).alias("o")).withColumn("i", F.row_number().over(Window.partitionBy("grp", "part").orderBy("o", "key"))).where(F.col("i") <= PICKED)
    few = few.withColumn("number", F.row_number().over(Window.partitionBy("grp").orderBy("o", "key"))).where(F.col("number") <= PICKED).select("grp", "key", "number")
    every_part = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    pivots = few.join(members.select("grp", "key", "set", "parts"), ["grp", "key"]).withColumn("part", every_part)
    rows = members.withColumn("number", F.lit(None).cast("int")).unionByName(pivots).select(F.struct("grp", "part").alias("part"), "grp", "key", "number", "set")
    told = checkpoint(rows.repartition("part").sortWithinPartitions("part").mapInArrow(lambda batches: _parts(batches, _to_pivots), "grp long, key long, near array<long>, far array<double>"))
    edges = told.select(F.col("key").alias("a"), F.explode("near").alias("b"))
    lists = told.where(F.size("near") > 0).groupBy("grp", F.array_sort("near").alias("near")).agg(F.count("*").alias("n"))
    main = lists.groupBy("grp").applyInPandas(_largest, "grp long, main array<long>")
    settled = F.arrays_overlap("near", "main") | F.array_contains("main", F.col("key"))
    left = checkpoint(told.join(main, "grp", "left").where(~F.coalesce(settled, F.lit(False))).select("grp", "key"))
    if left.isEmpty():
        return edges
    far = members.join(told.select("key", "far"), "key")
    blocks = checkpoint(left.groupBy("grp").agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("blocks")))
    asked = far.join(left, ["grp", "key"]).join(blocks, "grp")
    asked = asked.withColumn("block", F.pmod(F.xxhash64("key", F.lit("block")), F.col("blocks"))).withColumn("part", every_part)
    held = far.join(blocks, "grp").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    columns = [F.struct("grp", "part", "block").alias("part"), "key", "set", "far"]
    both = asked.select(*columns, F.lit(True).alias("asks")).unionByName(held.select(*columns, F.lit(False).alias("asks")))
    rows = both.repartition("part").sortWithinPartitions("part")
    return edges.unionByName(rows.mapInArrow(lambda batches: _parts(batches, _to_queries), "a long, b long"))


def with_components(docs: DataFrame, members: int = MEMBERS) -> DataFrame:
    """(doc_id, t, component): a row for each document; ``component`` is a number that near copies share.

    Candidate groups of over ``members`` texts are dealt out, the others searched by one task each.
    """
    keyed = checkpoint(with_keys(docs))
    folded = keyed.groupBy("key").agg(F.min_by("bands", "t").alias("bands"), F.min("fp").alias("fp"), F.min("t").alias("t"))
    groups = components(simhash_ties(folded).unionByName(ties(folded)))
    grouped = checkpoint(groups.select(F.col("u").alias("key"), F.col("v").alias("grp")).unionByName(groups.select(F.col("v").alias("key"), F.col("v").alias("grp")).distinct()))

    def with_texts(own: DataFrame) -> DataFrame:
        wanted = own.join(folded.select("key", "t"), "key")
        return docs.select(text_key().alias("t"), F.coalesce("text", F.lit("")).alias("text")).join(wanted, "t").dropDuplicates(["key"])

    sizes = checkpoint(grouped.groupBy("grp").agg(F.count("*").alias("n")).where(F.col("n") > members))
    if sizes.isEmpty():
        edges = links(with_texts(grouped))
    else:
        sizes = small(sizes)
        large, rest = (with_texts(grouped.join(sizes.select("grp"), "grp", how)) for how in ("left_semi", "left_anti"))
        edges = links(rest).unionByName(links_of_large(large, sizes))
    roots = components(edges)
    return keyed.select("doc_id", "t", "key").join(roots.withColumnRenamed("u", "key"), "key", "left").select("doc_id", "t", F.coalesce("v", "key").alias("component"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each component: that with the smallest id (a null id only if there is no other), of repeats of it any one.

    Columns of ``docs`` pass on whatever their names. What is kept is written, so that the join can
    split a text that many rows have.
    """
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t")
    best = with_components(docs.select("doc_id", "text")).groupBy("component", row.alias("row")).count().groupBy("component").agg(F.min_by("count", "row").alias("n"), F.min("row").alias("row"))
    key, n, own_id, own_t = (fresh(docs, c) for c in ("_key", "_n", "_id", "_t"))
    kept = checkpoint(best.select(F.col("n").alias(n), F.col("row.doc_id").alias(own_id), F.col("row.t").alias(own_t)))  # about as many rows as docs
    own = docs.withColumn(key, text_key()).join(kept, (F.col(key) == F.col(own_t)) & F.col("doc_id").eqNullSafe(F.col(own_id)))
    repeated = own.where(F.col(n) > 1).dropDuplicates([key, "doc_id"])
    return own.where(F.col(n) == 1).unionByName(repeated).select(*[F.col(f"`{c}`") for c in docs.columns])
