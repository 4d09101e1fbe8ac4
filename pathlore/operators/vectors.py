"""Hashed embeddings, picture hashes, and merging of vectors that are near each other."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathlore.operators.merging import written

DIMENSIONS = 384


def hashed(docs: DataFrame, key: str, text: str, dimensions: int = DIMENSIONS) -> DataFrame:
    """(key, place, value): the embedding of each text by feature hashing, as its places that aren't zero, with norm 1.

    Each word of 3 or more word characters adds or takes 1 at four places: bytes 0, 4, 8 and 12 of
    its MD5 name them, the byte behind each the sign. Texts without words, and places that cancel
    out, have no rows.
    """
    words = F.filter(F.split(F.regexp_replace(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^a-z0-9_\s]", " "), r"\s+"), lambda w: F.length(w) > 2)
    # dealt by key once, as texts, so that no sum below is dealt again; a word's number of uses first, so its hash is taken once for each text
    tf = docs.select(key, text).repartition(key).select(key, F.explode(words).alias("word")).groupBy(key, "word").agg(F.count("*").alias("n"))
    digest = F.md5("word")
    byte = lambda i: F.conv(F.substring(digest, 2 * i + 1, 2), 16, 10).cast("int")
    at = F.explode(F.array(*[F.struct((byte(4 * i) % dimensions).alias("place"), (byte(4 * i + 1) % 2 * 2 - 1).alias("sign")) for i in range(4)]))
    sums = tf.select(key, "n", at.alias("a")).groupBy(key, F.col("a.place").alias("place")).agg(F.sum(F.col("n") * F.col("a.sign")).alias("v")).where("v != 0")
    norm = F.sqrt(F.sum(F.col("v") * F.col("v")).over(Window.partitionBy(key)))
    return sums.select(key, "place", (F.col("v") / norm).alias("value"))


def dense(sparse: DataFrame, key: str, dimensions: int = DIMENSIONS) -> DataFrame:
    """(key, embedding array<float>) from (key, place, value)."""
    m = sparse.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("place", "value"))).alias("m"))
    places = F.sequence(F.lit(0), F.lit(dimensions - 1))
    return m.select(key, F.transform(places, lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)).cast("float")).alias("embedding"))


def difference_bits(pixels: Column, width: int = 9, height: int = 8) -> Column:
    """A picture's difference hash as text of 0 and 1, by rows: whether each of a row's grey values is below the next."""
    at = lambda i: F.floor(i / (width - 1)) * width + i % (width - 1)
    bit = lambda i: F.when(F.get(pixels, at(i).cast("int")) < F.get(pixels, (at(i) + 1).cast("int")), "1").otherwise("0")
    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit((width - 1) * height - 1)), bit), "")


#: Vectors that are settled in a round, clusters that a task scores them with, and clusters that are kept for each vector.
ROUND, CLUSTERS, KEPT = 16384, 8192, 16
#: What meets in a round: vectors (kind 0, unit), the clusters that would take them as they stand (1, near), and those clusters' sums and sizes (2).
_MET = "scope string, kind int, place long, near array<long>, unit array<double>, n long"


def _in_rounds(rows: DataFrame, order: list[Column]) -> DataFrame:
    """``rows`` with their place in the order by scope and ``order``, and the round that the place is in; written."""
    own = written(rows.orderBy("scope", *order).withColumn("place", F.monotonically_increasing_id()), "places")
    part = F.shiftright("place", 33)
    sizes = own.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.orderBy("_part")) - F.col("_n"))  # a row for each task of the sort
    rank = F.col("_before") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    return written(own.join(F.broadcast(before), part == F.col("_part")).withColumn("round", F.floor(rank / ROUND)).drop("_part", "_n", "_before"), "rounds", "round")


def _scored(least: float):
    """For vectors beside some of the clusters: the first few clusters that would take each, and what those clusters are."""

    def run(key: tuple, vectors: pd.DataFrame, clusters: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(vectors) and len(clusters):
            clusters = clusters.sort_values("first")
            first, total = clusters["first"].to_numpy(), np.array(clusters["total"].tolist(), float)
            n = clusters["n"].to_numpy()
            places, units, used = vectors["place"].to_numpy(), np.array(vectors["unit"].tolist(), float), np.zeros(len(n), bool)
            for i in range(0, len(units), 1024):
                at, to = np.nonzero(units[i : i + 1024] @ (total / n[:, None]).T >= least - 1e-12)
                few = np.arange(len(at)) - np.searchsorted(at, at) < KEPT
                at, to = at[few], to[few]
                used[to] = True
                begin = np.flatnonzero(np.diff(at, prepend=-1))
                out += [(key[0], 1, places[i + at[b]], near, None, 0) for b, near in zip(begin, np.split(first[to], begin[1:]), strict=bool(len(at)))]
            out += [(key[0], 2, first[c], None, total[c], n[c]) for c in np.flatnonzero(used)]
        return pd.DataFrame(out, columns=["scope", "kind", "place", "near", "unit", "n"])

    return run


def _settled(least: float):
    """The cluster of each vector of a round, in their order, and (without a place) the clusters that changed.

    Ends before a vector whose kept clusters have all changed, if others behind them might take it.
    """

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        own = rows[rows["kind"] == 0].sort_values("place")
        near: dict[int, list[int]] = {}
        for place, some in rows.loc[rows["kind"] == 1, ["place", "near"]].itertuples(index=False):
            near[place] = sorted([*near.get(place, []), *some.tolist()])[:KEPT]
        known = {c: (total, n) for c, total, n in rows.loc[rows["kind"] == 2, ["place", "unit", "n"]].itertuples(index=False)}
        units = np.array(own["unit"].tolist(), float)
        total, n, first, at, out = np.zeros_like(units), np.zeros(len(units)), np.zeros(len(units), np.int64), {}, []
        for place, unit in zip(own["place"].tolist(), units, strict=True):
            m, some = len(at), near.get(place, [])
            takes = first[:m][total[:m] @ unit / n[:m] >= least - 1e-12]
            changed = int(takes.min()) if len(takes) else None
            as_it_was = next((c for c in some if c not in at), None)
            if as_it_was is None and len(some) == KEPT and (changed is None or changed > some[-1]):
                break
            best = min((c for c in (changed, as_it_was) if c is not None), default=place)
            if best not in at:
                at[best], first[m] = m, best
                if best in known:
                    total[m], n[m] = known[best]
            total[at[best]] += unit
            n[at[best]] += 1
            out.append((key[0], place, best, None, 0))
        out += [(key[0], None, c, t, k) for c, t, k in zip(first[: len(at)], total, n, strict=False)]
        return pd.DataFrame(out, columns=["scope", "place", "first", "total", "n"]).astype({"place": "Int64", "first": "int64", "n": "int64"})

    return run


def first_fit(rows: DataFrame, least: float, order: list[Column]) -> DataFrame:
    """``rows`` (scope string, unit, others) with their ``place`` in the order and the place of the ``first`` member of the cluster that each is in.

    In the order, a vector joins the first cluster of its scope whose members' mean cosine with it is ``least`` or more, else it makes
    one; just as if each vector left made a cluster and went through those behind it. A cluster is the sum of
    its unit vectors and their number, so vectors are settled in rounds of ``ROUND``: they are scored with the clusters so far, in parts of
    about ``CLUSTERS``, and one task for each scope goes through the round in its order with the clusters that would take its vectors and
    those that change meanwhile. So no task holds more than a round and a part, and vectors of different rounds never meet.
    """
    own = _in_rounds(rows, order)
    clusters = told = None
    for i, n in sorted(own.groupBy("round").count().collect()):
        left = own.where(F.col("round") == i).select("scope", "place", "unit")
        while n:
            met = left.select("scope", F.lit(0).alias("kind"), "place", F.lit(None).cast("array<long>").alias("near"), "unit", F.lit(0).cast("long").alias("n"))
            if clusters is not None:
                parts = -(-clusters.count() // CLUSTERS)
                held = clusters.withColumn("part", F.pmod(F.xxhash64("first"), F.lit(parts)).cast("int"))
                asked = left.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
                met = met.unionByName(asked.groupBy("scope", "part").cogroup(held.groupBy("scope", "part")).applyInPandas(_scored(least), _MET))
            new = written(met.groupBy("scope").applyInPandas(_settled(least), "scope string, place long, first long, total array<double>, n long"), "settled")
            changed = new.where("place is null").drop("place")
            clusters = written(changed if clusters is None else clusters.join(changed.select("first"), "first", "left_anti").unionByName(changed), "clusters")
            some = new.where("place is not null").select("place", "first")
            told = some if told is None else told.unionByName(some)
            n -= some.count()
            left = left.join(some, "place", "left_anti")
    return own.join(told, "place") if told is not None else own.withColumn("first", F.col("place"))


def consolidated(memories: DataFrame, group: str | None = None, least: float = 0.85, members: int = 2) -> DataFrame:
    """(first, size, ids, content, importance, embedding): clusters of memories whose vectors are alike, within ``group`` if there is one.

    ``memories`` has (id, group, content, importance, accessed_at, embedding). The memories are taken
    newest first (ties by id); each one left makes a cluster and takes those left whose mean cosine with
    its members is ``least`` or more (``first_fit``). A zero vector is like none, and so are one with a null, of another length, and of a null group.
    """
    double = F.transform("embedding", lambda v: v.cast("double"))
    norm = F.sqrt(F.aggregate(double, F.lit(0.0), lambda s, v: s + v * v))
    scope = F.to_json(F.struct(*([group] if group else []), F.size("embedding").alias("_size")))
    own = memories.where(norm > 0).withColumns({"scope": scope, "unit": F.transform(double, lambda v: v / norm)})
    fit = first_fit(own.where(F.col(group).isNotNull()) if group else own, least, [F.col("accessed_at").desc(), F.col("id")])
    each = F.array_sort(F.collect_list(F.struct("place", "id", "content")))
    sums = F.array_sort(F.collect_list(F.struct("place", double.alias("v"))))
    found = fit.groupBy(F.col("first").alias("_first")).agg(*([F.first(group).alias(group)] if group else []), F.count("*").alias("size"), each.alias("_each"), F.avg("importance").alias("importance"), sums.alias("_sums")).where(F.col("size") >= members)
    whole = F.aggregate(F.slice("_sums", F.lit(2), F.col("size").cast("int")), F.col("_sums")[0].v, lambda s, x: F.zip_with(s, x.v, lambda a, b: a + b))
    ids = F.transform("_each", lambda x: x.id)
    return found.select(*([group] if group else []), ids[0].alias("first"), "size", ids.alias("ids"), F.array_join(F.transform("_each", lambda x: x.content), " | ").alias("content"), "importance", F.transform(whole, lambda v: v / F.col("size")).alias("embedding"))
