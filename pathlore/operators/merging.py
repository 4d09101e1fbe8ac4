"""Similar sets and vectors by joins, and greedy merging in an order, without a group in one task.

``similar_sets`` finds all pairs of word sets with a Jaccard similarity above a bound: words are ranked by rarity, and two such
sets share a word among the first few of each (their prefix), are of similar size, and still can share enough words behind
the first one they share. Candidates are verified word by word.

``first_alike`` merges in an order: a row joins the first row that it is like and that makes an entry, else it makes an
entry itself. That is settled in rounds over the table of pairs: a row with no undecided row like it ahead makes an
entry, and all behind that are like it join one. Any row that is decided takes its pairs with it.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathlore.session import shared_folder


def written(df: DataFrame, name: str, *by: str, rows: int = 0) -> DataFrame:
    """``df`` as a table in the shared folder, in a folder for each value of ``by`` and files of at most ``rows`` rows, which cuts its lineage."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("maxRecordsPerFile", rows).partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def prefix_size(n: Column, above: Column) -> Column:
    """How many of a set's rarest words hold one that any set with a similarity above the bound shares."""
    return (n - F.ceil(n * above - 1e-9) + 1).cast("int")


def similar_sets(sets: DataFrame, above: float, scope: str | None = None) -> DataFrame:
    """(a, b, similarity) of the pairs of ``sets`` (id, place, words) with a Jaccard similarity above the bound, a before b in ``place``.

    Sets are arrays of distinct words; empty ones are like none. With ``scope`` only sets that are equal there meet.
    Ids and places are distinct. ``sets`` is read several times, so give it a written table.
    """
    scope_of = F.col(scope) if scope else F.lit(0)
    own = sets.where(F.size("words") > 0).select("id", "place", scope_of.alias("scope"), "words", F.size("words").alias("n"))
    each = own.select("id", "scope", "n", F.explode("words").alias("word"))
    rarity = each.groupBy("scope", "word").agg(F.count("*").alias("df"))
    ranked = each.join(rarity, ["scope", "word"]).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("df", "word"))).alias("ranked"))
    bound = F.lit(float(above))
    heads = ranked.join(own.select("id", "place", "scope", "n"), "id").select(
        "id", "place", "scope", "n", F.posexplode(F.slice("ranked", F.lit(1), F.greatest(prefix_size(F.col("n"), bound), F.lit(1)))).alias("at", "w")
    ).select("id", "place", "scope", "n", "at", F.col("w.word").alias("word"))
    left = heads.select("scope", "word", F.col("id").alias("a"), F.col("place").alias("place_a"), F.col("n").alias("n_a"), F.col("at").alias("at_a"))
    right = heads.select("scope", "word", F.col("id").alias("b"), F.col("place").alias("place_b"), F.col("n").alias("n_b"), F.col("at").alias("at_b"))
    small, large = F.least("n_a", "n_b"), F.greatest("n_a", "n_b")
    # a pair above the bound shares this many words at least; behind the shared one no more can be shared than are left
    least = F.ceil((F.col("n_a") + F.col("n_b")) * (above / (1 + above)) - 1e-9)
    can = F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b")) + F.least("at_a", "at_b")
    pairs = left.join(right, ["scope", "word"]).where((F.col("place_a") < F.col("place_b")) & (small >= large * above - 1e-9) & (can >= least)).select("a", "b").distinct()
    words = own.select("id", "words")
    both = pairs.join(words.withColumnsRenamed({"id": "a", "words": "wa"}), "a").join(words.withColumnsRenamed({"id": "b", "words": "wb"}), "b")
    shared = F.size(F.array_intersect("wa", "wb"))
    return both.select("a", "b", (shared / (F.size("wa") + F.size("wb") - shared)).alias("similarity")).where(F.col("similarity") > above)


def first_alike(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, entry): for each of ``rows`` (id, place) the id of the entry that it joins or makes; ``pairs`` (a, b) are alike, a before b."""
    pairs = written(pairs.select("a", "b"), "alike")
    open_pairs, joined = pairs, None
    while not open_pairs.isEmpty():
        makers = open_pairs.select(F.col("a").alias("m")).distinct().join(open_pairs.select(F.col("b").alias("m")).distinct(), "m", "left_anti")
        covered = written(open_pairs.join(makers, F.col("a") == F.col("m"), "left_semi").select(F.col("b").alias("c")).distinct(), "joined")
        joined = covered if joined is None else joined.unionByName(covered)
        rest = open_pairs.join(covered, F.col("b") == F.col("c"), "left_anti").join(covered, F.col("a") == F.col("c"), "left_anti")
        open_pairs = written(rest, "open")
    if joined is None:
        return rows.select("id", F.col("id").alias("entry"))
    entries = pairs.join(joined, F.col("a") == F.col("c"), "left_anti").join(rows.select(F.col("id").alias("a"), "place"), "a")
    choice = entries.groupBy(F.col("b").alias("id")).agg(F.min_by("a", "place").alias("first"))
    own = joined.select(F.col("c").alias("id")).join(choice, "id")
    return rows.select("id").join(own, "id", "left").select("id", F.coalesce("first", "id").alias("entry"))


def merge_texts(texts: DataFrame, names: list[str], order: str, above: float, words: Callable[[Column], Column], scope: str | None = None) -> DataFrame:
    """``texts`` (distinct ``names`` and ``scope``, with ``order``) plus (entry_<name>...): the texts of the entry that each joins or makes.

    A text is like an entry if one of its named texts has a Jaccard similarity above the bound with the entry's of that name.
    """
    keys = [*([scope] if scope else []), *names]
    rows = written(texts.select(F.monotonically_increasing_id().alias("id"), *keys, F.struct(order, *keys).alias("place")), "texts")
    pairs = None
    for name in names:
        sets = rows.select("id", "place", *([scope] if scope else []), words(F.col(name)).alias("words"))
        own = similar_sets(sets, above, scope).select("a", "b")
        pairs = own if pairs is None else pairs.unionByName(own)
    of = first_alike(rows.select("id", "place"), pairs.distinct())
    entries = rows.select(F.col("id").alias("entry"), *[F.col(n).alias(f"entry_{n}") for n in names])
    return rows.drop("place").join(of, "id").join(entries, "entry").select(*keys, *[f"entry_{n}" for n in names])


def components(pairs: DataFrame) -> DataFrame:
    """(id, root): each id with a pair beside the smallest id that pairs lead to from it.

    Each round gives every node the smallest root among its neighbours' and its own, then the root's own
    root; nodes that are settled stay, and rounds grow with the logarithm of the longest way, not with it.
    """
    both = written(pairs.selectExpr("a AS u", "b AS v").unionByName(pairs.selectExpr("b AS u", "a AS v")).distinct(), "links")
    roots = written(both.groupBy("u").agg(F.least("u", F.min("v")).alias("root")).withColumnRenamed("u", "id"), "roots")
    while True:
        near = both.join(roots.withColumnsRenamed({"id": "v", "root": "r"}), "v").groupBy(F.col("u").alias("id")).agg(F.min("r").alias("near"))
        better = roots.join(near, "id").select("id", "root", F.least("root", "near").alias("r"))
        # a root that hears of a smaller one tells all that have it as their root
        hooks = better.where(F.col("r") < F.col("root")).groupBy("root").agg(F.min("r").alias("hook"))
        told = better.join(hooks, "root", "left").select("id", F.least("r", "hook").alias("x"), "root")
        jumped = told.join(roots.withColumnsRenamed({"id": "x", "root": "y"}), "x", "left").select("id", F.least("x", "y").alias("root"), (F.col("root") != F.least("x", "y")).alias("changed"))
        jumped = written(jumped, "roots")
        roots = jumped.select("id", "root")
        if jumped.where("changed").isEmpty():
            return roots


#: Vectors of a block; two blocks meet in a task.
VECTORS = 2048


def near_vectors(rows: DataFrame, least: float, scope: str | None = None, block: int = VECTORS) -> DataFrame:
    """(a, b): links that join the same components as all pairs of ``rows`` (id, unit) whose cosine is ``least`` or more.

    ``unit`` is an array of doubles with norm 1. The angle is a metric: two such vectors' angles to any pivot differ by no more
    than the bound's angle. So vectors are cut into bands of that width by their angle to a pivot, and only equal or
    neighbouring bands meet, in blocks of bounded size whose cosines are worked out together. A pair of
    blocks puts out a spanning forest of its links. Exact, and so as dear as the number of pairs of blocks in
    neighbouring bands. ``rows`` is read several times, so give it a written table.
    """
    wide, scope_of = math.acos(least), F.col(scope) if scope else F.lit(0)
    pivot = rows.orderBy(F.xxhash64("id"), "id").select("unit").first()
    if pivot is None:
        return rows.select(F.col("id").alias("a"), F.col("id").alias("b")).limit(0)
    dot = F.aggregate(F.zip_with("unit", F.array(*map(F.lit, pivot[0])), lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
    angle = F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), dot)))
    own = rows.select("id", "unit", scope_of.alias("scope"), F.floor(angle / wide).cast("int").alias("band"))
    sizes = written(own.groupBy("scope", "band").agg(F.ceil(F.count("*") / block).cast("int").alias("parts")), "bands")
    here = own.join(sizes, ["scope", "band"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    beside = sizes.select("scope", (F.col("band") - 1).alias("band"), F.col("parts").alias("above"))
    below = sizes.select("scope", (F.col("band") + 1).alias("band"), F.col("parts").alias("below"))
    here = here.join(beside, ["scope", "band"], "left").join(below, ["scope", "band"], "left")

    def each(parts: str, to: Callable[[Column], Column]) -> Column:
        return F.when(F.col(parts) > 0, F.transform(F.sequence(F.lit(0), F.col(parts) - 1), to)).otherwise(F.array().cast(kind))

    kind = "array<struct<band:int,x:int,next:boolean,y:int,first:boolean>>"
    cell = lambda band, x, next_, y, first: F.struct(band.alias("band"), x.alias("x"), F.lit(next_).alias("next"), y.alias("y"), first.alias("first"))
    band, part = F.col("band"), F.col("part")
    met = F.concat(
        each("parts", lambda j: cell(band, F.least(part, j), False, F.greatest(part, j), part <= j)),
        each("above", lambda j: cell(band, part, True, j, F.lit(True))),
        each("below", lambda j: cell(band - 1, j, True, part, F.lit(False))),
    )
    dealt = here.select("scope", "id", "unit", F.explode(met).alias("m")).select("scope", "m.*", "id", "unit")
    ids = rows.schema["id"].dataType.simpleString()

    def links(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("id", kind="stable")
        same = not part["next"].iloc[0] and part["x"].iloc[0] == part["y"].iloc[0]
        first = part["first"].to_numpy(bool)
        own, units = part["id"].tolist(), np.array(part["unit"].tolist(), float)
        x, y = (np.arange(len(part)),) * 2 if same else (np.flatnonzero(first), np.flatnonzero(~first))
        root = list(range(len(part)))

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        out = []
        for i in x:
            near = y[units[y] @ units[i] >= least - 1e-12]
            for j in near[near > i] if same else near:
                if find(i) != find(j):
                    root[find(j)] = find(i)
                    out.append((own[i], own[j]))
        return pd.DataFrame(out, columns=["a", "b"])

    return dealt.groupBy("scope", "band", "x", "next", "y").applyInPandas(links, f"a {ids}, b {ids}")
