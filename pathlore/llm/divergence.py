"""Source divergence audit: how far each source's word use is from its language's, and from each other source's.

Terms are runs of letters a-z (A-Z lower-cased) and characters beyond ASCII. A language keeps the terms that
``LEAST`` of its documents have. With a group's (language and source, or language) count of a
term, the sum N of its counts and V kept terms, p = 1 + floor(10^9 * (count + 1) / (N + V)); the
divergence of a term is f = floor((p - q)^2 / q). All arithmetic is on longs, exact up to N + V of
9 * 10^15 (beyond, Spark fails the job rather than wrapping).

Counts are folded in batches, then by (language, source, term), and gathered by (language, term)
into postings: a term's counts by source, at most one entry for each source of the language.

Leading terms of a group (``leading``), by upper bounds: a group's terms fall into buckets of
equal counts (of about equal ones, above 64), a few hundred at most. In a bucket f is at most that of
its largest p against the smallest q, the language's extreme probability in it. Buckets are
evaluated best first, as many in a round as reach ``k`` terms and then twice as many each time; a group
ends as soon as the bounds of all buckets left are strictly below its k-th value.

Pairs of sources (``pairs``): f against a source that lacks the term depends on the count only, so it
is summed from the counts' histogram; terms that neither has add a constant; what both have is corrected
from the postings, whose pairs a task adds up before it puts anything out.

Nulls: a null text, language or source counts as ''. Each row is a document of its own, so repeated
rows count repeatedly. Groups without terms have counts of 0. A language with one source has no pairs;
one without kept terms has pairs of value 0. Ties rank by the item's UTF-8 bytes. An empty table
gives an empty result. Other columns don't matter, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Words, checkpoint, slices, small, written

LEAST, TOP, UNIT = 3, 200, 1000
#: Counts up to which each has a bucket of its own; buckets for each doubling above.
EXACT, STEPS = 64, 8
#: Bytes of text whose counts are folded at once; pairs of entries that one step takes.
BATCH, PAIRS = 16 << 20, 1 << 20
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms_of(texts: pa.Array) -> Words:
    """The terms of a batch of texts: bytes are mapped one by one, so the texts keep their places."""
    texts = pc.fill_null(texts, "")
    _, offsets, data = texts.buffers()
    mapped = pa.py_buffer((data.to_pybytes() if data is not None else b"").translate(_TABLE))
    return Words(pa.StringArray.from_buffers(len(texts), offsets, mapped, offset=texts.offset))


def batch_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): a batch's occurrences of a term, and documents with it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", BATCH):
            words = terms_of(b.column("text"))
            if not len(words.codes):
                continue
            groups = pa.StructArray.from_arrays([b.column("lang"), b.column("source")], ["lang", "source"])
            names, group = {}, np.empty(b.num_rows, np.int64)
            for i, g in enumerate(groups.to_pylist()):
                group[i] = names.setdefault((g["lang"], g["source"]), len(names))
            size = len(words.vocab)
            owner = np.repeat(np.arange(b.num_rows), np.diff(words.offsets))
            in_row, times = np.unique(owner * size + words.codes, return_counts=True)
            key, place = np.unique(group[in_row // size] * size + in_row % size, return_inverse=True)
            n, seen = np.zeros(len(key), np.int64), np.bincount(place, minlength=len(key))
            np.add.at(n, place, times)
            lang, source = (pa.array([k[i] for k in names], pa.string()) for i in (0, 1))
            own = pa.array(key // size)
            columns = [lang.take(own), source.take(own), words.vocab.take(pa.array(key % size)), pa.array(n), pa.array(seen)]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "docs"])

    return docs.mapInArrow(run, "lang string, source string, term string, n long, docs long")


def postings_of(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(lang, term, total, counts array<(source, n)>) of each term that ``least`` of the language's documents have."""
    each = batch_counts(docs).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    by_term = each.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("counts"))
    return by_term.where(F.col("docs") >= least).drop("docs")


def probability(count: Column, size: Column) -> Column:
    """1 + floor(10^9 * (count + 1) / size) for count < size, by three digits at a time, as the product leaves a long."""
    whole, rest = F.lit(0).cast("long"), count + 1
    for step in (1, UNIT, UNIT, UNIT):
        whole, rest = whole * step + divided(rest * step, size), (rest * step) % size
    return whole + 1


def divided(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def divergence(p: Column, q: Column) -> Column:
    return divided((p - q) * (p - q), q)


def groups_of(docs: DataFrame, postings: DataFrame) -> DataFrame:
    """(gid, lang, source, size, zero, lang_size, terms): N + V of each group, p of a term that it lacks, its language's N + V and V."""
    languages = postings.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("total").alias("lang_n"))
    n = postings.select("lang", F.explode("counts").alias("c")).groupBy("lang", "c.source").agg(F.sum("c.n").alias("n"))
    own = docs.select("lang", "source").distinct().join(n, ["lang", "source"], "left").join(languages, "lang", "left").na.fill(0, ["n", "terms", "lang_n"])
    size = F.col("n") + F.col("terms")
    zero = F.when(F.col("terms") > 0, probability(F.lit(0).cast("long"), size))
    return own.select(F.monotonically_increasing_id().alias("gid"), "lang", "source", size.alias("size"), zero.alias("zero"), (F.col("lang_n") + F.col("terms")).alias("lang_size"), "terms")


def entries_of(postings: DataFrame, groups: DataFrame) -> DataFrame:
    """(gid, term, lang, n, p, q, zero): each term of each group that has it, with the group's and the language's p."""
    flat = postings.select("lang", "term", "total", F.explode("counts").alias("c")).select("lang", "term", "total", "c.source", "c.n")
    own = flat.join(small(groups), ["lang", "source"])
    return own.select("gid", "term", "lang", "n", probability(F.col("n"), F.col("size")).alias("p"), probability(F.col("total"), F.col("lang_size")).alias("q"), "zero")


def bucket(n: Column) -> Column:
    """Number of a count's bucket: its own up to ``EXACT``, ``STEPS`` for each doubling above."""
    return F.when(n <= EXACT, n).otherwise(EXACT + 1 + F.floor((F.log2(n) - F.log2(F.lit(EXACT))) * STEPS)).cast("long")


def leading(entries: DataFrame, k: int = TOP) -> DataFrame:
    """(gid, item, value, rank): the k terms of each group with p above q and the largest divergence.

    ``entries`` is a written table. A round costs one pass over it, and their number grows with the logarithm
    of that of the buckets. Only numbers of rows come to the driver.
    """
    keyed = entries.where("p > q").withColumn("bucket", bucket(F.col("n")))
    extremes = keyed.groupBy("gid", "bucket").agg(F.count("*").alias("terms"), F.max("p").alias("p"), F.min("q").alias("q"))
    best_first = Window.partitionBy("gid").orderBy(F.desc("bound"), "bucket")
    bounded = extremes.select("gid", "bucket", "terms", divergence(F.col("p"), F.col("q")).alias("bound"))
    reached = F.sum("terms").over(best_first.rowsBetween(Window.unboundedPreceding, -1))
    waiting = checkpoint(bounded.select("gid", "bucket", "bound", F.row_number().over(best_first).alias("place"), F.coalesce(reached, F.lit(0)).alias("before")))
    place = Window.partitionBy("gid").orderBy(F.desc("value"), "item")
    # the first round takes the buckets that hold the first k terms in order of bounds
    turn, wide, best = waiting.where(F.col("before") < k), waiting.where(F.col("before") < k).groupBy("gid").agg(F.max("place").alias("done")), None
    while True:
        chosen = small(turn.select("gid", "bucket"))
        found = keyed.join(chosen, ["gid", "bucket"], "left_semi").select("gid", F.col("term").alias("item"), divergence(F.col("p"), F.col("q")).alias("value"))
        both = found if best is None else best.drop("rank").unionByName(found)
        best = checkpoint(both.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k))
        kth = best.where(F.col("rank") == k).select("gid", F.col("value").alias("kth"))
        wide = checkpoint(wide)
        left = waiting.join(wide, "gid").where(F.col("place") > F.col("done")).join(kth, "gid", "left").where(F.col("kth").isNull() | (F.col("bound") >= F.col("kth")))
        turn = checkpoint(left.where(F.col("place") <= 2 * F.col("done")).select("gid", "bucket", "place"))
        if turn.isEmpty():
            return best
        done = turn.groupBy("gid").agg(F.max("place").alias("next"))
        wide = wide.join(done, "gid").select("gid", F.col("next").alias("done"))


def _common(entries: DataFrame) -> DataFrame:
    """(x, y, value): over the terms that groups x and y both have, f of their p less what the sums over single groups have counted for it."""
    lists = entries.groupBy("lang", "term").agg(F.collect_list("gid").alias("gid"), F.collect_list("p").alias("p"), F.collect_list("zero").alias("zero"))
    lists = lists.where(F.size("gid") > 1).select("gid", "p", "zero")

    def f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        return (p - q) * (p - q) // q

    def folded(parts: list[tuple]) -> tuple:
        x, y, value = (np.concatenate(c) for c in zip(*parts, strict=True))
        order = np.lexsort((y, x))
        x, y, value = x[order], y[order], value[order]
        first = np.flatnonzero(np.concatenate([[True], (np.diff(x) != 0) | (np.diff(y) != 0)]))
        return x[first], y[first], np.add.reduceat(value, first)

    def pieces(batch: pa.RecordBatch) -> Iterator[tuple]:
        gid, p, zero = (batch.column(i).flatten().to_numpy() for i in range(3))
        ends = np.cumsum(pc.list_value_length(batch.column(0)).to_numpy())
        size = np.diff(ends, prepend=0)
        partners = np.repeat(size, size)  # of each entry: those of its list, itself included
        first = np.repeat(ends - size, size)
        upto, a = np.cumsum(partners), 0
        while a < len(gid):
            b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + PAIRS, side="right")))
            n = partners[a:b]
            i = np.repeat(np.arange(a, b), n)
            j = np.repeat(first[a:b] - np.cumsum(n) + n, n) + np.arange(n.sum())
            i, j = i[i != j], j[i != j]
            value = f(p[i], p[j]) - f(p[i], zero[j]) - f(zero[i], p[j]) + f(zero[i], zero[j])
            yield folded([(gid[i], gid[j], value)])
            a = b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c) for c in folded(held)], ["x", "y", "value"])

        for b in batches:
            for piece in pieces(b):
                held.append(piece)
                if sum(len(h[0]) for h in held) > 4 * PAIRS:
                    held = [folded(held)]
                    if len(held[0][0]) > 2 * PAIRS:
                        yield out()
                        held = []
        if held:
            yield out()

    return lists.mapInArrow(run, "x long, y long, value long")


def pairs(entries: DataFrame, groups: DataFrame) -> DataFrame:
    """(gid, item, value): each group with each other source of its language, and the divergence summed over all kept terms."""
    x = groups.select("lang", F.col("gid").alias("x"), F.col("zero").alias("x_zero"), "terms")
    y = groups.select("lang", F.col("gid").alias("y"), F.col("zero").alias("y_zero"), F.col("source").alias("item"))
    ordered = x.join(small(y), "lang").where("x != y")
    neither = F.when(F.col("terms") > 0, F.col("terms") * divergence(F.col("x_zero"), F.col("y_zero"))).otherwise(0)
    constant = ordered.select("x", "y", neither.alias("value"))
    histogram = entries.groupBy("lang", F.col("gid").alias("x"), "p", F.col("zero").alias("x_zero")).agg(F.count("*").alias("m"))
    against = histogram.join(small(y.drop("item")), "lang").where("x != y")
    p, m, a, b = (F.col(c) for c in ("p", "m", "x_zero", "y_zero"))
    sums = against.groupBy("x", "y").agg(F.sum(m * (divergence(p, b) - divergence(a, b))).alias("own"), F.sum(m * (divergence(b, p) - divergence(b, a))).alias("other"))
    single = checkpoint(sums)
    parts = [constant, single.select("x", "y", F.col("own").alias("value")), single.select(F.col("y").alias("x"), F.col("x").alias("y"), F.col("other").alias("value")), _common(entries)]
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    names = y.select("y", "item")
    return union.groupBy("x", "y").agg(F.sum("value").alias("value")).join(small(names), "y").select(F.col("x").alias("gid"), "item", "value")


def audit(docs: DataFrame, least: int = LEAST, k: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank) of all groups: 'pair' for each other source, 'term' for the k leading terms."""
    own = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    postings = written(postings_of(own, least), "postings")
    groups = checkpoint(groups_of(own, postings))
    entries = written(entries_of(postings, groups), "entries")
    place = Window.partitionBy("gid").orderBy(F.desc("value"), "item")
    of_pairs = pairs(entries, groups).withColumn("rank", F.row_number().over(place))
    both = of_pairs.withColumn("part", F.lit("pair")).unionByName(leading(entries, k).withColumn("part", F.lit("term")))
    return both.join(small(groups.select("gid", "lang", "source")), "gid").select("lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank"))
