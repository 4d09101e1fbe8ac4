"""Patterns from recorded runs: merged by similarity, graduated, capped; and what use a memory had."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathlore.functions.text import tokens
from pathlore.operators.merging import merge_texts, written

MERGE_ABOVE = 0.5


def words(text: Column) -> Column:
    """Distinct lower-case words of 3 or more characters, split at white space."""
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: F.length(w) > 2))


def word_jaccard(a: Column, b: Column) -> Column:
    """Of word arrays as sets; 0 if either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / F.size(F.array_union(a, b)))


def signature(tools: Column) -> Column:
    return F.array_join(tools, " -> ")


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], k: int, salts: int = 16) -> DataFrame:
    """The first k rows of each group; of each of ``salts`` parts of a group first, so that a hot group is cut down before it meets."""
    part = F.pmod(F.xxhash64(*df.columns), F.lit(salts))
    few = df.withColumn("_part", part).withColumn("_rank", F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(*order))).where(F.col("_rank") <= k).drop("_part", "_rank")
    return few.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_rank") <= k).drop("_rank")


def pattern_of(runs: DataFrame, kind: str, sig: str, order: str) -> DataFrame:
    """(kind, sig, pattern): the pattern that each distinct signature of a kind belongs to.

    Runs are taken by ``order``: a signature joins the first pattern of its kind with a word Jaccard
    above ``MERGE_ABOVE``, else it makes a pattern. As patterns are only added behind, a signature's
    choice at its first run is its choice for ever, so distinct signatures decide. (One without words
    would make a pattern each time; here it makes one.)
    """
    return _patterns(runs.groupBy(kind, sig).agg(F.min(order).alias("first")), kind, sig)


def _patterns(distinct: DataFrame, kind: str, sig: str) -> DataFrame:
    own = distinct.select(kind, sig, "first")
    return merge_texts(own, [sig], "first", MERGE_ABOVE, words, kind).withColumnRenamed(f"entry_{sig}", "pattern")


def merged(runs: DataFrame, kind: str, sig: str, order: str) -> DataFrame:
    """(kind, pattern, occurrences, success_rate, iterations, cost, last): patterns with what their runs showed."""
    # counted by signature first and written: one pass over the runs, and only one row of each signature meets its pattern
    counted = runs.where(F.col(sig) != "").groupBy(kind, sig).agg(F.min(order).alias("first"), F.count("*").alias("n"), F.count_if(F.col("outcome") == "success").alias("good"), F.sum("iterations").alias("i"), F.sum("cost").alias("c"), F.max(order).alias("last"))
    counted = written(counted, "signatures")
    of = _patterns(counted, kind, sig)
    total = counted.join(of, [kind, sig]).groupBy(kind, "pattern").agg(*[F.sum(x).alias(x) for x in ("n", "good", "i", "c")], F.max("last").alias("last"))
    return total.select(kind, "pattern", F.col("n").alias("occurrences"), (F.col("good") / F.col("n")).alias("success_rate"), (F.col("i") / F.col("n")).alias("iterations"), (F.col("c") / F.col("n")).alias("cost"), "last")


def graduates(patterns: DataFrame, runs: int) -> DataFrame:
    """Patterns that are seen and succeed often enough for the evidence there is, best first, up to the cap that it allows.

    ``runs`` is the number of runs. Of the patterns only their number and mean rate come to the driver.
    """
    n, mean = patterns.agg(F.count("*"), F.avg("success_rate")).first()
    least = max(3, math.ceil(math.sqrt(runs)))
    rate = min(0.9, max(0.6, (0.5 if mean is None else mean) + 0.1))
    cap = max(15, math.floor(math.sqrt(n) * 2))
    good = patterns.where((F.col("occurrences") >= least) & (F.col("success_rate") >= rate))
    return good.orderBy((F.col("success_rate") * 10 + F.col("occurrences")).desc(), *patterns.columns[:2]).limit(cap)


def usage_terms(log: DataFrame, query: str, terms: Column, hashed) -> DataFrame:
    """``log`` with a row for its query and one for each of its first five terms, as a column ``hash``."""
    return log.withColumn("hash", F.explode(F.array_union(F.array(hashed(F.col(query))), F.transform(F.slice(terms, 1, 5), hashed))))


def library(segments: DataFrame, label: str, order: str, good: Column, above: float) -> DataFrame:
    """(entry, occurrences, success_rate, last): segments merged by the words that their labels share.

    In order of first use a label joins the first entry with a token Jaccard above ``above``, else it
    makes one; distinct labels decide (see ``pattern_of``).
    """
    counted = written(segments.groupBy(label).agg(F.count("*").alias("n"), F.count_if(good).alias("good"), F.min(order).alias("first"), F.max(order).alias("last")), "labels")
    of = merge_texts(counted.select(label, "first"), [label], "first", above, distinct_tokens).withColumnRenamed(f"entry_{label}", "entry")
    total = counted.join(of, label).groupBy("entry").agg(F.sum("n").alias("occurrences"), F.sum("good").alias("good"), F.max("last").alias("last"))
    return total.select("entry", "occurrences", (F.col("good") / F.col("occurrences")).alias("success_rate"), "last")


def distinct_tokens(text: Column) -> Column:
    return F.array_distinct(tokens(F.coalesce(text, F.lit(""))))


def segment_entries(segments: DataFrame, label: str, post: str, order: str, good: Column, above: float, cap: int) -> DataFrame:
    """(label, post, occurrences, success_rate, last): the library after all segments, those that occur most first up to ``cap`` (of equals the last used).

    In order of first use a segment joins the first entry whose label or postcondition is like its own, else it makes one.
    """
    counted = written(segments.groupBy(label, post).agg(F.count("*").alias("n"), F.count_if(good).alias("good"), F.min(order).alias("first"), F.max(order).alias("last")), "labels")
    of = merge_texts(counted.select(label, post, "first"), [label, post], "first", above, distinct_tokens)
    total = counted.join(of, [label, post]).groupBy(F.col(f"entry_{label}").alias("label"), F.col(f"entry_{post}").alias("post")).agg(F.sum("n").alias("occurrences"), F.sum("good").alias("good"), F.max("last").alias("last"))
    rated = total.select("label", "post", "occurrences", (F.col("good") / F.col("occurrences")).alias("success_rate"), "last")
    return rated.orderBy(F.col("occurrences").desc(), F.col("last").desc(), "label", "post").limit(cap)
