"""Reflections on the way into the store: quality by distinct lessons, sources, duplicates by similarity, the cap."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathlore.functions import lessons as ls
from pathlore.operators import retrieval

SOURCES = ["real", "videoagent", "webrl", "reflexion", "her", "transfer"]


def with_quality(reflections: DataFrame, name: str = "quality") -> DataFrame:
    """``reflections`` (lessons, outcome, failures, strategies) with their scores as a struct (see ``lessons.quality``).

    A score costs some 25 patterns for each lesson, and depends on the lessons, the outcome and on whether there are failures and
    strategies only. So distinct ones are scored and joined back; the join splits those that many rows have.
    """
    some = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    own = reflections.withColumn("_f", some("failures")).withColumn("_s", some("strategies"))
    keys = ["lessons", "outcome", "_f", "_s"]
    points = lambda c: F.when(F.col(c), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    distinct = own.select(*[F.col(k).alias(f"{k}_") for k in keys]).distinct()
    scored = distinct.withColumn(name, ls.quality(F.col("lessons_"), F.col("outcome_"), points("_f_"), points("_s_")))
    same = [F.col(k).eqNullSafe(F.col(f"{k}_")) for k in keys]
    return own.join(scored, same, "left").drop(*[f"{k}_" for k in keys], "_f", "_s")


def ingest(existing: DataFrame, candidates: DataFrame, sources: list[str] = SOURCES, least: float = 0.9) -> DataFrame:
    """(id, disposition, match): what becomes of each candidate (id, source, good, text): 'source', 'quality', 'duplicate' or 'accepted'.

    A candidate is a duplicate where the cosine of its text's words with those of one of ``existing`` (id, text) is
    ``least`` or more; candidates of one batch aren't held against each other.
    """
    fit = candidates.withColumn("disposition", F.when(~F.coalesce(F.col("source").isin(*sources), F.lit(False)), "source").when(~F.coalesce("good", F.lit(False)), "quality"))
    asked = fit.where("disposition is null").select("id", "text")
    same = retrieval.duplicates_above(existing.select("id", "text"), asked, "id", "text", least).select("id", "match")
    out = fit.join(same, "id", "left")
    return out.select("id", F.coalesce("disposition", F.when(F.col("match").isNotNull(), "duplicate").otherwise("accepted")).alias("disposition"), "match")


def stored(existing: DataFrame, accepted: DataFrame, cap: int, *order) -> DataFrame:
    """The store after a batch: what it accepted goes before what was there, each in the given order, up to the cap."""
    both = accepted.withColumn("_new", F.lit(0)).unionByName(existing.withColumn("_new", F.lit(1)))
    return both.orderBy("_new", *order).limit(cap).drop("_new")
