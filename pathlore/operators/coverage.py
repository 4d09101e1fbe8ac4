"""Coverage of categories: histogram, gaps, entropy, report, priorities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def histogram(df: DataFrame, category: str) -> DataFrame:
    return df.groupBy(F.coalesce(F.col(category), F.lit("unknown")).alias("category")).agg(F.count("*").alias("n"))


def gaps(df: DataFrame, category: str, threshold: int = 5) -> DataFrame:
    """Categories below the threshold and how many rows they lack."""
    return histogram(df, category).where(F.col("n") < threshold).withColumn("deficit", threshold - F.col("n"))


def report(df: DataFrame, category: str, converged_at: int = 5) -> DataFrame:
    """One row: totals, converged share, mean (2 places), entropy in bits, its maximum and their ratio (3 places), the five largest categories and the ten largest gaps."""
    h = histogram(df, category)
    own = h.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"),
        F.count("*").alias("categories"),
        F.count_if(F.col("n") >= converged_at).alias("converged"),
        F.sum(F.col("n") * F.log2("n")).alias("s"),
        F.min("n").alias("least"),
        F.max("n").alias("most"),
        F.round(F.avg("n"), 2).alias("mean"),
        # categories are few: they are what a vocabulary has
        F.slice(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "category"))), lambda x: x.category), 1, 5).alias("top"),
        F.slice(F.transform(F.array_sort(F.collect_list(F.when(F.col("n") < converged_at, F.struct("n", "category")))), lambda x: x.category), 1, 10).alias("gaps"),
    )
    entropy = F.coalesce(F.log2("total") - F.col("s") / F.col("total"), F.lit(0.0))
    top = F.coalesce(F.log2("categories"), F.lit(0.0))
    return own.select("total", "categories", "converged", F.round(F.try_divide("converged", "categories"), 3).alias("convergence_rate"), "least", "most", "mean", F.round(entropy, 3).alias("entropy"), F.round(top, 3).alias("max_entropy"), F.round(F.when(top > 0, entropy / top).otherwise(0.0), 3).alias("normalized"), "top", "gaps")


def priorities(counts: DataFrame, category: str, threshold: int, top: int) -> DataFrame:
    """(category, n, priority): of ``counts`` (category, n, fresh) the categories below the threshold, those that need most first: the deficit, 2 more without fresh rows, 3 more without any."""
    priority = threshold - F.col("n") + F.when(F.col("fresh") == 0, 2).otherwise(0) + F.when(F.col("n") == 0, 3).otherwise(0)
    return counts.where(F.col("n") < threshold).select(category, "n", priority.alias("priority")).orderBy(F.col("priority").desc(), category).limit(top)
