"""Exact order statistics without a sort of all rows or a buffer of all values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Ranges that values are counted in at each level.
RANGES = 4096


def median(df: DataFrame, value: str) -> DataFrame:
    """One row, ``median``: of a whole-number column without nulls, the mean of the two middle values; null for no rows.

    Each level counts the values by ranges of equal width and goes on in the range of the wanted
    rank, so a level sends no more rows to the driver than it has ranges, and all values between two
    whole numbers are one range after a few levels (three for 36 bits).
    """
    whole = df.agg(F.count(value).alias("n"), F.min(value).alias("low"), F.max(value).alias("high")).first()
    if not whole.n:
        return df.sparkSession.createDataFrame([(None,)], "median double")

    def at(rank: int) -> int:
        low, high = whole.low, whole.high
        while low < high:
            width = (high - low) // RANGES + 1
            own = df.where(F.col(value).between(low, high)).groupBy(F.floor((F.col(value) - low) / width).alias("r")).agg(F.count("*").alias("n"))
            for r, n in sorted(map(tuple, own.collect())):
                if rank < n:
                    low, high = low + r * width, min(high, low + (r + 1) * width - 1)
                    break
                rank -= n
        return low

    ranks = {(whole.n - 1) // 2, whole.n // 2}
    found = [at(r) for r in sorted(ranks)]
    return df.sparkSession.createDataFrame([(sum(found) / len(found),)], "median double")
