"""A watcher of logs: what each log names last, told when it changes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

ADDRESS = r"https?://[^\s\x22<>']+"


def read_parts(spark: SparkSession, path: str, name: str = r"^(.*)\.(\d+)\.log$") -> DataFrame:
    """A stream of (log, place, text): files of a folder as they come, each a further part of the log that its name begins with."""
    own = spark.readStream.format("text").option("wholetext", True).load(path)
    file = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]*)$", 1)
    return own.select(F.regexp_extract(file, name, 1).alias("log"), F.regexp_extract(file, name, 2).try_cast("long").alias("place"), F.col("value").alias("text")).where("place is not null")


def changes(parts: DataFrame, pattern: str = ADDRESS) -> DataFrame:
    """(log, place, found): from a stream of (log, place, text) the last match of a text, where it isn't what the log named before.

    The texts of a log must come in order from one trigger to the next; within one they are sorted by place. A
    text without a match changes nothing. A log's state is what it named last.
    """
    last = F.try_element_at(F.regexp_extract_all("text", F.lit(pattern), F.lit(0)), F.lit(-1))
    own = parts.select("log", F.col("place").cast("long").alias("place"), last.alias("found")).where("found is not null")
    kind = own.schema["log"].dataType.simpleString()

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (before,) = state.get if state.exists else (None,)
        out = []
        for row in pd.concat(frames).sort_values("place").itertuples(index=False):
            if row.found != before:
                before = row.found
                out.append((key[0], row.place, before))
        state.update((before,))
        yield pd.DataFrame(out, columns=["log", "place", "found"])

    return own.groupBy("log").applyInPandasWithState(run, f"log {kind}, place long, found string", "found string", "append", "NoTimeout")
