"""A store of memories as a table: add, change, delete, search terms, counts, export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathlore.functions.text import tokens
from pathlore.operators.merging import written
from pathlore.operators.vectors import hashed

# Kinds of entries, and kinds of brain memories.
ENTRY_TYPES = ["meeting", "call", "voice_command", "task", "fact", "preference", "conversation", "learning"]
MEMORY_TYPES = ["episodic", "semantic", "preference"]

ENTRY = "id STRING, type STRING, title STRING, content STRING, tags ARRAY<STRING>, source STRING, created TIMESTAMP, accesses BIGINT"


def new_entries(rows: DataFrame, types: list[str] = ENTRY_TYPES) -> DataFrame:
    """Entries of allowed types with defaults; rows of other types are left out (see ``rejected``)."""
    own = rows.where(F.col("type").isin(*types))
    return own.withColumn("title", F.coalesce(F.nullif("title", F.lit("")), F.lit("Untitled"))).withColumn("content", F.coalesce("content", F.lit(""))).withColumn("tags", F.coalesce("tags", F.array().cast("array<string>"))).withColumn("accesses", F.lit(0).cast("long"))


def rejected(rows: DataFrame, types: list[str] = ENTRY_TYPES) -> DataFrame:
    return rows.where(~F.coalesce(F.col("type").isin(*types), F.lit(False)))


def add(store: DataFrame, rows: DataFrame, key: str = "id") -> DataFrame:
    """The store with the rows whose key it doesn't have; one of equal new keys."""
    return store.unionByName(rows.dropDuplicates([key]).join(store.select(key), key, "left_anti").select(store.columns))


def update(store: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """The store with the changes' fields, where they aren't null; one change for each key."""
    own = [c for c in changes.columns if c != key]
    new = changes.select(key, *[F.col(c).alias(f"_new_{c}") for c in own])
    return store.join(new, key, "left").select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in own else F.col(c) for c in store.columns])


def delete(store: DataFrame, keys: DataFrame, key: str = "id") -> DataFrame:
    return store.join(keys.select(key), key, "left_anti")


def touched(store: DataFrame, reads: DataFrame, key: str = "id") -> DataFrame:
    """The store with its reads counted: reads are events (key), counted once for all."""
    n = reads.groupBy(key).agg(F.count("*").alias("_reads"))
    return store.join(n, key, "left").withColumn("accesses", F.col("accesses") + F.coalesce("_reads", F.lit(0))).drop("_reads")


def with_vectors(store: DataFrame, vectors: DataFrame | None = None, key: str = "id") -> DataFrame:
    """(id, digest, place, value): the vectors beside a store, brought up to it from those that were there before.

    A vector is that of its content, by whose digest it is known: rows that are new or changed are embedded, rows that are gone
    lose theirs, all others keep what they have. Contents without words have none. What is to be embedded is written, and embedded in one
    pass; ``vectors`` are read several times, so give written ones.
    """
    own = store.select(F.col(key).alias("id"), F.md5("content").alias("digest"), "content")
    if vectors is None:
        kept, missing = None, own
    else:
        kept = vectors.join(own.select("id", "digest"), ["id", "digest"], "left_semi")
        missing = own.join(vectors.select("id", "digest").distinct(), ["id", "digest"], "left_anti")
    missing = written(missing, "missing")
    made = hashed(missing, "id", "content").join(missing.select("id", "digest"), "id").select("id", "digest", "place", "value")
    return made if kept is None else kept.unionByName(made)


def counts(store: DataFrame) -> DataFrame:
    """(type, n), and the total beside a null type."""
    return store.rollup("type").agg(F.count("*").alias("n"))


def terms(store: DataFrame) -> DataFrame:
    """(id, term, tf): the index of titles, contents and tags."""
    text = F.concat_ws(" ", "title", "content", F.array_join("tags", " "))
    return store.select("id", F.explode(tokens(text)).alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"))


def meeting_entries(meetings: DataFrame, store: DataFrame) -> DataFrame:
    """Entries of the meetings (id, title, date, summary, transcript) that the store lacks: title, summary and the first 2000 characters of the transcript."""
    own = meetings.withColumn("id", F.concat(F.lit("meeting_"), F.col("id"))).join(store.select("id"), "id", "left_anti")
    full = lambda c: F.nullif(c, F.lit(""))
    content = F.concat_ws("\n\n", F.coalesce(full("title"), F.lit("Untitled Meeting")), full("summary"), full(F.substring("transcript", 1, 2000)))
    return own.select("id", F.lit("meeting").alias("type"), F.coalesce(full("title"), F.concat(F.lit("Meeting "), F.col("date"))).alias("title"), content.alias("content"))


def voice_content(command: Column, steps: Column, result: Column) -> Column:
    """Command, steps and result, a line each, without the empty ones."""
    lines = F.concat(F.array(command), F.coalesce(steps, F.array().cast("array<string>")), F.array(result))
    return F.array_join(F.filter(lines, lambda x: F.coalesce(x, F.lit("")) != ""), "\n")


def markdown(store: DataFrame, types: list[str], top: int = 100) -> DataFrame:
    """(type, text): the most important memories of some types, as a section for each type.

    ``store`` has memory_type, content, importance_score, access_count; ties by content.
    """
    order = [F.col("importance_score").desc(), F.col("access_count").desc(), F.col("content")]
    best = store.where(F.col("memory_type").isin(*types)).orderBy(*order).limit(top)
    entry = F.struct((-F.col("importance_score")).alias("a"), (-F.col("access_count")).alias("b"), "content", F.format_string("- %s\n  *Importance: %.2f, Accessed: %d times*\n\n", "content", "importance_score", "access_count").alias("line"))
    by = best.groupBy("memory_type").agg(F.array_sort(F.collect_list(entry)).alias("lines"))
    return by.select(F.col("memory_type").alias("type"), F.concat(F.lit("## "), F.initcap("memory_type"), F.lit(" Memories\n\n"), F.array_join(F.transform("lines", lambda x: x.line), "")).alias("text"))


def context_lines(kind: Column, content: Column) -> Column:
    """A memory as a line of context, tagged by its kind."""
    return F.concat(F.when(kind == "preference", "[PREF] ").when(kind == "semantic", "[FACT] ").otherwise("[MEM] "), content)
