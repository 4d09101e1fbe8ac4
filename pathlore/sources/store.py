"""Stored tables: a catalogue database with pinned schemas, each table in buckets of its key, so that a key's rows are in one bucket."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pathlore.sources.runs import REFLECTION, RUN

BUCKETS = 16


class Table(NamedTuple):
    schema: str
    key: str


TABLES = {
    "runs": Table(RUN, "taskId"),
    "reflections": Table(REFLECTION, "trajectoryId"),
    "messages": Table("session BIGINT, turn BIGINT, role STRING, text STRING", "session"),
    "memories": Table("id BIGINT, content STRING, memory_type STRING, created_at BIGINT, accessed_at BIGINT, access_count BIGINT, importance_score DOUBLE, session_id STRING, source STRING, metadata STRING, embedding ARRAY<FLOAT>", "id"),
    "access_log": Table("memory_id BIGINT, session_id STRING, query_hash STRING, query_terms STRING, accessed_at BIGINT, was_useful INT", "memory_id"),
    "executions": Table("id STRING, task_id STRING, started_at BIGINT, finished_at BIGINT, status STRING, result STRING, error STRING, duration_ms BIGINT", "task_id"),
}


class Store:
    """The tables of a database; those that are there already stay as they are, whatever has been stored in them."""

    def __init__(self, spark: SparkSession, name: str, location: str | None = None, buckets: int = BUCKETS):
        self.spark, self.name = spark, name
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {name}" + (f" LOCATION '{location}'" if location else ""))
        for own, t in TABLES.items():
            spark.sql(f"CREATE TABLE IF NOT EXISTS {name}.{own} ({t.schema}) USING parquet CLUSTERED BY ({t.key}) SORTED BY ({t.key}) INTO {buckets} BUCKETS")

    def table(self, name: str) -> DataFrame:
        return self.spark.table(f"{self.name}.{name}")

    def append(self, name: str, rows: DataFrame) -> None:
        """Adds rows with the table's columns by name: missing ones are null, others an error. Rows of a bucket go to one file."""
        schema = self.table(name).schema
        if unknown := {c.lower() for c in rows.columns} - {c.lower() for c in schema.names}:
            raise ValueError(f"{name} has no columns {sorted(unknown)}")
        there = {c.lower() for c in rows.columns}
        own = rows.select(*[(F.col(f"`{f.name}`") if f.name.lower() in there else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])
        buckets = int(self.spark.sql(f"DESCRIBE EXTENDED {self.name}.{name}").where("col_name = 'Num Buckets'").first()["data_type"])
        own.repartition(buckets, TABLES[name].key).write.insertInto(f"{self.name}.{name}")

    def of(self, name: str, key) -> DataFrame:
        """The rows of one key: one bucket is read."""
        own: Column = F.col(TABLES[name].key)
        return self.table(name).where(own == F.lit(key))

    def drop(self) -> None:
        self.spark.sql(f"DROP DATABASE IF EXISTS {self.name} CASCADE")
