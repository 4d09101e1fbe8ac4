"""An index of terms that follows a stream of runs, and outlives its writer.

Data folders are written first, under names of their own; a commit is one small file of the log, put in place by a
rename, that names the folders which make up the index then, the last batch, and when and how often the index
has been rebuilt. What a writer left behind without a commit is never read, and is removed at the next
rebuild. A writer that starts reads the last commit and goes on from there; a batch that comes again is passed over.

The newest text of a task counts: that of the latest batch, in a batch the one with the greatest ``at`` (if there
is such a column), of equal ones the greatest text. A null text removes the task.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathlore.functions.text import index_terms
from pathlore.sources import files

REBUILD_ADDS, REBUILD_SECONDS = 10, 24 * 3600
RUNS, TERMS = "task string, batch long, gone boolean, text string", "task string, batch long, term string, tf long"


@dataclass(frozen=True)
class Commit:
    version: int = 0
    batch: int = -1
    pending: int = 0
    built: float = 0.0
    rebuilds: int = 0
    folders: list[str] = field(default_factory=list)


class IndexWriter:
    """A sink for ``foreachBatch`` with (task, text[, at]): adds each batch, and rebuilds the index after ``adds`` runs or ``seconds``."""

    def __init__(self, path: str, adds: int = REBUILD_ADDS, seconds: float = REBUILD_SECONDS, clock=time.time):
        self.path, self.adds, self.seconds, self.clock = path.rstrip("/"), adds, seconds, clock
        self.started, self.last = clock(), Commit()

    @property
    def rebuilds(self) -> int:
        return self.last.rebuilds

    def __call__(self, batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        now = self.state(spark)
        if number <= now.batch:
            return
        name = f"part-{number}-{uuid.uuid4().hex}"
        order = F.struct(*(["at"] if "at" in batch.columns else []), F.col("text").isNotNull(), "text")
        newest = batch.groupBy(F.col("task").cast("string").alias("task")).agg(F.max_by("text", order).alias("text"))
        self.save(newest.select("task", F.lit(number).cast("long").alias("batch"), F.col("text").isNull().alias("gone"), "text"), f"{name}/runs")
        runs = spark.read.schema(RUNS).parquet(f"{self.path}/{name}/runs")
        self.save(terms(runs.where("not gone")), f"{name}/terms")
        self.commit(spark, replace(now, batch=number, pending=now.pending + runs.count(), built=now.built if now.version else self.started, folders=[*now.folders, name]))
        if self.last.pending >= self.adds or self.clock() - self.last.built > self.seconds:
            self.rebuild(spark)

    def rebuild(self, spark: SparkSession) -> None:
        """One folder with the newest text of each task and its terms, in place of all others."""
        now = self.state(spark)
        name = f"whole-{now.rebuilds + 1}-{uuid.uuid4().hex}"
        runs = self._table(spark, now, "runs", RUNS)
        kept = runs.join(_newest(runs).where("not gone").select("task", "batch"), ["task", "batch"], "left_semi")
        self.save(kept.select("task", "batch", "gone", "text"), f"{name}/runs")
        self.save(terms(spark.read.schema(RUNS).parquet(f"{self.path}/{name}/runs")), f"{name}/terms")
        self.commit(spark, replace(now, pending=0, built=self.clock(), rebuilds=now.rebuilds + 1, folders=[name]))
        self.clean(spark)

    def read(self, spark: SparkSession) -> DataFrame:
        """(task, term, tf) as of the last commit."""
        now = self.state(spark)
        newest = _newest(self._table(spark, now, "runs", RUNS)).where("not gone").select("task", "batch")
        return self._table(spark, now, "terms", TERMS).join(newest, ["task", "batch"], "left_semi").select("task", "term", "tf")

    def clean(self, spark: SparkSession) -> None:
        """Removes the folders and commits that the last commit doesn't name."""
        now = self.state(spark)
        for name in self._names(spark, ""):
            if name.startswith(("part-", "whole-")) and name not in now.folders:
                self.remove(spark, name)
        for name in self._names(spark, "log"):
            if name != f"{now.version}.json":
                self.remove(spark, f"log/{name}")

    def state(self, spark: SparkSession) -> Commit:
        """The last commit."""
        versions = [int(n[:-5]) for n in self._names(spark, "log") if n.endswith(".json") and n[:-5].isdigit()]
        if versions and max(versions) != self.last.version:
            row = spark.read.text(f"{self.path}/log/{max(versions)}.json", wholetext=True).first()
            self.last = Commit(**json.loads(row[0]))
        return self.last

    def commit(self, spark: SparkSession, state: Commit) -> None:
        own = replace(state, version=state.version + 1)
        self.put(spark, f"log/_{uuid.uuid4().hex}", json.dumps(asdict(own)), f"log/{own.version}.json")
        self.last = own

    # what is written: each of these leaves nothing, or all of it, for a reader

    def save(self, df: DataFrame, name: str) -> None:
        df.write.parquet(f"{self.path}/{name}")

    def put(self, spark: SparkSession, name: str, text: str, to: str) -> None:
        system, own = files._folder(spark, f"{self.path}/{name}")
        out = system.create(own, True)
        out.write(bytearray(text.encode()))
        out.close()
        if not system.rename(own, files._folder(spark, f"{self.path}/{to}")[1]):
            raise RuntimeError(f"another writer has put {to}")

    def remove(self, spark: SparkSession, name: str) -> None:
        system, own = files._folder(spark, f"{self.path}/{name}")
        system.delete(own, True)

    def _names(self, spark: SparkSession, folder: str) -> list[str]:
        system, own = files._folder(spark, f"{self.path}/{folder}" if folder else self.path)
        return [s.getPath().getName() for s in system.listStatus(own)] if system.exists(own) else []

    def _table(self, spark: SparkSession, now: Commit, name: str, schema: str) -> DataFrame:
        return spark.read.schema(schema).parquet(*[f"{self.path}/{f}/{name}" for f in now.folders]) if now.folders else spark.createDataFrame([], schema)


def _newest(runs: DataFrame) -> DataFrame:
    """(task, batch, gone): the latest batch of each task, and whether it removed it."""
    return runs.groupBy("task").agg(F.max("batch").alias("batch"), F.max_by("gone", "batch").alias("gone"))


def terms(runs: DataFrame) -> DataFrame:
    return runs.select("task", "batch", F.explode(index_terms(F.col("text"))).alias("term")).groupBy("task", "batch", "term").agg(F.count("*").alias("tf"))
