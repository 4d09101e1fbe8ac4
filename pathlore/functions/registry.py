"""Tools made at run time: named column functions with versions, switches and a log of their runs. No text is ever run as code."""

from __future__ import annotations

import re
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from pathlore.session import shared_folder
from pathlore.sources import files

MOST_TOOLS = 50
LOG = "tool string, version int, at long, ms long, n long, good long"


@dataclass(frozen=True)
class Tool:
    name: str
    description: str
    function: Callable[..., Column]
    inputs: dict[str, str]
    version: int = 1
    enabled: bool = True


def tool_name(name: str) -> str:
    """Lower-case letters, digits and single underscores, 50 at most."""
    return re.sub("_+", "_", re.sub("[^a-z0-9_]", "_", name.lower()))[:50]


@dataclass
class ToolRegistry:
    """Functions from columns to a column (built-ins or pandas UDFs), by name.

    A run is written to ``folder`` (by default a new one below the shared folder), and what it has counted on the way
    is a line of the log there, under the tool's name: reading results or log runs no tool again.
    """

    tools: dict[str, Tool] = field(default_factory=dict)
    folder: str | None = None

    def forge(self, name: str, description: str, function: Callable[..., Column], inputs: dict[str, str]) -> Tool:
        own = tool_name(name)
        if len(self.tools) >= MOST_TOOLS:
            raise ValueError(f"there are {MOST_TOOLS} tools already")
        if own in self.tools:
            raise ValueError(f"tool {own} exists")
        self.tools[own] = Tool(own, description, function, dict(inputs))
        return self.tools[own]

    def update(self, name: str, function: Callable[..., Column] | None = None, description: str | None = None, inputs: dict[str, str] | None = None) -> Tool:
        old = self._known(name)
        self.tools[name] = replace(old, function=function or old.function, description=description or old.description, inputs=inputs or old.inputs, version=old.version + 1)
        return self.tools[name]

    def toggle(self, name: str, enabled: bool) -> None:
        self.tools[name] = replace(self._known(name), enabled=enabled)

    def delete(self, name: str) -> None:
        """Removes a tool and its log."""
        self._known(name)
        del self.tools[name]
        if self.folder:
            system, own = files._folder(SparkSession.active(), f"{self.folder}/log/{name}")
            system.delete(own, True)

    def _known(self, name: str) -> Tool:
        if name not in self.tools:
            raise KeyError(f"no tool {name}")
        return self.tools[name]

    def run(self, df: DataFrame, name: str, *columns: str, result: str = "result") -> DataFrame:
        """``df`` with the tool's result, as written by a run that takes place now; a row's run is good if the result isn't null."""
        tool = self._known(name)
        if not tool.enabled:
            raise ValueError(f"tool {name} is off")
        spark = df.sparkSession
        self.folder = self.folder or f"{shared_folder(spark)}/tools-{uuid.uuid4().hex}"
        seen = Observation()
        out = df.withColumn(result, tool.function(*map(F.col, columns)))
        path, began = f"{self.folder}/runs/{uuid.uuid4().hex}", time.time()
        out.observe(seen, F.count(F.lit(1)).alias("n"), F.count_if(F.col(result).isNotNull()).alias("good")).write.parquet(path)
        row = (name, tool.version, int(began * 1000), int((time.time() - began) * 1000), seen.get["n"], seen.get["good"])
        files.append_log(spark.createDataFrame([row], LOG), f"{self.folder}/log/{name}")
        return spark.read.schema(out.schema).parquet(path)

    def runs(self, spark: SparkSession) -> DataFrame:
        """(tool, version, at, ms, n, good): a row for each run of a tool that is still there."""
        return files.good(files.read_documents(spark, f"{self.folder}/log", LOG, many_lines=False)) if self.folder else spark.createDataFrame([], LOG)

    def statistics(self, spark: SparkSession) -> DataFrame:
        """(tool, version, n, good): the log's counts."""
        return self.runs(spark).groupBy("tool", "version").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))

    def catalogue(self, spark: SparkSession) -> DataFrame:
        """(name, description, version, enabled, inputs) of all tools, by name."""
        rows = [(t.name, t.description, t.version, t.enabled, t.inputs) for t in sorted(self.tools.values(), key=lambda t: t.name)]
        return spark.createDataFrame(rows, "name string, description string, version int, enabled boolean, inputs map<string,string>")

    def schemas(self, spark: SparkSession) -> DataFrame:
        """(name, description, inputs) of the tools that are on, as others are told of them."""
        on = self.catalogue(spark).where("enabled")
        return on.select(F.concat(F.lit("forged_"), "name").alias("name"), F.concat(F.lit("[Forged Tool] "), "description").alias("description"), "inputs")
