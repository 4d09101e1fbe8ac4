"""Recorded runs and reflections: pinned schemas, defaults, summaries, narratives and views by row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pathlore.sources import files

ACTION = "STRUCT<type: STRING, coordinates: ARRAY<BIGINT>, text: STRING, command: STRING, raw: STRING>"
RUN = f"""taskId STRING, taskDescription STRING, startTime BIGINT, endTime BIGINT, duration BIGINT, success BOOLEAN,
finalText STRING, totalSteps BIGINT, loopsDetected BIGINT, stagnationsDetected BIGINT, surprisesDetected BIGINT,
recoveryLevel BIGINT, activeBranchIndex BIGINT,
checkpoints ARRAY<STRUCT<stepNumber: BIGINT, description: STRING, nodeId: STRING, nodeIndex: BIGINT, screenshotHash: STRING, semanticState: STRING, `timestamp`: BIGINT>>,
taskPlan STRUCT<steps: ARRAY<STRUCT<n: BIGINT, `desc`: STRING, done: BOOLEAN>>, totalSteps: BIGINT>,
nodes ARRAY<STRUCT<id: STRING, `index`: BIGINT, parentId: STRING, `timestamp`: BIGINT, relativeTime: BIGINT, screenshotPath: STRING, exactHash: STRING, thumbnailHash: STRING,
  action: {ACTION}, toolResult: STRING, flags: ARRAY<STRING>, expectation: STRING,
  surprise: STRUCT<score: DOUBLE, expected: STRING, observed: STRING, expectedKeywords: BIGINT, matchedKeywords: DOUBLE, method: STRING>,
  branch: STRING, semanticState: STRING, resolvedTarget: STRUCT<label: STRING, role: STRING, app: STRING, distance: BIGINT>, assistantIntent: STRING, axContext: STRING>>,
edges ARRAY<STRUCT<`from`: STRING, `to`: STRING, action: {ACTION}, `timestamp`: BIGINT>>,
branches ARRAY<STRUCT<id: STRING, name: STRING, `index`: BIGINT, baseFrameIndex: BIGINT, startFrameIndex: BIGINT, tipFrameIndex: BIGINT, status: STRING, approach: STRING, outcome: STRING, lesson: STRING>>"""

REFLECTION = """id STRING, trajectoryId STRING, taskDescription STRING, taskType STRING, outcome STRING, iterations BIGINT, loopsDetected BIGINT, stagnationsDetected BIGINT,
duration BIGINT, reflection STRING, lessons ARRAY<STRING>, failurePoints ARRAY<STRING>, effectiveStrategies ARRAY<STRING>, `timestamp` BIGINT, source STRING, confidence DOUBLE, sourceId STRING"""


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Runs, one document a file; files that can't be read are left out."""
    return files.good(files.read_documents(spark, path, RUN))


def load_run(runs: DataFrame, task: str) -> DataFrame:
    return runs.where(F.col("taskId") == task)


def read_reflections(spark: SparkSession, path: str, many_lines: bool = True) -> DataFrame:
    """Reflections with defaults: a missing source is 'real', a missing or zero confidence 1, a missing source id the own id."""
    own = files.good(files.read_documents(spark, path, REFLECTION, many_lines))
    return with_defaults(own)


def with_defaults(reflections: DataFrame) -> DataFrame:
    full = lambda c, d: F.when(F.coalesce(F.col(c), F.lit("")) == "", d).otherwise(F.col(c))
    return reflections.withColumn("source", full("source", F.lit("real"))).withColumn("confidence", F.when(F.coalesce(F.col("confidence"), F.lit(0.0)) == 0, 1.0).otherwise(F.col("confidence"))).withColumn("sourceId", full("sourceId", F.col("id")))


def summaries(runs: DataFrame) -> DataFrame:
    """A short row for each run, newest first."""
    branches = F.coalesce("branches", F.array().cast(runs.schema["branches"].dataType))
    own = runs.select("taskId", "taskDescription", "startTime", "duration", "totalSteps", "success", "loopsDetected", "stagnationsDetected", F.coalesce("surprisesDetected", F.lit(0)).alias("surprisesDetected"), F.size(branches).alias("branches"), F.size(F.filter(branches, lambda b: b.status == "failed")).alias("failedBranches"))
    return own.orderBy(F.col("startTime").desc(), "taskId")


def narrative(nodes: Column) -> Column:
    """The steps with an action or a flag, short: step, state, action, flags, a surprise above .5, expectation."""

    def entry(n: Column) -> Column:
        return F.struct(
            n["index"].alias("step"),
            F.coalesce(F.nullif(n.semanticState, F.lit("")), F.lit("unknown")).alias("state"),
            F.nullif(n.action.raw, F.lit("")).alias("action"),
            F.when(F.size(n.flags) > 0, n.flags).alias("flags"),
            F.when(n.surprise.score > 0.5, F.struct(n.surprise.score.alias("score"), n.surprise.observed.alias("reason"))).alias("surprise"),
            F.nullif(n.expectation, F.lit("")).alias("expectation"),
        )

    return F.filter(F.transform(nodes, entry), lambda e: e.action.isNotNull() | e.flags.isNotNull())


def save_runs(runs: DataFrame, path: str) -> None:
    """Writes runs with their narratives; pictures are named without their folders."""
    nodes = F.transform("nodes", lambda n: n.withField("screenshotPath", F.regexp_extract(n.screenshotPath, r"([^/]*)$", 1)))
    files.write_documents(runs.withColumn("nodes", nodes).withColumn("totalSteps", F.size("nodes").cast("long")).withColumn("narrative", narrative(F.col("nodes"))), path)


def steps(runs: DataFrame) -> DataFrame:
    """A row for each step of each run."""
    return runs.select("taskId", F.explode("nodes").alias("n")).select("taskId", F.col("n.index").alias("idx"), "n.exactHash", "n.thumbnailHash", F.col("n.action").alias("action"), "n.toolResult", "n.flags", "n.expectation", "n.surprise", "n.branch", "n.semanticState")


def branches(runs: DataFrame) -> DataFrame:
    return runs.select("taskId", F.explode("branches").alias("b")).select("taskId", "b.*")


def checkpoints(runs: DataFrame) -> DataFrame:
    return runs.select("taskId", F.explode("checkpoints").alias("c")).select("taskId", "c.*")


def action_summary(action: Column) -> Column:
    """A tool's call (a struct of type, name and input with action, coordinate, text, command) as type, raw form and shortened command."""
    given = action.input
    at = F.when(given.coordinate.isNotNull(), F.concat(F.lit(" ("), F.array_join(F.transform(given.coordinate, lambda x: x.cast("string")), ","), F.lit(")"))).otherwise(F.lit(""))
    typed = F.when(F.coalesce(given.text, F.lit("")) != "", F.concat(F.lit(': "'), F.substring(given.text, 1, 50), F.lit('"'))).otherwise(F.lit(""))
    command = F.coalesce(given.command, F.lit(""))
    computer = F.struct(given["action"].alias("type"), F.concat(given["action"], at, typed).alias("raw"), F.lit(None).cast("string").alias("command"))
    bash = F.struct(F.lit("bash").alias("type"), F.concat(F.lit("bash: "), F.substring(command, 1, 80)).alias("raw"), F.substring(command, 1, 100).alias("command"))
    other = F.struct(F.coalesce(action["name"], F.lit("unknown")).alias("type"), F.substring(F.to_json(given), 1, 100).alias("raw"), F.lit(None).cast("string").alias("command"))
    return F.when(action.isNotNull(), F.when(action["name"] == "computer", computer).when(action["name"] == "bash", bash).otherwise(other))


def rendered(runs: DataFrame) -> DataFrame:
    """(taskId, text): a run as lines: its steps with seconds, action and flags, its checkpoints, its plan."""

    def line(n: Column) -> Column:
        mark = F.when(F.size(n.flags) > 0, F.concat(F.lit(" ["), F.array_join(n.flags, ", "), F.lit("]"))).otherwise(F.lit(""))
        return F.concat(F.lit("  "), n.id, F.lit(" (+"), F.format_string("%.1f", F.coalesce(n.relativeTime, F.lit(0)) / 1000), F.lit("s): "), F.coalesce(n.action.raw, F.lit("initial_state")), mark)

    cp = F.transform("checkpoints", lambda c: F.concat(F.lit("  ["), c.stepNumber, F.lit("]: "), c.description))
    plan = F.transform("taskPlan.steps", lambda s: F.concat(F.lit("  "), s.n, F.lit(". "), s["desc"], F.when(s.done, " (DONE)").otherwise(" (PENDING)")))
    none = F.array().cast("array<string>")
    block = lambda title, rows: F.when(F.size(rows) > 0, F.concat(F.array(F.lit(f"\n{title}:")), rows)).otherwise(none)
    text = F.array_join(F.concat(F.transform("nodes", line), block("CHECKPOINTS", cp), block("TASK PLAN", plan)), "\n")
    return runs.select("taskId", text.alias("text"))


def successful_approaches(runs: DataFrame, kind: Column) -> DataFrame:
    """(kind, taskId, approach, checkpoints, lesson): the branches that succeeded, with what their runs reached."""
    own = runs.select(kind.alias("kind"), "taskId", F.transform("checkpoints", lambda c: c.description).alias("checkpoints"), F.explode("branches").alias("b")).where("b.status = 'succeeded'")
    return own.select("kind", "taskId", F.coalesce("b.approach", F.lit("unknown")).alias("approach"), "checkpoints", "b.lesson")
