"""State kept from evidence: thresholds, retention, graduation and time-bound reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def thresholds(reflections: Column, types: Column, patterns: Column, mean_rate: Column) -> list[Column]:
    """Caps and graduation limits that grow with the evidence: counts of reflections, types and patterns, mean success rate."""
    root = F.sqrt(patterns)
    return [
        F.greatest(F.lit(30), 8 * types).cast("long").alias("reflections_cap"),
        F.greatest(F.lit(20), patterns + F.ceil(2 * root)).cast("long").alias("patterns_cap"),
        F.greatest(F.lit(15), F.floor(2 * root)).cast("long").alias("strategies_cap"),
        F.greatest(F.lit(3), F.ceil(F.sqrt(reflections))).cast("long").alias("graduation_occurrences"),
        F.round(F.least(F.lit(0.9), F.greatest(F.lit(0.6), mean_rate + 0.1)), 6).alias("graduation_success"),
    ]


def newest_per_type(rows: DataFrame, kind: str, ts: str, key: str, cap: int) -> DataFrame:
    """The newest max(2, ceil(cap / types)) rows of each type, then the newest ``cap`` of all; ties by smallest key."""
    types = rows.select(kind).distinct().agg(F.greatest(F.lit(2), F.ceil(cap / F.greatest(F.count("*"), F.lit(1)))).alias("_k"))
    order = [F.col(ts).desc(), F.col(key)]
    few = rows.withColumn("_r", F.row_number().over(Window.partitionBy(kind).orderBy(*order))).where(F.col("_r") <= cap + 2)
    return few.crossJoin(F.broadcast(types)).where("_r <= _k").drop("_r", "_k").orderBy(*order).limit(cap)


def graduated(evidence: DataFrame, key: str, good: Column, occurrences: int, success: float) -> DataFrame:
    """Groups seen often enough with a high enough share of good rows."""
    return evidence.groupBy(key).agg(F.count("*").alias("occurrences"), F.avg(good.cast("double")).alias("rate")).where((F.col("occurrences") >= occurrences) & (F.col("rate") >= success))


def quiet(ts: Column, start: int, end: int) -> Column:
    """Whether the hour lies in [start, end), which may wrap around midnight."""
    h = F.hour(ts)
    return (h >= start) & (h < end) if start <= end else (h >= start) | (h < end)


def newest_messages(rows: DataFrame, session: str, turn: str, keep: int) -> DataFrame:
    """The last ``keep`` messages of each session."""
    w = Window.partitionBy(session).orderBy(F.col(turn).desc())
    return rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= keep).drop("_r")


def desktop_thresholds(reflections: Column, types: Column, segments: Column, mean_rate: Column, mean_words: Column) -> list[Column]:
    """Caps of the segment and skill libraries, graduation limits, and the similarity from which two segments are one."""
    root = F.sqrt(F.greatest(segments, F.lit(1)))
    return [
        F.greatest(F.lit(20), 5 * types).cast("long").alias("reflections_cap"),
        F.greatest(F.lit(30), segments + F.ceil(3 * root)).cast("long").alias("segments_cap"),
        F.greatest(F.lit(20), F.floor(3 * root)).cast("long").alias("skills_cap"),
        F.greatest(F.lit(3), F.ceil(F.sqrt(F.greatest(reflections, F.lit(1))))).cast("long").alias("graduation_occurrences"),
        F.round(F.least(F.lit(0.9), F.greatest(F.lit(0.5), mean_rate + 0.1)), 6).alias("graduation_success"),
        F.round(F.greatest(F.lit(0.3), 1 - 1 / F.sqrt(F.greatest(mean_words, F.lit(1.0)))), 6).alias("same_above"),
    ]


def importance(score: Column, days: Column, accesses: Column) -> Column:
    """A memory's score, decayed by days since its last access and raised by the number of accesses."""
    return score * F.greatest(F.lit(0.1), 1 / F.log10(days + 10)) * (1 + 0.3 * F.log10(accesses + 1))


def near_checkpoint(status: Column, frame: Column, checkpoint: int, within: int = 3) -> Column:
    """Whether a failed branch begins no more than so many frames from a checkpoint."""
    return (status == "failure") & (F.abs(frame - checkpoint) <= within)


def checkpoint_lessons(branches: DataFrame, checkpoints: DataFrame, task: str, within: int = 3) -> DataFrame:
    """(task, node, branch, base, lesson): for each checkpoint (task, node) the lessons of the failed branches (task, branch, base, status, lesson) that begin so near to it.

    A branch meets the checkpoints at the few frames around its own, so a task's branches and checkpoints aren't paired.
    """
    failed = branches.where((F.col("status") == "failed") & F.col("lesson").isNotNull())
    near = failed.select(task, "branch", "base", "lesson", F.explode(F.sequence(F.col("base") - within, F.col("base") + within)).alias("node"))
    return near.join(checkpoints.select(task, "node").distinct(), [task, "node"]).select(task, "node", "branch", "base", "lesson")


def execution_stats(rows: DataFrame, tool: Column, good: Column, ms: str) -> DataFrame:
    """Executions by tool: how many, how many good, mean, most and least time."""
    return rows.groupBy(tool).agg(F.count("*").alias("n"), F.count_if(good).alias("good"), F.round(F.avg(ms), 6).alias("mean_ms"), F.max(ms).alias("most_ms"), F.min(ms).alias("least_ms"))


def task_signature(schedule: Column, action: Column) -> Column:
    """16 hex digits of the SHA-256 of a task's schedule and action as JSON, fields in their order."""
    return F.substring(F.sha2(F.to_json(F.struct(schedule.alias("schedule"), action.alias("action"))), 256), 1, 16)


def admitted(tasks: DataFrame, creator: str, seconds: str, signature: str, key: str, most: int = 50, active: int = 200, step: int = 1000) -> DataFrame:
    """``tasks`` with outcome, in order of time and key, each seeing the tasks that were created before it only.

    'rate_limit' where ``most`` tasks of the creator were created in the hour before (less than 3600 seconds),
    else 'full' where ``active`` tasks were, else 'deduplicated' where one with the signature was, else 'created'.

    No more than ``active`` tasks can be created, and only they bear on others. So they are found in rounds: a
    task that the created ones so far refuse stays refused, the first ``step`` others in order come to the
    driver and are gone through, and the next round goes on behind them. Times are whole numbers.
    """
    spark = tasks.sparkSession
    kinds = {c: tasks.schema[c].dataType.simpleString() for c in (creator, seconds, signature, key)}
    place = F.struct(F.col(seconds).alias("s"), F.col(key).alias("k"))
    slot = f"struct<s:{kinds[seconds]},k:{kinds[key]}>"

    def against(created: list[tuple]) -> DataFrame:
        """The tasks with how many were created before them, of their creator in the hour, and with their signature."""
        rows = spark.createDataFrame([(c, sig, (s, k)) for c, s, sig, k in created], f"_c {kinds[creator]}, _sig {kinds[signature]}, _p {slot}")
        by_creator = F.broadcast(rows.groupBy("_c").agg(F.collect_list("_p").alias("_of")))
        by_signature = F.broadcast(rows.groupBy(F.col("_sig").alias("_s")).agg(F.min("_p").alias("_same")))
        whole = F.broadcast(rows.agg(F.collect_list("_p").alias("_all")))
        own = tasks.join(by_creator, F.col(creator).eqNullSafe(F.col("_c")), "left").join(by_signature, F.col(signature).eqNullSafe(F.col("_s")), "left").crossJoin(whole)
        before = lambda p: p < place
        recent = F.size(F.filter(F.coalesce("_of", F.array().cast(f"array<{slot}>")), lambda p: before(p) & (p.s > F.col(seconds) - 3600)))
        found = own.withColumn("_recent", recent).withColumn("_before", F.size(F.filter("_all", before))).withColumn("_known", F.coalesce(before(F.col("_same")), F.lit(False)))
        return found.drop("_c", "_of", "_s", "_same", "_all")

    created: list[tuple] = []
    last = None
    while len(created) < active:
        ahead = against(created).where((F.col("_recent") < most) & ~F.col("_known"))
        if last is not None:
            ahead = ahead.where(place > F.struct(F.lit(last[0]).cast(kinds[seconds]).alias("s"), F.lit(last[1]).cast(kinds[key]).alias("k")))
        some = ahead.orderBy(seconds, key).select(creator, seconds, signature, key).limit(step).collect()
        if not some:
            break
        for c, s, sig, k in some:
            if len(created) < active and sum(x[0] == c and x[1] > s - 3600 for x in created) < most and all(x[2] != sig for x in created):
                created.append((c, s, sig, k))
        last = (some[-1][1], some[-1][3])
    outcome = F.when(F.col("_recent") >= most, "rate_limit").when(F.col("_before") >= active, "full").when(F.col("_known"), "deduplicated").otherwise("created")
    return against(created).withColumn("outcome", outcome).drop("_recent", "_before", "_known")


def context_thresholds(reflections: Column, mean_lessons: Column, skills: Column, segments: Column, mean_rate: Column) -> list[Column]:
    """How much past experience a task is told (of 500 tokens), from what score on, and the fixed caps of the environment."""
    root = lambda n, by: F.sqrt(F.greatest(F.lit(1.0), n / by))
    occurrences = F.greatest(F.lit(3), F.ceil(F.sqrt(F.greatest(reflections, F.lit(1)))))
    fits = lambda share, tokens: F.greatest(F.lit(1), F.floor(share / tokens)).cast("long")
    return [
        fits(F.lit(500 * 0.5), (3 + mean_lessons) * 15).alias("max_reflections"),
        fits(F.lit(500 * 0.35), F.lit(45)).alias("max_skills"),
        fits(F.lit(500 * 0.15), F.lit(30)).alias("max_segments"),
        F.round(F.greatest(F.lit(0.05), 0.15 / root(reflections, 10)), 6).alias("reflection_above"),
        F.round(F.greatest(F.lit(0.03), 0.1 / root(skills, 5)), 6).alias("skill_above"),
        F.round(F.greatest(F.lit(0.05), 0.2 / root(segments, 10)), 6).alias("segment_above"),
        F.greatest(F.lit(2), F.floor(F.sqrt(occurrences))).cast("long").alias("least_occurrences"),
        F.round(F.greatest(F.lit(0.4), mean_rate), 6).alias("least_success"),
        *[F.lit(n).alias(name) for name, n in (("entity_cap", 60), ("shortcut_cap", 30), ("convention_cap", 10), ("environment_tokens", 50))],
    ]
