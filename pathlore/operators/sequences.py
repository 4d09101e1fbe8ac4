"""Step-sequence diagnostics. Steps are rows (task, idx from 0, state hash, acted)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathlore.functions.text import expectation_terms


def indexed(df: DataFrame, task: str, *order: str) -> DataFrame:
    """``df`` with the step number ``idx`` (from 0) within each task."""
    return df.withColumn("idx", (F.row_number().over(Window.partitionBy(task).orderBy(*order)) - 1).cast("long"))


def lookback(n: Column) -> Column:
    """How many steps back a loop is looked for, with n steps so far."""
    return F.least(F.lit(50), F.greatest(F.lit(10), F.floor(n * 0.6)))


def _nearest(task: str, state: str) -> Column:
    """The nearest step two or more back with the same state: one of the state's last two, so no self-join is needed."""
    by_state = Window.partitionBy(task, state).orderBy("idx")
    one, two = F.lag("idx", 1).over(by_state), F.lag("idx", 2).over(by_state)
    return F.when(F.col(state).isNotNull(), F.when(one <= F.col("idx") - 2, one).otherwise(two))


def flags(steps: DataFrame, task: str, state: str, picture: str | None = None, acted: Column | None = None) -> DataFrame:
    """Adds stagnation, loop_at and loop_by.

    Stagnation: the same state as the step before, though something was done (``acted``). loop_at: the
    nearest step two or more back, within the lookback, with the same state or the same ``picture``
    (a coarser state); loop_by: 'exact' or 'perceptual'. A step without a state has neither.
    """
    known = F.col(state).isNotNull()
    least = F.greatest(F.lit(0), F.col("idx") - lookback(F.col("idx") + 1))
    exact = _nearest(task, state)
    out = steps.withColumn("_exact", F.when(known & (exact >= least), exact))
    if picture:
        like = _nearest(task, picture)
        out = out.withColumn("_like", F.when(known & (like >= least), like))
    else:
        out = out.withColumn("_like", F.lit(None).cast("long"))
    same = F.coalesce(F.lag(state).over(Window.partitionBy(task).orderBy("idx")) == F.col(state), F.lit(False))
    out = out.withColumn("stagnation", same & (F.lit(True) if acted is None else F.coalesce(acted, F.lit(False))))
    out = out.withColumn("loop_at", F.greatest("_exact", "_like"))
    return out.withColumn("loop_by", F.when(F.col("loop_at") == F.col("_exact"), "exact").when(F.col("loop_at").isNotNull(), "perceptual")).drop("_exact", "_like")


def surprise(expected: Column, seen: Column) -> Column:
    """1 less the share of the expected terms that were seen; a term that is part of a seen one, or has one as a part, counts half. Null without terms."""
    hit = lambda k: F.when(F.array_contains(seen, k), 1.0).when(F.exists(seen, lambda o: F.contains(o, k) | F.contains(k, o)), 0.5).otherwise(0.0)
    hits = F.aggregate(F.transform(expected, hit), F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(expected) > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - hits / F.size(expected))))


def surprises(flagged: DataFrame, task: str, expectation: str, observed: Column, navigated: Column | None = None, given: Column | None = None) -> DataFrame:
    """Adds surprise (0 to 1) and surprised (above .5), from the expectation of the step before and what was observed.

    A score that the agent gave itself (``given``) goes first. Steps that were expected to navigate
    have none, and neither has a task's last step, whose successor would settle it; a given score
    counts there too.
    """
    by_task = Window.partitionBy(task).orderBy("idx")
    more = F.concat_ws(" ", F.when(F.col("loop_at").isNotNull(), "loop detected same screen"), F.when(F.col("stagnation"), "stagnation no change"))
    own = flagged.withColumn("_expected", expectation_terms(F.lag(expectation).over(by_task))).withColumn("_last", F.lead("idx").over(by_task).isNull())
    score = F.when(~F.col("_last") & (F.lit(True) if navigated is None else ~F.coalesce(navigated, F.lit(False))), surprise(F.col("_expected"), expectation_terms(F.concat_ws(" ", observed, more))))
    if given is not None:
        score = F.when(given.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), given))).otherwise(score)
    return own.withColumn("surprise", score).withColumn("surprised", F.coalesce(F.col("surprise") > 0.5, F.lit(False))).drop("_expected", "_last")


def recovery(flagged: DataFrame, task: str, checkpoint: Column | None = None) -> DataFrame:
    """A row for each task: counts, issue rate, rate in the recent window, issues since the last checkpoint, and recovery level 0-3.

    ``flagged`` has stagnation and loop_at, and may have surprised.
    """
    surprised = F.col("surprised") if "surprised" in flagged.columns else F.lit(False)
    looped = F.col("loop_at").isNotNull()
    number = sum((F.when(c, 1).otherwise(0) for c in (F.col("stagnation"), looped, surprised)), F.lit(0))  # a step may have several issues
    whole = Window.partitionBy(task)
    own = flagged.withColumn("_issues", number).withColumn("_n", F.count("*").over(whole))
    own = own.withColumn("_from", F.max(F.when(F.lit(False) if checkpoint is None else checkpoint, F.col("idx"))).over(whole))
    window = F.greatest(F.lit(3), F.floor(F.sqrt("_n") * 2))
    per = own.groupBy(task).agg(
        F.max("_n").alias("n_steps"),
        F.count_if(looped).alias("loops"),
        F.count_if("stagnation").alias("stagnations"),
        F.count_if(surprised).alias("surprises"),
        F.count_if((F.col("_issues") > 0) & (F.col("idx") >= F.col("_n") - window)).alias("recent"),
        F.sum(F.when(F.col("idx") > F.coalesce("_from", F.lit(-1)), F.col("_issues")).otherwise(0)).alias("run"),
    )
    root = F.sqrt("n_steps")
    rate = (F.col("loops") + F.col("surprises") * 0.5 + F.col("stagnations") * 0.4) / F.col("n_steps")
    recent = F.col("recent") / F.greatest(F.lit(3), F.floor(root * 2))

    def bound(low: int, part: int) -> Column:
        return F.greatest(F.lit(low), F.floor(root / part))

    run = F.col("run")
    level = (
        F.when((recent >= 0.75) | (run >= bound(3, 1)), 3)
        .when((rate >= 0.35) | (recent >= 0.6) | (run >= bound(2, 2)), 2)
        .when((rate >= 0.1) | (recent >= 0.25) | (run >= bound(1, 3)), 1)
        .otherwise(0)
    )
    return per.select(task, "n_steps", "loops", "stagnations", "surprises", F.round(rate, 6).alias("issue_rate"), F.round(recent, 6).alias("recent_rate"), run.alias("issue_run"), level.alias("recovery_level"))


def prefixes(steps: DataFrame, task: str, checkpoint: Column, name: Column, keep: int = 3) -> DataFrame:
    """(task, idx, steps, names): for each checkpoint step the number of steps up to it and the first ``keep`` distinct names among them."""
    first = Window.partitionBy(task, "_name").orderBy("idx")
    so_far = Window.partitionBy(task).orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    own = steps.withColumn("_name", name).withColumn("_new", F.when((F.row_number().over(first) == 1) & (F.col("_name") != ""), F.col("_name")))
    numbered = own.withColumn("_rank", F.when(F.col("_new").isNotNull(), F.count("_new").over(so_far)))
    some = F.collect_list(F.when(F.col("_rank") <= keep, F.col("_new"))).over(so_far)
    return numbered.withColumn("names", some).withColumn("steps", F.col("idx") + 1).withColumn("distinct_names", F.count("_new").over(so_far)).where(checkpoint).select(task, "idx", "steps", "names", "distinct_names")


def bisect_probes(good: int, bad: int, judge) -> tuple[int | None, list[int], str]:
    """The first bad step between a good and a bad one, the steps looked at on the way, and the confidence.

    ``judge`` tells whether a step is bad; from the first bad step on all must be. If the first step
    is bad already it is the answer with confidence 'low'; if the last one is good there is none.
    About log2 of the distance steps are looked at, on the driver: for a judge that costs more than a
    pass over the steps.
    """
    if good >= bad:
        raise ValueError(f"no steps between {good} and {bad}")
    probes = [good]
    if judge(good):
        return good, probes, "low"
    probes.append(bad)
    if not judge(bad):
        return None, probes, "none"
    while bad - good > 1:
        middle = (good + bad) // 2
        probes.append(middle)
        good, bad = (good, middle) if judge(middle) else (middle, bad)
    return bad, probes, "high"
