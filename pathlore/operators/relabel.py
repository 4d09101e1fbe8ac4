"""Runs read again: demonstrations, goals reached on the way, plans back to a checkpoint, branches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathlore.functions import patterns as p
from pathlore.functions.lessons import clamp, matches
from pathlore.operators.merging import written


def demo_confidence(good: Column, actions: Column, seconds: Column, kinds: Column) -> Column:
    """How far a demonstration is to be trusted: from .5 by outcome, number of actions, seconds and kinds of actions."""
    score = (
        0.5
        + F.when(good, 0.2).otherwise(-0.1)
        + F.when(actions.between(3, 20), 0.15).when(actions > 50, -0.1).otherwise(0.0)
        + F.when(seconds.between(2, 60), 0.15).when(seconds > 120, -0.1).otherwise(0.0)
        + F.when(kinds >= 2, 0.1).otherwise(0.0)
    )
    return clamp(score)


def demo_lessons(clicks: Column, types: Column, keys: Column, mean_delay: Column, most_delay: Column, good: Column, actions: Column, seconds: Column) -> Column:
    """Lessons of a demonstration: how it was done, its waits (in seconds), its outcome."""
    how = F.when(clicks > types + keys, "Primary interaction method: mouse clicks on visual elements").when(keys > clicks, "Primary interaction method: keyboard shortcuts").when(types > 0, "Task requires text input via keyboard typing")
    wait = F.when((most_delay > 3) & (most_delay > mean_delay * 3), F.format_string("Task requires waiting for UI updates (observed %.1fs delay)", most_delay)).when(mean_delay < 0.5, "Rapid sequential actions without delays")
    end = F.when(good, F.format_string("Task completed successfully in %d actions over %.1fs", actions, seconds)).otherwise("Task execution incomplete or unsuccessful")
    return F.array_compact(F.array(how, wait, end))


def strategies(kinds: Column, coordinates: Column, targets: Column) -> Column:
    """What a successful demonstration did: its first five kinds of actions, and how it aimed."""
    first = F.when(F.size(kinds) > 0, F.concat(F.lit("Action sequence: "), F.array_join(F.slice(kinds, 1, 5), " -> ")))
    aim = F.when(targets, "Used semantic target identification (element labels)").when(coordinates, "Used coordinate-based targeting")
    return F.array_compact(F.array(first, aim))


def prefix_lessons(names: Column, distinct: Column, steps: Column, goal: Column) -> Column:
    """Lessons of the steps up to a goal: kinds of actions (the first three of ``distinct``), their number, the goal."""
    kinds = F.when(distinct == 1, F.concat(F.lit("Single action type ("), names[0], F.lit(") sufficient for this sub-goal"))).when(distinct > 1, F.concat(F.lit("Multi-step procedure: "), F.array_join(names, ", ")))
    size = F.when(steps <= 3, F.concat(F.lit("Efficient completion: "), steps, F.lit(" actions"))).when(steps > 10, F.concat(F.lit("Complex sub-goal requiring "), steps, F.lit(" actions")))
    return F.slice(F.array_compact(F.array(kinds, size, F.concat(F.lit("Successfully achieved: "), goal))), 1, 3)


def sub_goal(label: Column, comment: Column, action: Column) -> Column:
    full = lambda c: F.nullif(c, F.lit(""))
    return F.coalesce(full(label), full(comment), full(action))


def inferred_goals(steps: DataFrame, action: str) -> DataFrame:
    """``steps`` whose action launches an application or goes somewhere, with ``goal_type``; a step that does both is there twice."""
    launch = steps.where(matches(F.col(action), p.LAUNCHES)).withColumn("goal_type", F.lit("app_launch"))
    return launch.unionByName(steps.where(matches(F.col(action), p.NAVIGATIONS)).withColumn("goal_type", F.lit("web_navigation")))


def way_back(steps: DataFrame, task: str) -> DataFrame:
    """(task, actions, escapes, undos, closes, hides, cost): what leads back from each task's last step to its last checkpoint.

    ``steps`` has idx, checkpoint (boolean), type, text, command and y of the action. Tasks without a
    checkpoint, or that are at it, have no row.
    """
    whole = Window.partitionBy(task)
    own = steps.withColumn("_cp", F.max(F.when(F.col("checkpoint"), F.col("idx"))).over(whole)).where((F.col("idx") > F.col("_cp")) & F.col("type").isNotNull())
    text, kind = F.lower(F.coalesce("text", F.lit(""))), F.col("type")
    key = kind == "key"
    has = lambda *xs: F.greatest(*[F.contains(text, F.lit(x)) for x in xs]) if len(xs) > 1 else F.contains(text, F.lit(xs[0]))
    window = key & has("cmd+n", "cmd+shift+n")
    tab = key & ~window & has("cmd+t")
    dialog = key & ~window & ~tab & has("cmd+space", "cmd+o")
    letter = key & ~window & ~tab & ~dialog & (F.length(text) == 1)
    click = kind.isin("left_click", "right_click", "double_click")
    menus = F.when(dialog, 1).otherwise(0) + F.when(click & (F.col("y") < 30), 1).otherwise(0) + F.when(kind == "right_click", 1).otherwise(0)
    typed = F.when(kind == "type", F.greatest(F.lit(1), F.ceil(F.length(text) / 20))).when(letter, 1).otherwise(0)
    opened = (kind == "bash") & F.contains(F.lower(F.coalesce("command", F.lit(""))), F.lit("open "))
    n = own.groupBy(task).agg(
        F.count("*").alias("actions"),
        F.sum(menus).alias("menus"),
        F.sum(typed).alias("typed"),
        F.count_if(window | tab).alias("opened"),
        F.max(opened.cast("int")).alias("app"),
    )
    escapes, undos = F.least("menus", F.lit(3)), F.least("typed", F.lit(10))
    some = escapes + undos * 2 + F.col("opened") * 3 + F.col("app") * 3
    cost = F.when(some == 0, 2).otherwise(some)  # two escapes to be sure
    return n.select(task, "actions", F.when(some == 0, 2).otherwise(escapes).cast("long").alias("escapes"), undos.cast("long").alias("undos"), F.least("opened", F.lit(5)).cast("long").alias("closes"), F.col("app").cast("long").alias("hides"), cost.cast("long").alias("cost"))


def arrival(last: Column, picture: Column, target: Column, target_picture: Column) -> Column:
    """How the last state matches a checkpoint's: 'exact', 'perceptual' or 'none'."""
    return F.when(target.isNotNull() & (last == target), "exact").when(target_picture.isNotNull() & (picture == target_picture), "perceptual").otherwise("none")


def branch_frames(steps: DataFrame, task: str, ends: Column, failed: Column) -> DataFrame:
    """(task, branch, start, tip, status): steps cut into branches, each ended by a step that ``ends`` marks; the last may be open ('exploring')."""
    so_far = Window.partitionBy(task).orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    own = steps.withColumn("branch", F.coalesce(F.sum(ends.cast("int")).over(so_far), F.lit(0)))
    b = own.groupBy(task, "branch").agg(F.min("idx").alias("start"), F.max("idx").alias("tip"), F.max(F.when(ends, F.when(failed, "failed").otherwise("succeeded"))).alias("status"))
    return b.withColumn("status", F.coalesce("status", F.lit("exploring")))


def auto_lesson(checkpoint: Column, actions: Column, approach: Column, failure: Column) -> Column:
    """A failed branch's lesson from its last three actions."""
    recent = F.slice(actions, F.greatest(F.lit(1), F.size(actions) - 2), F.lit(3))
    return F.concat(F.lit('After "'), F.coalesce(checkpoint, F.lit("initial state")), F.lit('", tried ['), F.when(F.size(recent) > 0, F.array_join(recent, ", ")).otherwise(approach), F.lit("] but "), failure)


def waves(plan: DataFrame, needs: DataFrame, most: int = 1000) -> DataFrame:
    """(step, wave): the round in which each step may run, once all that it needs have run; steps in circles or behind them have none.

    ``plan`` has (step), ``needs`` (step, needed). Each round settles one wave with an anti-join of
    the open steps with their open needs, and its result is written, so lineage doesn't grow. The needs of settled steps, and those
    that were settled in a round, are left out of the next one; a need of a step that isn't there stays. Open steps and needs are
    never broadcast, so they don't pass through the driver.
    """
    spark = plan.sparkSession
    left, open_needs, out, n = written(plan.select("step").distinct(), "left"), written(needs.select("step", "needed"), "needs"), None, 0
    while n < most:
        waiting = open_needs.select("step").hint("merge")
        ready = written(left.join(waiting, "step", "left_anti").withColumn("wave", F.lit(n)), "ready")
        if ready.isEmpty():
            break
        out = ready if out is None else out.unionByName(ready)
        done = ready.select("step").hint("merge")
        left = written(left.join(done, "step", "left_anti"), "left")
        open_needs = written(open_needs.join(done.withColumnRenamed("step", "needed"), "needed", "left_anti").select("step", "needed"), "needs")
        n += 1
    return out if out is not None else spark.createDataFrame([], f"step {plan.schema['step'].dataType.simpleString()}, wave int")
