"""Quality of lessons, types and difficulty of tasks, as columns."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as p

_WORD = "[A-Za-z0-9_]"
#: A word boundary between ASCII words, which \b isn't in this JVM's patterns.
BOUNDARY = rf"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))"


def ascii_words(pattern: str) -> str:
    """The pattern with ASCII word boundaries: before a word or a group of words nothing of a word may stand, after one nothing may follow."""
    before = re.sub(r"\\b(?=\w|\((?!\?)|\\d)", lambda m: f"(?<!{_WORD})", pattern)
    return before.replace(r"\b", f"(?!{_WORD})")


def matches(text: Column, pattern: str, fold: bool = True) -> Column:
    """Whether a pattern with ASCII word boundaries is in the text, in any case of letters by default."""
    return text.rlike(("(?i)" if fold else "") + ascii_words(pattern))


def clamp(value: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))


def _count(text: Column, of: list[str], fold: bool = True) -> Column:
    total = F.lit(0)
    for pattern in of:
        total = total + matches(text, pattern, fold).cast("int")
    return total


def mean_of(lessons: Column, score: Callable[[Column], Column]) -> Column:
    """The mean score of an array's lessons; 0 if there is none."""
    total = F.aggregate(F.transform(lessons, score), F.lit(0.0), lambda a, x: a + x)
    return F.when(F.coalesce(F.size(lessons), F.lit(0)) <= 0, 0.0).otherwise(total / F.size(lessons))


def specificity(lessons: Column) -> Column:
    return mean_of(lessons, lambda x: clamp(0.25 * _count(x, p.CONCRETE) - 0.15 * _count(x, p.VAGUE)))


def actionability(lessons: Column) -> Column:
    return mean_of(lessons, lambda x: clamp(0.5 + 0.2 * _count(x, p.ACTIONABLE) - 0.15 * _count(x, p.DESCRIPTIVE)))


def coherence(lessons: Column, outcome: Column, failures: Column, strategies: Column) -> Column:
    """Whether a lesson's language and the points named with it fit the outcome; 0 without lessons."""
    text = F.lower(F.array_join(lessons, " "))
    bad, good = matches(text, p.FAILURE, False), matches(text, p.SUCCESS, False)
    some = [F.coalesce(F.size(c), F.lit(0)) > 0 for c in (failures, strategies)]
    success = F.when(good | some[1], 0.3).otherwise(0.0) - F.when(bad & ~some[0], 0.2).otherwise(0.0)
    failure = F.when(bad | some[0], 0.3).otherwise(0.0) - F.when(good & ~bad, 0.2).otherwise(0.0)
    score = clamp(0.5 + F.when(outcome == "success", success).when(outcome == "failure", failure).otherwise(0.0))
    return F.when(F.coalesce(F.size(lessons), F.lit(0)) <= 0, 0.0).otherwise(score)


def novelty(lessons: Column) -> Column:
    def score(x: Column) -> Column:
        n = F.size(F.split(x, r"\s+"))
        trivial = _count(x, p.TRIVIAL) > 0
        return clamp(0.5 + F.when(n < 5, -0.2).when(n > 12, 0.1).otherwise(0.0) + F.when(trivial, -0.2).otherwise(0.2 * _count(x, p.NOVEL)))

    return mean_of(lessons, score)


def quality(lessons: Column, outcome: Column, failures: Column, strategies: Column) -> Column:
    """Struct of the four scores, their mean, and whether it is .6 or more."""
    parts = {"specificity": specificity(lessons), "actionability": actionability(lessons), "coherence": coherence(lessons, outcome, failures, strategies), "novelty": novelty(lessons)}
    mean = (parts["specificity"] + parts["actionability"] + parts["coherence"] + parts["novelty"]) / 4
    return F.struct(*[c.alias(k) for k, c in parts.items()], mean.alias("quality"), (mean >= 0.6).alias("is_valid"))


def first_type(text: Column, types: list[tuple[str, str]], other: str) -> Column:
    """The name of the first pattern that the lower-case text has."""
    low = F.lower(F.coalesce(text, F.lit("")))
    out = F.lit(other)
    for pattern, name in reversed(types):
        out = F.when(matches(low, pattern, False), name).otherwise(out)
    return out


def request_type(text: Column) -> Column:
    return first_type(text, p.REQUEST_TYPES, p.OTHER_REQUEST)


def demo_type(text: Column) -> Column:
    return first_type(text, p.DEMO_TYPES, p.OTHER_INTERACTION)


def goal_type(text: Column) -> Column:
    return first_type(text, p.GOAL_TYPES, p.OTHER_INTERACTION)


def difficulty(text: Column) -> Column:
    """From .3 upward by words of order, condition, precision, place, checks and number."""
    low = F.lower(F.coalesce(text, F.lit("")))
    score = F.lit(0.3)
    for word in p.STEP_WORDS:
        score = score + F.when(F.contains(low, F.lit(word)), 0.1).otherwise(0.0)
    for pattern, more in p.HARDER:
        score = score + F.when(matches(low, pattern, False), more).otherwise(0.0)
    return clamp(score)


def failure_mode(outcome: Column, loops: Column, stagnations: Column, iterations: Column) -> Column:
    mode = F.when(loops > 0, "loop").when(stagnations > 0, "stagnation").when(iterations > 20, "complexity").otherwise("execution_error")
    return F.when(outcome == "failure", mode).otherwise("unknown")


def task_difficulty(text: Column, mode: Column) -> Column:
    """The difficulty, raised by how the task failed."""
    more = F.when(mode == "loop", 0.15).when(mode == "complexity", 0.2).when(mode == "unknown", 0.0).otherwise(0.1)
    return F.least(F.lit(1.0), difficulty(text) + more)


# Cost from which a task of a type is dear, and from which any other is.
DEAR = {"vision": 1.5, "desktop_action": 0.5, "briefing": 0.3, "general": 0.25}
DEAR_OTHERWISE = 0.2


def rule_lessons(kind: Column, outcome: Column, iterations: Column, cost: Column, tools: Column, error: Column) -> Column:
    """Lessons that follow from a run's numbers alone; counts of 0 and nulls count as unknown."""
    from .scalar import lookup

    few = F.when(F.coalesce(iterations, F.lit(0)) == 0, 999).otherwise(iterations)
    names = F.array_distinct(tools)
    n = F.coalesce(iterations, F.lit(0))
    return F.array_compact(
        F.array(
            F.when((few <= 4) & (outcome == "success"), F.concat(F.lit("Efficient approach: "), F.array_join(names, ", "), F.lit(" in "), n, F.lit(" iterations for "), kind)),
            F.when(n > 6, F.concat(F.lit("High iteration count ("), n, F.lit("): consider more targeted tool selection"))),
            F.when(F.coalesce(cost, F.lit(0.0)) > lookup(kind, DEAR, DEAR_OTHERWISE), F.concat(F.lit("High cost ($"), F.format_string("%.2f", cost), F.lit(") for "), kind, F.lit(": consider optimizing"))),
            F.when(outcome == "failure", F.concat(F.lit("Failed task type '"), kind, F.lit("': "), F.coalesce(error, F.lit("unknown error")))),
            F.when((F.size(names) >= 3) & (few <= 3), F.concat(F.lit("Good fan-out pattern: "), F.size(names), F.lit(" tools in "), n, F.lit(" iterations"))),
        )
    )


def lesson_class(lesson: Column) -> Column:
    """'success', 'failure' or null, by words that the lesson has."""
    low = F.lower(lesson)
    has = lambda words: F.coalesce(F.array_contains(F.array(*[F.contains(low, F.lit(w)) for w in words]), True), F.lit(False))
    return F.when(has(["success", "worked", "effective"]), "success").when(has(["fail", "error", "avoid"]), "failure")


def fallback_judge(action: Column, confidence: Column, cost: Column) -> Column:
    """A rule's verdict on a candidate: goal .5, safety .3, progress .2."""
    goal = F.when(F.coalesce(confidence, F.lit(0.0)) == 0, 0.5).otherwise(confidence)
    safety = F.when(action == "key", 0.9).otherwise(0.8) * F.when(cost > 3, 0.9).otherwise(1.0)
    progress = F.when(action == "click", 0.7).when(action == "type", 0.8).otherwise(0.6)
    return 0.5 * goal + 0.3 * safety + 0.2 * progress
