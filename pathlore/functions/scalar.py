"""Time, cost, score and naming expressions as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Cost of an action, number of rollouts by complexity.
ACTION_COST = {"click": 2, "type": 3, "key": 1, "scroll": 2, "drag": 4}
OTHER_COST = 3
ROLLOUTS = {"simple": 3, "medium": 5, "complex": 8}
OTHER_ROLLOUTS = 5


def lookup(key: Column, table: dict, default) -> Column:
    """The table's value of a key; the default for unknown and null keys."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key), F.lit(default))


def clip(text: Column, longest: int = 200) -> Column:
    """The text, or its first characters and an ellipsis; null becomes empty."""
    return F.when(F.length(text) > longest, F.concat(F.substring(text, 1, longest), F.lit("..."))).otherwise(F.coalesce(text, F.lit("")))


def minutes_seconds(ms: Column) -> Column:
    """``m:ss``."""
    return F.format_string("%d:%02d", F.floor(ms / 60000), F.floor(ms / 1000) % 60)


def clock_to_ms(text: Column) -> Column:
    """Milliseconds of ``h:m:s`` or ``m:s``; 0 for any other number of parts."""
    parts = F.transform(F.split(text, ":"), lambda p: p.try_cast("double"))
    three = parts[0] * 3600 + parts[1] * 60 + parts[2]
    return F.when(F.size(parts) == 3, three * 1000).when(F.size(parts) == 2, (parts[0] * 60 + parts[1]) * 1000).otherwise(0.0)


def duration(ms: Column) -> Column:
    """The two largest units of a duration: ``3d 4h``, ``4h 5m``, ``5m 6s`` or ``6s``."""
    s = F.floor(ms / 1000)
    m, h, d = F.floor(ms / 60000), F.floor(ms / 3600000), F.floor(ms / 86400000)
    return F.when(d > 0, F.format_string("%dd %dh", d, h % 24)).when(h > 0, F.format_string("%dh %dm", h, m % 60)).when(m > 0, F.format_string("%dm %ds", m, s % 60)).otherwise(F.format_string("%ds", s))


def subtitle_ms(text: Column) -> Column:
    """60 ms a character, between 2 and 10 seconds."""
    return F.greatest(F.lit(2000), F.least(F.lit(10000), F.coalesce(F.length(text), F.lit(0)) * 60))


def composite(support: Column, judge: Column, cost: Column) -> Column:
    """Judge, support (saturating at 5) and cost weighted .5, .3 and .2, in 0..1; null or NaN take 0, .5 and 3."""

    def finite(c: Column, default: float) -> Column:
        c = c.cast("double")
        return F.when(c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")), default).otherwise(c)

    raw = 0.5 * finite(judge, 0.5) + 0.3 * F.least(finite(support, 0.0) / 5, F.lit(1.0)) + 0.2 * (1 - (finite(cost, 3.0) - 1) / 4)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))


def two_word_type(text: Column) -> Column:
    """The first two words of 3 or more letters, lower-case; ``unknown`` without any."""
    words = F.slice(F.filter(F.split(F.regexp_replace(F.lower(text), r"[^a-z0-9_\s]", " "), r"\s+"), lambda w: F.length(w) > 2), 1, 2)
    return F.when(text.isNull() | (F.size(words) == 0), "unknown").otherwise(F.array_join(words, " "))
