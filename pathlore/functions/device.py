"""Rules about screens, clicks, commands and timing, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as p


def scale_factor(width: Column, height: Column) -> Column:
    """How far a picture is shrunk: to 1568 for its long edge and 1.15 million points at most."""
    return F.least(F.lit(1.0), 1568 / F.greatest(width, height), F.sqrt(1_150_000 / (width * height)))


def unscaled(point: Column, factor: Column) -> Column:
    """A point [x, y] of the shrunk picture on the screen; anything else as it is."""
    whole = F.transform(point, lambda c: F.floor(c / factor + 0.5).cast("long"))
    return F.when(F.size(point) >= 2, F.slice(whole, 1, 2)).otherwise(point)


def rescaled(value: Column, now: Column, then: Column) -> Column:
    return F.floor(value * (now / then) + 0.5).cast("long")


def replay_delay(ms: Column, speed: Column) -> Column:
    """A recorded delay at another speed, between 100 and 5000 ms."""
    return F.greatest(F.lit(100.0), F.least(ms / speed, F.lit(5000.0)))


def click_target(text: Column) -> Column:
    """What a text says it will click, of 3 to 59 characters; null if it doesn't say."""
    found = [F.trim(F.regexp_extract(text, "(?i)" + x, 1)) for x in p.CLICK_TARGETS]
    return F.when(F.length(text) >= 5, F.coalesce(*[F.when(F.length(x).between(3, 59), x) for x in found]))


def is_blocked(command: Column) -> Column:
    bad = F.lit(False)
    for pattern in p.BLOCKED_COMMANDS:
        bad = bad | command.rlike(pattern)
    return bad


def correction(target: Column, action: Column, attempt: Column) -> Column:
    """What a user is told after a wrong click, by the number of attempts."""
    t = F.coalesce(F.nullif(target, F.lit("")), F.nullif(action, F.lit("")), F.lit("the highlighted element"))
    say = lambda a, b: F.concat(F.lit(a), t, F.lit(b))
    return F.when(attempt <= 1, say("Almost! Try clicking ", ".")).when(attempt == 2, say("I'm pointing at ", " -- give it a click.")).when(attempt == 3, say("Look for ", ". It's highlighted in blue.")).otherwise(say("Take your time. ", " is right where the pointer is."))


def legal(before: Column, state: Column) -> Column:
    """Whether one state of a tutorial may follow another."""
    ok = F.lit(False)
    for k, v in p.TRANSITIONS.items():
        ok = ok | ((before == k) & state.isin(*v))
    return F.coalesce(ok, F.lit(False))


def iterations(difficulty: Column) -> Column:
    """The middle of the band of iterations that a variant of a task may take (the bands are random there)."""
    d = F.when(F.coalesce(difficulty, F.lit(0.0)) == 0, 0.5).otherwise(difficulty)
    return F.when(d < 0.4, 3).when(d < 0.7, 8).otherwise(18)
