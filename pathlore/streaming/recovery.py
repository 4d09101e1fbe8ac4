"""Recovery level of tasks as their steps arrive, with the same results as ``operators.sequences`` on whole tasks.

A task's state is four variables: the places of the hashes that a loop can still reach, the counts,
the issues of the recent window with the run since the last checkpoint, and what its last step is expected to
settle. All of them stay small, whatever the task's length: hashes of ``REACH`` steps, and issues of the last
2 * sqrt(n) steps.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from pathlore.functions.patterns import EXPECTATION_STOPS
from pathlore.functions.text import expectation_terms
from pathlore.streaming.steps import REACH

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUTPUT = (
    "task {kind}, idx long, stagnation boolean, loop_at long, loop_by string, settled double, n_steps long, loops long, stagnations long, "
    "surprises long, issue_rate double, recent_rate double, issue_run long, recovery_level int"
)
LOOP_TERMS, STILL_TERMS = (tuple(w for w in text.split() if len(w) > 2 and w not in EXPECTATION_STOPS) for text in ("loop detected same screen", "stagnation no change"))


def last_before(places: dict[str, list[int]], key: str | None, idx: int) -> int | None:
    """The last place of a hash that is two or more steps back."""
    own = [i for i in places.get(key, ()) if i <= idx - 2] if key is not None else []
    return own[-1] if own else None


def remember(places: dict[str, list[int]], key: str | None, idx: int) -> None:
    if key is not None:
        places[key] = [*places.get(key, ())[-1:], idx]


def surprise(expected: list[str], seen: list[str]) -> float | None:
    """1 less the share of the expected terms that were seen, those that only overlap with one counting half."""
    if not expected:
        return None
    whole = set(seen)
    hits = sum(1.0 if k in whole else 0.5 if any(k in o or o in k for o in whole) else 0.0 for k in expected)
    return max(0.0, min(1.0, 1 - hits / len(expected)))


def level_of(n: int, loops: int, stagnations: int, surprises: int, recent: int, run: int) -> tuple[float, float, int]:
    """Issue rate, rate in the recent window and recovery level 0-3."""
    root = math.sqrt(n)
    rate, share = (loops + surprises * 0.5 + stagnations * 0.4) / n, recent / max(3, math.floor(root * 2))
    if share >= 0.75 or run >= max(3, math.floor(root)):
        level = 3
    elif rate >= 0.35 or share >= 0.6 or run >= max(2, math.floor(root / 2)):
        level = 2
    else:
        level = int(rate >= 0.1 or share >= 0.25 or run >= max(1, math.floor(root / 3)))
    return rate, share, level


class TaskMonitor(StatefulProcessor):
    """Puts out a row for each step: its flags, the surprise that it settles for the step before (or has been given), and the task's level so far."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.hashes = handle.getValueState("hashes", "keys array<string>, pictures array<boolean>, places array<array<long>>")
        self.counts = handle.getValueState("counts", "n long, loops long, stagnations long, surprises long, last string")
        self.issues = handle.getValueState("issues", "recent array<long>, run long, checkpoint long")
        self.pending = handle.getValueState("pending", "score double, expected array<string>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        places: tuple[dict, dict] = ({}, {})
        if self.hashes.exists():
            for name, picture, own in zip(*self.hashes.get(), strict=True):
                places[bool(picture)][name] = [int(i) for i in own]
        n, loops, stagnations, surprises, last = self.counts.get() if self.counts.exists() else (0, 0, 0, 0, None)
        recent, run, checkpoint = self.issues.get() if self.issues.exists() else ([], 0, -1)
        held, expected = self.pending.get() if self.pending.exists() else (None, [])
        recent, expected, out = [int(i) for i in recent], list(expected), []
        for row in pd.concat(rows).sort_values(["ts", "id"]).itertuples(index=False):
            idx, n = n, n + 1
            state, picture = (None if pd.isna(x) else str(x) for x in (row.state, row.picture))
            # this step settles what the one before it was to show
            settled = held
            if held is not None and held > 0.5:
                surprises += 1
                recent += [idx - 1] if recent[-1:] != [idx - 1] else []
                run += idx - 1 > checkpoint
            stagnation = state is not None and last == state and bool(row.acted)
            least = max(0, idx - min(REACH, max(10, math.floor(n * 0.6))))
            found = [i if state is not None and i is not None and i >= least else None for i in (last_before(places[0], state, idx), last_before(places[1], picture, idx))]
            loop_at = max((i for i in found if i is not None), default=None)
            loop_by = None if loop_at is None else "exact" if loop_at == found[0] else "perceptual"
            given = None if pd.isna(row.given) else max(0.0, min(1.0, float(row.given)))
            seen = [*row.observed, *(LOOP_TERMS if loop_at is not None else ()), *(STILL_TERMS if stagnation else ())]
            held = None if given is not None or row.navigated else surprise(expected, seen)
            issues = int(stagnation) + int(loop_at is not None) + int(given is not None and given > 0.5)
            loops, stagnations, surprises = loops + (loop_at is not None), stagnations + stagnation, surprises + (given is not None and given > 0.5)
            if row.checkpoint:
                checkpoint, run = idx, 0
            else:
                run += issues
            if issues:
                recent.append(idx)
            recent = [i for i in recent if i >= n - max(3, math.floor(math.sqrt(n) * 2))]
            rate, share, level = level_of(n, loops, stagnations, surprises, len(recent), run)
            out.append((key[0], idx, stagnation, loop_at, loop_by, settled if given is None else given, n, loops, stagnations, surprises, rate, share, run, level))
            expected, last = list(row.expected), state
            remember(places[0], state, idx)
            remember(places[1], picture, idx)
        kept = [(name, picture, own) for picture in (False, True) for name, own in places[picture].items() if own[-1] > n - 2 - REACH]
        self.hashes.update(tuple(map(list, zip(*kept, strict=True))) if kept else ([], [], []))
        self.counts.update((n, loops, stagnations, surprises, last))
        self.issues.update((recent, run, checkpoint))
        self.pending.update((held, expected))
        columns = ["task", "idx", "stagnation", "loop_at", "loop_by", "settled", "n_steps", "loops", "stagnations", "surprises", "issue_rate", "recent_rate", "issue_run", "recovery_level"]
        yield pd.DataFrame(out, columns=columns).astype({"loop_at": "Int64", "settled": "float64", "recovery_level": "int32"})

    def close(self) -> None:
        pass


def monitored(steps: DataFrame, task: str = "task") -> DataFrame:
    """A stream of (task, ts, id, state, picture, acted, expectation, observed, navigated, given, checkpoint) as rows of ``TaskMonitor``.

    A task's steps must arrive in order from one trigger to the next; within one they are sorted by ts and
    id. The session's state store must be RocksDB (``with_store``).
    """
    kind = steps.schema[task].dataType.simpleString()
    false = F.lit(False)
    own = steps.select(
        F.col(task).alias("task"), "ts", "id", F.col("state").cast("string"), F.col("picture").cast("string"), F.coalesce("acted", false).alias("acted"),
        expectation_terms(F.col("expectation")).alias("expected"), expectation_terms(F.col("observed")).alias("observed"),
        F.coalesce("navigated", false).alias("navigated"), F.col("given").cast("double"), F.coalesce("checkpoint", false).alias("checkpoint"),
    )
    return own.groupBy("task").transformWithStateInPandas(TaskMonitor(), OUTPUT.format(kind=kind), "append", "none")


def latest(rows: DataFrame) -> DataFrame:
    """Each task's last row, without the step's own columns."""
    kept = ["n_steps", "loops", "stagnations", "surprises", "issue_rate", "recent_rate", "issue_run", "recovery_level"]
    last = rows.groupBy("task").agg(F.max_by(F.struct(*kept), "idx").alias("last")).select("task", "last.*")
    return last.withColumns({c: F.round(c, 6) for c in ("issue_rate", "recent_rate")})


class with_store:
    """While a stream with such state is being started, the session's state store is RocksDB."""

    NAME = "spark.sql.streaming.stateStore.providerClass"

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def __enter__(self) -> None:
        self.old = self.spark.conf.get(self.NAME, None)
        self.spark.conf.set(self.NAME, STORE)

    def __exit__(self, *_) -> None:
        if self.old is None:
            self.spark.conf.unset(self.NAME)
        else:
            self.spark.conf.set(self.NAME, self.old)
