"""Flags of steps as they arrive, with the same results as ``operators.sequences.flags`` on whole tasks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState

#: Steps that a loop can reach back at most, and so the steps that a task's state keeps.
REACH = 50

OUTPUT = "task {kind}, idx long, stagnation boolean, loop_at long, loop_by string"
STATE = "n long, states array<string>, pictures array<string>"


def flag_one(n: int, states: list, pictures: list, state, picture, acted: bool) -> tuple[bool, int | None, str | None]:
    """Stagnation, loop_at and loop_by of step n, given the states and pictures of up to ``REACH`` steps before it."""
    same = bool(states) and state is not None and states[-1] == state
    if state is None:
        return False, None, None
    back = min(REACH, max(10, int((n + 1) * 0.6)))
    first = n - len(states)
    for i in range(n - 2, max(first, n - back) - 1, -1):
        if states[i - first] == state:
            return same and acted, i, "exact"
        if picture is not None and pictures[i - first] == picture:
            return same and acted, i, "perceptual"
    return same and acted, None, None


def flag_stream(steps: DataFrame, task: str = "task") -> DataFrame:
    """(task, idx, stagnation, loop_at, loop_by) of a stream of (task, ts, id, state, picture, acted).

    A task's steps must arrive in order from one trigger to the next; within one they are sorted by
    ts and id. A task's state is its number of steps and its last ``REACH`` hashes, whatever its length.
    """
    kind = steps.schema[task].dataType.simpleString()

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, states, pictures = state.get if state.exists else (0, [], [])
        states, pictures, out = list(states), list(pictures), []
        for row in pd.concat(parts).sort_values(["ts", "id"]).itertuples(index=False):
            own = None if pd.isna(row.state) else str(row.state)
            picture = None if pd.isna(row.picture) else str(row.picture)
            out.append((key[0], n, *flag_one(n, states, pictures, own, picture, bool(row.acted))))
            states, pictures, n = [*states, own][-REACH:], [*pictures, picture][-REACH:], n + 1
        state.update((n, states, pictures))
        done = pd.DataFrame(out, columns=["task", "idx", "stagnation", "loop_at", "loop_by"])
        yield done.astype({"loop_at": "Int64"})

    own = steps.selectExpr(f"`{task}` AS task", "ts", "id", "cast(state AS string) AS state", "cast(picture AS string) AS picture", "acted")
    return own.groupBy("task").applyInPandasWithState(run, OUTPUT.format(kind=kind), STATE, "append", "NoTimeout")
