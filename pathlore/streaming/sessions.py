"""Sessions and recent messages of a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

KEEP, IDLE = 10, "30 minutes"


def session_stream(events: DataFrame, key: str, ts: str = "ts", late: str = "10 minutes", idle: str = IDLE) -> DataFrame:
    """(key, started, ended, n): sessions that end after ``idle`` without an event, told once the watermark has passed their end."""
    own = events.withWatermark(ts, late).groupBy(key, F.session_window(ts, idle).alias("s"))
    return own.agg(F.count("*").alias("n")).select(key, F.col("s.start").alias("started"), F.col("s.end").alias("ended"), "n")


def message_stream(messages: DataFrame, expire_ms: int | None = 30 * 60 * 1000) -> DataFrame:
    """(session, turn, role, rank): after each trigger the last ``KEEP`` messages of the sessions that had some.

    ``messages`` has (session, turn, role). A session's state goes when nothing has come for
    ``expire_ms``; without that it stays. A run that is to end when all has been read must go without:
    while states wait for their time there is always a further trigger.
    """
    kind = messages.schema["session"].dataType.simpleString()

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        turns, roles = state.get if state.exists else ([], [])
        rows = pd.concat([pd.DataFrame({"turn": list(turns), "role": list(roles)}), *(x[["turn", "role"]] for x in parts)])
        rows = rows.sort_values("turn").tail(KEEP)
        state.update((rows["turn"].astype(int).tolist(), rows["role"].tolist()))
        if expire_ms:
            state.setTimeoutDuration(expire_ms)
        rows = rows.assign(session=key[0], rank=range(len(rows), 0, -1))
        yield rows[["session", "turn", "role", "rank"]].astype({"turn": "int64", "rank": "int64"})

    out = f"session {kind}, turn long, role string, rank long"
    return messages.groupBy("session").applyInPandasWithState(run, out, "turns array<long>, roles array<string>", "update", GroupStateTimeout.ProcessingTimeTimeout if expire_ms else GroupStateTimeout.NoTimeout)
