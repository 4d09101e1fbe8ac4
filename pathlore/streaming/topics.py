"""Topics of sessions as their messages arrive; a session ends half an hour after its start.

A session's state is one value: its start, the number of messages, and its topics in order, each with its occurrences and the time it was
last seen, the ``MOST`` last seen at most after each message (of equally old ones those that came first). So a trigger
reads and writes a session's state once, whatever its topics. A session ends by a timer in event time, once the watermark is beyond its
start by more than ``LASTS_MS``, or by a message that is so far from the start; its topics are put out then,
and a later message of the same key starts anew. Messages that are older than the watermark are dropped, and
older ones that aren't join the session that is open.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from pathlore.functions.text import topic_terms

MOST, LASTS_MS, LATE = 20, 30 * 60 * 1000, "10 minutes"
OUTPUT = "session {kind}, started long, messages long, topic string, n long, seen long, rank long"
COLUMNS = ["session", "started", "messages", "topic", "n", "seen", "rank"]


def with_message(topics: dict[str, list[int]], terms: list[str], ms: int, most: int = MOST) -> dict[str, list[int]]:
    """Topics (occurrences, last seen) in order, after one message more."""
    for term in terms:
        own = topics.setdefault(term, [0, ms])
        own[0], own[1] = own[0] + 1, ms
    if len(topics) > most:
        topics = dict(sorted(topics.items(), key=lambda x: -x[1][1])[:most])
    return topics


class SessionTopics(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.session = handle.getValueState("session", "started long, messages long, topics array<string>, n array<long>, seen array<long>")

    def _rows(self, key: tuple, started: int, messages: int, topics: dict[str, list[int]]) -> list[tuple]:
        own = [(key[0], started, messages, t, n, seen, i + 1) for i, (t, (n, seen)) in enumerate(topics.items())]
        return own or [(key[0], started, messages, None, 0, started, 0)]

    def _frame(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=COLUMNS)

    def _stored(self) -> tuple[int, int, dict[str, list[int]]] | None:
        if (own := self.session.get()) is None:
            return None
        started, messages, topics, n, seen = own
        return started, messages, {t: [i, ms] for t, i, ms in zip(topics, n, seen, strict=True)}

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = started = None
        messages, topics, out = 0, {}, []
        if (stored := self._stored()) is not None:
            started, messages, topics = stored
            before = started
        for row in pd.concat(rows).sort_values(["ms", "id"]).itertuples(index=False):
            if started is not None and row.ms - started > LASTS_MS:
                out += self._rows(key, started, messages, topics)
                started = None
            if started is None:
                started, messages, topics = int(row.ms), 0, {}
            topics, messages = with_message(topics, list(row.terms), int(row.ms)), messages + 1
        if before != started:
            if before is not None:
                self.handle.deleteTimer(before + LASTS_MS + 1)
            self.handle.registerTimer(started + LASTS_MS + 1)
        self.session.update((started, messages, list(topics), [n for n, _ in topics.values()], [seen for _, seen in topics.values()]))
        yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if (stored := self._stored()) is not None:
            self.session.clear()
            yield self._frame(self._rows(key, *stored))

    def close(self) -> None:
        pass


def ended_sessions(messages: DataFrame, late: str = LATE) -> DataFrame:
    """A stream of (session, ts, id, text) as rows of the topics of sessions that have ended; one with a null topic for a session without any.

    The session's state store must be RocksDB (``recovery.with_store``).
    """
    kind = messages.schema["session"].dataType.simpleString()
    terms = F.filter(topic_terms(F.col("text")), lambda w: F.length(w) > 3)
    own = messages.withWatermark("ts", late).select("session", "ts", F.unix_millis("ts").alias("ms"), "id", terms.alias("terms"))
    return own.groupBy("session").transformWithStateInPandas(SessionTopics(), OUTPUT.format(kind=kind), "append", "eventTime")
