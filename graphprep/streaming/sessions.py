"""Session chains on streams: arbitrary state with timers, in the order of event time whatever the order of arrival."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: The state store that timers and lists need.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
EDGES = "key string, session long, src long, dst long, at timestamp"


class ChainSessions(StatefulProcessor):
    """Events wait until the watermark has passed them, and are then chained in the order of (time, id). A pause of more than `gap`
    begins a new session. Of a key the state is what waits, and the last event of the chain until its session is over."""

    def __init__(self, gap_ms: int) -> None:
        self.gap = gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "ms long, id long")
        self.last = handle.getValueState("last", "ms long, id long, session long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = [(int(t.value // 1_000_000), int(i)) for f in rows for t, i in zip(f["time"], f["id"], strict=True)]
        self.waiting.appendList(new)
        for ms in {ms for ms, _ in new}:
            self.handle.registerTimer(ms + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        held = sorted({(r[0], r[1]) for r in self.waiting.get()}) if self.waiting.exists() else []
        ripe, rest = [e for e in held if e[0] < passed], [e for e in held if e[0] >= passed]
        last = tuple(self.last.get()) if self.last.exists() else None
        out = []
        for ms, i in ripe:
            if last and ms - last[0] <= self.gap:
                out.append((str(key[0]), last[2], last[1], i, pd.Timestamp(ms, unit="ms")))
                last = (ms, i, last[2])
            else:
                last = (ms, i, i)  # a session bears the number of its first event
        self.waiting.put(rest) if rest else self.waiting.clear()
        if last and ripe:
            self.last.update(last)
            self.handle.registerTimer(last[0] + self.gap + 1)
        elif last and passed > last[0] + self.gap and not rest:
            self.last.clear()  # nothing can follow any more
        return iter([pd.DataFrame(out, columns=["key", "session", "src", "dst", "at"])] if out else [])

    def close(self) -> None:
        pass


def stream_session_chains(events: DataFrame, key: str, time: str, event_id: str, gap: str, late: str) -> DataFrame:
    """Rows (key, session, src, dst, at): each event and the next one of its key's session. gap is an interval such as "30 minutes".

    Events later than `late` are left out, repeated ones count once. Edges come when the watermark has passed their second event. The session must use
    the state store of STATE_STORE.
    """
    gap_ms = int(pd.Timedelta(gap).total_seconds() * 1000)
    rows = events.selectExpr(f"`{key}` AS key", f"`{time}` AS time", f"CAST(`{event_id}` AS LONG) AS id").withWatermark("time", late)
    return rows.groupBy("key").transformWithStateInPandas(ChainSessions(gap_ms), EDGES, "Append", "EventTime")
