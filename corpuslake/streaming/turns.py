"""Turns of conversations as a stateful processor (R2, R3): what waits for its answer, and the files seen so far.

A session's state is a value (the user's text that waits, its line, the number of turns, the time of the last message) and
a list of at most ten files in first-seen order (W2), both in the RocksDB store. Idle sessions lose it after 30 days: by
event-time timers when messages have a time, else by the state's time to live. Messages of a session in one batch are put in order of
their lines, text by text of that batch only; how much a batch brings is the source's limit to set. Messages below a line
already seen are taken as they come. Null roles and texts: no role, an empty text. Repeated lines count again.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from corpuslake.operators.conversations import MOST_FILES

IDLE_MS = 30 * 24 * 3600 * 1000
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
TURN = "session_id long, turn_no int, user_text string, assistant_text string, files array<string>, start_line long, end_line long"
WAITING = "text string, line long, n int, seen long"


class TurnProcessor(StatefulProcessor):
    def __init__(self, timed: bool, idle_ms: int = IDLE_MS):
        self.timed, self.idle_ms = timed, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        keep = None if self.timed else self.idle_ms
        self.waiting = handle.getValueState("waiting", WAITING, keep)
        self.files = handle.getListState("files", "file string", keep)

    def _forget(self) -> None:
        self.waiting.clear()
        self.files.clear()

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        text, line, n, seen = self.waiting.get() or (None, None, 0, 0)
        if self.timed and seen and timerValues.getCurrentWatermarkInMs() >= seen + self.idle_ms:
            self._forget()  # the timer comes after the batch's rows
            text, line, n, seen = None, None, 0, 0
        known = [r[0] for r in self.files.get()] if self.files.exists() else []
        had = len(known)
        for r in sorted(rows, key=lambda r: r["line_idx"]):
            if self.timed:
                seen = max(seen, int(r["ts"].timestamp() * 1000))
            if r["role"] == "user":
                text, line = r["text"] or "", r["line_idx"]
            elif r["role"] == "assistant":
                if text is not None:
                    n += 1
                    for file in r["files"] or []:
                        if file not in known and len(known) < MOST_FILES:
                            known.append(file)
                    yield Row(session_id=key[0], turn_no=n, user_text=text, assistant_text=r["text"] or "", files=list(known), start_line=line, end_line=r["line_idx"])
                text, line = None, None
        self.waiting.update((text, line, n, seen))
        for file in known[had:]:
            self.files.appendValue((file,))
        if self.timed:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(seen + self.idle_ms)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self._forget()
        return iter([])

    def close(self) -> None:
        pass


@contextmanager
def rocksdb(spark: SparkSession, timed: bool = False):
    """Streams that start inside keep their state in RocksDB, which state variables need. Without times, a batch that has no
    data is not run: by the clock another one would always be due, and a stream of what is there now would not end."""
    wanted = {"spark.sql.streaming.stateStore.providerClass": ROCKSDB, "spark.sql.streaming.noDataMicroBatches.enabled": str(timed).lower()}
    before = {name: spark.conf.get(name, None) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value) if value else spark.conf.unset(name)


def turns_with_state(messages: DataFrame, timed: bool = False, late: str = "1 hour", idle_ms: int = IDLE_MS) -> DataFrame:
    """Messages (session_id, line_idx, role, text, files[, ts]) -> turns with the files seen so far. Start inside `rocksdb`."""
    columns = ["session_id", F.col("line_idx").cast("long").alias("line_idx"), "role", "text", "files"]
    rows = (messages.withWatermark("ts", late).select(*columns, "ts") if timed else messages.select(*columns)).groupBy("session_id")
    return rows.transformWithState(TurnProcessor(timed, idle_ms), TURN, "append", "EventTime" if timed else "ProcessingTime")


def state_of(spark: SparkSession, checkpoint: str, variable: str) -> DataFrame:
    """What a stream's checkpoint holds in a state variable: (key, value columns), an element of a list a row; with a time to live the values lie below `value`."""
    return spark.read.format("statestore").option("path", checkpoint).option("stateVarName", variable).load()
