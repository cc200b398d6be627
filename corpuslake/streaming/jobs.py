"""Streaming forms: transcripts to turns with state, change feeds, prompt search, duplicate suppression, feedback."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corpuslake.operators import ingest, lifecycle, search
from corpuslake.options import Search
from corpuslake.sources.tables import new_path

TURN = "session_id long, turn_no int, user_text string, assistant_text string, start_line long, end_line long"
STATE = "pending string, pending_line long, n_turns int"
IDLE_MS = 30 * 24 * 3600 * 1000


def _pair(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    pending, line, n = state.get if state.exists else (None, -1, 0)
    rows = pd.concat(list(batches)).sort_values("line_idx")
    out = []
    for role, text, at in zip(rows["role"], rows["text"], rows["line_idx"]):
        if role == "user":
            pending, line = text, int(at)
        elif role == "assistant" and pending is not None:
            n += 1
            out.append((key[0], n, pending, text, line, int(at)))
            pending, line = None, -1
    state.update((pending, line, n))
    yield pd.DataFrame(out, columns=["session_id", "turn_no", "user_text", "assistant_text", "start_line", "end_line"])


def turn_stream(messages: DataFrame, expire: bool = False, late: str = "1 hour") -> DataFrame:
    """Messages as they come -> turns (R1, R2): a user's text waits in the session's state for its answer, also across
    batches; offsets are in the checkpoint. With `expire`, messages have a time `ts`, and sessions that are idle for 30
    days of it lose their state (R3)."""
    timeout = GroupStateTimeout.EventTimeTimeout if expire else GroupStateTimeout.NoTimeout
    messages = messages.withWatermark("ts", late) if expire else messages

    def pair(key, batches, state):
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches))
        yield from _pair(key, iter([rows]), state)
        if expire:
            state.setTimeoutTimestamp(int(rows["ts"].max().timestamp() * 1000) + IDLE_MS)

    return messages.groupBy("session_id").applyInPandasWithState(pair, TURN, STATE, "append", timeout)


def drained(stream: DataFrame, path: str, checkpoint: str, mode: str = "append", seconds: int = 600) -> None:
    """Everything that is there now, into Parquet."""
    done = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
    if not done.awaitTermination(seconds):
        done.stop()
        raise TimeoutError("the stream did not end")


def each_batch(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, seconds: int = 600, mode: str = "append") -> None:
    """A handler for each batch; what it raises leaves the offset where it was, so the batch comes again."""
    done = stream.writeStream.outputMode(mode).foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    if not done.awaitTermination(seconds):
        done.stop()
        raise TimeoutError("the stream did not end")


def mining_handler(extract: Callable[[DataFrame], DataFrame], store: Callable[[DataFrame, int], None], quarantine: Callable[[DataFrame, int], None], least_chars: int = 200) -> Callable[[DataFrame, int], None]:
    """Advance rules (R4): below the gate or nothing extracted - on; extraction fails - held; storing fails - set aside.

    The extraction is written to a table first, so that it runs once and its failures are not taken for the store's."""

    def handle(turns: DataFrame, batch: int) -> None:
        passing = turns.groupBy("session_id").agg(F.sum(F.length("user_text") + F.length("assistant_text")).alias("chars")).filter(F.col("chars") >= least_chars)
        extracted = extract(turns.join(passing.select("session_id"), "session_id", "left_semi"))
        path = new_path(turns.sparkSession, "extracted")
        extracted.write.parquet(path)
        found = turns.sparkSession.read.schema(extracted.schema).parquet(path)
        try:
            store(found, batch)
        except Exception:
            quarantine(found, batch)

    return handle


def prompt_search_handler(chunks: DataFrame, vectors: DataFrame, write: Callable[[DataFrame, int], None], as_of, options: Search = Search(), embed: Callable[[DataFrame], DataFrame] | None = None, log: Callable[[DataFrame, int], None] | None = None) -> Callable[[DataFrame, int], None]:
    """Prompts -> context blocks (R5): trivial ones skipped, the rest expanded, searched, re-ranked and cut to the budget;
    `log` gets the telemetry rows. `embed` makes `embedding` of the column `expanded`; without it the prompts have one."""

    def handle(prompts: DataFrame, batch: int) -> None:
        asked, matches = search.served(prompts, chunks, vectors, as_of, options, embed)
        path = new_path(prompts.sparkSession, "matches")
        matches.write.parquet(path)
        matches = prompts.sparkSession.read.schema(matches.schema).parquet(path)
        write(search.context_block(matches), batch)
        if log:
            log(search.telemetry(asked, matches), batch)

    return handle


def index_sync_handler(read_chunks: Callable[[], DataFrame], read_docs: Callable[[], DataFrame], replace: Callable[[DataFrame, int], None], as_of) -> Callable[[DataFrame, int], None]:
    """Changed paths -> a new snapshot of the chunk table (R6); the writer keys snapshots by batch, so a repeat is the
    same snapshot again."""

    def handle(changes: DataFrame, batch: int) -> None:
        replace(ingest.sync(read_chunks(), read_docs(), changes, as_of), batch)

    return handle


def keyed_sync_handler(table, read_docs: Callable[[], DataFrame], as_of, name: str = "index") -> Callable[[DataFrame, int], None]:
    """Changed paths -> their chunks in a keyed chunk table (R6): a batch writes its own files' chunks only, and one that
    comes again writes nothing."""

    def handle(changes: DataFrame, batch: int) -> None:
        ingest.sync_table(table, read_docs(), changes, as_of, (name, batch))

    return handle


def near_repeat_handler(store) -> Callable[[DataFrame, int], None]:
    """Vectors as they come -> which of them repeat a stored row or an earlier one of their batch (R7, J6); a batch that
    comes again replaces what it wrote."""

    def handle(rows: DataFrame, batch: int) -> None:
        store.add(rows, batch)

    return handle


def distinct_stream(rows: DataFrame, keys: list[str], ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """Rows without repeats of their key within the watermark."""
    return rows.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def feedback_stream(served: DataFrame, ts: str = "ts", late: str = "1 hour", window: str = "1 day") -> DataFrame:
    """Served ids -> increments by id and window (R8), for with_retrievals."""
    return served.withWatermark(ts, late).groupBy(F.window(ts, window).alias("w"), "doc_id").agg(F.sum("increment").alias("increment"))


def latest(batches: DataFrame, keys: list[str], value: str, batch: str = "batch") -> DataFrame:
    """The last value of each key among the rows that an update-mode stream has written batch by batch."""
    return batches.groupBy(*keys).agg(F.max_by(value, batch).alias(value))


def with_feedback(table: DataFrame, increments: DataFrame, as_of) -> DataFrame:
    return lifecycle.with_retrievals(table, increments.select("doc_id", "increment"), as_of)


def activity_stream(events: DataFrame, late: str = "1 hour", window: str = "1 day") -> DataFrame:
    """Rolling activity report (A17) with bounded state."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))


def session_stream(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Bursts of a user's activity (A20): sessions closed by a gap."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
