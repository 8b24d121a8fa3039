"""Progress messages: parsing, state changes, latest status, stuck forms.

Watermarks: messages up to one hour late are used (the lifetime of a stored result); later ones are
dropped by the stateful operators and counted with ``dropped_late_rows``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from docfields.functions.kernels import ship_by_value

LATENESS, LIFETIME_MS = "1 hour", 3_600_000
STUCK_SECONDS = 360
ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

ship_by_value(__name__)


def parse_progress(messages: DataFrame, column: str = "value") -> DataFrame:
    """JSON messages to (form_id, status, confidence_score, message, ts); both confidence keys are read."""
    schema = ("form_id string, status string, confidence_score string, confidence string, message string, ts timestamp")
    return messages.select(F.from_json(F.col(column), schema).alias("m")).filter("m.status is not null").select(
        "m.form_id", "m.status",
        F.coalesce("m.confidence_score", "m.confidence").try_cast("double").alias("confidence_score"),
        "m.message", "m.ts")


def read_progress_stream(spark: SparkSession, path: str) -> DataFrame:
    """Progress messages from a folder of JSON-lines files."""
    return parse_progress(spark.readStream.text(path))


def read_progress_kafka(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """Progress messages from Kafka (needs the connector on the class path)."""
    source = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic)
    return parse_progress(source.load().select(F.col("value").cast("string").alias("value")))


def with_end(stream: DataFrame, path: str, **last: object) -> DataFrame:
    """A bounded stream with one more row, ``last`` (the other columns NULL), written below ``path``.

    Windows, timers and held-back rows wait for the watermark. Where the input ends, nothing would move it any more,
    and the last results would never come. A last row far behind all others in time closes them; what belongs to the
    row itself stays open or is filtered by its key.
    """
    spark = stream.sparkSession
    one = spark.range(1).select(*[F.lit(last.get(f.name)).cast(f.dataType).alias(f.name) for f in stream.schema])
    one.write.mode("overwrite").parquet(path)
    return stream.unionByName(spark.readStream.schema(stream.schema).parquet(path))


class _Changes(StatefulProcessor):
    """Holds events back until the watermark has passed them; then, in their order, emits those that differ from the
    last (status, confidence) of the form.

    Held events are a list state: an arriving event is appended, what waits is not written again. One timer stands for
    the earliest of them; when it fires, what the watermark has passed is emitted and the rest put back.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "ts long, event_id long, status string, confidence_score double")
        self.last = handle.getValueState("last", "ts long, status string, confidence_score double")
        self.due = handle.getValueState("due", "ms long")

    def _wake(self, ms: int) -> None:
        """Fire at ``ms`` (or as soon as the watermark moves), in place of any later timer."""
        before = self.due.get()
        if before is not None:
            if before[0] <= ms:
                return
            self.handle.deleteTimer(before[0])
        self.handle.registerTimer(ms)
        self.due.update((ms,))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        earliest = None
        for batch in rows:
            arrived = [
                (int(row.ts.value), int(row.event_id), row.status, None if pd.isna(row.confidence_score) else float(row.confidence_score))
                for row in batch.itertuples(index=False)]
            if arrived:
                self.held.appendList(arrived)
                first = min(a[0] for a in arrived)
                earliest = first if earliest is None else min(first, earliest)
        if earliest is not None:
            self._wake(max(earliest // 1_000_000 + 1, timerValues.getCurrentWatermarkInMs()) + 1)
        yield from ()

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.due.clear()
        watermark = timerValues.getCurrentWatermarkInMs()
        held = [tuple(h) for h in self.held.get()]
        ready = sorted((h for h in held if h[0] // 1_000_000 < watermark), key=lambda h: (h[0], h[1], str(h[2]), str(h[3])))
        waiting = [h for h in held if h[0] // 1_000_000 >= watermark]
        last = self.last.get()
        rows = []
        for ts, _, status, score in ready:
            if last is None or (status, score) != tuple(last)[1:]:
                rows.append((key[0], status, score, pd.Timestamp(ts, unit="ns")))
            last = (ts, status, score)
        if ready:
            self.last.update(last)
            self.held.clear()
            if waiting:
                self.held.put(waiting)
        if waiting:
            self._wake(max(min(h[0] for h in waiting) // 1_000_000 + 1, watermark) + 1)
        elif last is not None and watermark > last[0] // 1_000_000 + LIFETIME_MS:
            self.last.clear()
        elif last is not None:
            self._wake(max(last[0] // 1_000_000 + LIFETIME_MS, watermark) + 1)
        if rows:
            made = pd.DataFrame(rows, columns=["form_id", "status", "confidence_score", "ts"])
            yield made.astype({"confidence_score": "float64"})

    def close(self) -> None:
        pass


def state_changes(events: DataFrame) -> DataFrame:
    """Only the events that change a form's (status, confidence), in the order of (ts, event_id).

    Events wait in the state until the watermark has passed them, so the order of arrival does not matter; later
    ones are dropped and counted. Without an ``event_id`` ties in time go by status. State expires an hour after the
    last event. List states and timers need the RocksDB state store, which the session is set to.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS_DB)
    kind = events.schema["form_id"].dataType.simpleString()
    number = F.col("event_id") if "event_id" in events.columns else F.lit(0)
    return (
        events.select("form_id", "status", "confidence_score", "ts", number.cast("bigint").alias("event_id"))
        .withWatermark("ts", LATENESS).groupBy("form_id")
        .transformWithStateInPandas(
            _Changes(), f"form_id {kind}, status string, confidence_score double, ts timestamp",
            "append", "EventTime")
    )


def _latest(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        state.remove()
        return
    before = state.get if state.exists else None
    best = before
    for batch in batches:
        for row in batch.itertuples(index=False):
            score = None if pd.isna(row.confidence_score) else float(row.confidence_score)
            now = (int(row.ts.value), int(row.event_id), row.status, score, row.message)
            if best is None or now[:2] > tuple(best[:2]):
                best = now
    state.update(best)
    state.setTimeoutTimestamp(max(best[0] // 1_000_000 + LIFETIME_MS, state.getCurrentWatermarkMs()) + 1)
    if best != before:
        yield pd.DataFrame({"form_id": [key[0]], "status": [best[2]], "confidence_score": [best[3]], "message": [best[4]],
                            "ts": [pd.Timestamp(best[0], unit="ns")]})


def latest_status(events: DataFrame) -> DataFrame:
    """Last event per form by (ts, event_id) (update mode); one small state row per form.

    An older message arriving late changes nothing. State expires an hour after the last event: what could still
    arrive for the form is newer than that or is dropped by the watermark.
    """
    kind = events.schema["form_id"].dataType.simpleString()
    number = F.col("event_id") if "event_id" in events.columns else F.lit(0)
    return (
        events.select("form_id", "status", "confidence_score", "message", "ts", number.cast("bigint").alias("event_id"))
        .withWatermark("ts", LATENESS).groupBy("form_id")
        .applyInPandasWithState(
            _latest, f"form_id {kind}, status string, confidence_score double, message string, ts timestamp",
            "ts long, event_id long, status string, confidence_score double, message string", "update",
            GroupStateTimeout.EventTimeTimeout)
    )


def _stuck(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        since = state.get[0]
        state.remove()
        yield pd.DataFrame({"form_id": [key[0]], "since": [pd.Timestamp(since, unit="ns")]})
        return
    last, number, status = state.get if state.exists else (-1, -1, None)
    for batch in batches:
        for row in batch.itertuples(index=False):
            now = (int(row.ts.value), int(row.event_id), row.status)
            if now[:2] > (last, number) or (now[:2] == (last, number) and now[2] > (status or "")):
                last, number, status = now
    if status == "processing":
        state.update((last, number, status))
        # A timeout must lie after the watermark; a job already overdue fires at the next step of it.
        due = last // 1_000_000 + STUCK_SECONDS * 1000
        state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))
    elif state.exists:
        state.remove()


def stuck_forms(events: DataFrame, lateness: str = "10 minutes") -> DataFrame:
    """Forms in 'processing' for more than six minutes of event time without another event.

    The last event of a form is that with the largest (ts, event_id), then status; the order of arrival does not matter.
    """
    kind = events.schema["form_id"].dataType.simpleString()
    number = F.col("event_id") if "event_id" in events.columns else F.lit(0)
    return (
        events.select("form_id", "status", "ts", number.cast("bigint").alias("event_id"))
        .withWatermark("ts", lateness).groupBy("form_id")
        .applyInPandasWithState(_stuck, f"form_id {kind}, since timestamp", "ts long, event_id long, status string", "append",
                                GroupStateTimeout.EventTimeTimeout)
    )


def write_status(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Write every micro-batch below ``path`` in a folder of its own number, so that a replay overwrites it."""
    return foreach_batch(stream, lambda df, n: df.write.mode("overwrite").parquet(f"{path}/batch={n}"), checkpoint, mode)


def foreach_batch(
    stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append"
) -> StreamingQuery:
    """Run over what is available now and stop."""
    return (
        stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(sink)
        .trigger(availableNow=True).start()
    )


def dropped_late_rows(query: StreamingQuery) -> int:
    """Rows the stateful operators dropped for lateness, over the retained progress reports."""
    return sum(
        operator.get("numRowsDroppedByWatermark", 0)
        for report in query.recentProgress for operator in report["stateOperators"]
    )
