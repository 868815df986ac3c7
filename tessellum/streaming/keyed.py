"""Keyed state over streams: the live state of each file, and each query's results in their order.

Both keep a bounded state for each key, in update mode, and let go of a key that has been silent for
`idle` seconds. No event is dropped for being late: what comes after its key has gone is still given out
with its own time or number, and `current` and `answers` make of all rows what a batch makes of all events."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tessellum.operators.relational import progress

STATES = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CHANGES = "file_id long, status string, at long, event_id long, events long, silent boolean"
RELEASED = "query_id long, seq long, type string, payload string, late boolean"
#: Kinds of search results by the name under which a page takes them; contents of media by theirs.
PAGE_EVENTS = {"stage_update": "stage_update", "answer_chunk": "text_delta", "final_answer": "final_answer", "error": "error"}
MEDIA_EVENTS = {"image": "render_image", "table": "render_table", "chart": "render_chart"}


class _Timed(StatefulProcessor):
    """A processor whose key has one timer at most."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle

    def wake(self, at: int) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(at)

    def close(self) -> None:
        pass


def _place(at: int | None, event_id: int | None) -> tuple:
    """Where an event stands; nulls come first, as in Spark's order of structs."""
    return at is not None, at or 0, event_id is not None, event_id or 0


class LatestState(_Timed):
    """The last state of a file by (ts, event_id). Out: one row of each batch that has events of the file, one when it falls silent."""

    def __init__(self, idle: float):
        self.idle = int(idle * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.last = handle.getValueState("last", "at long, event_id long, status string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        best, n = self.last.get() if self.last.exists() else None, 0
        for row in rows:
            n += 1
            one = (row["at"], row["event_id"], row["status"])
            if best is None or _place(*one[:2]) > _place(*best[:2]):
                best = one
        self.last.update(tuple(best))
        self.wake(timerValues.getCurrentProcessingTimeInMs() + self.idle)
        yield Row(file_id=key[0], status=best[2], at=best[0], event_id=best[1], events=n, silent=False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        if self.last.exists():
            at, event_id, status = self.last.get()
            self.last.clear()
            yield Row(file_id=key[0], status=status, at=at, event_id=event_id, events=0, silent=True)


def live_status(events: DataFrame, idle: float = 3600) -> DataFrame:
    """A stream of changes (file_id, status, updated_at, event_id, events, silent) from a stream of (file_id, status, ts, event_id).

    events: how many the batch had of the file. silent: no event for `idle` seconds, the state has been let go.
    Rows without a file_id are one key, as in a batch."""
    rows = events.select(F.col("file_id").cast("long").alias("file_id"), "status", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.col("event_id").cast("long").alias("event_id"))
    changes = rows.groupBy("file_id").transformWithState(LatestState(idle), CHANGES, "update", "processingtime")
    return changes.select("file_id", "status", F.timestamp_micros("at").alias("updated_at"), "event_id", "events", "silent")


def current(changes: DataFrame) -> DataFrame:
    """The state of each file by all changes so far, as `latest_status` has it from all events."""
    last = F.max_by("status", F.struct("updated_at", "event_id"))
    rows = changes.groupBy("file_id").agg(last.alias("status"), F.max("updated_at").alias("updated_at"), F.sum("events").alias("events"))
    return rows.withColumn("progress", progress(F.col("status"))["progress"])


class InOrder(_Timed):
    """Results of a query in the order of their numbers. What comes early waits for what is missing, for `wait` seconds at most."""

    def __init__(self, wait: float, idle: float):
        self.wait, self.idle = int(wait * 1000), int(idle * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.next = handle.getValueState("next", "seq long")
        self.early = handle.getMapState("early", "seq long", "type string, payload string")

    def out(self, key, seq, kind, payload, late: bool) -> Row:
        return Row(query_id=key[0], seq=seq, type=kind, payload=payload, late=late)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        at = self.next.get()[0] if self.next.exists() else 0
        for row in rows:
            if row["seq"] is None or row["seq"] < at:
                yield self.out(key, row["seq"], row["type"], row["payload"], True)
            else:
                self.early.updateValue((row["seq"],), (row["type"], row["payload"]))
        while self.early.exists() and self.early.containsKey((at,)):
            kind, payload = self.early.getValue((at,))
            self.early.removeKey((at,))
            yield self.out(key, at, kind, payload, False)
            at += 1
        self.next.update((at,))
        self.wake(timerValues.getCurrentProcessingTimeInMs() + (self.wait if self.early.exists() and any(True for _ in self.early.keys()) else self.idle))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        held = sorted((k[0], tuple(v)) for k, v in self.early.iterator()) if self.early.exists() else []
        self.early.clear()
        if not held:
            self.next.clear()
            return
        for seq, (kind, payload) in held:
            yield self.out(key, seq, kind, payload, False)
        self.next.update((held[-1][0] + 1,))
        self.wake(timerValues.getCurrentProcessingTimeInMs() + self.idle)


def ordered_results(results: DataFrame, wait: float = 5, idle: float = 600) -> DataFrame:
    """A stream of results (query_id, seq, type, payload), numbered from 0, given out in order (RELEASED).

    A repeated number that still waits takes the later payload; one that has been given out comes again as
    `late`, as does what arrives once its gap has been passed over."""
    rows = results.select(F.col("query_id").cast("long").alias("query_id"), F.col("seq").cast("long").alias("seq"), "type", "payload")
    return rows.groupBy("query_id").transformWithState(InOrder(wait, idle), RELEASED, "update", "processingtime")


def page_event(kind: Column, content_type: Column) -> Column:
    """The name under which a page takes a result; null for kinds that it doesn't take."""
    of = lambda names, c: F.try_element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), c)
    return F.when(kind == "multimodal_content", of(MEDIA_EVENTS, content_type)).otherwise(of(PAGE_EVENTS, kind))


def event_text(name: Column, data: Column) -> Column:
    """A named event with its JSON, as pages read them from a stream of text."""
    return F.concat(F.lit("event: "), name, F.lit("\ndata: "), data, F.lit("\n\n"))


def answers(results: DataFrame) -> DataFrame:
    """One row of each query (query_id, success, answer, chunks): its last final answer by number, `{}` without one, and how many results it has.

    A query with an error and no answer has no success. Equal numbers count once, with the greatest payload."""
    once = results.groupBy("query_id", "seq").agg(F.max(F.struct("type", "payload")).alias("r")).select("query_id", "seq", "r.*")
    final = F.max_by("payload", F.when(F.col("type") == "final_answer", F.col("seq")))
    rows = once.groupBy("query_id").agg(final.alias("answer"), F.count("*").alias("chunks"), F.count_if(F.col("type") == "error").alias("errors"))
    return rows.select("query_id", (F.col("answer").isNotNull() | (F.col("errors") == 0)).alias("success"), F.coalesce("answer", F.lit("{}")).alias("answer"), "chunks")


def keep(changes: DataFrame, folder: str, checkpoint: str, every: str | None = None):
    """Start a stream that keeps its rows in a folder, one part of each batch; a batch that comes again replaces its own.

    every: a trigger interval; without one, all there is and stop."""

    def batch(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    writer = changes.writeStream.outputMode("update").foreachBatch(batch).option("checkpointLocation", checkpoint)
    settings = {"spark.sql.streaming.stateStore.providerClass": STATES}
    if every:
        return started(changes.sparkSession, writer.trigger(processingTime=every).start, settings)
    # timers of clock time would ask for batches without data for ever
    return started(changes.sparkSession, writer.trigger(availableNow=True).start, settings | {"spark.sql.streaming.noDataMicroBatches.enabled": "false"})


def started(spark: SparkSession, start: Callable, settings: Mapping[str, str]):
    """Start a query with settings of its own; it takes a copy of them, and the session gets its own back."""
    before = {name: spark.conf.get(name) for name in settings}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        return start()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
