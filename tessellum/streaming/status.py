"""Streams of file states: the latest state of each file, and ingestion by batches."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessellum.operators.relational import progress, upserted
from tessellum.operators.stores import Store

EVENTS = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampType()), T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType())])


def latest_status(events: DataFrame) -> DataFrame:
    """The last state of each file by (ts, event_id), with its progress; works on a batch and on a stream alike."""
    last = F.max_by("status", F.struct("ts", "event_id"))
    rows = events.groupBy("file_id").agg(last.alias("status"), F.max("ts").alias("updated_at"), F.count("*").alias("events"))
    return rows.withColumn("progress", progress(F.col("status"))["progress"])


def event_source(spark: SparkSession, folder: str, files_per_trigger: int = 8) -> DataFrame:
    """A stream of event files of a folder."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def watch(events: DataFrame, name: str, checkpoint: str, every: str | None = None):
    """Keep the latest states in a table in memory. every: a trigger interval; without one, all there is and stop."""
    writer = latest_status(events).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def staged(checks: Mapping[str, Column]) -> Column:
    """The state of a file after stages in order: that of the first one whose check isn't true, or `completed`.

    checks: by the state that a failure leaves. No later stage is looked at after a failure."""
    state = F.lit("completed")
    for failed, check in reversed(checks.items()):
        state = F.when(F.coalesce(check, F.lit(False)), state).otherwise(F.lit(failed))
    return state


def ingest_into(store: Store, name: str, checks: Mapping[str, Column]) -> Callable[[DataFrame, int], None]:
    """A batch function for `ingest` that keeps each file's state in a store; a batch that comes again changes nothing."""

    def batch(rows: DataFrame, number: int) -> None:
        states = rows.select("doc_id", staged(checks).alias("status")).groupBy("doc_id").agg(F.max("status").alias("status"))
        store.commit({name: upserted(store.read(name), states, ["doc_id"]) if store.exists(name) else states})

    return batch


def ingest(documents: DataFrame, batch: Callable[[DataFrame, int], None], checkpoint: str):
    """Run the batch pipeline on each new set of documents; `batch` writes by document, so a repeated batch does no harm."""
    return documents.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
