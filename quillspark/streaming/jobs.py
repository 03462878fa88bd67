"""Streams over landing folders and event tables; T1 to T6.

Sinks are idempotent per batch, so at-least-once delivery leaves each row once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillspark import sinks
from quillspark.functions import policy
from quillspark.sources import files


def landing(spark: SparkSession, path: str, per_trigger: int = 5) -> DataFrame:
    """Files as they arrive, a few a batch."""
    raw = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_trigger).load(path)
    name = F.url_decode(F.element_at(F.split("path", "/"), -1))
    return raw.withColumn("name", name).withColumn("c", policy.classify_lane(name, F.lit(""), F.col("length"))).select("path", "name", "length", "c.lane", "c.reason", "content")


def drain_stream(spark: SparkSession, source: str, target: str, checkpoint: str, secret: str, handlers: dict | None = None) -> StreamingQuery:
    """Drain all files that are there, batch by batch, and stop. `secret` keys the hashes of names."""

    def each(batch: DataFrame, batch_id: int) -> None:
        sinks.ingest_batch(files.drain(batch, handlers), target, batch_id, secret)

    return landing(spark, source).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def retry_due(held: DataFrame, now, attempts: int = 3) -> DataFrame:
    """Held documents whose retry time has come and that have attempts left."""
    return held.where((F.col("status") == "held") & (F.coalesce("attempts", F.lit(0)) < attempts) & (F.coalesce(F.try_to_timestamp("retry_after"), F.timestamp_millis(F.lit(0))) <= now))


def windowed_counts(events: DataFrame, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """T4: events per tumbling window and kind, with a watermark for late ones."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def session_counts(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of a submission by a gap in its steps."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("steps")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "steps")


def completions(steps: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Submissions complete once: a batch inserts the completions that are not there yet."""

    def each(batch: DataFrame, batch_id: int) -> None:
        done = batch.where("kind = 'complete'").groupBy("submission_id").agg(F.min("at").alias("completed_at"))
        sinks.insert_ignore(done, target, ["submission_id"])

    return steps.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def memoised(spark: SparkSession, path: str, step: str, compute: Callable[[], DataFrame]) -> DataFrame:
    """T5: the stored result of a step, computed once; an empty result is a result."""
    at = f"{path}/{step}"
    found = sinks.read(spark, at)
    if found is None:
        sinks.replace(compute(), at)
        found = sinks.read(spark, at)
    return found
