"""Streams: folders watched for new documents, and audit rows merged as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.storage import Table, upsert_derived


def watch(spark: SparkSession, path: str, schema, text: str = "text", event_time: str | None = None, delay: str = "1 day", fmt: str = "parquet", per_trigger: int | None = None) -> DataFrame:
    """New files of ``path`` as a stream with sha1, each content once.

    With ``event_time`` the memory of seen contents is bounded by the watermark; without it, it grows with the corpus.
    """
    reader = spark.readStream.format(fmt).schema(schema)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    rows = reader.load(path).withColumn("sha1", F.sha1(F.coalesce(F.col(text), F.lit("")).cast("binary")))
    if event_time:
        return rows.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["sha1"])
    return rows.dropDuplicates(["sha1"])


def upsert_stream(results: DataFrame, table: Table, checkpoint: str, key: str = "sha1") -> StreamingQuery:
    """Each batch merged into ``table``; a batch that is run again gives the same table."""

    def merge(batch: DataFrame, _: int) -> None:
        table.replace(upsert_derived(table.read(), batch, key))

    return results.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def activity(events: DataFrame, time: str = "ts", kind: str = "event_type", window: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Counts per window and kind; late rows within ``delay`` count, later ones do not."""
    rows = events.withWatermark(time, delay) if events.isStreaming else events
    return rows.groupBy(F.window(time, window).alias("w"), kind).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), kind, "n")
