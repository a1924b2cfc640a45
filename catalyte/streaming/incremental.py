"""Incremental forms of the keyed operators on Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import keyed


def upsert_stream(stream: DataFrame, table: str, key: str, checkpoint: str, empty: Callable[[], DataFrame]) -> StreamingQuery:
    """Merges micro-batches of records into the Parquet table at ``table``, with
    versions table/v=<batch>. A batch that runs again writes its version again,
    so the merge is idempotent; good records survive failed fetches. Each batch
    builds on the newest finished version before it; if there is none although
    earlier batches ran, it fails rather than publish a table without them. Runs
    over what is there and stops."""
    from ..sources.readers import exists, versions

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = [v for v in versions(spark, table) if v < batch_id and exists(spark, f"{table}/v={v}/_SUCCESS")]
        if batch_id and not before:
            raise FileNotFoundError(f"{table} has no version before {batch_id}")
        current = spark.read.parquet(f"{table}/v={max(before)}") if before else empty()
        last = keyed.keep_last(batch, [key], "position") if "position" in batch.columns else batch
        merged = keyed.upsert_keep_good(current.select(*empty().columns), last.select(*empty().columns), key)
        merged.drop("refetch_error").write.mode("overwrite").parquet(f"{table}/v={batch_id}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def tumbling_counts(events: DataFrame, time: str, kind: str, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Extension: counts by window and kind, for batch and stream alike."""
    stamped = events.withColumn("__t", F.col(time).cast("timestamp"))
    if stamped.isStreaming:
        stamped = stamped.withWatermark("__t", late)
    return stamped.groupBy(F.window("__t", width).alias("w"), kind).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), kind, "n")


def session_counts(events: DataFrame, time: str, user: str, gap: str = "6 hours", late: str = "1 day") -> DataFrame:
    """Extension: events by user session."""
    stamped = events.withColumn("__t", F.col(time).cast("timestamp"))
    if stamped.isStreaming:
        stamped = stamped.withWatermark("__t", late)
    grouped = stamped.groupBy(F.session_window("__t", gap).alias("s"), user).agg(F.count("*").alias("n"))
    return grouped.select(user, F.col("s.start").alias("session_start"), "n")
