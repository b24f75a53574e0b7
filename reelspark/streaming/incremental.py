"""Incremental forms: new keyframes are encoded once, manifests follow updates, speech periods grow."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from reelspark.operators.intervals import periods_and_gaps
from reelspark.sources.sinks import upsert_archives, write_vectors


def encode_stream(keyframes: DataFrame, encoder: Callable[[DataFrame], DataFrame], path: str, config_hash: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Encode the keyframes of a stream into a vector store; what the store has is not encoded again."""

    def batch(df: DataFrame, _: int) -> None:
        write_vectors(df.dropDuplicates(["keyframe_uid"]), encoder, path, config_hash)

    writer = keyframes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def upsert_stream(updates: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keep a manifest (one Parquet folder per version below ``path``) up to date with a stream of updates."""

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        old = f"{path}/v{number - 1}"
        merged = upsert_archives(spark.read.parquet(old), df) if number else df.dropDuplicates(["filename", "download_url"])
        merged.write.mode("overwrite").parquet(f"{path}/v{number}")

    return updates.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def periods_stream(segments: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keep the merged periods (video_id, start_ms, end_ms) of a stream of segments.

    Periods are segments themselves: each batch merges the new segments with the old
    periods of the videos it names.
    """

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        rows = df.select("video_id", "start_ms", "end_ms")
        kept = None
        if number:
            old = spark.read.parquet(f"{path}/v{number - 1}")
            touched = rows.select("video_id").distinct()
            rows = rows.unionByName(old.join(touched, "video_id", "left_semi"))
            kept = old.join(touched, "video_id", "left_anti")
        merged = periods_and_gaps(rows, "video_id", "start_ms", "end_ms").where("kind = 'period'").drop("kind")
        (merged if kept is None else merged.unionByName(kept)).write.mode("overwrite").parquet(f"{path}/v{number}")

    return segments.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_counts(records: DataFrame, time: str, key: str, window: str = "1 hour", delay: str = "1 day") -> DataFrame:
    """Rows (window, key, n) of a stream by event time; rows later than the delay are dropped by the watermark."""
    return records.withWatermark(time, delay).groupBy(F.window(time, window), key).agg(F.count(F.lit(1)).alias("n"))
