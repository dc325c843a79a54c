"""Streaming forms of the ingest steps, and event windows (beyond the batch pipeline)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.hashing import hash_sample


def read_stream(spark: SparkSession, folder: str, schema, pattern: str = "*.parquet", files_per_trigger: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def timed(stream: DataFrame, time: str, delay: str) -> DataFrame:
    """With a watermark; a timestamp without zone is read in the session's zone, as watermarks need one with zone."""
    known = stream if stream.schema[time].dataType.typeName() == "timestamp" else stream.withColumn(time, F.col(time).cast("timestamp"))
    return known.withWatermark(time, delay)


def first_arrivals(stream: DataFrame, key: str, time: str, delay: str = "2 days") -> DataFrame:
    """Each key once: repeats within the watermark are dropped; the state is bounded by it."""
    return timed(stream, time, delay).dropDuplicatesWithinWatermark([key])


def sampled(stream: DataFrame, identifier: str, fraction: float, seed: int) -> DataFrame:
    """Stateless hash sample: the same members as in batch."""
    return stream.where(hash_sample(seed, F.col(identifier), fraction))


def window_totals(stream: DataFrame, time: str, length: str, keys: list[str], value: str, slide: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Counts and sums per (sliding) window and key; rows later than the watermark are dropped."""
    span = F.window(time, length, slide) if slide else F.window(time, length)
    totals = timed(stream, time, delay).groupBy(span.alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return totals.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n", "total")


def sessions(stream: DataFrame, time: str, gap: str, key: str, delay: str = "1 hour") -> DataFrame:
    """Sessions of a key: events with less than ``gap`` between them."""
    totals = timed(stream, time, delay).groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count("*").alias("n"))
    return totals.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")


def write_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Process all that is there and stop; exactly once by the checkpoint."""
    return stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
