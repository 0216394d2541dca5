"""Counters, latencies and windows, the same plan for batches and streams.

On a stream the functions put a watermark on the event time, so that state
stays bounded; on a batch it has no effect."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def timed(df: DataFrame, time: str = "ts", late: str = "1 day") -> DataFrame:
    """The event time as a timestamp with zone, under a watermark if streaming."""
    df = df.withColumn(time, F.col(time).cast("timestamp"))
    return df.withWatermark(time, late) if df.isStreaming else df


def latency(df: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(value), 6).alias("mean"), F.min(value).alias("least"), F.max(value).alias("most"))


def tumbling(df: DataFrame, size: str, slide: str | None = None, time: str = "ts") -> DataFrame:
    """(start, event_type, n, total) by tumbling or sliding windows."""
    df = timed(df, time)
    w = F.window(time, size, slide) if slide else F.window(time, size)
    out = df.groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(df: DataFrame, gap: str, time: str = "ts") -> DataFrame:
    """(user_id, start, n) of runs of events with pauses under ``gap``."""
    out = timed(df, time).groupBy(F.session_window(time, gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return out.select("user_id", F.col("w.start").alias("start"), "n")


def first_seen(df: DataFrame, key: str, time: str = "ts", late: str = "1 day") -> DataFrame:
    """One row for each key within the watermark (a bounded result cache)."""
    if df.isStreaming:
        return timed(df, time, late).dropDuplicatesWithinWatermark([key])
    return df.dropDuplicates([key])


def read_stream(spark: SparkSession, folder: str, like: DataFrame, files_per_batch: int = 1) -> DataFrame:
    """A stream over the parquet files of a folder, with the schema of ``like``."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def run_once(df: DataFrame, sink: str, checkpoint: str, mode: str = "append", fmt: str = "parquet") -> StreamingQuery:
    """Processes everything available, then stops; restartable from ``checkpoint``."""
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).format(fmt)
    q = writer.queryName(sink).start() if fmt == "memory" else writer.start(sink)
    q.awaitTermination()
    return q
