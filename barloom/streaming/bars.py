"""Bars from a stream of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.bars import INTERVAL


def read_events(spark: SparkSession, folder: str, glob: str = "events.parquet") -> DataFrame:
    """The event files of a folder as a stream; each file is read once."""
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    return spark.readStream.schema(schema).option("pathGlobFilter", glob).parquet(folder)


def stream_bars(events: DataFrame, late: str = "10 minutes", interval: int = INTERVAL) -> DataFrame:
    """Tumbling OHLCV bars of each symbol, emitted once when the watermark passes their end; later events are dropped.

    State is one row for each open (symbol, window).
    """
    e = events.select(F.col("event_type").alias("symbol"), "event_id", F.col("ts").cast("timestamp").alias("ts"), F.round(F.col("value") * 100).cast("long").alias("px"))
    at = F.struct("ts", "event_id")
    w = e.withWatermark("ts", late).groupBy("symbol", F.window("ts", f"{interval} seconds").alias("w"))
    b = w.agg(F.min_by("px", at).alias("o"), F.max("px").alias("h"), F.min("px").alias("l"), F.max_by("px", at).alias("c"), F.count("*").alias("v"))
    return b.select("symbol", F.col("w.start").cast("long").alias("os"), "o", "h", "l", "c", "v")


def run_to_end(rows: DataFrame, out: str, checkpoint: str) -> None:
    """Runs what is there now into Parquet files, exactly once over restarts with the same checkpoint."""
    q = rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
