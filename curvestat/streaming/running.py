"""Streaming extension: sufficient statistics of groups as events arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def windowed_statistics(events: DataFrame, key: str, value: str, time: str = "ts", late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """n, sum and sum of squares of each key and time window; late events are kept up to the watermark."""
    v = F.col(value)
    return (
        events.withWatermark(time, late)
        .groupBy(F.window(time, width).alias("w"), key)
        .agg(F.count(v).alias("n"), F.sum(v).alias("s"), F.sum(v * v).alias("z"))
        .select(F.col("w.start").alias("window_start"), key, "n", "s", "z")
    )


def merge(statistics: DataFrame, keys: list[str]) -> DataFrame:
    """Statistics of coarser keys; sums merge associatively."""
    return statistics.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("z").alias("z"))


def to_parquet(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write finished windows once each; the checkpoint lets a restart go on where it stopped."""
    return stream.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
