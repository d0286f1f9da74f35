"""Event series: windows, watermarks and lags; the same functions serve streams and tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def windowed(events: DataFrame, length: str, slide: str | None = None, late: str | None = None, by: tuple[str, ...] = ("event_type",), ts: str = "ts", value: str = "value") -> DataFrame:
    """Counts and sums per window and key. On a stream ``late`` sets the watermark."""
    rows = events.withWatermark(ts, late) if late and events.isStreaming else events
    span = F.window(ts, length, slide) if slide else F.window(ts, length)
    return rows.groupBy(span.alias("w"), *by).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(value), 4).alias("total")).select(F.col("w.start").alias("window_start"), *by, "n", "total")


def sessions(events: DataFrame, gap: str, key: str = "user_id", ts: str = "ts", late: str | None = None) -> DataFrame:
    """Events of a key without a gap of ``gap`` make a session."""
    rows = events.withWatermark(ts, late) if late and events.isStreaming else events
    return rows.groupBy(key, F.session_window(ts, gap).alias("s")).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "n")


def weekly(events: DataFrame, lags: int = 5, ts: str = "ts", value: str = "value") -> DataFrame:
    """Mean and variance per week and the means of the weeks before. Weeks are few, so their order takes one task."""
    week = F.date_trunc("week", ts).alias("week")
    g = events.groupBy(week).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(value), 6).alias("mean_value"), F.round(F.var_pop(value), 6).alias("var_value"))
    w = W.orderBy("week")
    return g.withColumns({f"lag_{k}": F.lag("mean_value", k).over(w) for k in range(1, lags + 1)})


def stream_of(spark: SparkSession, path: str, schema, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Everything available into a table, exactly once under the checkpoint."""
    stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def bucket(ts: Column, seconds: int) -> Column:
    return F.timestamp_seconds(F.floor(F.unix_timestamp(ts) / seconds) * seconds)
