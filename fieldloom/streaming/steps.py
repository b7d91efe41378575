"""Time steps as a stream: new files of a folder are steps; windows over event time with late data bounded by a watermark."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery


def open_steps(spark: SparkSession, folder: str, schema: str, per_trigger: int = 1) -> DataFrame:
    """Rows of Parquet files as they appear, a bounded number of files a step."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def each_step(steps: DataFrame, f: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """f(rows, step number) for each step; progress is kept in the checkpoint, so a restart goes on with the next step."""
    writer: DataStreamWriter = steps.writeStream.foreachBatch(f).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    return writer.start()


def windows(rows: DataFrame, time: str, value: str, length: str, slide: str | None = None, late: str = "10 minutes", *keys: str) -> DataFrame:
    """start, keys, n, total, low, high of tumbling or sliding windows; rows later than the watermark are left out."""
    w = F.window(time, length, slide) if slide else F.window(time, length)
    out = rows.withWatermark(time, late).groupBy(w.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"), F.min(value).alias("low"), F.max(value).alias("high"))
    return out.select(F.col("w.start").alias("start"), *keys, "n", "total", "low", "high")


def running_mean(old: DataFrame, new: DataFrame, key: str, value: str, n: int) -> DataFrame:
    """Mean over n + 1 steps from the mean over n and the next step (progressive accumulation)."""
    j = old.select(key, F.col(value).alias("_a")).join(new.select(key, F.col(value).alias("_b")), key, "full")
    return j.select(key, ((F.coalesce("_a", F.lit(0.0)) * n + F.coalesce("_b", F.lit(0.0))) / (n + 1)).alias(value))
