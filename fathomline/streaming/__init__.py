"""Structured Streaming twins of the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F


def _timed(events: DataFrame, late: str) -> DataFrame:
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def windowed_bars(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Bars of events by type and window, final once the watermark has passed; the same columns as the batch bars."""
    w = _timed(events, late).groupBy(F.window("ts", width), F.col("event_type").alias("symbol"))
    return w.agg(F.max_by("value", "event_id").alias("close"), F.min("value").alias("low"), F.max("value").alias("high"), F.sum("value").alias("volume"), F.count("*").alias("n")).select("symbol", F.col("window.start").alias("ts"), "close", "low", "high", "volume", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Sessions of users."""
    s = _timed(events, late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return s.select("user_id", F.col("session_window.start").alias("first"), F.col("session_window.end").alias("last"), "n")


def upsert_into(path: str, keys: list[str], order: str):
    """A foreachBatch sink: each batch, with the last row of each key by `order`, goes under its own number, so that a batch
    that is written again replaces itself. `latest` reads what holds."""

    def write(batch: DataFrame, number: int) -> None:
        last = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))
        batch.withColumn("_last", last).where("_last = 1").drop("_last").write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def latest(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Of the batches under a path, the row of each key from the greatest batch."""
    rows = spark.read.parquet(path)
    last = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("batch")))
    return rows.withColumn("_last", last).where("_last = 1").drop("_last", "batch")
