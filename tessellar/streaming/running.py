"""Streaming extension: windowed group means over an event stream, and z-scores against them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_maps(events: DataFrame, length: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(window, key, n, mean, sd) of a stream (ts, key, value); rows later than `late` are dropped, state is bounded by it."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", length), "key").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"))


def zscored(events: DataFrame, reference: DataFrame) -> DataFrame:
    """Each event with its z-score against a static reference (key, mean, sd): a stateless stream-static join."""
    return events.join(reference, "key").withColumn("z", (F.col("value") - F.col("mean")) / F.nullif("sd", F.lit(0.0))).drop("mean", "sd")
