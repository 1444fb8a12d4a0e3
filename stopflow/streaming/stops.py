"""Extension: the same stops as a stream. Visits and stay time per person and local day, with late data bounded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.stops import STOPS, valid_locations


def read_stream(spark: SparkSession, path: str) -> DataFrame:
    """Parquet files of raw stops as they arrive below a path."""
    return spark.readStream.schema(STOPS).parquet(path)


def daily(stops: DataFrame, late: str = "2 days") -> DataFrame:
    """useruuid, day, visits, stay_time over tumbling local days; rows later than `late` are dropped from a stream."""
    local = valid_locations(stops).withColumn("at", F.timestamp_seconds(F.col("start") + F.col("timezone")))
    return (
        local.withWatermark("at", late)
        .groupBy("useruuid", F.window("at", "1 day").alias("w"))
        .agg(F.count("*").alias("visits"), F.sum(F.col("end") - F.col("start")).alias("stay_time"))
        .select("useruuid", F.unix_timestamp("w.start").alias("day"), "visits", "stay_time")
    )


def sessions(stops: DataFrame, gap: str = "12 hours", late: str = "2 days") -> DataFrame:
    """useruuid, start, end, visits of stays that follow each other within a gap."""
    local = valid_locations(stops).withColumn("at", F.timestamp_seconds("start"))
    return (
        local.withWatermark("at", late)
        .groupBy("useruuid", F.session_window("at", gap).alias("w"))
        .agg(F.count("*").alias("visits"))
        .select("useruuid", F.unix_timestamp("w.start").alias("start"), F.unix_timestamp("w.end").alias("end"), "visits")
    )
