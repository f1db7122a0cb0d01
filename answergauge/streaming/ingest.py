"""Rounds as a stream: each id once, and the spread of scores in windows of time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from answergauge import schema

STREAM = T.StructType([*schema.ROUND, T.StructField("ts", T.TimestampType())])


def read_rounds(spark: SparkSession, path: str, late: str = "1 hour") -> DataFrame:
    """Rounds of the JSON files that come to a folder, each id once as far back as late."""
    return spark.readStream.schema(STREAM).json(path).withWatermark("ts", late).dropDuplicatesWithinWatermark(["id"])


def spread_by_window(rounds: DataFrame, width: str = "10 minutes") -> DataFrame:
    """start, intent_id, n, spread: what gate 2 asks, for each window and intent."""
    found = rounds.groupBy(F.window("ts", width).alias("w"), "intent_id").agg(F.count("*").alias("n"), F.stddev_pop("score").alias("spread"))
    return found.select(F.col("w.start").alias("start"), "intent_id", "n", "spread")
