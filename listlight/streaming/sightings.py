"""Sightings as a stream: one for each ad and day, and counts by day."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read(spark: SparkSession, folder: str, schema, time: str = "ts") -> DataFrame:
    """A stream of Parquet files; zoneless times become timestamps, which watermarks need."""
    return spark.readStream.schema(schema).parquet(folder).withColumn(time, F.col(time).cast("timestamp"))


def daily_sightings(seen: DataFrame, late: str = "2 days", time: str = "ts") -> DataFrame:
    """(ad_id, seen_on, time): the first of an ad on a day; those later than `late` are dropped with their state."""
    return seen.withColumn("seen_on", F.to_date(time)).withWatermark(time, late).dropDuplicatesWithinWatermark(["ad_id", "seen_on"])


def counts_by_day(seen: DataFrame, late: str = "2 days", time: str = "ts") -> DataFrame:
    """seen_on, n over tumbling days."""
    return seen.withWatermark(time, late).groupBy(F.window(time, "1 day").alias("w")).agg(F.count("*").alias("n")).select(F.to_date("w.start").alias("seen_on"), "n")


def run_once(stream: DataFrame, folder: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Process what there is and stop: a scheduled run that picks up where the last one ended."""
    return stream.writeStream.format("parquet").outputMode(mode).option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
