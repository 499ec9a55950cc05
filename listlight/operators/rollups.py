"""Daily counts of sightings kept beside them: a change recounts the days that it touches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import partitions
from .partitions import PART
from .stats import KINDS
from .stored import drop, written


def _counted(rows: DataFrame) -> DataFrame:
    """seen_on, kind, n, with the month as partition, since a day has few rows."""
    month = F.concat(F.lit("m"), F.date_format("seen_on", "yyyy-MM"))  # a text that isn't taken for a date
    return rows.groupBy("seen_on", "kind").agg(F.count("*").alias("n")).withColumn(PART, month)


def create(sightings: DataFrame, folder: str) -> None:
    """Store sightings (id, ad_id, seen_on, kind) by day, and their counts by day and kind. An id is a sighting once; rows without a day are left out."""
    known = sightings.where("seen_on is not null").dropDuplicates(["id"])
    partitions.create(known.select("id", "ad_id", "seen_on", "kind"), f"{folder}/rows", F.col("seen_on"))
    spark = sightings.sparkSession
    partitions.create(_counted(partitions.read(spark, f"{folder}/rows").drop(PART)), f"{folder}/days", F.col(PART))


def change(spark: SparkSession, folder: str, added: DataFrame | None = None, removed: DataFrame | None = None) -> list:
    """Add sightings (id, ad_id, seen_on, kind), late ones and repeated ones too, and take back others (id, seen_on); the days that were recounted.

    A known id of the same day is the same sighting. Only the touched days of the sightings are read and rewritten, only their months of the counts.
    """
    moved = [d.where("seen_on is not null").withColumn(PART, F.col("seen_on")) for d in (added, removed) if d is not None]
    added = written(moved[0].select("id", "ad_id", "seen_on", "kind", PART), "added") if added is not None else None
    removed = written(moved[-1].select("id", "seen_on", PART), "removed") if removed is not None else None
    days = sorted({p for d in (added, removed) if d is not None for p in partitions.parts_of(d)})

    def after(old: DataFrame) -> DataFrame:
        out = old.unionByName(added).dropDuplicates(["id", "seen_on"]) if added is not None else old
        return out.join(removed.select("id", "seen_on"), ["id", "seen_on"], "left_anti") if removed is not None else out

    partitions.rewrite(spark, f"{folder}/rows", days, after)
    fresh = written(_counted(partitions.read(spark, f"{folder}/rows", days).drop(PART)), "counts")
    months = sorted({f"m{d:%Y-%m}" for d in days})
    partitions.rewrite(spark, f"{folder}/days", months, lambda old: old.where(~F.col("seen_on").isin(days)).unionByName(fresh))
    drop(*[d for d in (added, removed, fresh) if d is not None])
    return days


def daily_report(spark: SparkSession, folder: str, *, date_from: str, date_to: str, direction: str | None = "desc") -> DataFrame:
    """As stats.daily_report, from the counts."""
    days = partitions.read(spark, f"{folder}/days").where(F.col("seen_on").between(F.lit(date_from).cast("date"), F.lit(date_to).cast("date")))
    out = days.groupBy("seen_on").agg(*[F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("n"))), F.lit(0)).alias(k) for k in KINDS])
    out = out.select("*", (F.col("flat_rent") + F.col("flat_sale")).alias("flats"), (F.col("house_rent") + F.col("house_sale")).alias("houses")).withColumn("total", F.col("flats") + F.col("houses"))
    return out.orderBy(F.asc("seen_on") if str(direction).lower() == "asc" else F.desc("seen_on"))
