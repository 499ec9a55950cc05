"""Statistics of ads and their daily sightings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .regions import small


def days_active(sightings: DataFrame) -> DataFrame:
    """ad_id, n: days on which each ad was seen. Aggregated before it meets the ads."""
    return sightings.groupBy("ad_id").agg(F.count("*").alias("n"))


def in_window(when: Column, date_from: str, date_to: str) -> Column:
    """Calendar days of a timestamp, both ends included; Catalyst turns it into a pushed range."""
    return F.to_date(when).between(F.lit(date_from).cast("date"), F.lit(date_to).cast("date"))


def region_stats(ads: DataFrame, sightings: DataFrame, closure: DataFrame, roots: DataFrame, *, price: str, date_from: str, date_to: str) -> DataFrame:
    """root_id, total_ads, avg_price_per_sqm, avg_size, avg_days_tracked of each root (id) over its region and descendants.

    Roots without ads have 0 and nulls; an ad never seen counts 0 days. Ads: id, region_id, first_seen, size and the price column.
    """
    chosen = ads.where(in_window(F.col("first_seen"), date_from, date_to)).select("id", "region_id", "size", F.col(price).alias("price"))
    tracked = chosen.join(days_active(sightings), F.col("id") == F.col("ad_id"), "left").withColumn("n", F.coalesce("n", F.lit(0)))
    # One row for each region first: the closure then multiplies regions, not ads.
    by_region = tracked.groupBy("region_id").agg(
        F.count("*").alias("ads"),
        *[f(F.col(c)).alias(f"{k}_{c}") for c in ("price", "size", "n") for k, f in (("sum", F.sum), ("count", F.count))],
    )
    reach = closure.join(small(roots.select(F.col("id").alias("root_id"))), "root_id", "right")
    joined = reach.join(by_region, "region_id", "left")
    mean = lambda c: F.when(F.sum(f"count_{c}") > 0, F.sum(f"sum_{c}") / F.sum(f"count_{c}"))
    return joined.groupBy("root_id").agg(F.coalesce(F.sum("ads"), F.lit(0)).alias("total_ads"), mean("price").alias("avg_price_per_sqm"), mean("size").alias("avg_size"), mean("n").alias("avg_days_tracked"))


def region_totals(rent: DataFrame, sale: DataFrame, closure: DataFrame, roots: DataFrame, *, date_from: str, date_to: str) -> DataFrame:
    """As region_stats without a deal type: rent and sale ads counted together, averages null."""
    both = rent.select("region_id", "first_seen").union(sale.select("region_id", "first_seen"))
    by_region = both.where(in_window(F.col("first_seen"), date_from, date_to)).groupBy("region_id").agg(F.count("*").alias("ads"))
    reach = closure.join(small(roots.select(F.col("id").alias("root_id"))), "root_id", "right")
    out = reach.join(by_region, "region_id", "left").groupBy("root_id").agg(F.coalesce(F.sum("ads"), F.lit(0)).alias("total_ads"))
    return out.select("root_id", "total_ads", *[F.lit(None).cast("double").alias(c) for c in ("avg_price_per_sqm", "avg_size", "avg_days_tracked")])


def region_ads(ads: DataFrame, sightings: DataFrame, closure: DataFrame, root_id: int, *, date_from: str, date_to: str) -> DataFrame:
    """Ads of a region and its descendants with days_active, newest first."""
    own = small(closure.where(F.col("root_id") == root_id).select("region_id"))
    chosen = ads.where(in_window(F.col("first_seen"), date_from, date_to)).join(own, "region_id", "left_semi")
    joined = chosen.join(days_active(sightings), F.col("id") == F.col("ad_id"), "left")
    return joined.withColumn("days_active", F.coalesce("n", F.lit(0))).drop("ad_id", "n").orderBy(F.desc("first_seen"), "id")


KINDS = ("flat_rent", "flat_sale", "house_rent", "house_sale")


def daily_report(sightings: dict[str, DataFrame], *, date_from: str, date_to: str, direction: str | None = "desc", regions: DataFrame | None = None, ads: DataFrame | None = None) -> DataFrame:
    """seen_on, the count of each kind, flats, houses, total: one union and one aggregation.

    sightings: by kind (ad_id, seen_on). With regions (region_id), only sightings of ads (id, region_id) in them;
    hidden ads count, unlike in region_stats. direction: asc, or desc for whatever else is asked.
    """
    seen = reduce(DataFrame.union, [sightings[k].where(F.col("seen_on").between(F.lit(date_from).cast("date"), F.lit(date_to).cast("date"))).select("ad_id", "seen_on", F.lit(k).alias("kind")) for k in KINDS])
    if regions is not None:
        own = ads.join(small(regions.select("region_id")), "region_id", "left_semi").select(F.col("id").alias("ad_id"))
        seen = seen.join(own, "ad_id")
    out = seen.groupBy("seen_on").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in KINDS])
    out = out.select("*", (F.col("flat_rent") + F.col("flat_sale")).alias("flats"), (F.col("house_rent") + F.col("house_sale")).alias("houses")).withColumn("total", F.col("flats") + F.col("houses"))
    return out.orderBy(F.asc("seen_on") if str(direction).lower() == "asc" else F.desc("seen_on"))


def report_header(report: DataFrame) -> DataFrame:
    """days_with_data, avg_flats, avg_houses (rounded), total_sightings of a daily report."""
    mean = lambda c: F.coalesce(F.round(F.sum(c) / F.count("*")).cast("long"), F.lit(0))
    return report.agg(F.count("*").alias("days_with_data"), mean("flats").alias("avg_flats"), mean("houses").alias("avg_houses"), F.coalesce(F.sum("total"), F.lit(0)).alias("total_sightings"))


def counts_by_day(seen: DataFrame) -> DataFrame:
    return seen.groupBy("seen_on").agg(F.count("*").alias("n")).orderBy("seen_on")


# A study of rentals that are sales in disguise.

PRICE_EDGES = (5, 10, 15, 20, 30, 50, 100, 500, 1000)


def price_histogram(ads: DataFrame, price: str, edges: tuple[float, ...] = PRICE_EDGES) -> DataFrame:
    """bucket (0 for prices under the first edge), n."""
    bucket = sum([(F.col(price) >= e).cast("int") for e in edges[1:]], (F.col(price) >= edges[0]).cast("int"))
    return ads.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


def strategies(ads: DataFrame, price: str, total: str, rules: dict[str, Column], *, median: bool = True) -> DataFrame:
    """strategy, kept, removed, avg_price, median_price (unless it is left out), avg_total: what each filter (true where an ad goes) leaves, in one pass, all rules beside each other.

    The median of a strategy is ranked in one task; medians.strategies() has another way for many ads.
    """
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("strategy"), F.coalesce(r, F.lit(False)).alias("gone")) for n, r in {"none": F.lit(False), **rules}.items()]))
    rows = ads.select(F.col(price).alias("price"), F.col(total).alias("total"), each.alias("s")).select("price", "total", "s.strategy", "s.gone")
    left = ~F.col("gone")
    return rows.groupBy("strategy").agg(
        F.count_if(left).alias("kept"), F.count_if("gone").alias("removed"), F.avg(F.when(left, F.col("price"))).alias("avg_price"),
        *[F.median(F.when(left, F.col("price"))).alias("median_price")] * median, F.avg(F.when(left, F.col("total"))).alias("avg_total"),
    )


def by_district(ads: DataFrame, gone: Column) -> DataFrame:
    """district, n, removed, removed_percent, and whether all of it goes."""
    out = ads.groupBy("district").agg(F.count("*").alias("n"), F.count_if(gone).alias("removed"))
    return out.select("*", F.round(F.col("removed") * 100 / F.col("n"), 2).alias("removed_percent"), (F.col("removed") == F.col("n")).alias("all_removed"))
