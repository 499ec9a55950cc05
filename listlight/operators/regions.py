"""The tree of regions: closure, configuration, synchronisation, and the frontier of listing pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import parse
from .stored import SMALL, drop, numbered, small, written  # noqa: F401  (small is used from here too)

WRITTEN_FROM = 2  # rounds after which steps and pairs are written, so that plans stay short


def closure(regions: DataFrame) -> DataFrame:
    """(root_id, region_id): each region with itself and all its descendants, to any depth; regions in a cycle are an error.

    Pairs up to 2^k levels apart follow from those up to 2^(k-1), so a tree of depth d takes log2(d) rounds.
    """
    ids = regions.select("id", "parent_id").where("id is not null")
    reach = ids.select(F.col("id").alias("root_id"), F.col("id").alias("region_id"))
    step = ids.where("parent_id is not null").join(ids.select(F.col("id").alias("known")), F.col("parent_id") == F.col("known"), "left_semi").select(F.col("parent_id").alias("root_id"), F.col("id").alias("region_id"))
    levels, most, tables = 1, None, ()
    while not step.isEmpty():
        if levels > 1 << WRITTEN_FROM:
            most = ids.count() if most is None else most
            if levels > most:
                raise ValueError("regions form a cycle")
        below = reach.select(F.col("root_id").alias("via"), F.col("region_id").alias("below"))
        reach = reach.union(step.join(below, F.col("region_id") == F.col("via")).select("root_id", F.col("below").alias("region_id")))
        twice = step.select(F.col("root_id").alias("via"), F.col("region_id").alias("below"))
        step = step.join(twice, F.col("region_id") == F.col("via")).select("root_id", F.col("below").alias("region_id"))
        levels *= 2
        if levels >= 1 << WRITTEN_FROM:
            reach, step = written(reach, "reach"), written(step, "step")
            drop(*tables)
            tables = reach, step
    drop(*tables[1:])
    return reach


def of_kind(regions: DataFrame, kind: str, *, by_url: bool = False) -> DataFrame:
    """Regions of a kind (APARTMENT, HOUSE), by category or by what their address contains."""
    if not by_url:
        return regions.where(F.col("category") == kind)
    houses = F.col("url").contains("/homes-summer-residences/")
    return regions.where(houses if kind == "HOUSE" else ~houses)


def region_config(regions: DataFrame, kind: str, *, by_url: bool = False) -> DataFrame:
    """Root regions of a kind with their children: root, child (null without), whether each is crawled; by name."""
    own = of_kind(regions, kind, by_url=by_url)
    roots = own.where("parent_id is null").select(F.col("id").alias("root_id"), F.col("name").alias("root_name"), F.col("scrape_enabled").alias("root_enabled"))
    children = own.where("parent_id is not null").select(F.col("parent_id").alias("root_id"), F.col("id").alias("child_id"), F.col("name").alias("child_name"), F.col("scrape_enabled").alias("child_enabled"))
    return roots.join(children, "root_id", "left").orderBy("root_name", "root_id", F.asc_nulls_first("child_name"), "child_id")


def set_enabled(regions: DataFrame, kind: str, urls: list[str]) -> DataFrame:
    """regions with scrape_enabled false for the kind and true for each given address, of whatever kind."""
    houses = F.col("url").contains("/homes-summer-residences/")
    own = houses if kind == "HOUSE" else ~houses
    return regions.withColumn("scrape_enabled", F.when(F.col("url").isin(urls), True).when(own, False).otherwise(F.col("scrape_enabled")))


def enabled_counts(regions: DataFrame) -> DataFrame:
    """By category: regions, and those that are crawled."""
    return regions.groupBy("category").agg(F.count("*").alias("total"), F.count_if("scrape_enabled").alias("enabled"))


def frontier(regions: DataFrame, category: str, max_pages: int, deals: dict[str, str] | None = None) -> DataFrame:
    """Pages to fetch: each crawled region, deal type and page number with its address. deals: address suffix to deal type."""
    deals = deals or {"hand_over/": "RENT", "sell/": "SELL"}
    kinds = F.array(*[F.struct(F.lit(s).alias("suffix"), F.lit(t).alias("deal_type")) for s, t in deals.items()])
    own = regions.where(F.col("scrape_enabled") & (F.col("category") == category))
    pages = own.withColumn("d", F.explode(kinds)).withColumn("page", F.explode(F.sequence(F.lit(1), F.lit(max_pages))))
    return pages.select(F.col("id").alias("region_id"), "d.deal_type", "page", parse.page_url(F.col("url"), F.col("d.suffix"), F.col("page")).alias("url"))


def until_empty(pages: DataFrame, rows: Column) -> DataFrame:
    """pages (region_id, deal_type, page) up to the first one without rows, that one included."""
    first = F.min(F.when(rows == 0, F.col("page"))).over(Window.partitionBy("region_id", "deal_type"))
    return pages.withColumn("first_empty", first).where("first_empty is null or page <= first_empty").drop("first_empty")


def resume_region(sightings: DataFrame, ads: DataFrame, day: Column) -> DataFrame:
    """region_id (null if none): the larger of the regions of the last sighting of the day, by deal type. sightings: id, ad_id, seen_on; ads: id, region_id, deal_type."""
    today = sightings.where(F.col("seen_on") == day).select(F.col("id").alias("sighting_id"), "ad_id")
    placed = today.join(ads.select(F.col("id").alias("ad_id"), "region_id", "deal_type"), "ad_id")
    return placed.groupBy("deal_type").agg(F.max_by("region_id", "sighting_id").alias("region_id")).agg(F.max("region_id").alias("region_id"))


def resumed(regions: DataFrame, resume: DataFrame) -> DataFrame:
    """Crawled regions from the resume point (one row, region_id) on: all where it is null, none where it isn't crawled."""
    enabled = regions.where("scrape_enabled")
    point = resume.join(enabled.select(F.col("id").alias("found")), F.col("region_id") == F.col("found"), "left").select("region_id", "found")
    return enabled.crossJoin(F.broadcast(point)).where("region_id is null or id >= found").drop("region_id", "found")  # point is one row


def crawled_tree(links: DataFrame, base: str, root_path: str) -> DataFrame:
    """Region rows (name, url, parent_url) of links (page_path, href, title, text): those one level below the page they stand on, once each, in English addresses.

    Of several links to one address the first by parent (roots before all) and name counts.
    """
    own = links.where(parse.is_direct_child(F.col("href"), F.col("page_path")))
    path = F.regexp_replace(F.col("href"), r"[?#].*$", "")
    english = lambda p: F.replace(F.concat(F.lit(base), p), F.lit("/lv/"), F.lit("/en/"))
    parent = F.when(F.col("page_path") != root_path, english(F.col("page_path")))
    return own.select(parse.link_name(F.col("title"), F.col("text"), path).alias("name"), english(path).alias("url"), parent.alias("parent_url")).where("name <> ''").groupBy("url").agg(F.min(F.struct("parent_url", "name")).alias("first")).select("first.name", "url", "first.parent_url")


def synchronised(regions: DataFrame, crawled: DataFrame, category: str) -> DataFrame:
    """regions after a crawl: names (and children's parents) refreshed; new roots not crawled, new children crawled; children of unknown parents skipped.

    New ids continue after the largest, by address.
    """
    crawled = written(crawled, "crawled")  # read by five joins
    known = regions.select(F.col("id").alias("known_id"), F.col("url").alias("known_url"))
    fresh = crawled.join(known, F.col("url") == F.col("known_url"), "left_anti")
    roots = crawled.where("parent_url is null").select("url").union(regions.where("parent_id is null").select("url")).distinct()
    placed = fresh.join(roots.withColumnRenamed("url", "parent_url"), "parent_url", "left_semi").unionByName(fresh.where("parent_url is null"))
    last = regions.agg(F.coalesce(F.max("id"), F.lit(0)).alias("last"))
    ordered = numbered(placed.withColumn("is_child", F.col("parent_url").isNotNull()), ["is_child", "url"]).crossJoin(F.broadcast(last))  # last is one row
    new = ordered.select((F.col("last") + F.col("n")).alias("id"), "name", "url", F.lit(category).alias("category"), "parent_url", F.col("parent_url").isNotNull().alias("scrape_enabled"))
    seen = crawled.select(F.col("url").alias("c_url"), F.col("name").alias("c_name"), F.col("parent_url").alias("c_parent"))
    old = regions.join(seen, F.col("url") == F.col("c_url"), "left")
    old = old.select("id", F.coalesce("c_name", "name").alias("name"), "url", "category", F.col("c_parent").alias("parent_url"), "scrape_enabled", "parent_id")
    ids = old.select(F.col("url").alias("p_url"), F.col("id").alias("p_id")).union(new.select("url", "id"))
    both = old.unionByName(new.withColumn("parent_id", F.lit(None).cast("long"))).join(ids, F.col("parent_url") == F.col("p_url"), "left")
    return both.select("id", "name", "url", "category", F.coalesce("p_id", "parent_id").alias("parent_id"), "scrape_enabled")
