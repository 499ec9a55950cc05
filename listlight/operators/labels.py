"""Interval labels of a tree: "descendant of" as a range of numbers, where the pairs of a closure would be too many."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stats import days_active, in_window
from .stored import drop, numbered, running, small, written


def labels(regions: DataFrame) -> DataFrame:
    """(id, depth, first, last): each region's number in the order of a walk from the roots down, children by id, and the largest number below it.

    A region x lies in r's tree just if x.first is between r.first and r.last. A tour enters each region before and leaves it after its
    children; its events form one list, whose places are found by jumping: each round an event adds what the event that it points to has
    gathered, and points to where that one does. A tree of n regions takes log2(2 n) rounds of 2 n rows, whatever its depth (closure()
    has a row for each pair, so n * depth of them). Parents that aren't among the regions count as none; of rows that share an id the one with the least parent counts;
    regions in a cycle are an error.
    """
    ids = regions.where("id is not null").groupBy("id").agg(F.min("parent_id").alias("parent_id"))
    known = ids.select(F.col("id").alias("parent_id"), F.lit(True).alias("known"))
    nodes = ids.join(known, "parent_id", "left").select("id", F.when(F.col("known"), F.col("parent_id")).alias("parent_id"))
    nodes = written(numbered(nodes, ["parent_id", "id"]), "nodes")  # siblings stand together: the next one is the next row
    count = nodes.count()
    following = nodes.select((F.col("n") - 1).alias("n"), F.col("parent_id").alias("next_parent"), F.lit(True).alias("has_next"))
    child = nodes.where("parent_id is not null").groupBy(F.col("parent_id").alias("id")).agg(F.min("n").alias("child"))
    parent = nodes.select(F.col("id").alias("parent_id"), F.col("n").alias("parent"))
    linked = nodes.join(following, "n", "left").join(child, "id", "left").join(parent, "parent_id", "left")
    enter, leave = 2 * F.col("n"), 2 * F.col("n") + 1
    sibling = F.when(F.col("has_next") & F.col("parent_id").eqNullSafe(F.col("next_parent")), enter + 2)
    events = F.array(
        F.struct(enter.alias("event"), F.coalesce(2 * F.col("child"), leave).alias("next"), F.lit(1).cast("long").alias("deeper")),
        F.struct(leave.alias("event"), F.coalesce(sibling, 2 * F.col("parent") + 1).alias("next"), F.lit(-1).cast("long").alias("deeper")),
    )
    state = written(linked.select(F.explode(events).alias("e")).select("e.event", "e.next", F.lit(1).cast("long").alias("left"), "e.deeper"), "tour")
    for _ in range((2 * count).bit_length() + 1):
        if state.where("next is not null").isEmpty():
            break
        ahead = state.select(F.col("event").alias("next"), F.col("next").alias("on"), F.col("left").alias("more"), F.col("deeper").alias("more_deeper"))
        jumped = state.join(ahead, "next", "left").select("event", F.col("on").alias("next"), (F.col("left") + F.coalesce("more", F.lit(0))).alias("left"), (F.col("deeper") + F.coalesce("more_deeper", F.lit(0))).alias("deeper"))
        after = written(jumped, "tour")
        drop(state)
        state = after
    if not state.where("next is not null").isEmpty():
        raise ValueError("regions form a cycle")
    entered = state.where("event % 2 = 0").select((F.col("event") / 2).cast("long").alias("n"), (2 * count - F.col("left")).alias("place"), (-F.col("deeper")).alias("depth"))
    left = state.where("event % 2 = 1").select(((F.col("event") - 1) / 2).cast("long").alias("n"), (2 * count - F.col("left")).alias("end"))
    first = ((F.col("place") + F.col("depth")) / 2).cast("long")  # of the events before an entrance, all regions entered but the ancestors were left again
    size = ((F.col("end") - F.col("place") + 1) / 2).cast("long")
    out = written(nodes.join(entered, "n").join(left, "n").select("id", F.col("depth").cast("int").alias("depth"), first.alias("first"), (first + size - 1).alias("last")), "labels")
    drop(nodes, state)
    return out


def below(labelled: DataFrame, root_id: int) -> DataFrame:
    """(region_id) of a region's tree, itself included: a range of numbers."""
    root = labelled.where(F.col("id") == root_id).select(F.col("first").alias("lo"), F.col("last").alias("hi"))  # one row
    return labelled.join(F.broadcast(root), F.col("first").between(F.col("lo"), F.col("hi"))).select(F.col("id").alias("region_id"))


def over_trees(labelled: DataFrame, by_region: DataFrame, roots: DataFrame, sums: list[str]) -> DataFrame:
    """root_id and the sums, over its tree, of columns of by_region (region_id, ...) for each root (id): differences of running sums in the order of first, so no region meets its ancestors.

    Decimals and whole numbers lose nothing by the difference; doubles may.
    """
    placed = labelled.join(by_region, F.col("id") == F.col("region_id"), "left").select("first", *[F.coalesce(c, F.lit(0)).alias(c) for c in sums])
    upto = running(placed, ["first"], {f"upto_{c}": c for c in sums})
    own = small(roots.select(F.col("id").alias("root_id"))).join(labelled, F.col("root_id") == F.col("id")).select("root_id", "first", "last")
    start = own.join(upto.select("first", *[(F.col(f"upto_{c}") - F.col(c)).alias(f"before_{c}") for c in sums]), "first")
    end = upto.select(F.col("first").alias("last"), *[f"upto_{c}" for c in sums])
    return start.join(end, "last").select("root_id", *[(F.col(f"upto_{c}") - F.col(f"before_{c}")).alias(c) for c in sums])


def region_stats(ads: DataFrame, sightings: DataFrame, labelled: DataFrame, roots: DataFrame, *, price: str, date_from: str, date_to: str) -> DataFrame:
    """As stats.region_stats, from labels instead of a closure; sums are decimals of ten places."""
    exact = lambda c: F.col(c).cast("decimal(28,10)")
    chosen = ads.where(in_window(F.col("first_seen"), date_from, date_to)).select("id", "region_id", exact("size").alias("size"), exact(price).alias("price"))
    tracked = chosen.join(days_active(sightings), F.col("id") == F.col("ad_id"), "left").withColumn("n", F.coalesce("n", F.lit(0)))
    parts = [(f"{k}_{c}", f(F.col(c))) for c in ("price", "size", "n") for k, f in (("sum", F.sum), ("count", F.count))]
    by_region = tracked.groupBy("region_id").agg(F.count("*").alias("ads"), *[part.alias(name) for name, part in parts])
    summed = over_trees(labelled, by_region, roots, ["ads", *[name for name, _ in parts]])

    def mean(c: str) -> Column:
        return F.when(F.col(f"count_{c}") > 0, F.col(f"sum_{c}").cast("double") / F.col(f"count_{c}"))

    return summed.select("root_id", F.col("ads").alias("total_ads"), mean("price").alias("avg_price_per_sqm"), mean("size").alias("avg_size"), mean("n").alias("avg_days_tracked"))


def region_ads(ads: DataFrame, sightings: DataFrame, labelled: DataFrame, root_id: int, *, date_from: str, date_to: str) -> DataFrame:
    """As stats.region_ads, from labels."""
    chosen = ads.where(in_window(F.col("first_seen"), date_from, date_to)).join(small(below(labelled, root_id)), "region_id", "left_semi")
    joined = chosen.join(days_active(sightings), F.col("id") == F.col("ad_id"), "left")
    return joined.withColumn("days_active", F.coalesce("n", F.lit(0))).drop("ad_id", "n").orderBy(F.desc("first_seen"), "id")
