"""Exact medians of groups of any size: sketches bound where they lie, counts prove it, and only what is left between is looked at."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stats import strategies as _strategies
from .stored import drop, small, written

MOST = 10_000  # values of a group that are ranked at the end
SKETCH = 2000  # size of a sketch: its ranks are right to some 0.1 % of the values, as a rule
GRID = 256  # quantiles asked of a sketch
ROUNDS = 40


MOST_DISTINCT = 1 << 62  # of a group that no sketch has seen


def _same(keys: list[str], a: str, b: str) -> Column:
    on = F.lit(True)
    for k in keys:
        on = on & F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}"))
    return on


def _between(value: Column) -> Column:
    return (F.col("lo").isNull() | (value >= F.col("lo"))) & (F.col("hi").isNull() | (value <= F.col("hi")))


def medians(rows: DataFrame, keys: list[str], value: str, *, most: int = MOST, sketch: int = SKETCH) -> DataFrame:
    """keys, n and median (double; the mean of the middle two where n is even) of the value of each group. Null and NaN values don't count; a group without others has n 0 and null.

    Each round a KLL sketch of the values between the bounds known so far gives closer ones around the middle ranks; the values below and
    between them are counted, and bounds that don't hold (a sketch may err) are not taken. No task sees a group: sketches and counts are merged from partial ones,
    and the values ranked at the end are at most `most` distinct ones of a group, each with its count, unless ROUNDS rounds don't get there.
    """
    own = [f"key_{k}" for k in range(len(keys))]
    number = F.col(value).cast("double")
    table = written(rows.select(*[F.col(c).alias(k) for c, k in zip(keys, own)], F.when(~F.isnan(number), number).alias("v")), "values")
    count = table.groupBy(*own).agg(F.count("v").alias("n"))
    ends = [F.floor((F.col("n") - 1) / 2).cast("long").alias("first"), F.floor(F.col("n") / 2).cast("long").alias("second")]  # ranks from 0
    no = F.lit(None).cast("double")
    state = written(count.select(*own, "n", *ends, no.alias("lo"), no.alias("hi"), F.lit(0).cast("long").alias("below"), F.col("n").alias("inside"), F.lit(MOST_DISTINCT).alias("distinct")), "state")

    def joined(open_only: bool) -> DataFrame:
        s = state.where(_open(most)) if open_only else state.where("n > 0")
        return table.where("v is not null").alias("t").join(small(s).alias("s"), _same(own, "s", "t")).select(*[F.col(f"s.{k}").alias(k) for k in own], "v", "n", "first", "second", "lo", "hi", "below", "inside").where(_between(F.col("v")))

    for _ in range(ROUNDS):
        if state.where(_open(most)).isEmpty():
            break
        known = ["n", "first", "second", "lo", "hi", "below", "inside"]
        sketched = joined(True).groupBy(*own, *known).agg(F.kll_sketch_agg_double("v", F.lit(sketch)).alias("sketch"), F.approx_count_distinct("v").alias("distinct"))
        grid = F.kll_sketch_get_quantile_double("sketch", F.lit([k / GRID for k in range(GRID + 1)]))
        at = lambda rank, step: F.greatest(F.lit(1), F.least(F.lit(GRID + 1), ((F.col(rank) - F.col("below")) * GRID / F.greatest("inside", F.lit(1))).cast("int") + 1 + step))
        closer = sketched.withColumn("grid", grid).select(*own, *known, "distinct", F.element_at("grid", at("first", -1)).alias("new_lo"), F.element_at("grid", at("second", 2)).alias("new_hi"))
        closer = written(closer, "closer")
        values = table.where("v is not null").alias("t").join(small(closer).alias("s"), _same(own, "s", "t")).where(_between(F.col("v")))
        counted = values.groupBy(*[F.col(f"s.{k}").alias(k) for k in own]).agg(F.count_if(F.col("v") < F.col("new_lo")).alias("under"), F.count_if(F.col("v").between(F.col("new_lo"), F.col("new_hi"))).alias("middle"))
        both = closer.alias("a").join(counted.alias("b"), _same(own, "a", "b"))
        holds = (F.col("below") + F.col("under") <= F.col("first")) & (F.col("second") < F.col("below") + F.col("under") + F.col("middle"))
        pick = lambda new, old: F.when(holds, new).otherwise(F.col(old)).alias(old)
        moved = both.select(*[F.col(f"a.{k}").alias(k) for k in own], "n", "first", "second", pick(F.col("new_lo"), "lo"), pick(F.col("new_hi"), "hi"), F.when(holds, F.col("below") + F.col("under")).otherwise(F.col("below")).alias("new_below"), F.when(holds, F.col("middle")).otherwise(F.col("inside")).alias("new_inside"), "distinct")
        moved = moved.withColumnsRenamed({"new_below": "below", "new_inside": "inside"})
        after = written(state.where(~_open(most)).unionByName(moved), "state")
        drop(state, closer)
        state = after
    each = joined(False).groupBy(*own, "n", "first", "second", "below", "v").agg(F.count("*").alias("times"))
    upto = F.sum("times").over(Window.partitionBy(*own).orderBy("v"))
    ranked = each.withColumn("end", F.col("below") + upto).withColumn("begin", F.col("end") - F.col("times"))
    holds = lambda rank: F.max(F.when((F.col("begin") <= F.col(rank)) & (F.col(rank) < F.col("end")), F.col("v")))
    found = ranked.groupBy(*own).agg(((holds("first") + holds("second")) / 2).alias("median"))
    out = state.alias("a").join(found.alias("b"), _same(own, "a", "b"), "left")
    return out.select(*[F.col(f"a.{k}").alias(c) for c, k in zip(keys, own)], "n", "median")


def _open(most: int) -> Column:
    """Groups whose middle isn't narrowed down yet: more than `most` values lie between the bounds, and more than half as many distinct ones, if the sketch is right."""
    return (F.col("inside") > most) & (F.col("distinct") > most // 2) & (F.col("lo").isNull() | (F.col("lo") < F.col("hi")))


def strategies(ads: DataFrame, price: str, total: str, rules: dict[str, Column], **how: int) -> DataFrame:
    """As stats.strategies, its medians by medians()."""
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("strategy"), F.coalesce(r, F.lit(False)).alias("gone")) for n, r in {"none": F.lit(False), **rules}.items()]))
    left = ads.select(F.col(price).alias("price"), each.alias("s")).where("not s.gone").select("s.strategy", "price")
    middle = medians(left, ["strategy"], "price", **how).select("strategy", "median")
    others = _strategies(ads, price, total, rules, median=False)
    return others.join(F.broadcast(middle), "strategy", "left").select("strategy", "kept", "removed", "avg_price", F.col("median").alias("median_price"), "avg_total")  # a row for each rule
