"""Mixing sources to target weights by capped water-filling, with seeded whole and fractional repetitions.

Targets: each source asks for budget * weight / all weights words and is clamped at `epochs` times its
size; the excess goes to the sources below their clamp in proportion to weight, until none is above. Sources
are clamped in the order of clamp / weight, so running sums in that order give the level at which the filling
ends, in one pass over the table of sources (one row each, however large they are); only sums reach the driver.

Sampling: a source whose target is r times its size takes each document floor(r) times and some a further
time, so that their words come to the fraction left. Those are chosen by a seeded hash within classes of
document size (powers of two), from the largest to the smallest; what a class leaves over or takes too
much is carried to the next, so a source ends within about its smallest documents of the target where it has many. A class
is cut at one of BINS ranges of the hash, from sums by (source, class, range): no document is sorted and
no source is gathered anywhere, however hot.

Defined cases: a null text has size 0; a null source is a source of its own, ranked last. Documents of
size 0 are taken zero times in words and, as documents, floor(r) times. Repeated rows are separate
documents unless they share a doc_id, in which case the hash takes them alike. Where all sizes are 0 the
targets are 0. An empty table gives an empty result. Other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import drop, written

BINS = 1 << 12
FEW_SOURCES = 10_000  # sources up to which all cuts (at most 40 short rows each) are broadcast; beyond, those of the sources with the most rows
WORD = r"[^\x20\x09-\x0D]+"


def sized(docs: DataFrame) -> DataFrame:
    """docs with size: the number of words [^\\x20\\x09-\\x0D]+ of text, null as 0."""
    return docs.withColumn("size", F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long"))


def _running(rows: DataFrame, order: list[str], sums: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(rows with the sums over all rows before each in an order, nulls last, and the table that it reads): ranges are summed apart and offset by the ranges before them."""
    nulls_last = [f(c) for c in order for f in (lambda c: F.col(c).isNull(), F.col)]
    spread = written(rows.repartitionByRange(*nulls_last).withColumn("part", F.spark_partition_id()).select("*", *[v.alias(f"of_{k}") for k, v in sums.items()]), "ranges")
    zero = lambda c: F.coalesce(c, F.lit(0))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    parts = spread.groupBy("part").agg(*[F.sum(f"of_{k}").alias(k) for k in sums])
    offsets = parts.select("part", *[zero(F.sum(k).over(before)).alias(f"before_{k}") for k in sums])
    within = Window.partitionBy("part").orderBy(*nulls_last).rowsBetween(Window.unboundedPreceding, -1)
    joined = spread.join(F.broadcast(offsets), "part")
    return joined.select(*rows.columns, *[(F.col(f"before_{k}") + zero(F.sum(f"of_{k}").over(within))).alias(k) for k in sums]), spread


def water_fill(sources: DataFrame, *, budget: float, epochs: float) -> DataFrame:
    """sources (source, source_size, weight) with target: the shares of budget * total size by weight, none over epochs * source_size."""
    total, weights = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.sum(F.col("weight").cast("double"))).first()
    if not total:
        return sources.withColumn("target", F.lit(0.0))
    cap = F.col("source_size") * F.lit(float(epochs))
    ordered = sources.withColumn("clamp_at", cap / F.col("weight"))
    running, spread = _running(ordered, ["clamp_at", "source"], {"clamped": cap, "passed": F.col("weight").cast("double")})
    level = (F.lit(float(budget * total)) - F.col("clamped")) / F.greatest(F.lit(float(weights)) - F.col("passed"), F.col("weight"))
    ends = running.select("clamp_at", level.alias("level")).where(F.col("level") <= F.col("clamp_at") * (1 + 1e-12))
    first = ends.agg(F.min(F.struct("clamp_at", "level"))["level"]).first()[0]
    drop(spread)
    return sources.withColumn("target", F.least(F.col("weight") * F.lit(float("inf") if first is None else first), cap))


def _bin(seed: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), F.lit(BINS)).cast("int")


def _class() -> Column:
    return F.when(F.col("size") > 0, F.floor(F.log2(F.col("size").cast("double"))) + 1).otherwise(F.lit(0)).cast("int")


def _cuts(table: DataFrame, targets: DataFrame) -> DataFrame:
    """source, class, whole, cut: documents of hash bin < cut are taken once more than `whole` times."""
    bins = table.groupBy("source", "class", "bin").agg(F.sum("size").alias("words"))
    upto = Window.partitionBy("source", "class").orderBy("bin")  # BINS rows at most
    bins = bins.withColumn("upto", F.sum("words").over(upto))
    steps = bins.groupBy("source", "class").agg(F.array_sort(F.collect_list(F.struct("bin", "upto"))).alias("steps"), F.sum("words").alias("words"))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(ratio + 1e-12).cast("int")
    of = targets.select(F.col("source").alias("of"), "source_size", "target")
    joined = steps.join(of, F.col("source").eqNullSafe(F.col("of"))).withColumn("whole", whole).withColumn("left", F.greatest(ratio - F.col("whole"), F.lit(0.0)))
    # By class, from the largest: need = its own share + what is carried. The bins that fit into it are taken if the
    # smaller classes can hold the rest beside their own share, else those up to the sum nearest to it.
    one = F.struct(F.col("class").alias("class"), "words", "steps")
    by_source = joined.groupBy("source").agg(F.first("whole").alias("whole"), F.first("left").alias("left"), F.reverse(F.array_sort(F.collect_list(one))).alias("classes"))

    def take(state: Column, c: Column) -> Column:
        need, rest = state["carry"] + F.col("left") * c["words"], state["rest"] - c["words"]
        start = F.struct(F.lit(0).cast("int").alias("cut"), F.lit(0).cast("long").alias("got"))
        to = lambda s: F.struct((s["bin"] + 1).cast("int").alias("cut"), s["upto"].alias("got"))
        fitting = F.aggregate(c["steps"], start, lambda best, s: F.when((s["upto"] <= need) & (s["upto"] > best["got"]), to(s)).otherwise(best))
        nearest = F.aggregate(c["steps"], start, lambda best, s: F.when(F.abs(s["upto"] - need) < F.abs(best["got"] - need), to(s)).otherwise(best))
        best = F.when(need - fitting["got"] <= (1 - F.col("left")) * rest, fitting).otherwise(nearest)
        cut = F.array(F.struct(c["class"].alias("class"), best["cut"].alias("cut")))
        return F.struct((need - best["got"]).alias("carry"), rest.alias("rest"), F.concat(state["cuts"], cut).alias("cuts"))

    empty = F.array().cast("array<struct<class:int,cut:int>>")
    words = F.aggregate("classes", F.lit(0).cast("long"), lambda n, c: n + c["words"])
    state = F.aggregate("classes", F.struct(F.lit(0.0).alias("carry"), words.alias("rest"), empty.alias("cuts")), take)
    return by_source.select("source", "whole", F.explode(state["cuts"]).alias("c")).select("source", "whole", "c.class", "c.cut")


def mix(docs: DataFrame, *, weights: tuple[float, ...] = (3, 1, 2), budget: float = 1.5, epochs: float = 2.0, seed: int = 17) -> DataFrame:
    """docs (doc_id, source, text, ...) with size, source_size, target and copies (how often the mix takes the document).

    Sources by code point, null last, have the weights in turn and share budget * all sizes.
    """
    docs = docs.drop("size", "source_size", "target", "copies")
    sizes = sized(docs.select("doc_id", "source", "text")).select("doc_id", "source", "size")
    table = written(sizes.withColumn("class", _class()).withColumn("bin", _bin(seed)), "sizes")
    by_source = table.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    sources, spread = _running(by_source, ["source"], {"rank": F.lit(1).cast("long")})
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    weighted = written(sources.withColumn("weight", turn), "sources")
    targets = written(water_fill(weighted, budget=budget, epochs=epochs).select("source", "source_size", "target", "rows"), "targets")
    cuts = _cuts(table, targets)
    of = targets.select(F.col("source").alias("of"), "source_size", "target", "rows")
    plan = cuts.join(of, F.col("source").eqNullSafe(F.col("of"))).select("of", F.col("class").alias("of_class"), "cut", "whole", "source_size", "target", "rows")
    plan = written(plan, "plan")
    few, rows = targets.agg(F.count("*") <= FEW_SOURCES, F.sum("rows")).first()
    drop(table, spread, weighted, targets)
    packed = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "source", "text")  # extra columns cannot clash
    placed = sized(packed).withColumn("class", _class()).withColumn("bin", _bin(seed)).drop("text")
    # Sources with a FEW_SOURCES-th of all rows or more (so FEW_SOURCES at most) find their cuts by a broadcast, whatever they hold.
    large = F.lit(bool(few)) | (F.col("rows") * FEW_SOURCES >= F.lit(rows or 0))
    made = ["cut", "whole", "source_size", "target"]
    hot = F.broadcast(plan.where(large).select("of", "of_class", F.struct(*made).alias("hot")))
    joined = placed.join(hot, F.col("source").eqNullSafe(F.col("of")) & (F.col("class") == F.col("of_class")), "left").drop("of", "of_class")
    if few:
        joined = joined.withColumn("plan", F.col("hot"))
    else:
        # The others by a shuffle, in which the rows that have their cuts already are dealt out evenly.
        key = F.when(F.col("hot").isNull(), F.xxhash64("source", "class")).otherwise(F.xxhash64("doc_id", "bin"))
        cold = plan.where(~large).select("of", "of_class", F.struct(*made).alias("cold"), F.xxhash64(F.col("of").alias("source"), F.col("of_class").alias("class")).alias("key"))
        same = (F.col("placed_key") == F.col("key")) & F.col("hot").isNull() & F.col("source").eqNullSafe(F.col("of")) & (F.col("class") == F.col("of_class"))
        joined = joined.withColumn("placed_key", key).join(cold, same, "left").withColumn("plan", F.coalesce("hot", "cold"))
    copies = (F.col("plan.whole") + (F.col("bin") < F.col("plan.cut")).cast("int")).cast("int")
    return joined.select("row.*", "size", "plan.source_size", "plan.target", copies.alias("copies"))


def repeated(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """The rows of the mix: each document as often as it is taken."""
    return mixed.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*columns)
