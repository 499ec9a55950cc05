"""Writes to immutable tables: each returns the table after the write. Keys within a batch: the last by `sequence` wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stored import numbered


def last_of_each(batch: DataFrame, keys: list[str], sequence: str | None) -> DataFrame:
    """One row for each key: the one with the largest sequence, the largest other columns among equals or without a sequence."""
    rest = [c for c in batch.columns if c not in keys]
    if not rest:
        return batch.distinct()
    row = F.struct(*rest)
    newest = batch.groupBy(*keys).agg((F.max(row) if sequence is None else F.max_by(row, F.struct(sequence, row))).alias("r"))
    return newest.select(*[F.col(c) if c in keys else F.col(f"r.{c}").alias(c) for c in batch.columns])


def append(stored: DataFrame, batch: DataFrame) -> DataFrame:
    return stored.unionByName(batch)


def insert_ignore(stored: DataFrame, batch: DataFrame, keys: list[str], sequence: str | None = None) -> DataFrame:
    """stored plus the rows of batch whose key it lacks; stored rows never change."""
    new = last_of_each(batch, keys, sequence).join(stored.select(*keys), keys, "left_anti")
    return stored.unionByName(new.select(stored.columns))


def upsert(stored: DataFrame, batch: DataFrame, keys: list[str], update: list[str], sequence: str | None = None, fill: list[str] = ()) -> DataFrame:
    """stored with the rows of batch: a known key takes the `update` columns and keeps the others; a new key is inserted whole.

    fill: columns taken only where the stored value is null or blank.
    """
    new = last_of_each(batch, keys, sequence)
    s, b = stored.select(F.struct(*stored.columns).alias("s"), *keys), new.select(F.struct(*new.columns).alias("b"), *keys)
    both = s.join(b, keys, "full_outer")
    known, coming = F.col("s").isNotNull(), F.col("b").isNotNull()

    def value(c: str) -> Column:
        if c in keys:
            return F.col(c)
        if c not in new.columns:
            return F.col(f"s.{c}")
        old, inc = F.col(f"s.{c}"), F.col(f"b.{c}")
        if c in update:
            return F.when(coming, inc).otherwise(old)
        if c in fill:
            return F.when(known, F.coalesce(F.nullif(old, F.lit("")), F.nullif(inc, F.lit("")), old)).otherwise(inc)
        return F.when(known, old).otherwise(inc)

    return both.select(*[value(c).alias(c) for c in stored.columns])


def conditional_update(stored: DataFrame, condition: Column, values: dict[str, Column]) -> DataFrame:
    """stored with new values where the condition holds."""
    return stored.select(*[F.when(condition, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in stored.columns])


def touch(stored: DataFrame, key: str, seen: DataFrame, column: str, value: Column) -> DataFrame:
    """stored with a column set in the rows whose key is seen."""
    marked = stored.join(seen.select(key).distinct().withColumn("touched", F.lit(True)), key, "left")
    return conditional_update(marked, F.coalesce("touched", F.lit(False)), {column: value}).select(stored.columns)


def diff_update(stored: DataFrame, values: dict[str, Column]) -> DataFrame:
    """The rows that new values would change, with these: what a batched rewrite has to write (or a dry run to count)."""
    named = stored.select("*", *[v.alias(f"new_{c}") for c, v in values.items()])
    changed = None
    for c in values:
        differs = ~F.col(c).eqNullSafe(F.col(f"new_{c}"))
        changed = differs if changed is None else changed | differs
    return named.where(changed).select(*[F.col(f"new_{c}").alias(c) if c in values else F.col(c) for c in stored.columns])


def get_or_create(stored: DataFrame, wanted: DataFrame, keys: list[str], usable: Column | None = None) -> DataFrame:
    """A dimension (id, keys) with the wanted keys added under new ids after the largest, in the order of the keys."""
    new = (wanted.where(usable) if usable is not None else wanted).select(*keys).distinct().join(stored.select(*keys), keys, "left_anti")
    last = stored.agg(F.coalesce(F.max("id"), F.lit(0)).cast("long").alias("last"))  # one row
    added = numbered(new, keys).crossJoin(F.broadcast(last))
    return stored.select("id", *keys).union(added.select((F.col("last") + F.col("n")).alias("id"), *keys))


def keywords_added(stored: DataFrame, names: DataFrame) -> DataFrame:
    """The keyword dimension (id, name) with names (name) added, stripped and lower-cased; blank ones and those known make no row."""
    clean = names.select(F.lower(F.trim(F.regexp_replace("name", r"^\s+|\s+$", ""))).alias("name"))
    return get_or_create(stored, clean, ["name"], usable=F.col("name") != "")


def required(stored: DataFrame, columns: dict[str, str], *, relax: bool = False) -> DataFrame:
    """stored with columns that may not be null holding a default instead; with relax they may be null again, and the defaults become nulls."""
    change = (lambda c, v: F.nullif(F.col(c), F.lit(v))) if relax else (lambda c, v: F.coalesce(F.col(c), F.lit(v)))
    return stored.select(*[change(c, columns[c]).alias(c) if c in columns else F.col(c) for c in stored.columns])


def snapshot(tables: dict[str, DataFrame], folder: str) -> dict[str, int]:
    """Write each table as Parquet into its own folder below a new one; rows by name. An existing snapshot is never overwritten."""
    out = {}
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{folder}/{name}")
        out[name] = df.sparkSession.read.parquet(f"{folder}/{name}").count()
    return out


def sight(sightings: DataFrame, ads: DataFrame, day: Column) -> DataFrame:
    """sightings (ad_id, seen_on) with each of ads (ad_id) on the day; an ad is seen once a day however often it is written."""
    return sightings.union(ads.select("ad_id", day.alias("seen_on"))).dropDuplicates(["ad_id", "seen_on"])


def new_rows(batch: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of batch whose key isn't stored; duplicates and order columns stay."""
    return batch.join(stored.select(*keys), keys, "left_anti")


def new_slots(batch: DataFrame, stored: DataFrame) -> DataFrame:
    """Programmes of batch without a stored one of the same title and channel on the same calendar day."""
    day = lambda d: d.select("title", "channel", F.to_date("start_time").alias("day"))
    return batch.withColumn("day", F.to_date("start_time")).join(day(stored), ["title", "channel", "day"], "left_anti").select(batch.columns)


def without_parent(rows: DataFrame, foreign_key: str, parents: DataFrame, *, cascade: bool) -> DataFrame:
    """rows after their parents (id) were deleted elsewhere: dangling rows go (cascade) or lose the key."""
    ids = parents.select(F.col("id").alias("parent_key"))
    if cascade:
        return rows.join(ids, F.col(foreign_key) == F.col("parent_key"), "left_semi")
    return rows.join(ids, F.col(foreign_key) == F.col("parent_key"), "left").withColumn(foreign_key, F.col("parent_key")).select(rows.columns)


# One-shot rewrites of stored tables.

SHARED = ("id", "ad_id", "region_id", "total_price")


def split_by_deal(legacy: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rent, sale) of the old table of both (deal_type, alt_price): a rent's alternative price is its monthly one."""
    rent = legacy.where("deal_type = 'RENT'").select(*SHARED, F.col("alt_price").alias("monthly_price"))
    return rent, legacy.where("deal_type = 'SELL'").select(*SHARED)


def joined_deals(rent: DataFrame, sale: DataFrame) -> DataFrame:
    """The old table again; a sale's alternative price is 0."""
    left = rent.select(*SHARED, F.lit("RENT").alias("deal_type"), F.col("monthly_price").alias("alt_price"))
    return left.unionByName(sale.select(*SHARED, F.lit("SELL").alias("deal_type"), F.lit(0.0).alias("alt_price")))


def hide_before(ads: DataFrame, day: str, hidden: bool = True) -> DataFrame:
    """ads first seen before a day hidden (or shown again, whatever hid them)."""
    return conditional_update(ads, F.col("first_seen") < F.lit(day).cast("date"), {"is_hidden": F.lit(hidden)})
