"""Stored tables of which a write rewrites only the partitions that it touches, by day or by a hash of the key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import upsert as rows
from .stored import drop, written

PART = "part"
MOST_PARTS = 100_000  # partitions of a table; more are an error


def bucket(keys: list[str], buckets: int) -> Column:
    """The partition of a row by a hash of its key."""
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _write(df: DataFrame, path: str, mode: str) -> None:
    """Partitions of even size in a few files each; a hot partition is written by several tasks."""
    df.hint("rebalance", PART).write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(PART).parquet(path)


def create(df: DataFrame, path: str, part: Column) -> None:
    """Store df, partitioned by part, which must follow from the key of a row: a whole number, a day, or a text that looks like neither, as Spark reads it back by its look."""
    _write(df.withColumn(PART, part), path, "errorifexists")


def read(spark: SparkSession, path: str, parts: list | None = None) -> DataFrame:
    """The table, or only some of its partitions (a null one too), which is all that is then read."""
    table = spark.read.parquet(path)
    if parts is None:
        return table
    own = F.col(PART).isin([p for p in parts if p is not None])
    return table.where(own | F.col(PART).isNull() if None in parts else own)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def _delete_parts(spark: SparkSession, path: str, parts: list) -> None:
    for p in parts:
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{PART}={'__HIVE_DEFAULT_PARTITION__' if p is None else p}")
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def parts_of(df: DataFrame) -> list:
    """The partitions that rows of df (with part) lie in."""
    found = [r[0] for r in df.select(PART).distinct().limit(MOST_PARTS + 1).collect()]
    if len(found) > MOST_PARTS:
        raise ValueError(f"more than {MOST_PARTS} partitions")
    return found


def rewrite(spark: SparkSession, path: str, parts: list, make: Callable[[DataFrame], DataFrame]) -> None:
    """Replace partitions of a table by what make returns (with part) for their rows; all others keep their files.

    What is new is worked out in full and written aside first: a failure there leaves the table as it was. Then
    Spark's committer swaps the partitions one after the other. Partitions without rows go. One writer at a time.
    """
    if not parts:
        return
    new = written(make(read(spark, path, parts)), "touched")
    left = parts_of(new)
    if not set(left) <= set(parts):
        raise ValueError("rows of partitions that were not to be touched")
    _write(new, path, "overwrite")
    _delete_parts(spark, path, [p for p in parts if p not in left])
    drop(new)
    spark.catalog.refreshByPath(path)


def upsert(spark: SparkSession, path: str, batch: DataFrame, keys: list[str], update: list[str], part: Column, sequence: str | None = None, fill: list[str] = ()) -> list:
    """As upsert.upsert on a stored table; the partitions touched."""
    coming = written(batch.withColumn(PART, part), "coming")
    parts = parts_of(coming)
    rewrite(spark, path, parts, lambda old: rows.upsert(old, coming, keys, update, sequence, fill))
    drop(coming)
    return parts


def insert_ignore(spark: SparkSession, path: str, batch: DataFrame, keys: list[str], part: Column, sequence: str | None = None) -> list:
    """As upsert.insert_ignore on a stored table; only partitions that get new rows are touched."""
    coming = written(batch.withColumn(PART, part), "coming")
    stored = read(spark, path, parts_of(coming))
    new = written(rows.last_of_each(coming, keys, sequence).join(stored.select(*keys), keys, "left_anti").select(stored.columns), "new")
    parts = parts_of(new)
    rewrite(spark, path, parts, lambda old: old.unionByName(new))
    drop(coming, new)
    return parts


def diff_update(spark: SparkSession, path: str, values: dict[str, Column]) -> list:
    """As upsert.diff_update, applied to the stored table: partitions without a changed row are only read."""
    changed = written(rows.diff_update(read(spark, path), values).select(PART), "changed")
    parts = parts_of(changed)
    rewrite(spark, path, parts, lambda old: old.select(*[values[c].alias(c) if c in values else F.col(c) for c in old.columns]))
    drop(changed)
    return parts
