"""Tables in the folder that driver and executors share, by the module that the rest of the library uses; joins and batches of the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.batches import BATCH_BYTES, BATCH_ROWS, in_batches  # noqa: F401  (used from here too)
from ..operators.stored import drop, kept, read, shared_dir, write, written  # noqa: F401  (used from here too)


def written_apart(df: DataFrame, name: str, by: str, values: list, codec: str | None = None) -> list[DataFrame]:
    """As written: a table for each of the values that the column `by` has, without that column."""
    spark, rest = df.sparkSession, df.drop(by)
    path = write(df, name, codec, by)
    out = []
    for v in values:
        at = f"{path}/{by}={v}"
        rest.limit(0).write.mode("append").parquet(at)  # a value without rows is an empty table
        kept(spark, at)
        out.append(read(spark, at, rest.schema))
    return out


def join_spread(rows: DataFrame, table: DataFrame, keys: list[str], hot: Column, spread: Column) -> DataFrame:
    """rows left-joined with table, which has a row for each key, without a hot key landing in one task.

    Rows whose key is hot, which must hold for few rows of table, find theirs by a broadcast; in the shuffle that
    serves the others they are dealt out by the long `spread` instead of the first key.
    """
    found = F.struct(*[c for c in table.columns if c not in keys])
    joined = rows.join(F.broadcast(table.where(hot).select(*keys, found.alias("by_broadcast"))), keys, "left")
    moved = joined.withColumn("own_key", F.col(keys[0])).withColumn(keys[0], F.when(F.col("by_broadcast").isNull(), F.col(keys[0])).otherwise(spread))
    out = moved.join(table.where(~hot).select(*keys, found.alias("by_shuffle")), keys, "left").withColumn("found", F.coalesce("by_broadcast", "by_shuffle"))
    return out.select(F.col("own_key").alias(keys[0]), *[c for c in rows.columns if c != keys[0]], "found.*")
