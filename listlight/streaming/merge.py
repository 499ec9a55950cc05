"""A stream merged into a stored table, each batch exactly once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import partitions
from ..operators.partitions import PART
from ..operators.stored import drop, written

BATCH = "batch"
_HOW = {"min": F.min, "max": F.max, "sum": F.sum}


def _by_key(rows: DataFrame, keys: list[str], how: dict[str, str]) -> DataFrame:
    return rows.groupBy(*keys).agg(*[_HOW[h](c).alias(c) for c, h in how.items()]) if how else rows.select(*keys).distinct()


def merge(batch: DataFrame, batch_id: int, path: str, keys: list[str], how: dict[str, str], buckets: int = 64) -> list[int]:
    """Merge a batch (keys and the columns of how) into the table at path: by key the min, max or sum of each column; the partitions written.

    Partitions are buckets of the key. Each holds, with its rows, the id of the last batch that wrote it, and is replaced as a
    whole: when a batch comes again after a crash, partitions that hold its id already are left alone, so sums count it once too. A
    null value leaves what is stored.
    """
    spark = batch.sparkSession
    coming = written(_by_key(batch, keys, how).withColumn(PART, partitions.bucket(keys, buckets)), "coming")
    if not partitions.exists(spark, path):
        empty = coming.limit(0).select(*keys, *how, F.lit(0).cast("long").alias(BATCH), PART)
        empty.write.partitionBy(PART).parquet(path)
    schema = coming.select(*keys, *how, F.lit(0).cast("long").alias(BATCH), PART).schema
    parts = partitions.parts_of(coming)
    stored = spark.read.schema(schema).parquet(path).where(F.col(PART).isin(parts))
    done = {r[PART] for r in stored.groupBy(PART).agg(F.max(BATCH).alias(BATCH)).where(F.col(BATCH) >= batch_id).collect()}  # a row for each partition
    due = [p for p in parts if p not in done]
    if due:
        both = stored.where(F.col(PART).isin(due)).drop(BATCH).unionByName(coming.where(F.col(PART).isin(due)))
        new = written(_by_key(both, [*keys, PART], how).select(*keys, *how, F.lit(batch_id).cast("long").alias(BATCH), PART), "merged")
        partitions._write(new, path, "overwrite")
        drop(new)
    drop(coming)
    return due


def merged(spark: SparkSession, path: str) -> DataFrame:
    """The table that batches were merged into."""
    return spark.read.parquet(path).drop(BATCH, PART)


def merge_sink(stream: DataFrame, path: str, checkpoint: str, keys: list[str], how: dict[str, str], buckets: int = 64) -> StreamingQuery:
    """Merge what there is and stop: a scheduled run that picks up where the last one ended. The checkpoint belongs to the table: batch ids go on in it."""

    def write(batch: DataFrame, batch_id: int) -> None:
        merge(batch, batch_id, path, keys, how, buckets)

    return stream.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
