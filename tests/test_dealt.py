"""Parsing of pages: as many tasks as rows call for, few texts of a batch held at once."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from listlight.operators.batches import BATCH_BYTES, TASK_ROWS, dealt
from listlight.plans.registry import QUERIES
from listlight.sources import pages

PARTS = 12 * TASK_ROWS


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    """Many narrow rows in one small file, which readers take for one task."""
    folder = str(tmp_path_factory.mktemp("parts"))
    rows = spark.range(PARTS).select(
        F.col("id").alias("p_partkey"), F.lit("large ring").alias("p_name"), F.concat(F.lit("Brand#"), (F.col("id") % 25).cast("string")).alias("p_brand"),
        F.lit("LARGE").alias("p_type"), (F.col("id") % 50 + 1).cast("int").alias("p_size"), F.lit(900.0).alias("p_retailprice"),
    )
    rows.coalesce(1).write.parquet(f"{folder}/part.parquet")
    assert spark.read.parquet(f"{folder}/part.parquet").rdd.getNumPartitions() == 1
    return folder


@pytest.mark.parametrize("name", ["s05_flat_listing", "s06_house_listing", "s07_flat_details", "s08_house_details", "s12_programme_listing", "s16_articles"])
def test_parsing_is_dealt_to_many_tasks(spark, parts, name):
    assert QUERIES[name](spark, parts).rdd.getNumPartitions() >= 12


def test_dealt_rows_stay_the_same(spark, parts):
    rows = spark.read.parquet(f"{parts}/part.parquet")
    out = dealt(rows, "p_partkey")
    assert sorted(out.toPandas()["p_partkey"]) == list(range(PARTS))
    sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 12 and max(sizes) < 1.2 * TASK_ROWS
    assert dealt(rows.limit(0), "p_partkey").count() == 0


def test_few_pages_are_held_at_once(spark):
    """Pages of a long listing come in batches of a few MB, whatever the session's settings were."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", "10000"), ("spark.sql.execution.arrow.maxBytesPerBatch", "2147483647")):
        spark.conf.set(key, most)
    row = "<tr id=r>" + "<td>1</td>" * 10 + "</tr>"
    listings = spark.range(0, 400, 1, 1).select(F.repeat(F.lit(row), 300).alias("html"), F.lit("RENT").alias("deal_type"))
    assert pages.records(listings, pages.listing_rows(10), pages.ROW).count() == 400 * 300
    batches = listings.mapInArrow(lambda found: (pa.RecordBatch.from_pydict({"bytes": [b.nbytes]}) for b in found), "bytes long").collect()
    assert len(batches) >= 4 and all(b["bytes"] < 2 * BATCH_BYTES for b in batches)
