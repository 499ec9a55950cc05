"""A page index of many ranges in few files."""

import glob
import math

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from listlight.operators import pages, stored


def test_ranges_are_places_in_few_files(spark):
    n = 20_000
    index = pages.build(spark.range(n).repartition(5), [F.desc("id")], range_rows=50, file_rows=5000)
    files = glob.glob(index.folder.removeprefix("file:") + "/*/*.parquet")
    assert len(files) == 4  # 400 before: the driver sampled, listed and committed each range
    ranges = index.starts.orderBy("start").collect()
    assert n // 50 <= len(ranges) <= n // 50 + 4 and [r["start"] for r in ranges][1:] == [r["start"] + r["size"] for r in ranges][:-1]
    assert all(pq.ParquetFile(f).metadata.row_group(0).column(0).has_offset_index for f in files)
    for k in (1, 2, 99, 100, 101, 200, 400):
        assert [r["id"] for r in pages.page(index, k, 50).collect()] == list(range(n - 1 - (k - 1) * 50, n - 1 - k * 50, -1)), k
    for k in (1, 13, 20):  # pages over several ranges, and over two files
        assert [r["id"] for r in pages.page(index, k, 960).collect()] == list(range(n - 1 - (k - 1) * 960, max(n - 1 - k * 960, -1), -1)), k
    index.drop()


def test_order_with_nulls_and_repeated_places(spark):
    n = 3000
    rows = spark.range(n).select("id", F.when(F.col("id") % 3 > 0, F.col("id") % 7).alias("place")).repartition(7)
    index = pages.build(rows, [F.desc_nulls_first("place"), F.asc("id")], range_rows=40, file_rows=300)
    every = sorted(((k, k % 7 if k % 3 else None) for k in range(n)), key=lambda r: (r[1] is not None, -(r[1] or 0), r[0]))
    got = [tuple(r) for k in range(1, math.ceil(n / 700) + 1) for r in pages.page(index, k, 700).collect()]
    assert got == every
    stored.close(spark)
