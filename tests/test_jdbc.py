"""Tables of a relational database: Derby, which comes with Spark, in memory."""

import uuid

import pytest
from pyspark.sql import functions as F

from listlight.sources.tables import jdbc, load
from tests.oracle import SF

DRIVER = "org.apache.derby.jdbc.EmbeddedDriver"


@pytest.fixture(scope="module")
def database(spark):
    url = f"jdbc:derby:memory:t{uuid.uuid4().hex};create=true"
    orders = load(spark, SF, "orders").select("o_orderkey", "o_custkey", "o_totalprice", F.col("o_orderdate").cast("timestamp").alias("o_orderdate"))
    for name, df in (("orders", orders), ("nothing", orders.limit(0))):
        df.write.format("jdbc").options(url=url, dbtable=name, driver=DRIVER).save()
    return url, orders


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("bounds", [{}, {"lower": 10, "upper": 500}])
def test_same_rows_as_parquet_in_ranges(spark, database, bounds):
    url, orders = database
    read = jdbc(spark, url, "orders", "O_ORDERKEY", 5, driver=DRIVER, **bounds)
    assert read.rdd.getNumPartitions() == 5
    assert sorted(map(tuple, read.collect())) == sorted(map(tuple, orders.collect()))
    sizes = read.groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) == 5 and (bounds or max(r["count"] for r in sizes) < orders.count() / 2)


def test_filters_and_columns_go_to_the_database(spark, database):
    url, orders = database
    read = jdbc(spark, url, "orders", "O_ORDERKEY", 3, driver=DRIVER)
    few = read.where((F.col("O_CUSTKEY") < 20) & (F.col("O_TOTALPRICE") > 1000)).select("O_ORDERKEY")
    shown = plan(few)
    assert "PushedFilters: [" in shown and "*LessThan(o_custkey,20)" in shown and "*GreaterThan(o_totalpr" in shown
    assert "ReadSchema: struct<o_orderkey:bigint>" in shown
    expected = orders.where("o_custkey < 20 and o_totalprice > 1000")
    assert sorted(r[0] for r in few.collect()) == sorted(r["o_orderkey"] for r in expected.collect())


def test_empty_tables(spark, database):
    url, orders = database
    read = jdbc(spark, url, "nothing", "O_ORDERKEY", 4, driver=DRIVER)
    assert read.count() == 0 and [c.lower() for c in read.columns] == orders.columns
