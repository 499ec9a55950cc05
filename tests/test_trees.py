"""Interval labels against the closure, on random trees and on chains that a closure couldn't hold."""

import random
import time

import pytest
from pyspark.sql import functions as F

from listlight.operators import labels, regions, stored


def tree(spark, rows):
    return spark.createDataFrame(rows, "id long, parent_id long")


@pytest.mark.parametrize("seed", [1, 2])
def test_labels_say_what_the_closure_says(spark, seed):
    rng = random.Random(seed)
    ids = rng.sample(range(1000), 120)
    rows = [(i, rng.choice([None, *ids[:k]]) if k else None) for k, i in enumerate(ids)] + [(2000, 7777), (None, 3)]  # an unknown parent, a null id
    df = tree(spark, rows)
    got = {r["id"]: r for r in labels.labels(df).collect()}
    pairs = {(a, b) for a in got for b in got if got[a]["first"] <= got[b]["first"] <= got[a]["last"]}
    assert pairs == {tuple(r) for r in regions.closure(df).collect()}
    assert sorted(r["first"] for r in got.values()) == list(range(len(got)))
    parents = dict(rows)
    for i, r in got.items():
        up, depth = parents.get(i), 0
        while up in got:
            up, depth = parents.get(up), depth + 1
        assert r["depth"] == depth


def test_sums_over_trees(spark):
    rng = random.Random(3)
    rows = [(0, None)] + [(k, rng.randrange(k)) for k in range(1, 80)] + [(500, None)]
    df = tree(spark, rows)
    values = spark.createDataFrame([(k, k * k) for k in range(0, 80, 3)], "region_id long, v long")
    labelled = labels.labels(df)
    got = {r["root_id"]: r["v"] for r in labels.over_trees(labelled, values, df, ["v"]).collect()}
    reach = regions.closure(df).join(values, "region_id", "left").groupBy("root_id").agg(F.coalesce(F.sum("v"), F.lit(0)).alias("v"))
    assert got == {r["root_id"]: r["v"] for r in reach.collect()}
    assert {r["region_id"] for r in labels.below(labelled, 5).collect()} == {r["region_id"] for r in regions.closure(df).where("root_id = 5").collect()}


def test_edges(spark):
    assert labels.labels(tree(spark, [])).count() == 0
    assert [tuple(r) for r in labels.labels(tree(spark, [(4, None), (4, None)])).collect()] == [(4, 0, 0, 0)]
    for rows in ([(1, 2), (2, 1)], [(1, 1)], [(1, None), (2, 3), (3, 4), (4, 2)]):
        with pytest.raises(ValueError):
            labels.labels(tree(spark, rows))
    stored.close(spark)


def test_a_chain_of_a_hundred_thousand(spark):
    n = 100_000
    chain = spark.range(n).selectExpr("id", "nullif(id - 1, -1) as parent_id")
    began = time.time()
    got = labels.labels(chain)
    assert got.where(f"depth = id and first = id and last = {n - 1}").count() == n
    ones = spark.range(n).selectExpr("id as region_id", "1L as v")
    sums = labels.over_trees(got, ones, chain, ["v"])
    assert sums.where(f"v = {n} - root_id").count() == n
    assert time.time() - began < 300
    stored.close(spark)


def test_running_sums_over_many_ranges(spark):
    rows = spark.range(1000).selectExpr("id", "(id * 7919) % 13 as v").repartition(7)
    got = {r["id"]: (r["s"], r["n"]) for r in stored.running(rows.withColumn("one", F.lit(1)), ["id"], {"s": "v", "n": "one"}).collect()}
    total = 0
    for k in range(1000):
        total += k * 7919 % 13
        assert got[k] == (total, k + 1)
    assert stored.running(rows.limit(0), ["id"], {"s": "v"}).count() == 0
