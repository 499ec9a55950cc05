"""Medians by bounds from sketches against sorting."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from listlight.operators import medians, stored


@pytest.mark.parametrize("most, sketch", [(10_000, 2000), (50, 200), (4, 8)])
def test_medians_equal_sorting(spark, most, sketch):
    rng = random.Random(most)
    rows = [("a", rng.gauss(0, 1)) for _ in range(1501)] + [("b", rng.randint(0, 3) * 1.0) for _ in range(1000)] + [("c", 5.0)] * 777 + [("d", rng.random() ** 9) for _ in range(2)]
    rows += [("e", 1.0)] * 300 + [("e", 2.0)] * 300 + [(None, float(k)) for k in range(999)] + [("f", None)] * 3 + [("a", None), ("a", float("nan")), ("g", 1e300), ("g", -1e300), ("h", float("inf"))]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    got = {r["k"]: (r["n"], r["median"]) for r in medians.medians(df, ["k"], "v", most=most, sketch=sketch).collect()}
    groups = {}
    for k, v in rows:
        groups.setdefault(k, []).extend([] if v is None or v != v else [v])
    assert got == {k: (len(v), statistics.median(v) if v else None) for k, v in groups.items()}
    stored.close(spark)


def test_ranked_values_are_few(spark, monkeypatch):
    """What is ranked at the end is between the bounds: of 20,000 values of a group at most 100."""
    seen = []
    monkeypatch.setattr(medians, "Window", type("W", (), {"partitionBy": staticmethod(lambda *a: (seen.append(a), __import__("pyspark.sql").sql.Window.partitionBy(*a))[1])}))
    kept = {}
    original = medians.written

    def spy(df, name):
        out = original(df, name)
        if name == "state":
            kept["state"] = [tuple(r) for r in out.select("inside", "n").collect()]
        return out

    monkeypatch.setattr(medians, "written", spy)
    df = spark.range(20_000).selectExpr("id % 2 as k", "double(id * 7919 % 20011) as v")
    got = {r["k"]: r["median"] for r in medians.medians(df, ["k"], "v", most=100, sketch=100).collect()}
    exact = {r["k"]: r["m"] for r in df.groupBy("k").agg(F.median("v").alias("m")).collect()}
    assert got == exact and seen and all(inside <= 100 < n for inside, n in kept["state"])


def test_no_keys_and_no_rows(spark):
    df = spark.createDataFrame([(3.0,), (1.0,), (2.0,)], "v double")
    assert [tuple(r) for r in medians.medians(df.withColumn("k", F.lit(1)), ["k"], "v").collect()] == [(1, 3, 2.0)]
    assert medians.medians(df.withColumn("k", F.lit(1)).limit(0), ["k"], "v").count() == 0
