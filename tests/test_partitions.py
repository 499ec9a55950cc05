"""Writes that touch only what changes, counts kept beside sightings, and batches merged exactly once."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from listlight.operators import partitions, rollups, stored, upsert
from listlight.streaming import merge

DAY = dt.date(2026, 1, 1)


def files(path) -> dict[str, tuple]:
    out = {}
    for folder, _, names in os.walk(path):
        for n in names:
            if n.endswith(".parquet"):
                at = os.stat(f"{folder}/{n}")
                out[f"{folder.removeprefix(path)}/{n}"] = (at.st_mtime_ns, at.st_size)
    return out


def of_part(listed: dict, parts) -> dict:
    return {f: v for f, v in listed.items() if any(f.startswith(f"/part={p}/") for p in parts)}


@pytest.fixture
def table(spark, tmp_path):
    df = spark.range(400).selectExpr("id", "id * 2 as price", "'old' as comment")
    partitions.create(df, str(tmp_path / "t"), partitions.bucket(["id"], 8))
    return df, str(tmp_path / "t")


def test_upsert_leaves_other_partitions_alone(spark, table):
    df, path = table
    before = files(path)
    batch = spark.createDataFrame([(3, 1, "a", 1), (3, 2, "b", 2), (1001, 5, "new", 1)], "id long, price long, comment string, seq int")
    touched = partitions.upsert(spark, path, batch, ["id"], ["price"], partitions.bucket(["id"], 8), sequence="seq")
    after = files(path)
    assert 1 <= len(touched) <= 2
    others = [p for p in range(8) if p not in touched]
    assert of_part(before, others) == of_part(after, others) and len(of_part(before, others)) >= 6
    assert not set(of_part(before, touched)) & set(of_part(after, touched))
    expected = upsert.upsert(df, batch, ["id"], ["price"], sequence="seq")
    assert sorted(map(tuple, partitions.read(spark, path).drop("part").collect())) == sorted(map(tuple, expected.collect()))


def test_insert_ignore_of_known_rows_writes_nothing(spark, table):
    df, path = table
    before = files(path)
    assert partitions.insert_ignore(spark, path, df.limit(50), ["id"], partitions.bucket(["id"], 8)) == []
    assert files(path) == before
    new = df.limit(3).withColumn("id", F.col("id") + 5000)
    assert 1 <= len(partitions.insert_ignore(spark, path, new.union(new), ["id"], partitions.bucket(["id"], 8))) <= 3
    assert partitions.read(spark, path).count() == 403


def test_diff_update_rewrites_only_partitions_with_changes(spark, table):
    _, path = table
    before = files(path)
    touched = partitions.diff_update(spark, path, {"comment": F.when(F.col("id") == 17, "new").otherwise(F.col("comment"))})
    assert len(touched) == 1 and of_part(files(path), [p for p in range(8) if p not in touched]) == of_part(before, [p for p in range(8) if p not in touched])
    assert [r["id"] for r in partitions.read(spark, path).where("comment = 'new'").collect()] == [17]
    assert partitions.diff_update(spark, path, {"comment": F.col("comment")}) == []


def test_a_failed_write_leaves_the_table_as_it_was(spark, table):
    df, path = table
    before = files(path)
    bad = spark.range(5).select("id", F.raise_error(F.lit("stop")).cast("long").alias("price"), F.lit("x").alias("comment"))
    with pytest.raises(Exception, match="stop"):
        partitions.upsert(spark, path, bad, ["id"], ["price"], partitions.bucket(["id"], 8))
    with pytest.raises(Exception, match="stop"):
        partitions.rewrite(spark, path, [0, 1], lambda old: old.withColumn("price", F.raise_error(F.lit("stop")).cast("long")))
    with pytest.raises(ValueError, match="touched"):
        partitions.rewrite(spark, path, [0], lambda old: old.withColumn("part", F.lit(5)))
    assert files(path) == before and partitions.read(spark, path).count() == 400


def test_only_the_touched_partitions_are_read(spark, table):
    _, path = table
    plan = partitions.read(spark, path, [2, 5])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [part" in plan and len(partitions.read(spark, path, [2, 5]).inputFiles()) >= 8  # listed, not read
    assert partitions.read(spark, path, [2, 5]).select("part").distinct().count() == 2


def test_emptied_and_null_partitions(spark, tmp_path):
    rows = spark.createDataFrame([(1, DAY), (2, None), (3, None)], "id int, seen_on date")
    path = str(tmp_path / "t")
    partitions.create(rows, path, F.col("seen_on"))
    partitions.rewrite(spark, path, [None], lambda old: old.where("id = 2"))
    assert sorted(r["id"] for r in partitions.read(spark, path).collect()) == [1, 2]
    partitions.rewrite(spark, path, [DAY, None], lambda old: old.where("id = 1"))
    assert [r["id"] for r in partitions.read(spark, path).collect()] == [1] and len(files(path)) == 1


def test_rollups_equal_a_recount_after_any_changes(spark, tmp_path):
    rng = random.Random(5)
    row = lambda k: (k, k % 7, DAY + dt.timedelta(days=k * 13 % 70), rng.choice(["flat_rent", "flat_sale", "house_rent", "house_sale"]))
    kind = "id long, ad_id long, seen_on date, kind string"
    frame = lambda rows: spark.createDataFrame(rows, kind)
    known = {r[0]: r for r in map(row, range(300))}
    folder = str(tmp_path / "r")
    rollups.create(frame([*known.values(), *list(known.values())[:20], (999, 1, None, "flat_rent")]), folder)
    for step in range(3):
        add = [row(k) for k in range(300 + 40 * step, 330 + 40 * step)]
        add += [known[k] for k in rng.sample(sorted(known), 5)]  # repeated
        gone = [known[k] for k in rng.sample(sorted(known), 10)]
        if step == 1:
            gone = [r for r in known.values() if r[2] == DAY]  # a whole day
        before = files(f"{folder}/rows")
        days = rollups.change(spark, folder, frame(add + add[:3]), frame(gone).select("id", "seen_on"))
        known |= {r[0]: r for r in add}
        for r in gone:
            known.pop(r[0], None)
        assert set(days) == {r[2] for r in add + gone}
        others = [DAY + dt.timedelta(days=d) for d in range(70) if DAY + dt.timedelta(days=d) not in days]
        assert of_part(before, others) == of_part(files(f"{folder}/rows"), others)
        counts = {}
        for _, _, day, k in known.values():
            counts[day, k] = counts.get((day, k), 0) + 1
        got = {(r["seen_on"], r["kind"]): r["n"] for r in partitions.read(spark, f"{folder}/days").collect()}
        assert got == counts
    report = rollups.daily_report(spark, folder, date_from="2026-01-01", date_to="2026-01-31", direction="asc").collect()
    assert [r["seen_on"] for r in report] == sorted({r[2] for r in known.values() if r[2] <= dt.date(2026, 1, 31)})
    assert all(r["total"] == r["flats"] + r["houses"] == sum(1 for x in known.values() if x[2] == r["seen_on"]) for r in report)


def batch(spark, rows):
    return spark.createDataFrame(rows, "ad_id long, last_seen date, times long")


HOW = {"last_seen": "max", "times": "sum"}


def test_a_batch_that_comes_again_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "m")
    one, two = [(k % 20, DAY, 1) for k in range(60)], [(k % 30, DAY + dt.timedelta(days=1), 1) for k in range(30)]
    assert len(merge.merge(batch(spark, one), 0, path, ["ad_id"], HOW, 4)) == 4
    merge.merge(batch(spark, two), 1, path, ["ad_id"], HOW, 4)
    expected = {k: (DAY + dt.timedelta(days=1), 4 if k < 20 else 1) for k in range(30)}
    read = lambda: {r["ad_id"]: (r["last_seen"], r["times"]) for r in merge.merged(spark, path).collect()}
    assert read() == expected
    before = files(path)
    assert merge.merge(batch(spark, two), 1, path, ["ad_id"], HOW, 4) == [] and merge.merge(batch(spark, one), 0, path, ["ad_id"], HOW, 4) == []
    assert files(path) == before and read() == expected
    assert merge.merge(batch(spark, [(5, None, None)]), 2, path, ["ad_id"], HOW, 4) and read() == expected  # nulls leave what is stored


def test_a_batch_that_broke_off_is_finished_once(spark, tmp_path):
    """Half of the partitions were written when the driver died: its replay writes the others alone."""
    path = str(tmp_path / "m")
    rows = [(k, DAY, 1) for k in range(100)]
    merge.merge(batch(spark, rows), 0, path, ["ad_id"], HOW, 4)
    half = batch(spark, rows).where(partitions.bucket(["ad_id"], 4) < 2)
    merge.merge(half, 1, path, ["ad_id"], HOW, 4)
    assert sorted(merge.merge(batch(spark, rows), 1, path, ["ad_id"], HOW, 4)) == [2, 3]
    assert {r["times"] for r in merge.merged(spark, path).collect()} == {2}


def test_merge_sink_equals_sightings_once_a_day(spark, tmp_path):
    """Keys alone, as in upsert.sight; several files, runs and empty runs."""
    kind = "ad_id long, seen_on date"
    every = []
    for run in range(3):
        if run < 2:
            rows = [(k % 9, DAY + dt.timedelta(days=k % 4 + run)) for k in range(40)]
            every += rows
            spark.createDataFrame(rows, kind).repartition(3).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
        merge.merge_sink(stream, str(tmp_path / "out"), str(tmp_path / "state"), ["ad_id", "seen_on"], {}, 4).awaitTermination()
    got = sorted(map(tuple, merge.merged(spark, str(tmp_path / "out")).collect()))
    assert got == sorted(set(every))
    stored.close(spark)
