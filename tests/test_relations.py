"""Regions, statistics, search, writes and themes on small tables, and properties that must hold."""

import datetime as dt
import uuid

import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from listlight.operators import ingest, regions, search, stats, stored, themes, upsert
from listlight.sources import scorer
from listlight.sources.tables import SCHEMAS, all_rows, visible

TREE = [(1, None), (2, 1), (3, 2), (4, 1), (9, None)]


@pytest.fixture(scope="module")
def tree(spark):
    return spark.createDataFrame(TREE, "id long, parent_id long")


def test_closure_reaches_any_depth(tree):
    got = {tuple(r) for r in regions.closure(tree).collect()}
    assert got == {(1, 1), (1, 2), (1, 3), (1, 4), (2, 2), (2, 3), (3, 3), (4, 4), (9, 9)}


def test_region_stats_keep_zeroes(spark, tree):
    day = dt.datetime(2026, 1, 5)
    ads = spark.createDataFrame([(1, 2, 10.0, 4.0, day), (2, 3, 30.0, 6.0, day), (3, 4, 50.0, 8.0, dt.datetime(2025, 1, 1))], "id long, region_id long, size double, price double, first_seen timestamp")
    seen = spark.createDataFrame([(1, dt.date(2026, 1, 5)), (1, dt.date(2026, 1, 6))], "ad_id long, seen_on date")
    out = stats.region_stats(ads, seen, regions.closure(tree), tree, price="price", date_from="2026-01-01", date_to="2026-01-31")
    got = {r["root_id"]: tuple(r)[1:] for r in out.collect()}
    assert got[1] == got[2] == (2, 5.0, 20.0, 1.0) and got[3] == (1, 6.0, 30.0, 0.0) and got[9] == got[4] == (0, None, None, None)
    children = sum(got[k][0] for k in (2, 4))
    assert got[1][0] == children + ads.where("region_id = 1").count()


def test_broadcast_only_small(spark):
    assert "broadcast" in regions.small(spark.range(5), 5)._jdf.queryExecution().logical().toString().lower()
    assert "broadcast" not in regions.small(spark.range(6), 5)._jdf.queryExecution().logical().toString().lower()


def test_visibility(spark):
    ads = spark.createDataFrame([(1, False, False), (2, True, False), (3, False, True)], "id int, is_hidden boolean, is_sale_misclassified boolean")
    assert [r["id"] for r in visible(ads).collect()] == [1] and all_rows(ads).count() == 3
    assert visible(ads.drop("is_sale_misclassified")).count() == 2


def test_schemas_declare_the_tables():
    assert {"flat_rent", "house_sale", "sighting", "vacancy", "page_analysis", "program"} <= set(SCHEMAS)
    assert SCHEMAS["flat_rent"]["monthly_price"].dataType.simpleString() == "double"


@pytest.mark.parametrize("rows, asked, page", [(0, 1, 1), (1, 0, 1), (50, "x", 1), (51, 2, 2), (51, 99, 2), (51, None, 1), (101, "-1", 3)])
def test_page_numbers(rows, asked, page):
    assert search.page_number(asked, rows, 50) == page


def test_ratings_compare_as_text_and_nulls_stay(spark):
    day = dt.datetime(2026, 1, 5)
    rows = spark.createDataFrame([(1, "R", "10.0", day, 1), (2, "PG", "7.5", day, 1), (3, None, "8", day, 1), (4, None, None, day, 1), (5, "R", "9", day, 1)], "id long, pg_rating string, imdb_rating string, start_time timestamp, channel_id long")
    channels = spark.createDataFrame([(1, "a")], "id long, name string")
    ids = lambda **k: [r["id"] for r in search.programmes(rows, channels, date_from="2026-01-05", date_to="2026-01-05", **k).collect()]
    assert ids() == [2, 3, 4] and ids(min_rating="7.5") == [2, 3] and ids(not_rating="", min_rating="7.5") == [2, 3, 5]
    assert ids(not_rating="", min_rating="7.5", numeric=True) == [1, 2, 3, 5]


def test_excluded_tags_win(spark):
    rows = spark.createDataFrame([(1,), (2,), (3,)], "id int")
    tags = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (2, "x"), (3, "c")], "id int, tag string")
    found = lambda **k: sorted(r["id"] for r in search.tag_search(rows, "id", tags, **k).collect())
    assert found(include=["a", "b"]) == [1, 2] and found(include=["a", "b"], exclude=["x"]) == [1] and found() == [1, 2, 3]
    assert sorted(found(include=["a"]) + [r["id"] for r in rows.join(tags.where("tag = 'a'"), "id", "left_anti").collect()]) == [1, 2, 3]


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 6), st.integers(0, 9)), max_size=8), st.lists(st.tuples(st.integers(0, 6), st.integers(0, 9), st.integers(0, 9)), max_size=8))
def test_writes_are_idempotent(spark, stored, batch):
    stored = dict(stored)
    s = spark.createDataFrame(list(stored.items()), "k int, v int")
    b = spark.createDataFrame([(k, v, n) for n, (k, v, _) in enumerate(batch)], "k int, v int, seq int")
    last = {k: v for k, v, _ in batch}
    once = upsert.upsert(s, b, ["k"], ["v"], sequence="seq")
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(once) == sorted((stored | last).items()) == rows(upsert.upsert(once, b, ["k"], ["v"], sequence="seq"))
    kept = upsert.insert_ignore(s, b, ["k"], sequence="seq")
    assert rows(kept) == sorted((last | stored).items()) == rows(upsert.insert_ignore(kept, b, ["k"], sequence="seq"))
    new, old = upsert.new_rows(b, s, ["k"]).count(), b.join(s, "k", "left_semi").count()
    assert new + old == b.count()


def test_sightings_once_a_day(spark):
    seen = spark.createDataFrame([(1, dt.date(2026, 1, 1))], "ad_id long, seen_on date")
    ads = spark.createDataFrame([(1,), (2,), (2,)], "ad_id long")
    day = F.lit("2026-01-01").cast("date")
    assert upsert.sight(upsert.sight(seen, ads, day), ads, day).count() == 2


def test_upsert_keeps_unlisted_columns_and_fills_blanks(spark):
    s = spark.createDataFrame([(1, 10.0, 2, ""), (2, 20.0, 3, "A")], "id int, price double, rooms int, title string")
    b = spark.createDataFrame([(1, 11.0, 9, "B"), (2, 21.0, 9, "B"), (3, 31.0, 9, "C")], "id int, price double, rooms int, title string")
    got = sorted(tuple(r) for r in upsert.upsert(s, b, ["id"], ["price"], fill=["title"]).collect())
    assert got == [(1, 11.0, 2, "B"), (2, 21.0, 3, "A"), (3, 31.0, 9, "C")]


def test_kid_friendly(spark):
    names = spark.createDataFrame([(1, "kid_unfriendly", 1), (2, "violence", 2)], "id long, name string, analysis_order int")
    rows = [(1, 1, 1, False, "expensive"), (2, 1, 2, False, "expensive"), (3, 2, 1, False, "expensive"), (4, 2, 2, False, "cheap"), (5, 3, 1, False, "expensive"), (6, 3, 2, False, "expensive"), (7, 4, 1, True, "cheap"), (8, 5, 2, True, "cheap")]
    analyses = spark.createDataFrame(rows, "id long, page_id long, theme_id long, theme_match boolean, model_tier string")
    reviews = spark.createDataFrame([(6, False), (7, False), (8, False), (1, True)], "page_analysis_id long, analysis_approved boolean")
    pages = spark.createDataFrame([(k,) for k in range(1, 7)], "id long")
    # 1: all clear; 2: one only cheap; 3: a rejected review; 4: the match of kid_unfriendly rejected; 5: another theme's; 6: none
    assert sorted(r["id"] for r in themes.kid_friendly(pages, analyses, reviews, names).collect()) == [1, 4]


def test_resume_point(spark):
    r = spark.createDataFrame([(1, True), (2, True), (3, False), (4, True)], "id long, scrape_enabled boolean")
    at = lambda x: sorted(y["id"] for y in regions.resumed(r, spark.createDataFrame([(x,)], "region_id long")).collect())
    assert at(2) == [2, 4] and at(3) == [] and at(None) == [1, 2, 4]


def test_closure_of_a_deep_chain_and_of_a_cycle(spark):
    deep = spark.createDataFrame([(k, k - 1 if k else None) for k in range(1000)] + [(5000, 9999)], "id long, parent_id long")
    got = regions.closure(deep)
    assert got.count() == 1000 * 1001 // 2 + 1 and got.where("root_id = 0").count() == 1000 and got.distinct().count() == got.count()
    with pytest.raises(ValueError, match="cycle"):
        regions.closure(spark.createDataFrame([(1, 3), (2, 1), (3, 2), (4, 1)], "id long, parent_id long"))
    assert regions.closure(deep.limit(0)).count() == 0


def test_numbering_and_determinism(spark):
    rows = spark.createDataFrame([(f"k{k % 700:03}", k) for k in range(1400)], "name string, v long").repartition(7)
    got = stored.numbered(rows, ["name", "v"]).orderBy("n").collect()
    assert [(r["name"], r["v"]) for r in got] == sorted((r["name"], r["v"]) for r in got) and [r["n"] for r in got] == list(range(1, 1401))
    assert {r["v"] for r in upsert.last_of_each(rows, ["name"], None).collect()} == set(range(700, 1400))
    tie = spark.createDataFrame([(1, "a", 5), (1, "b", 5)], "id long, x string, s long")
    assert upsert.last_of_each(tie, ["id"], "s").collect()[0]["x"] == "b"
    stored_keys = spark.createDataFrame([(7, "k001")], "id long, name string")
    new = upsert.get_or_create(stored_keys, rows, ["name"]).orderBy("id").collect()
    assert [r["name"] for r in new] == ["k001", *(f"k{k:03}" for k in range(700) if k != 1)] and [r["id"] for r in new] == [7, *range(8, 707)]


def test_cascade_asks_the_cheap_scorer_once(spark, tmp_path):
    pages = spark.createDataFrame([(1, "bad", True), (2, "fine", None), (3, "bad", False)], "id long, text string, cheap boolean")
    kinds = spark.createDataFrame([("b", 2), ("a", 1)], "name string, analysis_order int")

    def asked(name):
        def score(batch):
            for t in batch["text"]:
                (tmp_path / f"{name}-{uuid.uuid4().hex}").write_text(t)
            return pd.DataFrame({"theme_match": [t == "bad" for t in batch["text"]], "confidence_score": [0.5] * len(batch)})

        return lambda rows: scorer.scored(rows, score)

    out = themes.cascade(pages, kinds, asked("cheap"), asked("high"), cheap_tier=F.col("cheap")).collect()
    assert sorted((r["page_id"], r["theme"], r["theme_match"], r["model_tier"]) for r in out) == [(1, "a", True, "cheap"), (2, "a", False, "cheap"), (2, "a", False, "expensive"), (2, "b", False, "expensive"), (3, "a", True, "expensive")]
    assert len(list(tmp_path.glob("cheap-*"))) == 2


def test_snapshots_are_never_overwritten(spark, tmp_path):
    df = spark.range(3)
    assert upsert.snapshot({"a": df}, str(tmp_path / "s")) == {"a": 3}
    with pytest.raises(Exception, match="(?i)exist"):
        upsert.snapshot({"a": df}, str(tmp_path / "s"))


def test_one_first_and_exists(spark):
    df = spark.createDataFrame([(3, "c"), (1, "a")], "id int, v string")
    assert [tuple(r) for r in search.one(df, F.col("id") == 3).collect()] == [(3, "c")]
    with pytest.raises(search.NotFound):
        search.one(df, F.col("id") == 9)
    assert search.first(df.orderBy("id")).collect()[0]["v"] == "a" and search.first(df.limit(0)).count() == 0
    assert search.exists(df) and search.exists(df, F.col("v") == "a") and not search.exists(df, F.col("v") == "x") and not search.exists(df.limit(0))


def test_ingestion_in_stages(spark):
    """Stored listings stay as they are, others are completed once; what can't be completed or is no good is excluded; all found and stored are seen."""
    pages = spark.createDataFrame([("a:1,b:2",), ("b:2,c:3",), ("d:4,e:5,f:0",)], "html string")
    stored = spark.createDataFrame([("b", 20.0, "old"), ("z", 1.0, "old")], "ad_id string, price double, comment string")
    details = spark.createDataFrame([("a", "nice"), ("c", "fine"), ("f", "free")], "ad_id string, comment string")
    entry = F.explode(F.split("html", ","))
    run = ingest.Ingestion(
        ["ad_id"],
        parse=lambda p: p.select(entry.alias("x")).select(F.split("x", ":")[0].alias("ad_id"), F.split("x", ":")[1].cast("double").alias("price")),
        complete=lambda rows: rows.join(details, "ad_id"),
        valid=F.col("price") > 0,
        finish=lambda rows: rows.withColumn("comment", F.upper("comment")),
    ).run(pages, stored)
    assert sorted(map(tuple, run.stored.collect())) == [("a", 1.0, "NICE"), ("b", 20.0, "old"), ("c", 3.0, "FINE"), ("z", 1.0, "old")]
    assert {r["ad_id"] for r in run.new.collect()} == {"a", "c"} and {r["ad_id"] for r in run.excluded.collect()} == {"d", "e", "f"}
    assert sorted(r["ad_id"] for r in run.seen.collect()) == ["a", "b", "c"]
    run.drop()
    nothing = ingest.Ingestion(["ad_id"], parse=lambda p: p.select(F.col("html").alias("ad_id"), F.lit(1.0).alias("price"), F.lit("").alias("comment"))).run(pages.limit(0), stored)
    assert nothing.stored.count() == 2 and nothing.new.count() == nothing.seen.count() == 0
