"""Pages by a sparse index against sorting and skipping; trigram search against looking at every text."""

import random

import pytest
from pyspark.sql import functions as F

from listlight.functions import classify
from listlight.operators import grams, pages, search, stored


@pytest.mark.parametrize("n, range_rows", [(0, 10), (1, 10), (50, 7), (1003, 40)])
def test_every_page_is_the_one_that_sorting_gives(spark, n, range_rows):
    rng = random.Random(n)
    rows = [(k, rng.choice([None, *range(5)]), "x" * (k % 3)) for k in range(n)]
    df = spark.createDataFrame(rows, "id long, place int, page string").repartition(4)
    order = [F.desc_nulls_first("place"), F.asc("id")]
    index = pages.build(df, order, range_rows=range_rows)
    every = sorted(rows, key=lambda r: (r[1] is not None, -(r[1] or 0), r[0]))
    for asked in {1, 2, "3", n // 50 + 1, 999, 0, "x", None, -1}:
        at = (search.page_number(asked, n, 50) - 1) * 50
        got = pages.page(index, asked, 50)
        assert got.columns == df.columns and [tuple(r) for r in got.collect()] == every[at : at + 50], asked
    index.drop()


def test_a_late_page_reads_no_more_than_the_first(spark):
    n = 60_000
    index = pages.build(spark.range(n).repartition(6), [F.desc("id")], range_rows=1000)
    read = {}
    for k in (1, 2, 601, 1199, 1200):
        page = pages.page(index, k, 50)
        plan = page._jdf.queryExecution()
        assert [r["id"] for r in page.collect()] == list(range(n - 1 - (k - 1) * 50, max(n - 1 - k * 50, -1), -1))
        scan = plan.executedPlan().toString()
        assert "PartitionFilters: [" in scan and "PartitionFilters: []" not in scan and "page_place" in scan.split("PushedFilters")[1]
        hit = index.starts.where(f"start < {k * 50} and start + size > {(k - 1) * 50}").agg(F.sum("size")).first()[0]
        read[k] = hit
    assert all(rows <= 4 * 1000 for rows in read.values())  # a range or two, whichever page
    index.drop()
    stored.close(spark)


ROWS = [(1, "Build it", "one 1"), (2, "BUILDING", None), (3, None, "rebuild\n1"), (4, "bui", "ld 1"), (5, "ab", "1"), (6, "строить Дом", "x"), (7, "", ""), (8, "😀😀😀 smile", "1"), (9, "b uild", "1 build")]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(ROWS, "id long, a string, b string")


@pytest.mark.parametrize("words", ["build 1", "BUILD", "1", "", "дом", "ild 1 re", "nothing", "😀😀😀", "smile 1", "bui ld", "строить"])
def test_search_finds_what_a_full_look_finds(spark, table, words):
    found = grams.index(table, "id", ["a", "b"], buckets=3)
    got = sorted(r["id"] for r in grams.search(table, found, words, ["a", "b"]).collect())
    assert got == sorted(r["id"] for r in search.admin_search(table, words, ["a", "b"]).collect())
    found.drop()


def test_few_texts_are_looked_at(spark):
    rng = random.Random(4)
    rows = [(k, " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(4))) for k in range(3000)]
    df = spark.createDataFrame(rows, "id long, t string")
    found = grams.index(df, "id", ["t"])
    word = rows[77][1].split()[2]
    keys = {r["key"] for r in grams.candidates(found, word).collect()}
    exact = {k for k, t in rows if word in t}
    assert exact <= keys and len(keys) < 30  # of 3,000
    assert grams.candidates(found, "ab") is None and grams.candidates(found, "zzz").count() == 0


def test_keywords_anywhere_in_texts(spark, table):
    names = spark.createDataFrame([("build",), ("1",), ("Дом",), ("ld 1",), ("uil",), ("zzz",), ("ab1",), (None,)], "name string")
    docs = table.withColumn("joined", F.concat(F.coalesce("a", F.lit("")), F.coalesce("b", F.lit(""))))
    found = grams.index(docs, "id", ["joined"])
    got = sorted((r["id"], r["name"]) for r in grams.tagged_by_substring(docs, found, names, "joined").collect())
    assert got == sorted((r["id"], r["name"]) for r in classify.tagged_by_substring(table, names, "a", "b").collect())
    assert (5, "ab1") in got
    with pytest.raises(ValueError):
        grams.tagged_by_substring(docs, found, names, "joined", most=3)
    empty = grams.index(docs.limit(0), "id", ["joined"])
    assert grams.tagged_by_substring(docs.limit(0), empty, names, "joined").count() == 0
    stored.close(spark)
