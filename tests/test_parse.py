"""Parsers and classifiers on inline rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from listlight.functions import classify, parse


def column(spark, f, values):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, raw string")
    return [r["x"] for r in df.select("k", f(F.col("raw")).alias("x")).orderBy("k").collect()]


@pytest.mark.parametrize(
    "f, cases",
    [
        (parse.price, {"-": 0.0, "": 0.0, "1,200 €": 1200.0, "12 000 €": 0.0, "30 €/day": 900.0, "150 €/week": 600.0, "1,450 €/mon.": 1450.0, "450 €/mēn.": 0.0, "abc": 0.0, "€": 0.0, "buy ": 0.0, "1_000": 1000.0, "1200d": 0.0}),
        (parse.land_area, {"239 m²": 239.0, "0.11 ha.": 1100.0, "0,5 HA": 5000.0, "1200": 1200.0, "1200.5": 1200.0, "1 200 m²": 1200.0, "1,200 m²": 1200.0, "-": None, "": None, "abc": None, "no data": None, "1.234,5 ha": None}),
        (parse.rooms, {"3": 3, "12": 12, " 2": 2, "100": 0, "Citi": 0, "x": 0, "": 0}),
        (parse.floor, {"3/5": 3, "5": 5, "-/9": 0, "2.7/3.9": 2, "": 0}),
        (parse.max_floor, {"3/5": 5, "5": 5, "-/9": 9, "2.7/3.9": 3, "": 0}),
        (parse.size, {"-": 0.0, "": 0.0, "1,200": 1200.0, "62.5": 62.5, "x": 0.0}),
        (parse.house_size, {"120": 120.0, "1,200": 0.0, "": 0.0}),
        (lambda c: F.to_json(parse.street(c)), {k: '{"name":"%s","no":"%s"}' % v for k, v in {"Brivibas 12": ("Brivibas", "12"), "Brivibas 12a": ("Brivibas", "12a"), "Raiņa bulv. 5/7": ("Raiņa bulv.", "5/7"), "12": ("12", ""), "Lielā iela": ("Lielā iela", ""), "A  3": ("A ", "3"), "": ("", "")}.items()}),
        (parse.last_line, {"Kadaga\nKadagas 9": "Kadagas 9", " \n": "", "a\n \n": "a"}),
        (parse.project, {"103.": "Series 103", " New ": "New Construction", "": None, "other": None, "-": "Unknown"}),
        (parse.post_time, {"Date: 31.12.2025 10:00": dt.datetime(2025, 12, 31, 10), "Date: 32.12.2025 10:00": None, "Date: soon": None}),
        (parse.post_day, {"3.11.2025": dt.datetime(2025, 11, 3), "31.2.2025": None, "x": None}),
        (lambda c: parse.slot(F.lit("2026-04-24").cast("date"), c)["duration_minutes"], {"23:30 - 00:15": 45, "10:00 - 10:00": 0, "20:00 - 22:15": 135, "20:00": None, "x - y": None}),
        (lambda c: parse.entity_free(c), {"a&nbsp;b & c&āb;": "ab & c"}),
        (parse.repaired_json, {'```json\n{"a": [1, 2,], }\n```': '{"a": [1, 2]}', '{"a": 1}': '{"a": 1}'}),
        (lambda c: parse.is_direct_child(c, F.lit("/lv/flats")), {"/lv/flats/riga/": True, "/lv/flats/riga?x=1": True, "/lv/flats/riga/centre/": False, "/lv/flats/": False, "/lv/flats/all/": False, "/lv/cars/riga/": False}),
    ],
)
def test_parser(spark, f, cases):
    assert column(spark, f, list(cases)) == list(cases.values())


def test_names_of_links(spark):
    rows = spark.createDataFrame([("Riga, all", "x", "/a/"), ("", " Text ", "/a/"), ("", "", "/a/old-town/"), (",x", "t", "/a/")], "title string, text string, href string")
    assert [r[0] for r in rows.select(parse.link_name(F.col("title"), F.col("text"), F.col("href"))).collect()] == ["Riga", "Text", "Old Town", ""]


def test_disguised_sales(spark):
    rows = [("ok", 50.0, False), ("ok", 50.01, True), ("PĀRDOD dzīvokli", 9.0, True), ("Продаётся", 9.0, True), ("pirkumiem", 9.0, False), (None, None, False)]
    df = spark.createDataFrame(rows, "comment string, price double, expected boolean")
    assert df.where(classify.is_sale_in_disguise(F.col("comment"), F.col("price")) != F.col("expected")).count() == 0


def test_programmes(spark):
    film, other, home = "Kinopolska 1", "news24", "tv1000 east"
    rows = [
        ("Vakara KINOFILMA", "ziņas", other, 20, "movie"), ("Gada hronika", "filma par mežu", film, 200, "not_movie"), ("Stunda", "Saeima balso", film, 99, "not_movie"), ("SeriālS", None, film, 61, "not_movie"),
        ("Upe", "", film, 60, "movie"), ("Upe", "", film, 59, "unknown"), ("Upe", "", film, 45, "unknown"), ("Upe", "", film, 44, "not_movie"), ("Upe", "", film, None, "unknown"),
        ("Ezers", "", other, 80, "movie"), ("Ezers", "", other, 79, "unknown"), ("Ezers", "", other, 45, "unknown"), ("Ezers", "", other, 44, "not_movie"), ("Ezers", "", other, None, "unknown"),
        (None, None, home, 60, "movie"), (None, "", None, 80, "movie"), ("Jūra", "", "TV1000", -1, "not_movie"), ("", "", "my kino channel", 75, "movie"),
    ]
    df = spark.createDataFrame(rows, "title string, about string, channel string, minutes int, expected string")
    got = df.select("expected", classify.programme(F.col("title"), F.col("about"), F.col("channel"), F.col("minutes")).alias("c")).collect()
    assert [r["c"]["content_type"] for r in got] == [r["expected"] for r in got]
    assert got[0]["c"]["confidence"] == 1.0
    assert {"Panorāma", "De Facto"} <= set(classify.EXCLUDED_TITLES) and len(classify.EXCLUDED_TITLES) == 30


def test_keywords_by_token_and_by_pattern_agree(spark):
    docs = spark.createDataFrame([(1, "Über den Fluss, Java-Script c++!"), (2, "javascript überall"), (3, None)], "id int, text string")
    words = spark.createDataFrame([("über",), ("Java",), ("fluss",)], "name string")
    pairs = lambda df: sorted(tuple(r) for r in df.select("id", "name").collect())
    assert pairs(classify.tagged(docs, words, "text")) == pairs(classify.tagged_by_token(docs, "id", words, "text")) == [(1, "Java"), (1, "fluss"), (1, "über")]
    odd = spark.createDataFrame([("c++",)], "name string")
    assert pairs(classify.tagged(docs, odd, "text")) == [(1, "c++")]
    assert pairs(classify.tagged_by_substring(docs, words, "text")) == [(1, "Java"), (1, "fluss"), (1, "über"), (2, "Java"), (2, "über")]
