"""Pages, the fetching source and the stream."""

import datetime as dt
import io
import urllib.error

import pandas as pd
import pytest

from listlight.sources import config, feeds, http, pages, scorer
from listlight.streaming import sightings

def programme(title, times, about=None, image=None):
    return (
        f'<div class="show-expander-content"><h2 class="tet-font__headline--s">{title}</h2><p class="subtitle">' + "".join(f"<span>{t}</span> " for t in times) + "</p>"
        + (f'<p class="text tet-font__body--s">{about}</p>' if about else "") + (f'<div class="expander-image"><img src="{image}"></div>' if image else "") + "</div>"
    )


LISTING = (
    "<body><div>Today</div>"
    + programme("Ziemas kinofilma", ["23:15 - 01:05", "HD"], "Par sniegu.", "/i/7.png")
    + programme("Nedēļas cikls", ["07:00 - 07:25"], "Otrā daļa.")
    + programme("Bez laika", ["rīt"]) + programme("Bez beigām", ["09:30"]) + '<div class="show-expander-content"><p class="subtitle"><span>01:00 - 02:00</span></p></div>'
    + programme("Garais stāsts", ["12:00 - 13:40"])
)


def test_programme_page(spark):
    page = spark.createDataFrame([(LISTING, "ltv1_hd", dt.date(2026, 4, 24)), (None, "x", None)], "html string, channel string, day date")
    got = {r["title_lv"]: (r["start_time"].strftime("%H:%M"), r["duration_minutes"], r["classification"]["content_type"], r["classification"]["confidence"], r["image_url"], r["description_lv"]) for r in pages.programme_listing(page).collect() if r["title_lv"]}
    assert got == {"Ziemas kinofilma": ("23:15", 110, "movie", 1.0, "/i/7.png", "Par sniegu."), "Nedēļas cikls": ("07:00", 25, "not_movie", 0.95, "", "Otrā daļa."), "Garais stāsts": ("12:00", 100, "movie", 0.8, "", "")}


def test_deep_pages(spark):
    """Tags that are never closed, however many, in every parser of pages."""
    deep = "<table><tr id=r><td>a<td>b<td>c<td>d" + "<b>" * 100_000 + "text</table>" + "</i>" * 50_000
    rows = spark.createDataFrame([(deep, "RENT", "ltv1", dt.date(2026, 4, 24))], "html string, deal_type string, channel string, day date")
    assert "".join(pages.tree(deep).strings()) == "abcdtext"
    for found in (pages.flat_listing(rows, "x"), pages.house_listing(rows, "x"), pages.programme_listing(rows), pages.flat_details(rows), pages.house_details(rows), pages.articles(rows, "http://b")):
        assert found.count() >= 0


def test_config(tmp_path, spark):
    (tmp_path / "c.json").write_text('{"sources": [{"name": "a", "most": 3, "x": 1}, {"name": "b"}]}')
    assert config.load("NAME", environment={}) == {} == config.load("NAME", environment={"NAME": str(tmp_path / "none")})
    found = config.load("NAME", environment={"NAME": str(tmp_path / "c.json")})
    assert found == config.load("NAME", environment={}, default=str(tmp_path / "c.json"))
    assert [tuple(r) for r in config.dimension(spark, found["sources"], "name string, most int").collect()] == [("a", 3), ("b", None)]
    for bad in ("{", "{]"):
        with pytest.raises(ValueError, match="NAME"):
            config.load("NAME", environment={"NAME": bad})
    (tmp_path / "kind.txt").write_text(" ask \n")
    assert config.prompts(str(tmp_path)) == {"kind": "ask"}


def test_attempts_and_blocked_replies():
    naps, calls = [], []

    def ask(theme, text):
        calls.append(text)
        if text == "blocked":
            raise scorer.Blocked
        if text == "down" or calls.count(text) == 1 and text == "late":
            raise TimeoutError
        return text == "bad", 0.7

    batch = pd.DataFrame({"theme": ["t"] * 5, "text": ["bad", "fine", "blocked", "late", "down"]})
    got = scorer.attempted(ask, sleep=naps.append)(batch)
    assert got["theme_match"].tolist() == [True, False, True, False, pd.NA] and got["confidence_score"].tolist() == [0.7, 0.7, 1.0, 0.7, pd.NA]
    assert naps == [1.0, 1.0] and calls.count("down") == 2 and calls.count("blocked") == 1


def test_chains(spark):
    table = [(f"a{k}", f"a{k + 1}") for k in range(1500)] + [("x", "y"), ("y", "x"), ("z", None), ("w", "gone")]
    p = spark.createDataFrame(table, "url string, next_url string")
    starts = spark.createDataFrame([("a0",), ("x",), ("z",), ("w",), ("none",), ("a0",)], "url string")
    got = sorted(tuple(r) for r in feeds.chain(p, starts, 5).collect())
    assert got == sorted([*[("a0", f"a{k}", k + 1) for k in range(5)], ("w", "w", 1), *[("x", "xy"[k % 2], k + 1) for k in range(5)], ("z", "z", 1)])
    assert feeds.chain(p, starts.where("url = 'a0'"), 1200).count() == 1200
    assert feeds.chain(p.limit(0), starts).count() == 0


def test_empty_and_broken_pages(spark):
    rows = spark.createDataFrame([(None, "RENT"), ("", "RENT"), ("<tr id=1><td>", "SELL"), ("no table", "SELL")], "html string, deal_type string")
    assert pages.flat_listing(rows, "x").count() == pages.house_listing(rows, "x").count() == 0
    assert pages.flat_details(rows).count() == pages.house_details(rows).count() == 4
    assert {r["title"] for r in pages.articles(rows, "http://b").collect()} == {"No Title Found"}


def test_json_feed(spark):
    body = '{"vacancies":[{"id":7,"positionTitle":"Dev","keywords":["a","b"],"expirationDate":"2026-01-02T00:00:00"},{"id":8}]}'
    got = feeds.vacancies(spark.createDataFrame([("p", body), ("q", "broken"), ("r", None)], "portal string, body string")).collect()
    assert [(r["portal"], r["vacancy_portal_id"], r["title"], r["keywords"]) for r in got] == [("p", "7", "Dev", ["a", "b"]), ("p", "8", "", [])]
    assert got[0]["application_deadline"] == dt.datetime(2026, 1, 2)


class Answer(io.BytesIO):
    status = 200


def test_retries_and_backs_off():
    naps, left = [], [503, 429]

    def opener(url, timeout):
        if left:
            raise urllib.error.HTTPError(url, left.pop(0), "", None, None)
        return Answer(b"ok")

    assert http.get("http://x", sleep=naps.append, opener=opener) == (200, "ok") and naps == [30.0, 60.0]

    def failing(code):
        def opener(url, timeout):
            raise urllib.error.HTTPError(url, code, "", None, None)

        return opener

    naps.clear()
    assert http.get("http://x", sleep=naps.append, opener=failing(404)) == (404, None) and naps == []
    assert http.get("http://x", sleep=naps.append, opener=failing(500)) == (500, None) and len(naps) == 3


def test_throttle_waits_for_the_rest_of_the_pause():
    now, naps = [0.0], []

    def sleep(s):
        naps.append(s)
        now[0] += s

    t = http.Throttle(1.0, clock=lambda: now[0], sleep=sleep)
    t.wait()
    now[0] += 0.25
    t.wait()
    now[0] += 5
    t.wait()
    assert naps == [0.75]


def test_one_partition_for_each_domain(spark):
    reader = http.PagesReader({"urls": "http://a.invalid/1 http://b.invalid/1 http://a.invalid/2", "retries": "0", "pause": "0"})
    assert [p.urls for p in reader.partitions()] == [["http://a.invalid/1", "http://a.invalid/2"], ["http://b.invalid/1"]]
    spark.dataSource.register(http.Pages)
    rows = spark.read.format("pages").options(urls="http://127.0.0.1:9/x", retries="0", pause="0").load().collect()
    assert [tuple(r) for r in rows] == [("http://127.0.0.1:9/x", None, None)]


@pytest.mark.parametrize("again", [1, 2])
def test_stream_sees_an_ad_once_a_day(spark, tmp_path, again):
    day = dt.datetime(2026, 1, 5, 9)
    spark.createDataFrame([(1, day), (1, day + dt.timedelta(hours=3)), (2, day), (1, day + dt.timedelta(days=1))], "ad_id long, ts timestamp").write.parquet(f"{tmp_path}/in")
    for _ in range(again):
        seen = sightings.daily_sightings(sightings.read(spark, f"{tmp_path}/in", "ad_id long, ts timestamp"))
        sightings.run_once(seen, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    assert sorted((r["ad_id"], r["seen_on"].day) for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [(1, 5), (1, 6), (2, 5)]
