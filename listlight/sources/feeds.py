"""Feeds and links by column expressions: JSON vacancies, links and page features of HTML, frontiers of days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.stored import drop, written

VACANCIES = (
    "vacancies array<struct<id: bigint, positionTitle: string, positionContent: string, employerName: string, salaryFrom: double, salaryTo: double, "
    "publishDate: string, expirationDate: string, categories: array<string>, keywords: array<string>>>"
)


def vacancies(responses: DataFrame, body: str = "body") -> DataFrame:
    """A row for each vacancy of JSON responses; malformed responses have none."""
    rows = responses.withColumn("v", F.explode(F.from_json(body, VACANCIES)["vacancies"])).select(*[c for c in responses.columns if c != body], "v.*")
    return rows.select(
        *[c for c in responses.columns if c != body], F.col("id").cast("string").alias("vacancy_portal_id"), F.coalesce("positionTitle", F.lit("")).alias("title"),
        F.coalesce("positionContent", F.lit("")).alias("content"), F.coalesce("employerName", F.lit("")).alias("company_name"), F.col("salaryFrom").alias("salary_from"), F.col("salaryTo").alias("salary_to"),
        F.try_to_timestamp("publishDate").alias("first_seen"), F.try_to_timestamp("expirationDate").alias("application_deadline"),
        F.coalesce("categories", F.array().cast("array<string>")).alias("categories"), F.coalesce("keywords", F.array().cast("array<string>")).alias("keywords"),
    )


def named(rows: DataFrame, key: str, names: str, dimension: DataFrame) -> DataFrame:
    """(key, id) for each name of an array column that the dimension (id, name) has, exactly so."""
    return rows.select(key, F.explode(F.array_distinct(names)).alias("name")).join(dimension.select("id", "name"), "name").select(key, "id")


def links(html: Column) -> Column:
    """Array of the addresses of all links."""
    return F.regexp_extract_all(html, F.lit(r'<a [^>]*href="([^"]*)"'), F.lit(1))


def links_under(pages: DataFrame, prefix: str, html: str = "html") -> DataFrame:
    """A row for each link of a page that begins with the prefix."""
    return pages.select(*[c for c in pages.columns if c != html], F.explode(links(F.col(html))).alias("href")).where(F.startswith("href", F.lit(prefix)))


def article_links(pages: DataFrame, html: str = "html") -> DataFrame:
    """Links in second-level headings of article lists, those with a fragment left out."""
    found = F.regexp_extract_all(F.col(html), F.lit(r'(?s)class="h2_wrap"[^>]*>\s*<h2[^>]*>\s*<a [^>]*href="([^"]*)"'), F.lit(1))
    return pages.select(*[c for c in pages.columns if c != html], F.explode(found).alias("href")).where(~F.col("href").contains("#"))


def next_page(html: Column) -> Column:
    """Address of the next page of a listing; null at the end."""
    return F.nullif(F.regexp_extract(html, r'<link [^>]*rel="next"[^>]*href="([^"]*)"', 1), F.lit(""))


def chain(pages: DataFrame, starts: DataFrame, most: int = 20) -> DataFrame:
    """(start, url, n): the pages (url, next_url) that each listing leads through from its first (starts: url), at most `most` of a listing.

    Pages 2^k steps on follow from those 2^(k-1) on, so the rounds are log2(most), however many listings there are.
    An address that isn't among the pages ends a chain; one that leads back goes on until `most`.
    """
    step = pages.groupBy("url").agg(F.min("next_url").alias("next_url"))
    known = step.select(F.col("url").alias("next_url"))
    step = written(step.join(known, "next_url", "left_semi").select(F.col("url").alias("at"), F.col("next_url").alias("to")), "step")
    walk = starts.select("url").distinct().join(pages.select("url").distinct(), "url", "left_semi").select(F.col("url").alias("start"), "url", F.lit(1).alias("n"))
    reach = 1
    while reach < most and not step.isEmpty():
        before, first = (walk, step), reach == 1
        walk = written(walk.union(walk.join(step, F.col("url") == F.col("at")).select("start", F.col("to").alias("url"), F.col("n") + reach)), "walk")
        step = written(step.join(step.select(F.col("at").alias("to"), F.col("to").alias("on")), "to").select("at", F.col("on").alias("to")), "step")
        drop(*before[first:])  # the first walk isn't written
        reach *= 2
    drop(step)
    return walk.where(F.col("n") <= most)


def bare_text(html: Column) -> Column:
    """Text without scripts, styles, tags and the spaces around the pieces."""
    no_code = F.regexp_replace(html, r"(?s)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>", "")
    return F.regexp_replace(F.regexp_replace(no_code, r"<[^>]*>", "\n"), r"\s*\n\s*", "")


def page_features(html: Column) -> list[Column]:
    """title, image_count, video_count, text_length, has_video of an article's HTML."""
    count = lambda pattern: F.size(F.regexp_extract_all(html, F.lit(pattern), F.lit(0)))
    emotions = count(r'<img [^>]*alt="emotion"')
    videos = count(r"<video[ >]") + count(r'<iframe [^>]*src="[^"]*(youtube\.com|vimeo\.com|dailymotion\.com)')
    title = F.regexp_replace(F.regexp_extract(html, r"(?s)<h1[^>]*>(.*?)</h1>", 1), r"<[^>]*>", "")
    text = bare_text(html)
    return [
        F.when(F.trim(title) != "", F.trim(title)).otherwise("No Title Found").alias("title"), (count(r"<img[ >]") - emotions).cast("long").alias("image_count"),
        videos.cast("long").alias("video_count"), F.length(text).cast("long").alias("text_length"), ((videos > 0) | F.lower(text).contains("video")).alias("has_video"),
    ]


def day_frontier(channels: DataFrame, today: str, past: int = 7, future: int = 7) -> DataFrame:
    """(channel, day) for each day from `past` before today to `future` - 1 after it."""
    days = F.sequence(F.date_sub(F.lit(today).cast("date"), past), F.date_add(F.lit(today).cast("date"), future - 1))
    return channels.select(F.col("name").alias("channel"), F.explode(days).alias("day"))
