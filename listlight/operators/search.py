"""Filtered lists, facets, search and paging."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class AdFilter:
    """Optional conditions; None or a blank string leaves one out."""

    district: str | None = None
    rooms: str | int | None = None
    price_min: str | float | None = None
    price_max: str | float | None = None

    def conditions(self, price: str) -> list[Column]:
        given = lambda v: v is not None and str(v).strip() != ""
        out = []
        if given(self.district):
            out.append(F.col("district") == self.district)
        if given(self.rooms):
            out.append(F.col("rooms") == int(self.rooms))
        if given(self.price_min):
            out.append(F.col(price) >= float(self.price_min))
        if given(self.price_max):
            out.append(F.col(price) <= float(self.price_max))
        return out


def filtered_ads(ads: DataFrame, wanted: AdFilter, *, price: str) -> DataFrame:
    """Ads that meet all conditions, by post_date, latest first, those without one at the top, ties by id."""
    out = reduce(DataFrame.where, wanted.conditions(price), ads)
    return out.orderBy(F.desc_nulls_first("post_date"), "id")


def page_number(asked: str | int | None, rows: int, per_page: int) -> int:
    """A page that exists: the first for what is no number, the last beyond the end (and for numbers below 1)."""
    last = max(1, -(-rows // per_page))
    try:
        page = int(asked)
    except (TypeError, ValueError):
        return 1
    return page if 1 <= page <= last else last


def paged(ordered: DataFrame, asked: str | int | None = 1, per_page: int = 50, rows: int | None = None) -> DataFrame:
    """One page of an ordered table. rows: its size, counted if not given and needed."""
    page = 1 if str(asked) == "1" else page_number(asked, ordered.count() if rows is None else rows, per_page)
    return ordered.offset((page - 1) * per_page).limit(per_page)


def page_window(rows: Column, page: Column, per_page: int, reach: int = 2) -> list[Column]:
    """Columns of a pager: number of pages, first and last row shown, first and last page offered."""
    pages = F.greatest(F.ceil(rows / F.lit(per_page)), F.lit(1)).cast("long")
    start = F.when(rows == 0, F.lit(0)).otherwise((page - 1) * per_page + 1).cast("long")
    return [
        pages.alias("num_pages"), start.alias("start_index"), F.least(page * per_page, rows).cast("long").alias("end_index"),
        F.greatest(page - reach, F.lit(1)).cast("long").alias("first_page"), F.least(page + reach, pages).cast("long").alias("last_page"),
    ]


class NotFound(LookupError):
    """No row where one was asked for."""


def one(df: DataFrame, condition: Column) -> DataFrame:
    """The row for which a condition on a unique key holds; NotFound if there is none. At most one row is looked for."""
    found = df.where(condition).limit(1)
    if found.isEmpty():
        raise NotFound("no such row")
    return found


def first(ordered: DataFrame) -> DataFrame:
    """The first row of an ordered table, none if it is empty."""
    return ordered.limit(1)


def exists(df: DataFrame, condition: Column | None = None) -> bool:
    """Whether there is a row (for which a condition holds); reading ends with the first."""
    return not (df if condition is None else df.where(condition)).limit(1).isEmpty()


def facet(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n"))


def admin_search(df: DataFrame, words: str, columns: list[str]) -> DataFrame:
    """Rows in which each word occurs, in whatever case, in one of the columns at least."""
    for word in words.lower().split():
        df = df.where(reduce(lambda a, b: a | b, [F.coalesce(F.lower(F.col(c).cast("string")).contains(word), F.lit(False)) for c in columns]))
    return df


def tag_search(rows: DataFrame, key: str, tags: DataFrame, *, include: list[str] = (), also: list[str] = (), exclude: list[str] = ()) -> DataFrame:
    """rows that have any tag of `include` (and any of `also`) and none of `exclude`; tags: key, tag. Semi and anti joins: no row twice."""
    for names, how in ((include, "left_semi"), (also, "left_semi"), (exclude, "left_anti")):
        if names:
            rows = rows.join(tags.where(F.col("tag").isin(list(names))).select(key), key, how)
    return rows


def vacancies(rows: DataFrame, key: str, tags: DataFrame, *, include: list[str] = (), industries: list[str] = (), exclude: list[str] = (), active_at: Column | None = None) -> DataFrame:
    """Vacancies by tag; active_at: only with a deadline at or after it. Latest deadline first, none last; then last seen, never first."""
    rows = tag_search(rows, key, tags, include=include, also=industries, exclude=exclude)
    if active_at is not None:
        rows = rows.where(F.col("application_deadline") >= active_at)
    return rows.orderBy(F.desc_nulls_last("application_deadline"), F.desc_nulls_first("last_seen"), key)


def programmes(rows: DataFrame, channels: DataFrame, *, date_from: str, date_to: str, rating: str = "", not_rating: str = "R", min_rating: str = "", channel: str = "", not_channel: str = "", numeric: bool = False) -> DataFrame:
    """Programmes of a window with their channel, by channel and start.

    not_rating keeps programmes without a rating; an empty string leaves a condition out. Ratings are text and compare
    as text ('10.0' < '7.5'), unless numeric.
    """
    terms = [F.to_date("start_time").between(F.lit(date_from).cast("date"), F.lit(date_to).cast("date"))]
    if rating:
        terms.append(F.col("pg_rating") == rating)
    if not_rating:
        terms.append(~F.col("pg_rating").eqNullSafe(not_rating))
    if min_rating:
        terms.append(F.col("imdb_rating").try_cast("double") >= float(min_rating) if numeric else F.col("imdb_rating") >= min_rating)
    joined = rows.join(channels.select(F.col("id").alias("channel_id"), F.col("name").alias("channel_name")), "channel_id")
    if channel:
        terms.append(F.col("channel_name") == channel)
    if not_channel:
        terms.append(F.col("channel_name") != not_channel)
    return joined.where(reduce(lambda a, b: a & b, terms)).orderBy("channel_name", "start_time", "id")


def vacancy_keywords(vacancies: DataFrame, links: DataFrame, keywords: DataFrame) -> DataFrame:
    """Vacancies seen before, a row for each keyword, last seen first."""
    out = vacancies.where("last_seen is not null").join(links, F.col("id") == F.col("vacancy_id")).join(keywords.select(F.col("id").alias("keyword_id"), F.col("name").alias("keyword")), "keyword_id")
    return out.orderBy(F.desc("last_seen"), "id", "keyword_id")


def text_order(column: str, collation: str | None = None) -> Column:
    """What to sort texts by: their bytes, or a collation (UNICODE puts a before ā before b before Z)."""
    return F.col(column) if collation is None else F.collate(column, collation)
