"""Records from HTML pages: a small tree by the standard parser, read in Arrow batches; everything after it is columns."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import classify, parse
from ..operators.batches import in_batches

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
DEPTH = 500  # elements nested deeper are placed at that depth
ENDS = {"td": ("td", "th"), "th": ("td", "th"), "tr": ("tr",), "li": ("li",), "p": ("p",)}  # an opening tag ends an open one of these


class Element:
    """An element of a page. `every` holds all elements of the page in order, `places` those of each tag: what is below an element are those from its own place to `end`."""

    __slots__ = ("tag", "attributes", "children", "every", "places", "place", "end")

    def __init__(self, tag: str, attributes: dict[str, str], every: list[Element], places: dict[str, list[int]]):
        self.tag, self.attributes, self.children = tag, attributes, []
        self.every, self.places, self.place = every, places, len(every)
        self.end = self.place + 1
        every.append(self)
        places.setdefault(tag, []).append(self.place)

    def walk(self) -> Iterator[Element]:
        """All elements below, in order."""
        return iter(self.every[self.place + 1 : self.end])

    def all(self, tag: str, css: str = "", **attributes: str) -> Iterator[Element]:
        wanted, places = set(css.split()), self.places.get(tag, ())
        for place in places[bisect_right(places, self.place) : bisect_left(places, self.end)]:
            e = self.every[place]
            if (not wanted or wanted <= set(e.attributes.get("class", "").split())) and all(e.attributes.get(k) == v for k, v in attributes.items()):
                yield e

    def first(self, tag: str, css: str = "", **attributes: str) -> Element | None:
        return next(self.all(tag, css, **attributes), None)

    def strings(self, without: tuple[str, ...] = ()) -> Iterator[str]:
        """All text below, in order, without that of some elements."""
        todo = self.children[::-1]
        while todo:
            c = todo.pop()
            if isinstance(c, str):
                yield c
            elif c.tag not in without:
                todo += c.children[::-1]

    def text(self) -> str:
        return "".join(self.strings())

    def own_text(self) -> str:
        return "".join(c for c in self.children if isinstance(c, str)).strip()


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.every, self.places = [], {}
        self.stack = [self._element("document", ())]

    def updatepos(self, i: int, j: int) -> int:
        """Lines aren't counted, as nobody asks for them."""
        return j

    def _element(self, tag: str, attrs) -> Element:
        return Element(tag, {k: v or "" for k, v in attrs}, self.every, self.places)

    def _shut(self, k: int) -> None:
        for e in self.stack[k:]:
            e.end = len(self.every)
        del self.stack[k:]

    def _close(self, tags: tuple[str, ...], within: str | None = None) -> None:
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k].tag in tags:
                self._shut(k)
                return
            if self.stack[k].tag == within:
                return

    def handle_starttag(self, tag, attrs):
        if tag in ENDS:
            self._close(ENDS[tag], "tr" if tag in ("td", "th") else "table" if tag == "tr" else None)
        e = self._element(tag, attrs)
        self.stack[-1].children.append(e)
        if tag not in VOID and len(self.stack) < DEPTH:
            self.stack.append(e)

    def handle_startendtag(self, tag, attrs):
        self.stack[-1].children.append(self._element(tag, attrs))

    def handle_endtag(self, tag):
        self._close((tag,))

    def handle_data(self, data):
        self.stack[-1].children.append(data)


def tree(html: str | None) -> Element:
    b = _Builder()
    b.feed(html or "")
    b.close()
    page = b.stack[0]
    b._shut(0)
    return page


def records(pages: DataFrame, read: Callable[[Element], list[dict]], fields: str, column: str = "html") -> DataFrame:
    """A row with the other columns of pages for each record that read() finds in a page."""
    keep = [c for c in pages.columns if c != column]
    schema = ", ".join([*(f"`{c}` {t}" for c, t in pages.select(*keep).dtypes), fields])
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    found_schema = to_arrow_schema(StructType.fromDDL(fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [read(tree(x.as_py())) for x in batch.column(0)]
            at = pa.array([k for k, f in enumerate(found) for _ in f], pa.int32())
            rows = pa.RecordBatch.from_pylist([r for f in found for r in f], schema=found_schema)
            yield pa.RecordBatch.from_arrays([*(c.take(at) for c in batch.columns[1:]), *rows.columns], [*keep, *rows.schema.names])

    return in_batches(pages.select(column, *keep), run, schema)


def listing_rows(cells: int) -> Callable[[Element], list[dict]]:
    """Table rows with an id and exactly so many cells: their id, first link, cells, and the address cell by lines."""

    def read(page: Element) -> list[dict]:
        out = []
        for row in page.all("tr"):
            own = list(row.all("td"))
            if len(own) == cells and row.attributes.get("id"):
                href = next((a.attributes["href"] for a in row.all("a") if a.attributes.get("href")), "")
                out.append({"row_id": row.attributes["id"], "href": href, "cells": [c.text() for c in own], "address": "\n".join(own[3].strings())})
        return out

    return read


ROW = "row_id string, href string, cells array<string>, address string"


def flat_listing(pages: DataFrame, site: str) -> DataFrame:
    """Flats of listing pages (html, deal_type, ...): rows without rooms, size or price are left out."""
    r = records(pages, listing_rows(10), ROW)
    c = F.col("cells")
    street = parse.street(parse.last_line(F.col("address")))
    total, per_sqm = parse.price(c[9]), parse.price(c[8])
    out = r.select(
        *[x for x in r.columns if x not in ("row_id", "href", "cells", "address")], parse.flat_key(F.col("row_id"), c).alias("ad_id"),
        F.when(F.col("href") != "", F.concat(F.lit(site), "href")).otherwise("").alias("link"), c[2].alias("comment"),
        street["name"].alias("street_name"), street["no"].alias("street_no"), parse.rooms(c[4]).alias("rooms"), parse.size(c[5]).alias("size"),
        parse.floor(c[6]).alias("floor"), parse.max_floor(c[6]).alias("max_floor"), c[7].alias("project_raw"), parse.project(c[7]).alias("project"),
        per_sqm.alias("price_per_sqm"), total.alias("total_price"),
        parse.ten_years(per_sqm, F.col("deal_type")).alias("alt_price_per_sqm"), parse.ten_years(total, F.col("deal_type")).alias("alt_price"),
    )
    return out.where("rooms <> 0 and total_price <> 0 and size <> 0")


def house_listing(pages: DataFrame, site: str) -> DataFrame:
    """Houses of listing pages (html, deal_type, ...): rows without a price are left out."""
    r = records(pages, listing_rows(9), ROW)
    c = F.col("cells")
    street, total, area = parse.street(c[3]), parse.price(c[8]), parse.house_size(c[4])
    out = r.select(
        *[x for x in r.columns if x not in ("row_id", "href", "cells", "address")], parse.house_key(F.col("row_id"), c).alias("ad_id"),
        F.when(F.col("href") != "", F.concat(F.lit(site), "href")).otherwise("").alias("link"), c[2].alias("comment"),
        street["name"].alias("street_name"), street["no"].alias("street_no"), F.lit(0).alias("rooms"), area.alias("size"),
        parse.whole(c[5]).alias("floors"), parse.land_area(c[7]).alias("land_area_sqm"), total.alias("total_price"),
        parse.per_area(total, area).alias("price_per_sqm"), parse.ten_years(total, F.col("deal_type")).alias("alt_price"),
    )
    return out.where("total_price <> 0")


def _options(page: Element) -> dict[str, str]:
    """The first value of each label, in the order of the page."""
    found: dict[str, str] = {}
    for row in page.all("tr"):
        own = [e for e in row.children if isinstance(e, Element)]
        for name, value in zip(own, own[1:]):
            if "ads_opt_name" in name.attributes.get("class", "") and "ads_opt" in value.attributes.get("class", "") and (label := name.text().strip()) not in found:
                found[label] = (value.first("b") or value).own_text()
    return found


def _flat_detail(page: Element) -> list[dict]:
    message, options = page.first("div", id="msg_div_msg"), _options(page)
    footer = next((text for t in page.all("td", "msg_footer") if "Date" in (text := t.text())), "")
    phone = next((e.text().strip() for e in page.all("span") if e.attributes.get("id", "").startswith("phone_td_")), "")
    mail = next((href for a in page.all("a") if "/mail/" in (href := a.attributes.get("href", ""))), "")
    return [
        {
            "comment": "\n".join(s.strip() for s in message.strings(("table", "div")) if s.strip()) if message else "",
            "footer": footer,
            "phone": phone,
            "contact_id": mail.rsplit("/", 1)[-1].replace(".html", ""),
            "street": next((v for k, v in options.items() if k in ("Street:", "Iela:")), ""),
            "house_type": options.get("House type:", ""),
            "facilities": options.get("Facilities:", ""),
        }
    ]


def flat_details(pages: DataFrame) -> DataFrame:
    """Details of a flat's own page: message, post date, phone, contact, street, house type, facilities."""
    r = records(pages, _flat_detail, "comment string, footer string, phone string, contact_id string, street string, house_type string, facilities string")
    street = parse.street(F.col("street"))
    return r.withColumns({"post_date": parse.post_time(F.col("footer")), "street_name": street["name"], "street_no": street["no"]}).drop("footer", "street")


def _house_detail(page: Element) -> list[dict]:
    out = {"posted": "", "phone": "", "contact_id": ""}
    for row in (page.first("table", id="page_main") or page).all("tr"):
        own = list(row.all("td"))
        if len(own) != 2:
            continue
        label, value = (e.text().strip() for e in own)
        if len(value) > 100:
            continue
        for key, words in (("posted", ("Date", "Datums")), ("phone", ("Phone", "Tālrunis")), ("contact_id", ("Contact", "Kontakts"))):
            if any(w in label for w in words):
                out[key] = value
                break
    return [out]


def house_details(pages: DataFrame) -> DataFrame:
    r = records(pages, _house_detail, "posted string, phone string, contact_id string")
    return r.withColumn("post_date", parse.post_day(F.col("posted"))).drop("posted")


def _programmes(page: Element) -> list[dict]:
    out = []
    for block in page.all("div", "show-expander-content"):
        title, subtitle = block.first("h2", "tet-font__headline--s"), block.first("p", "subtitle")
        times = subtitle.first("span") if subtitle else None
        if not title or not times:
            continue
        about, image = block.first("p", "text tet-font__body--s"), block.first("div", "expander-image")
        picture = image.first("img") if image else None
        out.append({"title_lv": title.text().strip(), "times": times.text().strip(), "description_lv": about.text().strip() if about else "", "image_url": picture.attributes.get("src", "") if picture else ""})
    return out


def programme_listing(pages: DataFrame) -> DataFrame:
    """Programmes of a channel's page (html, channel, day), classified; blocks without readable times are left out."""
    r = records(pages, _programmes, "title_lv string, times string, description_lv string, image_url string")
    slot = parse.slot(F.col("day"), F.col("times"))
    r = r.withColumns({"start_time": slot["start_time"], "duration_minutes": slot["duration_minutes"]}).where("duration_minutes is not null")
    return r.withColumn("classification", classify.programme(F.col("title_lv"), F.col("description_lv"), F.col("channel"), F.col("duration_minutes"))).drop("times")


def _article(page: Element) -> list[dict]:
    article = page.first("article", "open_article v2")
    if not article:
        return [{"title": "No Title Found", "images": [], "content": "", "links": [], "videos": 0}]
    parts = [x for x in (article.first("h1"), article.first("div", "intro")) if x] + list(article.all("div", "gallery_img"))
    inside = [e for p in parts for e in p.walk()]
    heading = article.first("h1")
    embeds = sum(e.tag == "iframe" and any(s in e.attributes.get("src", "") for s in ("youtube.com", "vimeo.com", "dailymotion.com")) for e in inside)
    comment = next((e for e in inside if e.tag == "a" and "com" in e.attributes.get("class", "").split()), None)
    if comment:
        comment.children, comment.attributes = [], {}
    return [
        {
            "title": "".join(s.strip() for s in heading.strings()) if heading else "No Title Found",
            "images": [e.attributes.get("data-src") or e.attributes.get("src", "") for e in inside if e.tag == "img" and e.attributes.get("alt") != "emotion"],
            "content": "".join(s.strip() for p in parts for s in p.strings(("script", "style"))),
            "links": [e.attributes["href"] for e in inside if e.tag == "a" and e.attributes.get("href")],
            "videos": sum(e.tag == "video" for e in inside) + embeds,
        }
    ]


def articles(pages: DataFrame, base: str) -> DataFrame:
    """Cleaned articles of pages: title, content, images and links with absolute addresses, and the features of the content."""
    r = records(pages, _article, "title string, images array<string>, content string, links array<string>, videos int")
    absolute = lambda c: F.transform(c, lambda x: parse.absolute_url(base, x))
    return r.withColumns(
        {
            "images": absolute("images"), "links": absolute("links"), "image_count": F.size("images"), "video_count": F.col("videos"),
            "text_length": F.length("content"), "has_video": (F.col("videos") > 0) | F.lower("content").contains("video"),
        }
    ).drop("videos")
