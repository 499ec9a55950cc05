"""Normalising raw listing strings: prices, sizes, floors, addresses, dates. Column in, Column out, no UDFs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"
NOT_ASCII = r"[^\x00-\x7F]"

# Raw building-series spellings of the portal and the labels that stand for them.
PROJECTS = {
    "103-th": "Series 103",
    "103.": "Series 103",
    "602-th": "Series 602",
    "602.": "Series 602",
    "467-th": "Series 467",
    "467.": "Series 467",
    "119-th": "Series 119",
    "119.": "Series 119",
    "104-th": "Series 104",
    "104.": "Series 104",
    "Spec. pr.": "Special Project",
    "Specpr.": "Special Project",
    "Chrusch.": "Khrushchyovka",
    "Hrušč.": "Khrushchyovka",
    "Czech pr.": "Czech Project",
    "Čehu pr.": "Czech Project",
    "Lit pr.": "Lithuanian Project",
    "LT proj.": "Lithuanian Project",
    "Stalin project": "Stalin Era",
    "Staļina": "Stalin Era",
    "Recon.": "Renovated",
    "Renov.": "Renovated",
    "New": "New Construction",
    "Jaun.": "New Construction",
    "Sm.fam.": "Small Family House",
    "M. ģim.": "Small Family House",
    "Priv.house": "Private House",
    "Priv. m.": "Private House",
    "Pre-war house": "Pre-War",
    "P. kara": "Pre-War",
    "-": "Unknown",
}


def number(c: Column) -> Column:
    """A string as double, null where it is no plain decimal number. Underscores between digits are allowed."""
    plain = F.regexp_replace(c, r"(?<=[0-9])_(?=[0-9])", "")
    return F.when(plain.rlike(NUMBER), F.trim(plain).try_cast("double"))


def whole(c: Column) -> Column:
    """The integer part of a number string, 0 where it is none."""
    return F.coalesce(number(c).try_cast("int"), F.lit(0))


def price(raw: Column) -> Column:
    """A price per month: rates per day count 30 times, per week 4 times; what can't be read is 0. Without a unit, inner spaces make it unreadable."""
    s = F.regexp_replace(F.trim(raw), ",", "")
    value = lambda unit: number(F.regexp_replace(F.replace(F.replace(s, F.lit(unit), F.lit("")), F.lit(" "), F.lit("")), NOT_ASCII, ""))
    found = (
        F.when(~s.contains("/"), number(F.regexp_replace(s, NOT_ASCII, "")))
        .when(s.contains("/day"), value("/day") * 30)
        .when(s.contains("/week"), value("/week") * 4)
        .otherwise(value("/mon."))
    )
    return F.coalesce(found, F.lit(0.0))


def size(raw: Column) -> Column:
    """Square metres of a flat; thousands commas are dropped, unreadable is 0."""
    return F.coalesce(number(F.replace(F.trim(raw), F.lit(","), F.lit(""))), F.lit(0.0))


def house_size(raw: Column) -> Column:
    """Square metres of a house; a comma makes it unreadable, which is 0."""
    return F.coalesce(number(raw), F.lit(0.0))


def per_area(amount: Column, area: Column) -> Column:
    """amount / area, 0 where there is no area."""
    return F.when(area > 0, amount / area).otherwise(F.lit(0.0))


def rooms(raw: Column) -> Column:
    """One or two characters that are a number, else 0."""
    digits = F.when(F.length(raw).between(1, 2) & F.trim(raw).rlike(r"^[+-]?[0-9]+$"), F.trim(raw).try_cast("int"))
    return F.coalesce(digits, F.lit(0))


def floor(raw: Column) -> Column:
    return whole(F.split(raw, "/")[0])


def max_floor(raw: Column) -> Column:
    return whole(F.element_at(F.split(raw, "/"), -1))


def land_area(raw: Column) -> Column:
    """Square metres: hectares count 10,000, else the first run of digits, spaces and commas (decimals are lost); unreadable is null."""
    s = F.trim(raw)
    hectares = F.regexp_extract(s, r"(?i)([0-9.,]+)\s*ha", 1)
    metres = F.regexp_replace(F.regexp_extract(s, r"([0-9\s,]+)", 1), "[, ]", "")
    return F.when((s == "") | (s == "-"), F.lit(None).cast("double")).when(hectares != "", number(F.replace(hectares, F.lit(","), F.lit("."))) * 10000).otherwise(number(metres))


def street(raw: Column) -> Column:
    """struct(name, no): the last of several words is the number if it begins with a digit."""
    s = F.trim(raw)
    split = s.rlike(r"^.* [0-9][^ ]*$")
    name = F.when(split, F.regexp_extract(s, r"^(.*) ([0-9][^ ]*)$", 1)).otherwise(s)
    no = F.when(split, F.regexp_extract(s, r"^(.*) ([0-9][^ ]*)$", 2)).otherwise(F.lit(""))
    return F.struct(name.alias("name"), no.alias("no"))


def last_line(cell: Column) -> Column:
    """The last line of a cell that isn't blank, trimmed; '' if there is none."""
    lines = F.filter(F.transform(F.split(cell, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(F.size(lines) > 0, F.element_at(lines, -1)).otherwise(F.lit(""))


def flat_key(row_id: Column, cells: Column) -> Column:
    """Natural key of a flat: the row's id and cells 3 to 7 in a row, price excluded."""
    return F.concat(row_id, *[cells[k] for k in (3, 4, 5, 6, 7)])


def house_key(row_id: Column, cells: Column) -> Column:
    return F.concat(row_id, *[cells[k] for k in (3, 4, 5, 7)])


def ten_years(amount: Column, deal_type: Column) -> Column:
    """Rent over 120 months; a sale price as it is."""
    return F.when(deal_type == "RENT", amount * 120).otherwise(amount)


def project(raw: Column) -> Column:
    """Label of a raw series name; null if blank or unknown."""
    known = F.create_map(*[F.lit(x) for pair in PROJECTS.items() for x in pair])
    return F.element_at(known, F.trim(raw))


def category(url: Column) -> Column:
    return F.when(url.contains("/flats/"), "APARTMENT").when(url.contains("/homes-summer-residences/"), "HOUSE").otherwise("APARTMENT")


def link_name(title: Column, text: Column, href: Column) -> Column:
    """Display name of a link: its title up to the first comma, else its text, else the words of its last path part."""
    slug = F.element_at(F.split(F.regexp_replace(href, "/+$", ""), "/"), -1)
    return F.when(title != "", F.trim(F.split(title, ",")[0])).when(F.trim(text) != "", F.trim(text)).otherwise(F.initcap(F.replace(slug, F.lit("-"), F.lit(" "))))


def is_direct_child(href: Column, parent: Column) -> Column:
    """Whether a link (query and fragment aside) lies exactly one path level below the parent, and isn't its list of all."""
    path = F.regexp_replace(href, r"[?#].*$", "")
    base = F.concat(F.regexp_replace(parent, "/$", ""), F.lit("/"))
    rest = F.regexp_replace(F.substr(path, F.length(base) + 1), r"^/+|/+$", "")
    return F.startswith(path, base) & (rest != "") & ~rest.contains("/") & (rest != "all")


def entity_free(text: Column, most: int = 255) -> Column:
    """Text without HTML entities, at most `most` characters."""
    return F.substring(F.regexp_replace(text, r"&[\p{L}\p{N}_]+;", ""), 1, most)


def absolute_url(base: str, src: Column) -> Column:
    return F.when(F.startswith(src, F.lit("http")), src).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), F.regexp_replace(src, "^/+", "")))


def repaired_json(reply: Column) -> Column:
    """A model's reply as JSON text: without code fences and trailing commas."""
    bare = F.regexp_replace(reply, r"^\s*(```(json)?)?\s*|\s*(```)?\s*$", "")
    return F.regexp_replace(bare, r",\s*([}\]])", "$1")


def search_url(base: str, keyword: Column, limit: int = 1000) -> Column:
    return F.concat(F.lit(f"{base}?limit={limit}&keywords[]="), keyword)


def page_url(region_url: Column, suffix: Column, page: Column) -> Column:
    """The first page is the bare listing; later ones are numbered files in it."""
    return F.when(page == 1, F.concat(region_url, suffix)).otherwise(F.concat(region_url, suffix, F.lit("page"), page.cast("string"), F.lit(".html")))


def deal_type(suffix: Column) -> Column:
    return F.when(suffix == "hand_over/", "RENT").when(suffix == "sell/", "SELL")


def post_time(footer: Column) -> Column:
    """Timestamp of a footer such as 'Date: 31.12.2025 10:00' (six characters are dropped); null if invalid."""
    return F.try_to_timestamp(F.trim(F.substring(footer, 7, 100)), F.lit("dd.MM.yyyy HH:mm"))


def post_day(value: Column) -> Column:
    """Timestamp of d.M.yyyy; null if it isn't one."""
    return F.when(value.rlike(r"^[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}$"), F.try_to_timestamp(value, F.lit("d.M.yyyy")))


def minutes_of(clock: Column) -> Column:
    """Minutes since midnight of HH:mm; null if invalid."""
    ok = clock.rlike(r"^([01]?[0-9]|2[0-3]):[0-5]?[0-9]$")
    part = F.split(clock, ":")
    return F.when(ok, part[0].try_cast("int") * 60 + part[1].try_cast("int"))


def slot(day: Column, times: Column) -> Column:
    """struct(start_time, duration_minutes) of 'HH:mm - HH:mm' on a day; an end before the start is on the next day."""
    part = F.split(F.trim(times), " - ")
    begin, end = minutes_of(part[0]), minutes_of(F.get(part, F.lit(1)))
    start = F.to_timestamp(day) + F.make_dt_interval(F.lit(0), F.lit(0), begin, F.lit(0))
    return F.struct(F.when(end.isNotNull(), start).alias("start_time"), F.pmod(end - begin, F.lit(1440)).alias("duration_minutes"))


def salary_label(low: Column, high: Column) -> Column:
    shown = lambda c: F.format_string("%d", c.cast("long"))
    return (
        F.when(low.isNotNull() & high.isNotNull(), F.concat(shown(low), F.lit(" - "), shown(high)))
        .when(low.isNotNull(), F.concat(F.lit("from "), shown(low)))
        .when(high.isNotNull(), F.concat(F.lit("to "), shown(high)))
        .otherwise("not stated")
    )


def deadline_status(deadline: Column, now: Column) -> Column:
    return F.when(deadline.isNull(), "none").when(deadline < now, "past").otherwise("active")


def dash_if_zero(value: Column, digits: int) -> Column:
    """Rounded text of a number; zero and null show as a dash."""
    return F.when(value.isNull() | (value == 0), "—").otherwise(F.format_number(value, digits))
