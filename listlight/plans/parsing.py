"""Queries on the parsers: raw strings made of part's columns, by the same SQL text in both engines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import classify, parse
from .market import Market
from .registry import query

PRICE = """CASE p_partkey % 12
  WHEN 0 THEN '-' WHEN 1 THEN p_size || ',200 €' WHEN 2 THEN p_size || ' 000 €' WHEN 3 THEN p_size || ' €/day' WHEN 4 THEN '1' || p_size || ' €/week'
  WHEN 5 THEN '1,' || p_size || '50 €/mon.' WHEN 6 THEN p_size || ' €/mēn.' WHEN 7 THEN 'buy ' WHEN 8 THEN '1_' || p_size WHEN 9 THEN p_size || 'd' WHEN 10 THEN '' ELSE '  ' || p_size || '.5 ' END"""
SIZE = "CASE p_partkey % 6 WHEN 0 THEN '-' WHEN 1 THEN '1,' || p_size || '00' WHEN 2 THEN ' ' || p_size || ' ' WHEN 3 THEN 'x' || p_size WHEN 4 THEN p_size || '.25' ELSE '' END"
ROOMS = "CASE p_partkey % 5 WHEN 0 THEN CAST(p_size AS VARCHAR(9)) WHEN 1 THEN '1' || p_size || '0' WHEN 2 THEN 'Citi' WHEN 3 THEN ' 2' ELSE '' END"
FLOOR = "CASE p_partkey % 5 WHEN 0 THEN p_size || '/9' WHEN 1 THEN CAST(p_size AS VARCHAR(9)) WHEN 2 THEN '-/' || p_size WHEN 3 THEN p_size || '.7/3.9' ELSE '' END"
LAND = """CASE p_partkey % 10 WHEN 0 THEN p_size || ' m²' WHEN 1 THEN '0.' || p_size || ' ha.' WHEN 2 THEN '0,' || p_size || ' HA' WHEN 3 THEN p_size || '00.5' WHEN 4 THEN '1 ' || p_size || '00 m²'
  WHEN 5 THEN '1,' || p_size || '00 m²' WHEN 6 THEN '-' WHEN 7 THEN 'no data' WHEN 8 THEN '1.2' || p_size || ',5 ha' ELSE '' END"""
STREET = "CASE p_partkey % 7 WHEN 0 THEN p_brand || ' ' || p_size WHEN 1 THEN p_brand || ' ' || p_size || 'a' WHEN 2 THEN p_brand || ' bulv. 5/' || p_size WHEN 3 THEN CAST(p_size AS VARCHAR(9)) WHEN 4 THEN 'Lielā iela' WHEN 5 THEN 'A  ' || p_size ELSE '' END"
DAY = "CASE p_partkey % 4 WHEN 0 THEN (p_size % 28 + 1) || '.' || (p_size % 12 + 1) || '.2025' WHEN 1 THEN '31.2.2025' WHEN 2 THEN 'yesterday' ELSE '05.06.2026' END"
FOOTER = "CASE p_partkey % 3 WHEN 0 THEN 'Date: ' || lpad(CAST(p_size % 28 + 1 AS VARCHAR(9)), 2, '0') || '.11.2025 ' || lpad(CAST(p_size % 24 AS VARCHAR(9)), 2, '0') || ':07' WHEN 1 THEN 'Date: 99.11.2025 10:00' ELSE 'Date: soon' END"
SLOT = "lpad(CAST(p_partkey % 24 AS VARCHAR(9)), 2, '0') || ':' || lpad(CAST(p_size AS VARCHAR(9)), 2, '0') || ' - ' || lpad(CAST(p_partkey * 7 % 24 AS VARCHAR(9)), 2, '0') || ':15'"

_NUMBER = r"'^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$'"


def _number(c: str) -> str:
    return f"CASE WHEN regexp_matches({c}, {_NUMBER}) THEN TRY_CAST(trim({c}) AS DOUBLE) END"


def _raw(m: Market, **raw: str):
    return m.table("part").select("p_partkey", *[F.expr(sql).alias(name) for name, sql in raw.items()])


_UNIT = lambda u: _number(rf"regexp_replace(replace(replace(s, '{u}', ''), ' ', ''), '[^\x00-\x7F]', '', 'g')")
_PRICE_SQL = rf"""coalesce(CASE WHEN NOT contains(s, '/') THEN {_number("replace(regexp_replace(s, '[^\x00-\x7F]', '', 'g'), '_', '')")} WHEN contains(s, '/day') THEN 30 * {_UNIT("/day")} WHEN contains(s, '/week') THEN 4 * {_UNIT("/week")} ELSE {_UNIT("/mon.")} END, 0)"""


@query(f"SELECT p_partkey, {_PRICE_SQL} AS price, 120 * {_PRICE_SQL} AS ten_years FROM (SELECT p_partkey, replace(trim({PRICE}), ',', '') AS s FROM part)")
def x01_price(m: Market):
    """X01, X10."""
    price = parse.price(F.col("raw"))
    return _raw(m, raw=PRICE).select("p_partkey", price.alias("price"), parse.ten_years(price, F.lit("RENT")).alias("ten_years"))


@query(
    f"""SELECT p_partkey, coalesce({_number("replace(trim(raw), ',', '')")}, 0) AS size, coalesce({_number("raw")}, 0) AS house_size,
    CASE WHEN coalesce({_number("raw")}, 0) > 0 THEN p_retailprice / coalesce({_number("raw")}, 0) ELSE 0 END AS per_sqm FROM (SELECT *, {SIZE} AS raw FROM part)"""
)
def x02_sizes(m: Market):
    """X02, X03."""
    area = parse.house_size(F.col("raw"))
    raw = m.table("part").select("p_partkey", "p_retailprice", F.expr(SIZE).alias("raw"))
    return raw.select("p_partkey", parse.size(F.col("raw")).alias("size"), area.alias("house_size"), parse.per_area(F.col("p_retailprice"), area).alias("per_sqm"))


_WHOLE = lambda c: f"CAST(coalesce(trunc({_number(c)}), 0) AS INTEGER)"


@query(
    f"""SELECT p_partkey, CASE WHEN length(r) BETWEEN 1 AND 2 AND regexp_matches(trim(r), '^[+-]?[0-9]+$') THEN CAST(trim(r) AS INTEGER) ELSE 0 END AS rooms,
    {_WHOLE("split_part(f, '/', 1)")} AS floor, {_WHOLE("split_part(f, '/', -1)")} AS max_floor FROM (SELECT p_partkey, {ROOMS} AS r, {FLOOR} AS f FROM part)"""
)
def x04_rooms_and_floors(m: Market):
    """X04, X05, X06, P12."""
    f = F.col("f")
    return _raw(m, r=ROOMS, f=FLOOR).select("p_partkey", parse.rooms(F.col("r")).alias("rooms"), parse.floor(f).alias("floor"), parse.max_floor(f).alias("max_floor"))


_HECTARES = r"regexp_extract(s, '(?i)([0-9.,]+)\s*ha', 1)"


@query(
    rf"""SELECT p_partkey, CASE WHEN s IN ('', '-') THEN NULL WHEN {_HECTARES} <> '' THEN 10000 * {_number(f"replace({_HECTARES}, ',', '.')")}
    ELSE {_number(r"regexp_replace(regexp_extract(s, '([0-9\s,]+)', 1), '[, ]', '', 'g')")} END AS land_area FROM (SELECT p_partkey, trim({LAND}) AS s FROM part)"""
)
def x07_land_area(m: Market):
    return _raw(m, raw=LAND).select("p_partkey", parse.land_area(F.col("raw")).alias("land_area"))


@query(
    f"""SELECT p_partkey, CASE WHEN regexp_matches(s, '^.* [0-9][^ ]*$') THEN regexp_extract(s, '^(.*) ([0-9][^ ]*)$', 1) ELSE s END AS name,
    CASE WHEN regexp_matches(s, '^.* [0-9][^ ]*$') THEN regexp_extract(s, '^(.*) ([0-9][^ ]*)$', 2) ELSE '' END AS no FROM (SELECT p_partkey, trim({STREET}) AS s FROM part)"""
)
def x08_street(m: Market):
    """From the last line of a cell."""
    cell = F.concat(F.lit("Village\n "), F.col("raw"), F.lit("\n"))
    s = parse.street(F.when(F.col("raw") == "", F.lit("")).otherwise(parse.last_line(cell)))
    return _raw(m, raw=STREET).select("p_partkey", s["name"].alias("name"), s["no"].alias("no"))


@query("SELECT p_partkey, 'r' || p_partkey || p_brand || p_type || p_size || '1/5' || 'New' AS flat_key, 'r' || p_partkey || p_brand || p_type || p_size || 'New' AS house_key FROM part")
def x09_natural_keys(m: Market):
    cells = F.array(F.lit(""), F.lit(""), F.lit("comment"), F.col("p_brand"), F.col("p_type"), F.col("p_size").cast("string"), F.lit("1/5"), F.lit("New"), F.lit("9 €"))
    row = F.concat(F.lit("r"), F.col("p_partkey").cast("string"))
    return m.table("part").select("p_partkey", parse.flat_key(row, cells).alias("flat_key"), parse.house_key(row, cells).alias("house_key"))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'Series 103' WHEN 1 THEN 'Private House' WHEN 2 THEN 'Unknown' END AS project FROM part")
def x13_project(m: Market):
    """X13, K06."""
    raw = "CASE p_partkey % 4 WHEN 0 THEN ' 103. ' WHEN 1 THEN 'Priv. m.' WHEN 2 THEN '-' ELSE p_brand END"
    return _raw(m, raw=raw).select("p_partkey", parse.project(F.col("raw")).alias("project"))


@query("SELECT doc_id, n_chars > 8000 OR contains(lower(text), 'über') OR contains(lower(text), 'outre') AS flagged FROM documents")
def x11_disguised_sales(m: Market):
    """Words or a price over the limit, case-insensitive and accent-sensitive."""
    return m.table("documents").select("doc_id", classify.is_sale_in_disguise(F.col("text"), F.col("n_chars"), ("ÜBER", "outre"), 8000).alias("flagged"))


@query("SELECT id, CASE WHEN id % 2 = 0 THEN 'APARTMENT' ELSE 'HOUSE' END AS category FROM (SELECT CAST(r_regionkey AS BIGINT) AS id FROM region)")
def x12_category(m: Market):
    """X12, M03."""
    return m.regions().where("parent_id is null").select("id", parse.category(F.col("url")).alias("category"))


@query(f"SELECT p_partkey, CASE WHEN p_partkey % 4 IN (0, 3) THEN TRY_STRPTIME(d, '%d.%m.%Y') END AS day, TRY_STRPTIME(substr(f, 7), '%d.%m.%Y %H:%M') AS posted FROM (SELECT p_partkey, {DAY} AS d, {FOOTER} AS f FROM part)")
def d01_post_dates(m: Market):
    """Invalid ones are null."""
    out = _raw(m, d=DAY, f=FOOTER)
    return out.select("p_partkey", parse.post_day(F.col("d")).cast("timestamp_ntz").alias("day"), parse.post_time(F.col("f")).cast("timestamp_ntz").alias("posted"))


@query(
    f"""SELECT p_partkey, TIMESTAMP '2026-04-24' + to_minutes(b) AS start_time, CAST((e - b + 1440) % 1440 AS INTEGER) AS duration_minutes
    FROM (SELECT p_partkey, CAST(left(s, 2) AS INTEGER) * 60 + CAST(substr(s, 4, 2) AS INTEGER) AS b, CAST(substr(s, 9, 2) AS INTEGER) * 60 + CAST(substr(s, 12, 2) AS INTEGER) AS e FROM (SELECT p_partkey, {SLOT} AS s FROM part))"""
)
def d03_slots(m: Market):
    """An end before the start is on the next day."""
    s = parse.slot(F.lit("2026-04-24").cast("date"), F.col("raw"))
    return _raw(m, raw=SLOT).select("p_partkey", s["start_time"].cast("timestamp_ntz").alias("start_time"), s["duration_minutes"].alias("duration_minutes"))


@query("SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS day, CAST(o_orderdate AS DATE) - 30 AS since, CAST(o_orderdate AS DATE) + 7 AS until FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1998-01-01' - 30 AND DATE '1998-01-01'")
def d05_date_window(m: Market):
    """A window of 30 days back from a given day."""
    day, end = F.to_date("o_orderdate"), F.lit("1998-01-01").cast("date")
    own = m.table("orders").where(day.between(F.date_sub(end, 30), end))
    return own.select(F.col("o_orderkey").alias("id"), day.alias("day"), F.date_sub(day, 30).alias("since"), F.date_add(day, 7).alias("until"))


@query("SELECT p_partkey, left(p_brand || CASE WHEN p_partkey % 2 = 0 THEN ' & ' ELSE '  ' END || repeat(p_name, 30), 255) AS reason FROM part")
def x21_entity_free(m: Market):
    raw = F.concat(F.col("p_brand"), F.lit("&nbsp;"), F.when(F.col("p_partkey") % 2 == 0, " & ").otherwise(" &amp; "), F.repeat("p_name", F.lit(30)))
    return m.table("part").select("p_partkey", parse.entity_free(raw).alias("reason"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'https://cdn.example/' || p_size ELSE 'https://blog.example/img/' || p_size END AS url FROM part")
def x22_absolute_urls(m: Market):
    """X22."""
    raw = F.concat(F.when(F.col("p_partkey") % 2 == 0, "https://cdn.example/").otherwise("/img/"), F.col("p_size").cast("string"))
    return m.table("part").select("p_partkey", parse.absolute_url("https://blog.example", raw).alias("url"))


@query(
    """SELECT p_partkey, CASE WHEN lo IS NOT NULL AND hi IS NOT NULL THEN CAST(lo AS BIGINT) || ' - ' || CAST(hi AS BIGINT) WHEN lo IS NOT NULL THEN 'from ' || CAST(lo AS BIGINT) WHEN hi IS NOT NULL THEN 'to ' || CAST(hi AS BIGINT) ELSE 'not stated' END AS salary,
    CASE WHEN p_partkey % 3 = 0 THEN 'none' WHEN DATE '2026-01-01' + p_size < DATE '2026-01-20' THEN 'past' ELSE 'active' END AS deadline
    FROM (SELECT *, CASE WHEN p_partkey % 2 = 0 THEN p_size * 10 END AS lo, CASE WHEN p_partkey % 3 = 0 THEN p_size * 20 END AS hi FROM part)"""
)
def k18_labels(m: Market):
    """Labels that carry logic: salary in four forms, and the state of a deadline."""
    key = F.col("p_partkey")
    low, high = F.when(key % 2 == 0, F.col("p_size") * 10), F.when(key % 3 == 0, F.col("p_size") * 20)
    day = F.when(key % 3 != 0, F.date_add(F.lit("2026-01-01").cast("date"), F.col("p_size")))
    return m.table("part").select("p_partkey", parse.salary_label(low, high).alias("salary"), parse.deadline_status(day, F.lit("2026-01-20").cast("date")).alias("deadline"))
