"""Queries on writes: tables after an upsert, a migration or a sighting."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import partitions, rollups, stored, upsert
from .analytics import SEEN_FROM, SEEN_TO
from .market import ADS, SEEN, SIGHTINGS, Market
from .registry import query

# Stored: ads with even ids, half of them hidden. Incoming: ads divisible by three, with other prices and rooms, some twice.
_STORED = f"""{ADS}, stored AS (SELECT id, rooms, total_price, 'old' AS comment, id % 4 = 0 AS is_hidden, first_seen FROM ads WHERE id % 2 = 0),
batch AS (
  SELECT id, rooms + 1 AS rooms, total_price * 2 AS total_price, 'new' AS comment, false AS is_hidden, first_seen, 1 AS seq FROM ads WHERE id % 3 = 0
  UNION ALL SELECT id, rooms + 2, total_price * 3, 'newer', false, first_seen, 2 FROM ads WHERE id % 9 = 0
), latest AS (SELECT * EXCLUDE (seq) FROM batch QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC) = 1)"""


def _tables(m: Market):
    ads = m.ads().select("id", "rooms", "total_price", "first_seen")
    columns = ["id", "rooms", "total_price", "comment", "is_hidden", "first_seen"]
    stored = ads.where("id % 2 = 0").withColumn("comment", F.lit("old")).withColumn("is_hidden", F.col("id") % 4 == 0).select(columns)

    def some(k: int, seq: int, comment: str):
        own = ads.where(F.col("id") % k == 0)
        return own.select("id", (F.col("rooms") + seq).alias("rooms"), (F.col("total_price") * (seq + 1)).alias("total_price"), F.lit(comment).alias("comment"), F.lit(False).alias("is_hidden"), "first_seen", F.lit(seq).alias("seq"))

    return stored, some(3, 1, "new").union(some(9, 2, "newer"))


_UPSERTED = f"""WITH {_STORED} SELECT coalesce(s.id, b.id) AS id, coalesce(s.rooms, b.rooms) AS rooms, coalesce(b.total_price, s.total_price) AS total_price, coalesce(b.comment, s.comment) AS comment,
    coalesce(s.is_hidden, b.is_hidden) AS is_hidden, coalesce(s.first_seen, b.first_seen) AS first_seen FROM stored AS s FULL JOIN latest AS b ON b.id = s.id"""


@query(_UPSERTED)
def k02_upsert(m: Market):
    """Listed columns change, the others keep their values; the last of a batch wins."""
    old, batch = _tables(m)
    return upsert.upsert(old, batch, ["id"], ["total_price", "comment"], sequence="seq")


@query(_UPSERTED)
def k02_upsert_touched(m: Market):
    """K02 on a stored table: only the buckets of the batch's keys are rewritten."""
    old, batch = _tables(m)
    at, part = stored.own_folder(m.spark, "ads") + "/table", partitions.bucket(["id"], 16)
    partitions.create(old, at, part)
    partitions.upsert(m.spark, at, batch, ["id"], ["total_price", "comment"], part, sequence="seq")
    return partitions.read(m.spark, at).drop(partitions.PART)


@query(f"WITH {_STORED} SELECT * FROM stored UNION ALL SELECT * FROM latest WHERE id NOT IN (SELECT id FROM stored)")
def k03_insert_ignore(m: Market):
    old, batch = _tables(m)
    return upsert.insert_ignore(old, batch, ["id"], sequence="seq")


@query(
    f"""WITH {_STORED} SELECT coalesce(s.id, b.id) AS id, CASE WHEN s.id IS NULL THEN b.comment ELSE coalesce(nullif(s.comment, ''), nullif(b.comment, ''), s.comment) END AS comment
    FROM (SELECT id, CASE WHEN id % 8 = 0 THEN '' ELSE comment END AS comment FROM stored) AS s FULL JOIN latest AS b ON b.id = s.id"""
)
def k09_fill_blanks(m: Market):
    """A stored text is replaced only if blank."""
    old, batch = _tables(m)
    old = old.withColumn("comment", F.when(F.col("id") % 8 == 0, "").otherwise(F.col("comment")))
    return upsert.upsert(old, batch, ["id"], [], sequence="seq", fill=["comment"]).select("id", "comment")


@query(f"WITH {_STORED} SELECT id, CASE WHEN id IN (SELECT id FROM batch) THEN TIMESTAMP '2026-01-01' ELSE first_seen END AS first_seen FROM stored")
def k10_touch(m: Market):
    old, batch = _tables(m)
    return upsert.touch(old, "id", batch, "first_seen", F.lit("2026-01-01").cast("timestamp_ntz")).select("id", "first_seen")


@query(f"WITH {_STORED} SELECT id FROM batch WHERE id NOT IN (SELECT id FROM stored)")
def j07_new_rows(m: Market):
    """Rows not stored, duplicates kept."""
    old, batch = _tables(m)
    return upsert.new_rows(batch, old, ["id"]).select("id")


_SEEN_TWICE = f"WITH {ADS}, {SIGHTINGS} SELECT ad_id, seen_on FROM sightings UNION SELECT id, DATE '2001-12-31' FROM ads WHERE id % 5 = 0 UNION SELECT id, DATE '1998-03-05' FROM ads WHERE id % 5 = 0"


@query(_SEEN_TWICE)
def k04_sight(m: Market):
    """Once a day for each ad, however often it is written."""
    ads = m.ads().where("id % 5 = 0").select(F.col("id").alias("ad_id"))
    day = lambda d: F.lit(d).cast("date")
    once = upsert.sight(m.sightings(), ads.union(ads), day("2001-12-31"))
    return upsert.sight(once, ads, day("1998-03-05"))


@query(_SEEN_TWICE)
def k04_sight_touched(m: Market):
    """K04 on a table stored by month: a day's run rewrites its month alone, a repeated one nothing."""
    at, month = stored.own_folder(m.spark, "sightings") + "/table", F.concat(F.lit("m"), F.date_format("seen_on", "yyyy-MM"))
    partitions.create(m.sightings(), at, month)
    ads = m.ads().where("id % 5 = 0").select(F.col("id").alias("ad_id"))
    for day in ("2001-12-31", "1998-03-05", "1998-03-05"):
        partitions.insert_ignore(m.spark, at, ads.union(ads).withColumn("seen_on", F.lit(day).cast("date")), ["ad_id", "seen_on"], month)
    return partitions.read(m.spark, at).drop(partitions.PART)


@query(
    f"""WITH {SEEN} SELECT seen_on, count(*) FILTER (kind = 'flat_rent') AS flat_rent, count(*) FILTER (kind = 'flat_sale') AS flat_sale, count(*) FILTER (kind = 'house_rent') AS house_rent,
         count(*) FILTER (kind = 'house_sale') AS house_sale, count(*) FILTER (kind LIKE 'flat%') AS flats, count(*) FILTER (kind LIKE 'house%') AS houses, count(*) AS total
      FROM seen WHERE seen_on BETWEEN DATE '{SEEN_FROM}' AND DATE '{SEEN_TO}' GROUP BY seen_on ORDER BY seen_on DESC"""
)
def a05_daily_report_from_rollup(m: Market):
    """A04, A05 from stored daily counts, after late, repeated and withdrawn sightings."""
    kinds = {"view": "flat_rent", "click": "flat_sale", "purchase": "house_rent", "signup": "house_sale"}
    kind = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])[F.col("event_type")]
    events = m.table("events").select(F.col("event_id").alias("id"), F.col("user_id").alias("ad_id"), F.to_date("ts").alias("seen_on"), kind.alias("kind")).where("kind is not null")
    late = (F.col("id") % 10 == 0) & (F.dayofmonth("seen_on") % 7 == 0)
    false = events.where((F.col("id") % 50 == 1) & (F.dayofmonth("seen_on") < 9)).withColumn("id", -F.col("id") - 1)  # to be withdrawn
    at = stored.own_folder(m.spark, "rollup")
    rollups.create(events.where(~late).union(false), at)
    rollups.change(m.spark, at, added=events.where(late).union(events.where(late)).union(events.where(late).limit(20)), removed=false.select("id", "seen_on"))
    rollups.change(m.spark, at, added=events.where(late))
    return rollups.daily_report(m.spark, at, date_from=SEEN_FROM, date_to=SEEN_TO)


@query(
    """WITH stored AS (SELECT c_custkey AS id, c_name AS phone, c_mktsegment AS contact_id FROM customer WHERE c_custkey % 2 = 0),
    wanted AS (SELECT DISTINCT phone, contact_id FROM (SELECT c_name AS phone, c_mktsegment AS contact_id FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT '', '' UNION ALL SELECT s_name, '' FROM supplier) WHERE phone <> '' OR contact_id <> '')
    SELECT id, phone, contact_id FROM stored
    UNION ALL SELECT (SELECT max(id) FROM stored) + row_number() OVER (ORDER BY phone, contact_id), phone, contact_id FROM wanted AS w WHERE NOT EXISTS (SELECT 1 FROM stored AS s WHERE s.phone = w.phone AND s.contact_id = w.contact_id)"""
)
def k05_sellers(m: Market):
    """A dimension with what it lacked; blank keys make no row."""
    customers = m.table("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("phone"), F.col("c_mktsegment").alias("contact_id"))
    wanted = customers.where("id % 3 = 0").select("phone", "contact_id").union(m.table("supplier").select("s_name", F.lit("")))
    wanted = wanted.union(m.spark.createDataFrame([("", "")], "phone string, contact_id string"))
    return upsert.get_or_create(customers.where("id % 2 = 0"), wanted, ["phone", "contact_id"], usable=(F.col("phone") != "") | (F.col("contact_id") != ""))


@query("SELECT DISTINCT l_orderkey AS vacancy_id, l_suppkey AS keyword_id FROM lineitem")
def k15_bridge(m: Market):
    """A bridge is a set."""
    pairs = m.table("lineitem").select(F.col("l_orderkey").alias("vacancy_id"), F.col("l_suppkey").alias("keyword_id"))
    return upsert.append(pairs, pairs.where("vacancy_id % 2 = 0")).dropDuplicates()


_LEGACY = f"{ADS}, legacy AS (SELECT id, 'a' || id AS ad_id, region_id, total_price, total_price * 2 AS alt_price, deal_type FROM ads)"


def _legacy(m: Market):
    return m.ads().select("id", F.concat(F.lit("a"), F.col("id").cast("string")).alias("ad_id"), "region_id", "total_price", (F.col("total_price") * 2).alias("alt_price"), "deal_type")


@query(f"WITH {_LEGACY} SELECT id, ad_id, region_id, total_price, alt_price AS monthly_price FROM legacy WHERE deal_type = 'RENT'")
def m01_split_rent(m: Market):
    """M01, U04."""
    return upsert.split_by_deal(_legacy(m))[0]


@query(f"WITH {_LEGACY} SELECT id, ad_id, region_id, total_price, deal_type, CASE WHEN deal_type = 'RENT' THEN alt_price ELSE 0.0 END AS alt_price FROM legacy")
def m01_joined_deals(m: Market):
    """The inverse; a sale's alternative price is lost."""
    return upsert.joined_deals(*upsert.split_by_deal(_legacy(m)))


@query(f"WITH {ADS} SELECT id, is_hidden OR first_seen < DATE '1998-01-01' AS is_hidden FROM ads")
def m04_hide_before(m: Market):
    """M04, K14."""
    return upsert.hide_before(m.ads(), "1998-01-01").select("id", "is_hidden")


@query("SELECT o_orderkey AS id, c.c_custkey AS customer_id FROM orders LEFT JOIN customer AS c ON c.c_custkey = o_custkey AND c.c_custkey % 10 <> 0")
def k_set_null(m: Market):
    """References to deleted parents become null."""
    rows = m.table("orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("customer_id"))
    return upsert.without_parent(rows, "customer_id", m.table("customer").where("c_custkey % 10 <> 0").select(F.col("c_custkey").alias("id")), cascade=False)


@query("SELECT l_orderkey AS order_id, l_linenumber AS line FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 10 <> 0)")
def k_cascade(m: Market):
    """Rows of deleted parents go."""
    rows = m.table("lineitem").select(F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line"))
    return upsert.without_parent(rows, "order_id", m.table("orders").where("o_orderkey % 10 <> 0").select(F.col("o_orderkey").alias("id")), cascade=True)


@query(
    """WITH p AS (SELECT p_partkey AS id, p_brand AS title, p_type AS channel, TIMESTAMP '2026-04-01' + to_hours(CAST(p_partkey % 72 AS INTEGER)) AS start_time FROM part)
    SELECT b.id FROM p AS b WHERE b.id % 2 = 1 AND NOT EXISTS (SELECT 1 FROM p AS s WHERE s.id % 2 = 0 AND s.title = b.title AND s.channel = b.channel AND CAST(s.start_time AS DATE) = CAST(b.start_time AS DATE))"""
)
def j07_new_slots(m: Market):
    """J07 for programmes: same title and channel on the same day."""
    start = F.lit("2026-04-01").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), (F.col("p_partkey") % 72).cast("int"))
    p = m.table("part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("title"), F.col("p_type").alias("channel"), start.alias("start_time"))
    return upsert.new_slots(p.where("id % 2 = 1"), p.where("id % 2 = 0")).select("id")


@query(
    """WITH stored AS (SELECT c_custkey AS id, lower(c_name) AS name FROM customer WHERE c_custkey % 2 = 0), wanted AS (SELECT DISTINCT lower(c_name) AS name FROM customer WHERE c_custkey % 3 = 0)
    SELECT id, name FROM stored UNION ALL SELECT (SELECT max(id) FROM stored) + row_number() OVER (ORDER BY name), name FROM wanted WHERE name NOT IN (SELECT name FROM stored)"""
)
def k16_keywords(m: Market):
    """Names are stripped and lower-cased; known and blank ones make no row."""
    customers = m.table("customer").select(F.col("c_custkey").alias("id"), "c_name")
    wanted = customers.where("id % 3 = 0").select(F.concat(F.lit(" \t"), F.upper("c_name"), F.lit(" ")).alias("name"))
    wanted = wanted.union(customers.where("id % 6 = 0").select("c_name")).union(customers.select(F.lit("  ")))
    return upsert.keywords_added(customers.where("id % 2 = 0").select("id", F.lower("c_name").alias("name")), wanted)


@query("SELECT o_orderkey AS id, coalesce(nullif(o_orderpriority, '5-LOW'), '') AS raw_project FROM orders")
def m05_required(m: Market):
    """A column that may no longer be null."""
    rows = m.table("orders").select(F.col("o_orderkey").alias("id"), F.nullif(F.col("o_orderpriority"), F.lit("5-LOW")).alias("raw_project"))
    return upsert.required(rows, {"raw_project": ""})


@query("SELECT o_orderkey AS id, nullif(o_orderpriority, '5-LOW') AS raw_project FROM orders")
def m05_relaxed(m: Market):
    """The inverse; blanks become nulls again."""
    rows = m.table("orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderpriority") == "5-LOW", "").otherwise(F.col("o_orderpriority")).alias("raw_project"))
    return upsert.required(rows, {"raw_project": ""}, relax=True)


@query("SELECT 'customer' AS name, count(*) AS n FROM customer UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'part', count(*) FROM part")
def k17_snapshot(m: Market):
    """Tables written to a new folder, and what was read back."""
    counts = upsert.snapshot({t: m.table(t) for t in ("customer", "orders", "part")}, stored.own_folder(m.spark, "snapshot"))
    return m.spark.createDataFrame(sorted(counts.items()), "name string, n long")
