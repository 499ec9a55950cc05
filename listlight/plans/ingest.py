"""Queries on ingestion: pages made of part's columns are parsed, pruned, classified and written."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import stored as stored_tables
from ..operators.batches import dealt
from ..operators.ingest import Ingestion
from ..sources import pages
from ..streaming import merge
from ..streaming import sightings as stream
from .market import Market
from .registry import query

SITE = "https://ads.example"


def _td(*cells) -> F.Column:
    return F.concat(*[x for c in cells for x in (F.lit("<td>"), c if isinstance(c, F.Column) else F.lit(c), F.lit("</td>"))])


def _flat_pages(m: Market):
    """Listing pages of 50 parts: a row for each, and rows that are none."""
    s = lambda c: F.col(c).cast("string")
    cells = _td("", "", F.concat(F.lit("Nice "), "p_name"), F.concat(F.lit("Town<br>"), "p_type", F.lit(" "), s("p_size")), (F.col("p_size") % 4).cast("string"), s("p_size"), F.lit("2/5"), F.lit("103-th"), F.lit("9.5 €"), F.concat(s("p_size"), F.lit("00 €/mon.")))
    row = F.concat(F.lit("<tr id='r"), s("p_partkey"), F.lit("'>"), cells, F.lit("<a href='/msg/"), s("p_partkey"), F.lit(".html'>x</a></tr><tr id=x><td>too few</td></tr><tr>"), cells, F.lit("</tr>"))
    parts = dealt(m.table("part").withColumn("page", F.floor(F.col("p_partkey") / 50)), "page")  # grouped where they are, so the texts aren't shuffled
    return parts.groupBy("page").agg(F.concat(F.lit("<table>"), F.array_join(F.collect_list(row), ""), F.lit("</table>")).alias("html")).withColumn("deal_type", F.lit("RENT"))


@query(
    """SELECT p_partkey // 50 AS page, 'r' || p_partkey || 'Town' || p_type || ' ' || p_size || (p_size % 4) || p_size || '2/5' || '103-th' AS ad_id, 'https://ads.example/msg/' || p_partkey || '.html' AS link, 'Nice ' || p_name AS comment,
    p_type AS street_name, CAST(p_size AS VARCHAR) AS street_no, p_size % 4 AS rooms, CAST(p_size AS DOUBLE) AS size, 2 AS floor, 5 AS max_floor, 'Series 103' AS project, p_size * 100.0 AS total_price, CAST(p_size * 12000 AS DOUBLE) AS alt_price
    FROM part WHERE p_size % 4 <> 0""".replace("p_size * 100.0", "CAST(p_size * 100 AS DOUBLE)")
)
def s05_flat_listing(m: Market):
    """S05, P12, X01 to X13 on pages."""
    return pages.flat_listing(_flat_pages(m), SITE).select("page", "ad_id", "link", "comment", "street_name", "street_no", "rooms", "size", "floor", "max_floor", "project", "total_price", "alt_price")


@query(
    """SELECT p_partkey, 'h' || p_partkey || p_type || ' ' || p_size || p_size || '2' || '0.1 ha' AS ad_id, p_type AS street_name, CAST(p_size AS VARCHAR) AS street_no, 2 AS floors, CAST(1000 AS DOUBLE) AS land_area_sqm,
    CAST(p_size * 1000 AS DOUBLE) AS total_price, CAST(1000 AS DOUBLE) AS price_per_sqm FROM part WHERE p_partkey % 3 <> 0"""
)
def s06_house_listing(m: Market):
    """Rows without a price go."""
    s = lambda c: F.col(c).cast("string")
    cells = _td("", "", "House", F.concat("p_type", F.lit(" "), s("p_size")), s("p_size"), "2", "", "0.1 ha", F.when(F.col("p_partkey") % 3 == 0, "-").otherwise(F.concat(s("p_size"), F.lit(",000 €"))))
    html = F.concat(F.lit("<table><tr id=h"), s("p_partkey"), F.lit(">"), cells, F.lit("</table>"))
    found = pages.house_listing(dealt(m.table("part"), "p_partkey").select("p_partkey", html.alias("html"), F.lit("SELL").alias("deal_type")), SITE)
    return found.select("p_partkey", "ad_id", "street_name", "street_no", "floors", "land_area_sqm", "total_price", "price_per_sqm")


@query(
    """SELECT p_partkey, p_name || chr(10) || 'call me' AS comment, '+371 ' || p_size AS phone, 'c' || p_size AS contact_id, p_brand AS house_type, 'Lift' AS facilities,
    CASE WHEN p_partkey % 2 = 0 THEN TIMESTAMP '2025-11-03 10:05:00' END AS post_date, p_type AS street_name, CAST(p_size AS VARCHAR) AS street_no FROM part"""
)
def s07_flat_details(m: Market):
    """Message, date, phone, contact, street and options of a flat's page, with cells left open."""
    s = lambda c: F.col(c).cast("string")
    html = F.concat(
        F.lit("<div id=msg_div_msg>"), "p_name", F.lit("<br> call me <table><tr><td>no</table></div><table><tr><td class=ads_opt_name>Street:<td class=ads_opt><b>"), "p_type", F.lit(" "), s("p_size"),
        F.lit(" <a href=#>[Map]</a></b><tr><td class=ads_opt_name>House type:<td class=ads_opt>"), "p_brand", F.lit("<tr><td class=ads_opt_name>Facilities:<td class=ads_opt><b>Lift</b></table><span id=phone_td_1>+371 "), s("p_size"),
        F.lit("</span><a href='/mail/x/c"), s("p_size"), F.lit(".html'>m</a><table><tr><td class=msg_footer>Views<td class=msg_footer>"), F.when(F.col("p_partkey") % 2 == 0, "Date: 03.11.2025 10:05").otherwise("Date: today"), F.lit("</table>"),
    )
    found = pages.flat_details(dealt(m.table("part"), "p_partkey").select("p_partkey", html.alias("html")))
    return found.select("p_partkey", "comment", "phone", "contact_id", "house_type", "facilities", F.col("post_date").cast("timestamp_ntz").alias("post_date"), "street_name", "street_no")


@query("SELECT p_partkey, '+371 ' || p_size AS phone, p_brand AS contact_id, CASE WHEN p_partkey % 2 = 0 THEN TIMESTAMP '2025-11-03' END AS post_date FROM part")
def s08_house_details(m: Market):
    """Two-cell rows, English or Latvian labels, long values skipped."""
    s = lambda c: F.col(c).cast("string")
    html = F.concat(
        F.lit("<table id=page_main><tr><td>Datums:<td>"), F.when(F.col("p_partkey") % 2 == 0, "3.11.2025").otherwise("3 Nov"), F.lit("<tr><td>Phone<td>+371 "), s("p_size"),
        F.lit("<tr><td>Kontakts<td>"), "p_brand", F.lit("<tr><td>Phone<td>"), F.repeat(F.lit("x"), F.lit(101)), F.lit("<tr><td>a<td>b<td>c</table>"),
    )
    found = pages.house_details(dealt(m.table("part"), "p_partkey").select("p_partkey", html.alias("html")))
    return found.select("p_partkey", "phone", "contact_id", F.col("post_date").cast("timestamp_ntz").alias("post_date"))


@query(
    """SELECT p_partkey, p_name AS title_lv, CASE WHEN p_partkey % 2 = 0 THEN 'About' ELSE '' END AS description_lv, TIMESTAMP '2026-04-24 20:00:00' AS start_time, p_size % 60 AS duration_minutes,
    CASE WHEN p_size % 60 < 45 THEN 'not_movie' ELSE 'unknown' END AS content_type FROM part WHERE p_partkey % 3 <> 0"""
)
def s12_programme_listing(m: Market):
    """S12, D03, X20 on pages; blocks without times go."""
    times = F.when(F.col("p_partkey") % 3 == 0, "20:00").otherwise(F.concat(F.lit("20:00 - 20:"), F.lpad((F.col("p_size") % 60).cast("string"), 2, "0")))
    html = F.concat(
        F.lit('<div class="show-expander-content"><h2 class="tet-font__headline--s"> '), "p_name", F.lit('</h2><p class="subtitle"><span>'), times, F.lit("</span> <span>x</span></p>"),
        F.when(F.col("p_partkey") % 2 == 0, '<p class="text tet-font__body--s">About</p>').otherwise(""), F.lit("</div><div class='show-expander-content'><h2>no</h2></div>"),
    )
    found = pages.programme_listing(dealt(m.table("part"), "p_partkey").select("p_partkey", html.alias("html"), F.lit("tv").alias("channel"), F.lit("2026-04-24").cast("date").alias("day")))
    return found.select("p_partkey", "title_lv", "description_lv", F.col("start_time").cast("timestamp_ntz").alias("start_time"), "duration_minutes", "classification.content_type")


@query("SELECT p_partkey, href FROM (SELECT p_partkey, unnest(['/a/' || p_size, '/b/' || p_size || '#c', '/c']) AS href FROM part) WHERE NOT contains(href, '#')")
def s14_article_links(m: Market):
    s = F.col("p_size").cast("string")
    one = lambda *href: F.concat(F.lit('<article><div class="h2_wrap">\n<h2><a class="x" href="'), *href, F.lit('">t</a></h2></div></article>'))
    html = F.concat(one(F.lit("/a/"), s), one(F.lit("/b/"), s, F.lit("#c")), one(F.lit("/c")), F.lit('<a href="/d">d</a>'))
    from ..sources import feeds

    return feeds.article_links(m.table("part").select("p_partkey", html.alias("html")))


@query(
    """SELECT p_partkey, p_name AS title, p_name || 'Intro' AS content, 2 AS image_count, CAST(p_partkey % 2 AS INTEGER) AS video_count, CAST(length(p_name) + 5 AS INTEGER) AS text_length, p_partkey % 2 = 1 AS has_video,
    'https://blog.example/i.png,https://cdn.example/j.png' AS images FROM part"""
)
def s16_articles(m: Market):
    """The article without what surrounds it, addresses made absolute."""
    html = F.concat(
        F.lit("<nav>no</nav><article class='open_article v2'><h1> "), "p_name", F.lit("</h1><a class=com href=/x>5</a><div class=intro>Intro <script>no</script><img data-src='/i.png' src=p><img alt=emotion src=e>"),
        F.when(F.col("p_partkey") % 2 == 1, "<iframe src='https://www.youtube.com/e'></iframe>").otherwise(""), F.lit("</div><p>not this</p><div class=gallery_img><img src='https://cdn.example/j.png'></div></article>"),
    )
    found = pages.articles(dealt(m.table("part"), "p_partkey").select("p_partkey", html.alias("html")), "https://blog.example")
    return found.select("p_partkey", "title", "content", "image_count", "video_count", "text_length", "has_video", F.array_join("images", ",").alias("images"))


@query(
    """WITH parsed AS (SELECT 'r' || p_partkey || 'Town' || p_type || ' ' || p_size || (p_size % 4) || p_size || '2/5' || '103-th' AS ad_id, p_partkey, CAST(p_size * 100 AS DOUBLE) AS total_price, 'Nice ' || p_name AS comment FROM part WHERE p_size % 4 <> 0)
    SELECT ad_id, total_price, comment, true AS seen FROM parsed WHERE p_partkey % 2 = 1
    UNION ALL SELECT ad_id, 1.0, 'stored', true FROM parsed WHERE p_partkey % 2 = 0 UNION ALL SELECT 'gone', 1.0, 'stored', false"""
)
def c01_ingested_ads(m: Market):
    """Parse, prune what is stored, insert the rest, and mark who was seen today."""
    listing = pages.flat_listing(_flat_pages(m), SITE).select("ad_id", "link", "total_price", "comment")
    found = stored_tables.written(listing, "listing")
    even = F.regexp_extract("link", "([0-9]+)", 1).cast("int") % 2 == 0
    stored = found.where(even).select("ad_id", F.lit(1.0).alias("total_price"), F.lit("stored").alias("comment"))
    stored = stored.union(m.spark.createDataFrame([("gone", 1.0, "stored")], stored.schema))
    run = Ingestion(["ad_id"], parse=lambda rows: rows, valid=F.col("total_price") > 0).run(found, stored)
    return run.stored.join(run.seen.withColumn("seen", F.lit(True)), "ad_id", "left").withColumn("seen", F.coalesce("seen", F.lit(False)))


@query("SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'updated' ELSE 'created' END AS action, count(*) AS n FROM orders GROUP BY 1")
def a13_action_counts(m: Market):
    """How many rows a write creates and updates."""
    orders = m.table("orders").select(F.col("o_orderkey").alias("id"))
    stored = orders.where("id % 2 = 0").withColumn("known", F.lit(True))
    return orders.join(stored, "id", "left").groupBy(F.when(F.col("known"), "updated").otherwise("created").alias("action")).agg(F.count("*").alias("n"))


@query("SELECT CAST(ts AS DATE) AS seen_on, count(DISTINCT user_id) AS n FROM events GROUP BY 1")
def st_daily_sightings(m: Market):
    """Streaming: files to one sighting for each ad and day, exactly once over two runs of a scheduled job, counted by day."""
    at = stored_tables.own_folder(m.spark, "sightings")
    events = m.table("events")
    events.select("user_id", "ts").write.parquet(f"{at}/in")
    for _ in range(2):
        seen = stream.read(m.spark, f"{at}/in", "user_id bigint, ts timestamp_ntz").withColumnRenamed("user_id", "ad_id")
        stream.run_once(stream.daily_sightings(seen, late="60 days"), f"{at}/out", f"{at}/state").awaitTermination()
    return m.spark.read.parquet(f"{at}/out").groupBy("seen_on").agg(F.count("*").alias("n"))


@query("SELECT user_id AS ad_id, min(CAST(ts AS DATE)) AS first_seen, max(CAST(ts AS DATE)) AS last_seen, count(*) AS times FROM events GROUP BY user_id")
def st_merged_sightings(m: Market):
    """K04 as a stream: two scheduled runs merge what came into the first and last day and the number of sightings of each ad; a batch that comes again changes nothing."""
    at = stored_tables.own_folder(m.spark, "merged")
    events = m.table("events")
    for k in range(2):
        events.where(F.col("event_id") % 2 == k).select("user_id", "ts").write.mode("append").parquet(f"{at}/in")
        seen = stream.read(m.spark, f"{at}/in", "user_id bigint, ts timestamp_ntz").select(F.col("user_id").alias("ad_id"), F.to_date("ts").alias("first_seen"), F.to_date("ts").alias("last_seen"), F.lit(1).cast("long").alias("times"))
        how = {"first_seen": "min", "last_seen": "max", "times": "sum"}
        merge.merge_sink(seen, f"{at}/out", f"{at}/state", ["ad_id"], how, buckets=8).awaitTermination()
    merge.merge(events.where("event_id % 2 = 1").select(F.col("user_id").alias("ad_id"), F.to_date("ts").alias("first_seen"), F.to_date("ts").alias("last_seen"), F.lit(1).cast("long").alias("times")), 1, f"{at}/out", ["ad_id"], how, buckets=8)
    return merge.merged(m.spark, f"{at}/out")
