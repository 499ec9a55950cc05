"""Queries on ads, sightings and regions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import classify, parse
from ..operators import grams, labels, medians, pages, regions, search, stats
from ..sources.tables import visible
from .market import ADS, CLOSURE, MOST_PER_SQM, REGIONS, SEEN, SIGHTINGS, Market
from .registry import query

FROM, TO = "1995-06-01", "2001-06-30"
SEEN_FROM, SEEN_TO = "2024-01-05", "2024-01-25"

_STATS = """
  SELECT c.root_id, count(a.id) AS total_ads, round(avg(a.price_per_sqm), 4) AS avg_price_per_sqm, round(avg(a.size), 4) AS avg_size, round(avg(CASE WHEN a.id IS NOT NULL THEN coalesce(s.n, 0) END), 4) AS avg_days_tracked
  FROM closure AS c JOIN roots AS r ON r.id = c.root_id
  LEFT JOIN (SELECT * FROM shown WHERE {deal} AND CAST(first_seen AS DATE) BETWEEN DATE '{lo}' AND DATE '{hi}') AS a ON a.region_id = c.region_id
  LEFT JOIN (SELECT ad_id, count(*) AS n FROM sightings GROUP BY ad_id) AS s ON s.ad_id = a.id
  GROUP BY c.root_id"""


def _rounded(df):
    return df.select("root_id", "total_ads", *[F.round(c, 4).alias(c) for c in ("avg_price_per_sqm", "avg_size", "avg_days_tracked")])


def _stats(m: Market, deal: str, roots):
    ads = visible(m.ads()).where(F.col("deal_type") == deal)
    return _rounded(stats.region_stats(ads, m.sightings(), regions.closure(m.regions()), roots, price="price_per_sqm", date_from=FROM, date_to=TO))


@query(f"WITH RECURSIVE {CLOSURE}, {ADS}, {SIGHTINGS}, roots AS (SELECT id FROM regions WHERE parent_id IS NULL)" + _STATS.format(deal="deal_type = 'RENT'", lo=FROM, hi=TO))
def a01_region_stats_rent(m: Market):
    """The flagship."""
    return _stats(m, "RENT", m.regions().where("parent_id is null"))


@query(f"WITH RECURSIVE {CLOSURE}, {ADS}, {SIGHTINGS}, roots AS (SELECT id FROM regions WHERE category = 'HOUSE')" + _STATS.format(deal="deal_type = 'SELL'", lo=FROM, hi=TO))
def a01_region_stats_sale(m: Market):
    return _stats(m, "SELL", m.regions().where("category = 'HOUSE'"))


@query(
    f"""WITH RECURSIVE {CLOSURE}, {ADS}
    SELECT c.root_id, count(a.id) AS total_ads, CAST(NULL AS DOUBLE) AS avg_price_per_sqm, CAST(NULL AS DOUBLE) AS avg_size, CAST(NULL AS DOUBLE) AS avg_days_tracked
    FROM closure AS c JOIN regions AS r ON r.id = c.root_id AND r.parent_id IS NULL
    LEFT JOIN (SELECT * FROM shown WHERE CAST(first_seen AS DATE) BETWEEN DATE '{FROM}' AND DATE '{TO}') AS a ON a.region_id = c.region_id GROUP BY c.root_id"""
)
def a02_region_totals(m: Market):
    ads = visible(m.ads())
    roots = m.regions().where("parent_id is null")
    return stats.region_totals(ads.where("deal_type = 'RENT'"), ads.where("deal_type = 'SELL'"), regions.closure(m.regions()), roots, date_from=FROM, date_to=TO)


@query(f"WITH RECURSIVE {CLOSURE}, {ADS}, {SIGHTINGS}, roots AS (SELECT id FROM regions WHERE parent_id = 3 OR id = 2)" + _STATS.format(deal="deal_type = 'RENT' AND district = 'BUILDING' AND region_id % 2 = 0", lo=FROM, hi=TO))
def a03_child_region_stats(m: Market):
    """A region's children, those without ads too."""
    ads = visible(m.ads()).where("deal_type = 'RENT' and district = 'BUILDING' and region_id % 2 = 0")
    roots = m.regions().where("parent_id = 3 or id = 2")
    return _rounded(stats.region_stats(ads, m.sightings(), regions.closure(m.regions()), roots, price="price_per_sqm", date_from=FROM, date_to=TO))


@query(f"WITH RECURSIVE {CLOSURE} SELECT root_id, region_id FROM closure")
def j09_closure(m: Market):
    return regions.closure(m.regions())


@query(
    f"""WITH RECURSIVE {REGIONS}, paths AS (
      SELECT id, 0 AS depth, [id] AS path FROM regions WHERE parent_id IS NULL UNION ALL SELECT r.id, depth + 1, list_append(path, r.id) FROM paths AS p JOIN regions AS r ON r.parent_id = p.id
    ), placed AS (SELECT *, row_number() OVER (ORDER BY path) - 1 AS first FROM paths)
    SELECT id, CAST(depth AS INTEGER) AS depth, first, first + (SELECT count(*) FROM placed AS b WHERE list_contains(b.path, a.id)) - 1 AS last FROM placed AS a"""
)
def j09_labels(m: Market):
    """J09 as intervals: a region's number in a walk from the roots, and the largest one below it."""
    return labels.labels(m.regions())


def _labelled_stats(m: Market, ads, roots):
    return _rounded(labels.region_stats(ads, m.sightings(), labels.labels(m.regions()), roots, price="price_per_sqm", date_from=FROM, date_to=TO))


@query(f"WITH RECURSIVE {CLOSURE}, {ADS}, {SIGHTINGS}, roots AS (SELECT id FROM regions)" + _STATS.format(deal="deal_type = 'RENT'", lo=FROM, hi=TO))
def a01_region_stats_by_label(m: Market):
    """Every region's tree, by running sums in the order of labels."""
    return _labelled_stats(m, visible(m.ads()).where("deal_type = 'RENT'"), m.regions())


@query(f"WITH RECURSIVE {CLOSURE}, {ADS}, {SIGHTINGS}, roots AS (SELECT id FROM regions WHERE parent_id = 3 OR id = 2)" + _STATS.format(deal="deal_type = 'RENT' AND district = 'BUILDING' AND region_id % 2 = 0", lo=FROM, hi=TO))
def a03_child_region_stats_by_label(m: Market):
    """A03, J09, J10 from labels."""
    ads = visible(m.ads()).where("deal_type = 'RENT' and district = 'BUILDING' and region_id % 2 = 0")
    return _labelled_stats(m, ads, m.regions().where("parent_id = 3 or id = 2"))


_REGION_ADS = f"""WITH RECURSIVE {CLOSURE}, {ADS}, {SIGHTINGS}
    SELECT a.id, a.region_id, a.total_price, coalesce(s.n, 0) AS days_active FROM shown AS a
    LEFT JOIN (SELECT ad_id, count(*) AS n FROM sightings GROUP BY ad_id) AS s ON s.ad_id = a.id
    WHERE a.deal_type = 'SELL' AND CAST(first_seen AS DATE) BETWEEN DATE '{FROM}' AND DATE '{TO}' AND a.region_id IN (SELECT region_id FROM closure WHERE root_id = 2)"""


@query(_REGION_ADS)
def a09_region_ads_by_label(m: Market):
    """A region's tree as a range."""
    ads = visible(m.ads()).where("deal_type = 'SELL'")
    return labels.region_ads(ads, m.sightings(), labels.labels(m.regions()), 2, date_from=FROM, date_to=TO).select("id", "region_id", "total_price", "days_active")


@query(_REGION_ADS)
def a09_region_ads(m: Market):
    """All ads of a region's tree, newest first."""
    ads = visible(m.ads()).where("deal_type = 'SELL'")
    return stats.region_ads(ads, m.sightings(), regions.closure(m.regions()), 2, date_from=FROM, date_to=TO).select("id", "region_id", "total_price", "days_active")


@query(f"WITH {SIGHTINGS} SELECT ad_id, count(*) AS n FROM sightings GROUP BY ad_id")
def a09_days_active(m: Market):
    return stats.days_active(m.sightings())


_REPORT = """
  SELECT seen_on, count(*) FILTER (kind = 'flat_rent') AS flat_rent, count(*) FILTER (kind = 'flat_sale') AS flat_sale, count(*) FILTER (kind = 'house_rent') AS house_rent,
         count(*) FILTER (kind = 'house_sale') AS house_sale, count(*) FILTER (kind LIKE 'flat%') AS flats, count(*) FILTER (kind LIKE 'house%') AS houses, count(*) AS total
  FROM seen"""
_IN_RANGE = f"WHERE seen_on BETWEEN DATE '{SEEN_FROM}' AND DATE '{SEEN_TO}'"


@query(f"WITH {SEEN} {_REPORT} {_IN_RANGE} GROUP BY seen_on ORDER BY seen_on DESC")
def a05_daily_report(m: Market):
    """Four series aligned by day, one shuffle."""
    return stats.daily_report(m.seen(), date_from=SEEN_FROM, date_to=SEEN_TO)


@query(
    f"""WITH RECURSIVE {CLOSURE}, {SEEN} {_REPORT} JOIN customer ON c_custkey = ad_id {_IN_RANGE}
    AND c_nationkey + 100 IN (SELECT region_id FROM closure WHERE root_id = 1) GROUP BY seen_on ORDER BY seen_on"""
)
def j04_daily_report_of_region(m: Market):
    """Sightings of a region's ads, through the ads and without their visibility."""
    own = regions.closure(m.regions()).where("root_id = 1")
    return stats.daily_report(m.seen(), date_from=SEEN_FROM, date_to=SEEN_TO, direction="asc", regions=own, ads=m.seen_ads())


@query(
    f"""WITH {SEEN}, report AS ({_REPORT} {_IN_RANGE} GROUP BY seen_on)
    SELECT count(*) AS days_with_data, CAST(round(sum(flats) / count(*)) AS BIGINT) AS avg_flats, CAST(round(sum(houses) / count(*)) AS BIGINT) AS avg_houses, CAST(sum(total) AS BIGINT) AS total_sightings FROM report"""
)
def a10_report_header(m: Market):
    return stats.report_header(stats.daily_report(m.seen(), date_from=SEEN_FROM, date_to=SEEN_TO))


@query(f"WITH {SEEN} SELECT seen_on, count(*) AS n FROM seen WHERE kind = 'flat_rent' GROUP BY seen_on")
def a04_counts_by_day(m: Market):
    return stats.counts_by_day(m.seen()["flat_rent"])


# Lists and search over ads.


@query(
    f"""WITH {ADS} SELECT id, district, rooms, price_per_sqm, post_date FROM shown
    WHERE deal_type = 'RENT' AND district = 'MACHINERY' AND rooms = 3 AND price_per_sqm BETWEEN 100 AND 2500 ORDER BY post_date DESC NULLS FIRST, id"""
)
def p02_filtered_ads(m: Market):
    """P01, P02, P15, T01."""
    ads = visible(m.ads()).where("deal_type = 'RENT'")
    wanted = search.AdFilter(district="MACHINERY", rooms="3", price_min=100, price_max="2500")
    return search.filtered_ads(ads, wanted, price="price_per_sqm").select("id", "district", "rooms", "price_per_sqm", "post_date")


@query(f"WITH {ADS} SELECT id, post_date FROM shown WHERE deal_type = 'SELL' ORDER BY post_date DESC NULLS FIRST, id LIMIT 50 OFFSET 50")
def t07_second_page(m: Market):
    """50 a page; blank conditions are left out."""
    ads = visible(m.ads()).where("deal_type = 'SELL'")
    return search.paged(search.filtered_ads(ads, search.AdFilter(district=" ", rooms=""), price="price_per_sqm"), "2").select("id", "post_date")


_SALES = f"WITH {ADS}, ordered AS (SELECT id, post_date, row_number() OVER (ORDER BY post_date DESC NULLS FIRST, id) - 1 AS place FROM shown WHERE deal_type = 'SELL')"


@query(f"{_SALES} SELECT id, post_date, CAST(place // 50 + 1 AS INTEGER) AS page FROM ordered WHERE place // 50 + 1 IN (1, 2, 37, (SELECT (max(place) // 50) + 1 FROM ordered))")
def t07_deep_pages(m: Market):
    """Pages far apart and the last one, each from the ranges that it lies in."""
    ads = visible(m.ads()).where("deal_type = 'SELL'").select("id", "post_date")
    index = pages.build(ads, [F.desc_nulls_first("post_date"), F.asc("id")], range_rows=500)
    last = -(-index.rows // 50)
    asked = [p for p in dict.fromkeys((1, 2, 37, last)) if p <= last]
    return reduce(DataFrame.union, [pages.page(index, p).withColumn("page", F.lit(p)) for p in asked])


@query(
    f"""WITH {ADS}, n AS (SELECT count(*) AS total FROM shown), p AS (SELECT total, CAST(page AS BIGINT) AS page FROM n, (SELECT unnest([1, 3, 7]) AS page))
    SELECT page, total, CAST(ceil(total / 50) AS BIGINT) AS num_pages, (page - 1) * 50 + 1 AS start_index, least(page * 50, total) AS end_index,
           greatest(page - 2, 1) AS first_page, least(page + 2, CAST(ceil(total / 50) AS BIGINT)) AS last_page FROM p"""
)
def t08_page_window(m: Market):
    """T08, A06."""
    total = visible(m.ads()).agg(F.count("*").alias("total"))
    pages = total.withColumn("page", F.explode(F.array(*[F.lit(p).cast("long") for p in (1, 3, 7)])))
    return pages.select("page", "total", *search.page_window(F.col("total"), F.col("page"), 50))


@query(f"WITH {ADS} SELECT district, count(*) AS n FROM ads GROUP BY district")
def p18_facet(m: Market):
    return search.facet(m.ads(), "district")


_ADMIN = f"WITH {ADS}, {REGIONS} SELECT a.id FROM ads AS a LEFT JOIN regions AS r ON r.id = a.region_id WHERE (contains(lower(district), 'build') OR contains(lower(seller), 'build') OR contains(lower(name), 'build')) AND (contains(lower(district), '1') OR contains(lower(seller), '1') OR contains(lower(name), '1'))"


@query(_ADMIN)
def p17_admin_search(m: Market):
    """Every word in some column, joined ones too."""
    names = regions.small(m.regions().select(F.col("id").alias("region_id"), "name"))
    return search.admin_search(m.ads().join(names, "region_id", "left"), "Build 1", ["district", "seller", "name"]).select("id")


@query(_ADMIN)
def p17_search_by_trigrams(m: Market):
    """The rows that hold all trigrams of a word are looked at, the others aren't."""
    names = regions.small(m.regions().select(F.col("id").alias("region_id"), "name"))
    rows, columns = m.ads().join(names, "region_id", "left").select("id", "district", "seller", "name"), ["district", "seller", "name"]
    return grams.search(rows, grams.index(rows, "id", columns), "Build 1", columns).select("id")


@query(f"WITH {ADS} SELECT DISTINCT district FROM shown ORDER BY district")
def t06_districts(m: Market):
    """T05, T06, P15."""
    return visible(m.ads()).select("district").distinct().orderBy("district")


@query(f"WITH {ADS} SELECT id, post_date FROM ads WHERE post_date IS NULL AND NOT is_hidden")
def p07_without_date(m: Market):
    return m.ads().where("post_date is null and not is_hidden").select("id", "post_date")


@query("SELECT id FROM (SELECT o_orderkey AS id FROM orders) WHERE false")
def p14_nothing(m: Market):
    """A relation known to be empty."""
    return m.ads().where(F.lit(False)).select("id")


@query(f"WITH {REGIONS} SELECT id, url FROM regions WHERE contains(url, '/flats/') AND NOT contains(url, 'asia') AND name = 'ASIA' OR id = 104")
def p16_point_lookup(m: Market):
    """P06, P16."""
    url = F.col("url")
    return m.regions().where(url.contains("/flats/") & ~url.contains("asia") & (F.col("name") == "ASIA") | (F.col("id") == 104)).select("id", "url")


# Regions.


@query(f"WITH {REGIONS} SELECT category, count(*) AS total, count(*) FILTER (scrape_enabled) AS enabled FROM regions GROUP BY category")
def a11_enabled_counts(m: Market):
    return regions.enabled_counts(m.regions())


@query(
    f"""WITH {REGIONS} SELECT r.id AS root_id, r.name AS root_name, r.scrape_enabled AS root_enabled, c.id AS child_id, c.name AS child_name, c.scrape_enabled AS child_enabled
    FROM regions AS r LEFT JOIN regions AS c ON c.parent_id = r.id AND NOT contains(c.url, '/homes-summer-residences/') WHERE r.parent_id IS NULL AND NOT contains(r.url, '/homes-summer-residences/')"""
)
def p06_region_config(m: Market):
    """By what the address contains."""
    return regions.region_config(m.regions(), "APARTMENT", by_url=True)


@query(
    f"""WITH {REGIONS} SELECT id, url, CASE WHEN url IN ('https://ads.example/en/real-estate/flats/asia/', 'https://ads.example/en/real-estate/flats/china/') THEN true
    WHEN contains(url, '/homes-summer-residences/') THEN false ELSE scrape_enabled END AS scrape_enabled FROM regions"""
)
def k14_set_enabled(m: Market):
    """The posted addresses are crawled, of whatever kind."""
    urls = ["https://ads.example/en/real-estate/flats/asia/", "https://ads.example/en/real-estate/flats/china/"]
    return regions.set_enabled(m.regions(), "HOUSE", urls).select("id", "url", "scrape_enabled")


_FRONTIER = f"""WITH {REGIONS}, frontier AS (
  SELECT id AS region_id, deal_type, page, url || suffix || CASE WHEN page = 1 THEN '' ELSE 'page' || page || '.html' END AS url
  FROM regions, (VALUES ('hand_over/', 'RENT'), ('sell/', 'SELL')) AS d(suffix, deal_type), (SELECT unnest(generate_series(1, 10)) AS page) WHERE scrape_enabled AND category = 'APARTMENT'
)"""


@query(f"{_FRONTIER} SELECT region_id, deal_type, CAST(page AS INTEGER) AS page, url FROM frontier")
def s03_frontier(m: Market):
    """S03, S04."""
    return regions.frontier(m.regions(), "APARTMENT", 10)


@query(
    f"""{_FRONTIER} SELECT region_id, deal_type, CAST(page AS INTEGER) AS page FROM frontier AS f
    WHERE page <= coalesce((SELECT min(page) FROM frontier AS g WHERE g.region_id = f.region_id AND g.deal_type = f.deal_type AND (g.region_id + g.page * length(g.deal_type)) % 6 = 0), 99)"""
)
def c02_until_empty(m: Market):
    """A deal type's pages up to the first empty one."""
    pages = regions.frontier(m.regions(), "APARTMENT", 10)
    rows = (F.col("region_id") + F.col("page") * F.length("deal_type")) % 6
    return regions.until_empty(pages, rows).select("region_id", "deal_type", "page")


_LAST = f"""{ADS}, numbered AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS ad_id FROM lineitem WHERE CAST(l_shipdate AS DATE) = DATE '1998-03-05'),
point AS (SELECT max(region_id) AS region_id FROM (SELECT deal_type, max_by(region_id, n.id) AS region_id FROM numbered AS n JOIN ads AS a ON a.id = n.ad_id GROUP BY deal_type))"""


def _resume(m: Market):
    seen = m.table("lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_orderkey").alias("ad_id"), F.to_date("l_shipdate").alias("seen_on"))
    return regions.resume_region(seen, m.ads(), F.lit("1998-03-05").cast("date"))


@query(f"WITH {_LAST} SELECT region_id FROM point")
def w01_resume_region(m: Market):
    """The region of the day's last sighting, by deal type, the larger of both."""
    return _resume(m)


@query(f"WITH {REGIONS}, {_LAST} SELECT id FROM regions, point WHERE scrape_enabled AND (region_id IS NULL OR (id >= region_id AND region_id IN (SELECT id FROM regions WHERE scrape_enabled)))")
def w02_resumed_regions(m: Market):
    return regions.resumed(m.regions(), _resume(m)).select("id")


_LINKS = f"""{REGIONS}, links AS (
  SELECT '/lv/flats/' AS page_path, '/lv/flats/' || lower(replace(name, ' ', '-')) || '/' AS href, CASE WHEN id % 2 = 0 THEN name || ', all' ELSE '' END AS title, CASE WHEN id % 3 = 0 THEN '' ELSE name END AS text FROM regions WHERE parent_id IS NULL
  UNION ALL
  SELECT '/lv/flats/' || lower(replace(p.name, ' ', '-')) || '/', '/lv/flats/' || lower(replace(p.name, ' ', '-')) || '/' || lower(replace(c.name, ' ', '-')) || CASE WHEN c.id % 4 = 0 THEN '/x/' WHEN c.id % 5 = 0 THEN '/?s=1' ELSE '/' END,
         '', CASE WHEN c.id % 3 = 0 THEN '' ELSE c.name END FROM regions AS c JOIN regions AS p ON p.id = c.parent_id
  UNION ALL SELECT '/lv/flats/', '/lv/flats/all/', '', 'All'
),
crawled AS (
  SELECT DISTINCT CASE WHEN title <> '' THEN trim(split_part(title, ',', 1)) WHEN text <> '' THEN text
         ELSE array_to_string(list_transform(string_split(replace(list_extract(string_split(rtrim(regexp_replace(href, '[?#].*$', ''), '/'), '/'), -1), '-', ' '), ' '), lambda w: upper(left(w, 1)) || substr(w, 2)), ' ') END AS name,
         replace('https://ads.example' || regexp_replace(href, '[?#].*$', ''), '/lv/', '/en/') AS url, CASE WHEN page_path <> '/lv/flats/' THEN replace('https://ads.example' || page_path, '/lv/', '/en/') END AS parent_url
  FROM (SELECT *, trim(substr(regexp_replace(href, '[?#].*$', ''), length(page_path) + 1), '/') AS rest FROM links)
  WHERE starts_with(href, page_path) AND rest <> '' AND NOT contains(rest, '/') AND rest <> 'all'
)"""


def _crawled(m: Market):
    slug = lambda c: F.lower(F.replace(F.col(c), F.lit(" "), F.lit("-")))
    r = m.regions()
    roots = r.where("parent_id is null").select(
        F.lit("/lv/flats/").alias("page_path"), F.concat(F.lit("/lv/flats/"), slug("name"), F.lit("/")).alias("href"),
        F.when(F.col("id") % 2 == 0, F.concat("name", F.lit(", all"))).otherwise("").alias("title"), F.when(F.col("id") % 3 == 0, "").otherwise(F.col("name")).alias("text"),
    )
    c = r.alias("c").join(r.alias("p"), F.col("p.id") == F.col("c.parent_id"))
    page = F.concat(F.lit("/lv/flats/"), slug("p.name"), F.lit("/"))
    end = F.when(F.col("c.id") % 4 == 0, "/x/").when(F.col("c.id") % 5 == 0, "/?s=1").otherwise("/")
    children = c.select(page.alias("page_path"), F.concat(page, slug("c.name"), end).alias("href"), F.lit("").alias("title"), F.when(F.col("c.id") % 3 == 0, "").otherwise(F.col("c.name")).alias("text"))
    every = m.spark.createDataFrame([("/lv/flats/", "/lv/flats/all/", "", "All")], roots.schema)
    return regions.crawled_tree(roots.union(children).union(every), "https://ads.example", "/lv/flats/")


@query(f"WITH {_LINKS} SELECT name, url, parent_url FROM crawled")
def s18_crawled_tree(m: Market):
    """S18, S19, X26."""
    return _crawled(m)


_STORED = "stored AS (SELECT row_number() OVER (ORDER BY url) AS id, 'old ' || name AS name, url, 'APARTMENT' AS category, CAST(NULL AS BIGINT) AS parent_id, false AS scrape_enabled FROM crawled WHERE parent_url IS NULL AND length(name) > 4)"


@query(
    f"""WITH {_LINKS}, {_STORED}, known_roots AS (SELECT url FROM crawled WHERE parent_url IS NULL UNION SELECT url FROM stored),
    new AS (
      SELECT (SELECT max(id) FROM stored) + row_number() OVER (ORDER BY parent_url IS NOT NULL, url) AS id, name, url, parent_url, parent_url IS NOT NULL AS scrape_enabled
      FROM crawled WHERE url NOT IN (SELECT url FROM stored) AND (parent_url IS NULL OR parent_url IN (SELECT url FROM known_roots))
    ), merged AS (
      SELECT s.id, coalesce(c.name, s.name) AS name, s.url, c.parent_url, s.scrape_enabled FROM stored AS s LEFT JOIN crawled AS c ON c.url = s.url
      UNION ALL SELECT id, name, url, parent_url, scrape_enabled FROM new
    )
    SELECT m.id, m.name, m.url, 'APARTMENT' AS category, p.id AS parent_id, m.scrape_enabled FROM merged AS m LEFT JOIN merged AS p ON p.url = m.parent_url"""
)
def k07_synchronised_regions(m: Market):
    """Names refreshed, new roots and children added under new ids."""
    from pyspark.sql import Window

    crawled = _crawled(m)
    stored = crawled.where("parent_url is null and length(name) > 4").select(
        F.row_number().over(Window.orderBy("url")).cast("long").alias("id"), F.concat(F.lit("old "), "name").alias("name"), "url", F.lit("APARTMENT").alias("category"), F.lit(None).cast("long").alias("parent_id"), F.lit(False).alias("scrape_enabled")
    )
    return regions.synchronised(stored, crawled, "APARTMENT")


# The study of rentals that are sales.

_RENTALS = f"{ADS}, rentals AS (SELECT * FROM ads WHERE deal_type = 'RENT')"


@query(f"WITH {_RENTALS} SELECT CAST(len(list_filter([200, 500, 1000, 2000, 5000], lambda e: price_per_sqm >= e)) AS INTEGER) AS bucket, count(*) AS n FROM rentals GROUP BY 1")
def a12_price_histogram(m: Market):
    return stats.price_histogram(m.ads().where("deal_type = 'RENT'"), "price_per_sqm", (200, 500, 1000, 2000, 5000))


_STRATEGIES = f"""WITH {_RENTALS}, rows AS (
      SELECT price_per_sqm AS price, total_price AS total, unnest([{{'s': 'none', 'g': false}}, {{'s': 'price', 'g': price_per_sqm > {MOST_PER_SQM}}}, {{'s': 'words', 'g': contains(lower(seller), '77')}},
             {{'s': 'both', 'g': price_per_sqm > {MOST_PER_SQM} OR contains(lower(seller), '77')}}]) AS r FROM rentals
    )
    SELECT r.s AS strategy, count(*) FILTER (NOT r.g) AS kept, count(*) FILTER (r.g) AS removed, round(avg(price) FILTER (NOT r.g), 4) AS avg_price, round(median(price) FILTER (NOT r.g), 4) AS median_price, round(avg(total) FILTER (NOT r.g), 4) AS avg_total
    FROM rows GROUP BY r.s"""


@query(_STRATEGIES)
def a12_strategies(m: Market):
    """What each filter leaves."""
    price, words = F.col("price_per_sqm") > MOST_PER_SQM, classify.contains_any(F.col("seller"), ("77",))
    out = stats.strategies(m.ads().where("deal_type = 'RENT'"), "price_per_sqm", "total_price", {"price": price, "words": words, "both": price | words})
    return out.select("strategy", "kept", "removed", *[F.round(c, 4).alias(c) for c in ("avg_price", "median_price", "avg_total")])


@query(_STRATEGIES)
def a12_strategies_by_selection(m: Market):
    """Medians between bounds from sketches, narrowed down until few values are left (here 200)."""
    price, words = F.col("price_per_sqm") > MOST_PER_SQM, classify.contains_any(F.col("seller"), ("77",))
    rentals = m.ads().where("deal_type = 'RENT'")
    out = medians.strategies(rentals, "price_per_sqm", "total_price", {"price": price, "words": words, "both": price | words}, most=200)
    return out.select("strategy", "kept", "removed", *[F.round(c, 4).alias(c) for c in ("avg_price", "median_price", "avg_total")])


@query(
    f"""WITH {_RENTALS}, told AS (
      SELECT price_per_sqm AS price, total_price AS total, price_per_sqm > {MOST_PER_SQM} AS dear, district || CASE WHEN id % 7 = 0 THEN ' ar izpirkuma tiesībām' WHEN id % 5 = 0 THEN ' ikdienas pirkumiem' WHEN id % 11 = 0 THEN ' PĀRDOD' ELSE '' END AS comment FROM rentals
    ), rows AS (
      SELECT price, total, unnest([{{'s': 'none', 'g': false}}, {{'s': 'A', 'g': dear}}, {{'s': 'B', 'g': contains(lower(comment), 'pirkum') OR contains(lower(comment), 'pārdod')}},
        {{'s': 'C', 'g': dear OR contains(lower(comment), 'pirkum') OR contains(lower(comment), 'pārdod')}}, {{'s': 'C+', 'g': dear OR contains(lower(comment), 'izpirkum') OR contains(lower(comment), 'pārdod')}}]) AS r FROM told
    )
    SELECT r.s AS strategy, count(*) FILTER (NOT r.g) AS kept, count(*) FILTER (r.g) AS removed, round(avg(price) FILTER (NOT r.g), 4) AS avg_price, round(median(price) FILTER (NOT r.g), 4) AS median_price, round(avg(total) FILTER (NOT r.g), 4) AS avg_total
    FROM rows GROUP BY r.s"""
)
def a12_refined_strategies(m: Market):
    """Price, words of the broad list, both, and C+ with the refined words, which keeps ads that speak of shopping."""
    more = F.when(F.col("id") % 7 == 0, " ar izpirkuma tiesībām").when(F.col("id") % 5 == 0, " ikdienas pirkumiem").when(F.col("id") % 11 == 0, " PĀRDOD").otherwise("")
    rentals = m.ads().where("deal_type = 'RENT'").withColumn("comment", F.concat("district", more))
    out = medians.strategies(rentals, "price_per_sqm", "total_price", classify.sale_strategies(F.col("comment"), F.col("price_per_sqm"), most=MOST_PER_SQM))
    return out.select("strategy", "kept", "removed", *[F.round(c, 4).alias(c) for c in ("avg_price", "median_price", "avg_total")])


@query(f"WITH {_RENTALS} SELECT seller AS district, count(*) AS n, count(*) FILTER (price_per_sqm > 1500) AS removed, round(count(*) FILTER (price_per_sqm > 1500) * 100 / count(*), 2) AS removed_percent, count(*) FILTER (price_per_sqm > 1500) = count(*) AS all_removed FROM rentals GROUP BY seller")
def a12_by_district(m: Market):
    """Share removed by district, and districts that go whole (here: sellers)."""
    ads = m.ads().where("deal_type = 'RENT'").withColumn("district", F.col("seller"))
    return stats.by_district(ads, F.col("price_per_sqm") > 1500)


@query(f"WITH {SEEN} SELECT seen_on, count(*) AS total FROM seen {_IN_RANGE} GROUP BY seen_on ORDER BY seen_on DESC LIMIT 1")
def t04_direction(m: Market):
    """A direction that isn't known means the latest day first."""
    return stats.daily_report(m.seen(), date_from=SEEN_FROM, date_to=SEEN_TO, direction="sideways").select("seen_on", "total").limit(1)


@query(f"WITH {REGIONS} SELECT id, name, CAST(row_number() OVER (ORDER BY lower(name), id) AS INTEGER) AS place FROM regions")
def t05_collated_names(m: Market):
    """Names in the order of a collation, whatever their case."""
    names = m.regions().select("id", F.when(F.col("id") % 2 == 0, F.lower("name")).otherwise(F.col("name")).alias("shown"), "name")
    place = F.row_number().over(Window.orderBy(search.text_order("shown", "UNICODE_CI"), "id"))  # the regions are few
    return names.select("id", "name", place.alias("place"))


@query("SELECT p_partkey AS id, CASE WHEN p_size % 3 = 0 THEN '—' ELSE format('{:,.2f}', p_retailprice * p_size) END AS label FROM part")
def k18_dashes(m: Market):
    """Numbers as texts; zero and null show as a dash."""
    price = F.when(F.col("p_size") % 3 != 0, F.col("p_retailprice") * F.col("p_size")).when(F.col("p_size") % 2 == 0, F.lit(0.0))
    return m.table("part").select(F.col("p_partkey").alias("id"), parse.dash_if_zero(price, 2).alias("label"))
