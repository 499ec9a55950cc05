"""A market of listings laid over the driver's tables, as DataFrames and, for the oracle, as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import parse
from ..sources.tables import load

MOST_PER_SQM = 3000.0  # price per unit of size above which a rental counts as a sale


class Market:
    """regions: TPC regions with nations below them. ads: orders, in the customer's nation. sightings: ship days of an order's lines."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return load(self.spark, self.folder, name)

    def regions(self) -> DataFrame:
        slug = lambda c: F.lower(F.replace(F.col(c), F.lit(" "), F.lit("-")))
        kind = lambda c: F.when(F.col(c) % 2 == 0, "flats").otherwise("homes-summer-residences")
        url = lambda k, n: F.concat(F.lit("https://ads.example/en/real-estate/"), kind(k), F.lit("/"), slug(n), F.lit("/"))
        roots = self.table("region").select(F.col("r_regionkey").cast("long").alias("id"), F.lit(None).cast("long").alias("parent_id"), F.col("r_name").alias("name"), url("r_regionkey", "r_name").alias("url"))
        children = self.table("nation").select((F.col("n_nationkey") + 100).cast("long").alias("id"), F.col("n_regionkey").cast("long").alias("parent_id"), F.col("n_name").alias("name"), url("n_regionkey", "n_name").alias("url"))
        both = roots.union(children)
        return both.select("*", parse.category(F.col("url")).alias("category"), (F.col("id") % 3 != 0).alias("scrape_enabled"))

    def ads(self) -> DataFrame:
        """All ads, rent and sale, hidden ones too."""
        sizes = self.table("lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("size"))
        orders = self.table("orders").join(self.table("customer").select("c_custkey", "c_nationkey", "c_mktsegment", "c_name"), F.col("o_custkey") == F.col("c_custkey"))
        status = F.col("o_orderstatus")
        deal = F.when(status == "O", "RENT").when(status == "F", "SELL").when(F.col("o_orderkey") % 2 == 0, "RENT").otherwise("SELL")
        size = F.coalesce("size", F.lit(0.0))
        per_sqm = parse.per_area(F.col("o_totalprice"), size)
        return orders.join(sizes, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(
            F.col("o_orderkey").alias("id"), (F.col("c_nationkey") + 100).cast("long").alias("region_id"), F.col("c_mktsegment").alias("district"), F.col("c_name").alias("seller"),
            F.left("o_orderpriority", F.lit(1)).cast("int").alias("rooms"), size.alias("size"), F.col("o_totalprice").alias("total_price"), per_sqm.alias("price_per_sqm"),
            deal.alias("deal_type"), (status == "P").alias("is_hidden"), F.col("o_orderdate").alias("first_seen"),
            F.nullif(F.col("o_orderdate"), F.lit("1995-01-01").cast("timestamp_ntz")).alias("post_date"), ((deal == "RENT") & (per_sqm > MOST_PER_SQM)).alias("is_sale_misclassified"),
        )

    def sightings(self) -> DataFrame:
        return self.table("lineitem").select(F.col("l_orderkey").alias("ad_id"), F.to_date("l_shipdate").alias("seen_on")).distinct()

    def seen(self) -> dict[str, DataFrame]:
        """Events as sightings of four kinds."""
        events = self.table("events").select(F.col("user_id").alias("ad_id"), F.to_date("ts").alias("seen_on"), "event_type")
        kinds = {"flat_rent": "view", "flat_sale": "click", "house_rent": "purchase", "house_sale": "signup"}
        return {k: events.where(F.col("event_type") == e).drop("event_type") for k, e in kinds.items()}

    def seen_ads(self) -> DataFrame:
        return self.table("customer").select(F.col("c_custkey").alias("id"), (F.col("c_nationkey") + 100).cast("long").alias("region_id"))

    def keywords(self) -> DataFrame:
        words = [(1, "the"), (2, "de"), (3, "der"), (4, "über"), (5, "Idiot"), (6, "c++"), (7, "outre")]
        return self.spark.createDataFrame(words, "id long, name string")

    def analyses(self) -> DataFrame:
        """Labels as analyses of documents for two themes; the even documents' by the expensive model, some by the cheap one."""
        labels = self.table("labels")
        tier = F.when(F.col("doc_id") % 7 == 0, "cheap").otherwise("expensive")
        one = lambda k, match: labels.select((F.col("doc_id") * 2 + (k - 1)).alias("id"), F.col("doc_id").alias("page_id"), F.lit(k).cast("long").alias("theme_id"), match.alias("theme_match"), tier.alias("model_tier"))
        return one(1, F.col("quality") == 0).union(one(2, F.col("toxic") == 1))

    def themes(self) -> DataFrame:
        return self.spark.createDataFrame([(1, "kid_unfriendly", 2), (2, "toxicity", 1)], "id long, name string, analysis_order int")

    def reviews(self) -> DataFrame:
        a = self.analyses()
        return a.where("page_id % 11 = 0").select(F.col("id").alias("page_analysis_id"), (F.col("id") % 2 == 0).alias("analysis_approved"))

    def programmes(self) -> DataFrame:
        """Parts as programmes: some names hold a film or series word, one type is a film channel."""
        title = F.when(F.col("p_partkey") % 11 == 0, F.concat("p_name", F.lit(" filma"))).when(F.col("p_partkey") % 7 == 0, F.concat("p_name", F.lit(". Seriāls"))).otherwise(F.col("p_name"))
        start = F.to_timestamp_ntz(F.date_add(F.lit("2026-04-01").cast("date"), (F.col("p_partkey") % 28).cast("int")).cast("string")) + F.make_dt_interval(F.lit(0), (F.col("p_partkey") % 24).cast("int"))
        return self.table("part").select(
            F.col("p_partkey").alias("id"), title.alias("title_lv"), F.lit("").alias("description_lv"), F.when(F.col("p_partkey") % 5 == 0, "filmzone hd").otherwise(F.col("p_brand")).alias("channel"),
            F.nullif(F.col("p_size") * 3, F.lit(30)).alias("duration_minutes"), start.alias("start_time"), (F.col("p_partkey") % 4).alias("channel_id"),
            F.element_at(F.array(F.lit("R"), F.lit("PG"), F.lit(None).cast("string")), (F.col("p_partkey") % 3 + 1).cast("int")).alias("pg_rating"),
            F.element_at(F.array(F.lit("10.0"), F.lit("7.5"), F.lit("8"), F.lit("6.9"), F.lit(None).cast("string")), (F.col("p_partkey") % 5 + 1).cast("int")).alias("imdb_rating"),
        )

    def channels(self) -> DataFrame:
        return self.spark.createDataFrame([(0, "ltv1"), (1, "filmzone"), (2, "tv3"), (3, "re:tv")], "id long, name string")

    def vacancies(self) -> DataFrame:
        """Orders as vacancies: those of a day have no deadline, others were never seen again."""
        return self.table("orders").select(
            F.col("o_orderkey").alias("id"), F.nullif(F.col("o_orderdate"), F.lit("1995-01-01").cast("timestamp_ntz")).alias("application_deadline"),
            F.when(F.col("o_orderkey") % 13 != 0, F.date_trunc("month", F.col("o_orderdate")).cast("timestamp_ntz")).alias("last_seen"), F.col("o_orderpriority").alias("title"), F.col("o_totalprice").alias("salary_from"),
        )

    def tags(self) -> DataFrame:
        flags = self.table("lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_returnflag").alias("tag"))
        return flags.union(self.table("lineitem").select("l_orderkey", "l_linestatus")).distinct()


# The same relations for DuckDB, to stand after WITH RECURSIVE.

REGIONS = """
regions AS (
  SELECT id, parent_id, name, url, CASE WHEN contains(url, '/flats/') THEN 'APARTMENT' ELSE 'HOUSE' END AS category, id % 3 <> 0 AS scrape_enabled
  FROM (
    SELECT CAST(r_regionkey AS BIGINT) AS id, CAST(NULL AS BIGINT) AS parent_id, r_name AS name,
           'https://ads.example/en/real-estate/' || CASE WHEN r_regionkey % 2 = 0 THEN 'flats' ELSE 'homes-summer-residences' END || '/' || lower(replace(r_name, ' ', '-')) || '/' AS url
    FROM region
    UNION ALL
    SELECT CAST(n_nationkey + 100 AS BIGINT), CAST(n_regionkey AS BIGINT), n_name,
           'https://ads.example/en/real-estate/' || CASE WHEN n_regionkey % 2 = 0 THEN 'flats' ELSE 'homes-summer-residences' END || '/' || lower(replace(n_name, ' ', '-')) || '/'
    FROM nation
  )
)"""

CLOSURE = f"""{REGIONS},
closure AS (
  SELECT id AS root_id, id AS region_id FROM regions
  UNION ALL
  SELECT c.root_id, r.id FROM closure AS c JOIN regions AS r ON r.parent_id = c.region_id
)"""

ADS = f"""
ads AS (
  SELECT *, deal_type = 'RENT' AND price_per_sqm > {MOST_PER_SQM} AS is_sale_misclassified
  FROM (
    SELECT o_orderkey AS id, CAST(c_nationkey + 100 AS BIGINT) AS region_id, c_mktsegment AS district, c_name AS seller, CAST(left(o_orderpriority, 1) AS INTEGER) AS rooms,
           coalesce(size, 0.0) AS size, o_totalprice AS total_price, CASE WHEN coalesce(size, 0.0) > 0 THEN o_totalprice / size ELSE 0.0 END AS price_per_sqm,
           CASE WHEN o_orderstatus = 'O' THEN 'RENT' WHEN o_orderstatus = 'F' THEN 'SELL' WHEN o_orderkey % 2 = 0 THEN 'RENT' ELSE 'SELL' END AS deal_type,
           o_orderstatus = 'P' AS is_hidden, o_orderdate AS first_seen, nullif(o_orderdate, TIMESTAMP '1995-01-01') AS post_date
    FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN (SELECT l_orderkey, sum(l_quantity) AS size FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey
  )
),
shown AS (SELECT * FROM ads WHERE NOT is_hidden AND NOT is_sale_misclassified)"""

SIGHTINGS = "sightings AS (SELECT DISTINCT l_orderkey AS ad_id, CAST(l_shipdate AS DATE) AS seen_on FROM lineitem)"

SEEN = """
seen AS (
  SELECT user_id AS ad_id, CAST(ts AS DATE) AS seen_on,
         CASE event_type WHEN 'view' THEN 'flat_rent' WHEN 'click' THEN 'flat_sale' WHEN 'purchase' THEN 'house_rent' WHEN 'signup' THEN 'house_sale' END AS kind
  FROM events WHERE event_type IN ('view', 'click', 'purchase', 'signup')
)"""

KEYWORDS = "keywords(id, name) AS (VALUES (1, 'the'), (2, 'de'), (3, 'der'), (4, 'über'), (5, 'Idiot'), (6, 'c++'), (7, 'outre'))"

ANALYSES = """
analyses AS (
  SELECT doc_id * 2 AS id, doc_id AS page_id, 1 AS theme_id, quality = 0 AS theme_match, CASE WHEN doc_id % 7 = 0 THEN 'cheap' ELSE 'expensive' END AS model_tier FROM labels
  UNION ALL
  SELECT doc_id * 2 + 1, doc_id, 2, toxic = 1, CASE WHEN doc_id % 7 = 0 THEN 'cheap' ELSE 'expensive' END FROM labels
),
themes(id, name, analysis_order) AS (VALUES (1, 'kid_unfriendly', 2), (2, 'toxicity', 1)),
reviews AS (SELECT id AS page_analysis_id, id % 2 = 0 AS analysis_approved FROM analyses WHERE page_id % 11 = 0)"""

PROGRAMMES = """
programmes AS (
  SELECT p_partkey AS id, CASE WHEN p_partkey % 11 = 0 THEN p_name || ' filma' WHEN p_partkey % 7 = 0 THEN p_name || '. Seriāls' ELSE p_name END AS title_lv,
         CASE WHEN p_partkey % 5 = 0 THEN 'filmzone hd' ELSE p_brand END AS channel, nullif(p_size * 3, 30) AS duration_minutes,
         CAST(DATE '2026-04-01' + CAST(p_partkey % 28 AS INTEGER) AS TIMESTAMP) + to_hours(CAST(p_partkey % 24 AS INTEGER)) AS start_time, p_partkey % 4 AS channel_id,
         CASE p_partkey % 3 WHEN 0 THEN 'R' WHEN 1 THEN 'PG' END AS pg_rating,
         CASE p_partkey % 5 WHEN 0 THEN '10.0' WHEN 1 THEN '7.5' WHEN 2 THEN '8' WHEN 3 THEN '6.9' END AS imdb_rating
  FROM part
),
channels(id, name) AS (VALUES (0, 'ltv1'), (1, 'filmzone'), (2, 'tv3'), (3, 're:tv'))"""

VACANCIES = """
vacancies AS (
  SELECT o_orderkey AS id, nullif(o_orderdate, TIMESTAMP '1995-01-01') AS application_deadline,
         CASE WHEN o_orderkey % 13 <> 0 THEN CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) END AS last_seen, o_orderpriority AS title, o_totalprice AS salary_from
  FROM orders
),
tags AS (SELECT DISTINCT l_orderkey AS id, l_returnflag AS tag FROM lineitem UNION SELECT DISTINCT l_orderkey, l_linestatus FROM lineitem)"""
