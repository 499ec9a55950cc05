"""Loading tables, and the declared schemas of listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table of the folder. Columns and filters are pruned by the reader."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


_TYPES = {"long": T.LongType(), "int": T.IntegerType(), "string": T.StringType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "date": T.DateType(), "timestamp": T.TimestampType()}


def _schema(text: str) -> T.StructType:
    """'name type, ...' as a schema, without a session."""
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (f.split() for f in text.split(", "))])


_AD = (
    "id long, ad_id string, comment string, link string, region_id long, region_name string, district string, street_name string, street_no string, "
    "rooms int, size double, post_date timestamp, seller_id long, price_per_sqm double, total_price double, first_seen timestamp, last_seen timestamp, is_hidden boolean"
)
_FLAT = f"{_AD}, floor int, max_floor int, project_raw string, project_id long, house_type string, facilities string"
_HOUSE = f"{_AD}, floors int, land_area_sqm double"
_RENT = ", monthly_price double, monthly_price_per_sqm double, total_price_120m double, price_per_sqm_120m double"

SCHEMAS = {
    name: _schema(ddl)
    for name, ddl in {
        "project": "id long, name string, description string",
        "region": "id long, name string, url string, category string, parent_id long, scrape_enabled boolean",
        "seller": "id long, phone string, contact_id string",
        "flat_rent": f"{_FLAT}{_RENT}, is_sale_misclassified boolean",
        "flat_sale": _FLAT,
        "house_rent": f"{_HOUSE}{_RENT}",
        "house_sale": _HOUSE,
        "sighting": "ad_id long, seen_on date",
        "vacancy": "id string, company_name string, job_portal_id long, title string, salary_from double, salary_to double, url string, first_seen timestamp, last_seen timestamp, days_open int, vacancy_portal_id string, application_deadline timestamp, state string",
        "industry": "id long, name string",
        "keyword": "id long, name string, only_filter boolean, added timestamp",
        "vacancy_keyword": "vacancy_id string, keyword_id long",
        "vacancy_industry": "vacancy_id string, industry_id long",
        "theme": "id long, name string, analysis_order int",
        "page": "id long, title string, url string, created_at timestamp, has_video boolean, video_count int, image_count int, text_length int",
        "page_analysis": "id long, page_id long, theme_id long, confidence_score double, reasoning_summary string, theme_match boolean, model string, model_tier string",
        "page_analysis_review": "page_analysis_id long, user_id long, analysis_approved boolean, created_at timestamp",
        "channel": "id long, name string, logo_url string, should_scrape boolean",
        "category": "id long, name string",
        "program": "id string, title_lv string, title_eng string, description_lv string, description_eng string, imdb_rating string, pg_rating string, channel_id long, start_time timestamp, duration_minutes int, url string, image_url string, title_match_ratio double, description_match_ratio double, combined_match_ratio double, content_type string, classification_confidence double, classification_reasoning string, tmdb_id string, imdb_id string, enrichment_source string",
        "program_category": "program_id string, category_id long",
    }.items()
}


def jdbc(spark: SparkSession, url: str, table: str, key: str, parts: int, lower: int | None = None, upper: int | None = None, **options: str) -> DataFrame:
    """A table of a relational database, read in `parts` ranges of a numeric key; filters, columns and limits go to the database.

    Without bounds they are asked of the database first (one row). Rows outside of them are read too, by the outermost ranges, those without a key by the
    first. An empty table is read as one part.
    """
    source = spark.read.format("jdbc").options(url=url, **options)
    if lower is None or upper is None:
        least, most = source.option("dbtable", table).load().agg(F.min(key), F.max(key)).first()
        lower, upper = (least if lower is None else lower), (most if upper is None else upper)
    if lower is None or upper is None:
        return source.option("dbtable", table).load()
    return source.options(dbtable=table, partitionColumn=key, numPartitions=parts, lowerBound=int(lower), upperBound=int(upper) + 1).load()


def visible(ads: DataFrame) -> DataFrame:
    """The default view of ads: not hidden, and where rentals are marked, not sales in disguise."""
    out = ads.where("not is_hidden")
    return out.where("not is_sale_misclassified") if "is_sale_misclassified" in ads.columns else out


def all_rows(ads: DataFrame) -> DataFrame:
    return ads
