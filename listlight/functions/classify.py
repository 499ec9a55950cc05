"""Ordered rules over listings, programmes and texts, as CASE expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.stored import small

# Sale vocabulary in rental comments (Latvian with and without accents, Russian).
SALE_WORDS = ("pārdod", "pārdošan", "pārdots", "izpirkum", "pirkt", "pardod", "pardosan", "pardots", "продаётся", "Продаем", "Продается", "Продам")
BROAD_SALE_WORD = "pirkum"  # of an earlier list, instead of izpirkum: also in words for everyday shopping
MOST_RENT_PER_SQM = 50

# Words in a title or description that mark programmes other than films.
SERIES_MARKERS = ("seriāls", "telenovele", "cikls", "raidījums", "šovs", "ziņas", "panorāma", "intervija", "koncerts", "hronika", "sērija", "studija", "saeima", "sarunu", "brokastis", "jautājums", "rīta ")
# Words in a title that mark films; parts of the names of film channels.
FILM_MARKERS = ("filma", "kinofilma")
FILM_CHANNELS = ("filmzone", "kinopolska", "tv1000", "kino")
# Titles of local programmes that are not listed.
EXCLUDED_TITLES = (
    "Aizliegtais paņēmiens", "Gudrs, vēl gudrāks", "V.I.P. - Veiksme. Intuīcija. Prāts", "Kas notiek Latvijā?", "Kas skatāms Filmzone?",
    "Panorāma", "Dienas ziņas", "Krustpunktā", "Rīta Panorāma", "Laika ziņas", "Sporta ziņas", "Nakts ziņas", "Kultūras ziņas", "Saki Jā!",
    "Spiegu spēles", "De Facto", "Basketbols.Basketbols: NBA.", "Leģendārais loms", "Aculiecinieks", "1 :1. Aktuālā intervija",
    "Sporta studija", "Autoziņas", "Bez Tabu", "900 sekundes", "Kultūršoks", "SuperBingo", "Kobra 17", "Tāskmāsters", "UgunsGrēks 4", "Vides fakti",
)


def contains_any(text: Column, words: tuple[str, ...]) -> Column:
    """Case-insensitive, accent-sensitive; false for null."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return reduce(lambda a, b: a | b, [low.contains(w.lower()) for w in words])


def first_of(text: Column, words: tuple[str, ...]) -> Column:
    """The first of words, in their order, that text contains; null if none."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.coalesce(*[F.when(low.contains(w.lower()), F.lit(w)) for w in words])


def is_sale_in_disguise(comment: Column, monthly_price_per_sqm: Column, words: tuple[str, ...] = SALE_WORDS, most: float = MOST_RENT_PER_SQM) -> Column:
    """A rental whose price or vocabulary is that of a sale."""
    return F.coalesce(monthly_price_per_sqm > most, F.lit(False)) | contains_any(comment, words)


def sale_strategies(comment: Column, monthly_price_per_sqm: Column, words: tuple[str, ...] = SALE_WORDS, broad: tuple[str, ...] = (*SALE_WORDS, BROAD_SALE_WORD), most: float = MOST_RENT_PER_SQM) -> dict[str, Column]:
    """The filters of the price study, true where an ad goes: A by price, B by words of the earlier, broad list, C by both, C+ by price and refined words."""
    price = F.coalesce(monthly_price_per_sqm > most, F.lit(False))
    return {"A": price, "B": contains_any(comment, broad), "C": price | contains_any(comment, broad), "C+": price | contains_any(comment, words)}


def is_film_channel(channel: Column) -> Column:
    key = F.translate(F.lower(F.coalesce(channel, F.lit(""))), " -", "__")
    return reduce(lambda a, b: a | b, [key.contains(n) for n in FILM_CHANNELS])


def duration(minutes: Column) -> Column:
    """Minutes, at least 0; null stays null."""
    return F.when(minutes.isNotNull(), F.greatest(minutes.cast("int"), F.lit(0)))


def programme(title: Column, description: Column, channel: Column, minutes: Column) -> Column:
    """struct(content_type, confidence, reasoning) by the first rule that applies."""
    title, description = F.coalesce(title, F.lit("")), F.coalesce(description, F.lit(""))
    both = F.concat(title, F.lit(" "), description)
    film, other = first_of(title, FILM_MARKERS), first_of(both, SERIES_MARKERS)
    long, on_film_channel = duration(minutes), is_film_channel(channel)

    def verdict(kind: str, confidence: float, reason: Column | str) -> Column:
        reason = F.lit(reason) if isinstance(reason, str) else reason
        return F.struct(F.lit(kind).alias("content_type"), F.lit(confidence).alias("confidence"), reason.alias("reasoning"))

    return (
        F.when(film.isNotNull(), verdict("movie", 1.0, F.concat(F.lit("film word in title: "), film)))
        .when(other.isNotNull(), verdict("not_movie", 0.95, F.concat(F.lit("other programme: "), other)))
        .when(on_film_channel & (long >= 60), verdict("movie", 0.9, "film channel, 60 minutes or more"))
        .when(on_film_channel & long.isNull(), verdict("unknown", 0.0, "film channel, no duration"))
        .when(~on_film_channel & (long >= 80), verdict("movie", 0.8, "80 minutes or more"))
        .when(long < 45, verdict("not_movie", 0.85, "under 45 minutes"))
        .otherwise(verdict("unknown", 0.0, "no rule applies"))
    )


def is_media_heavy(has_video: Column, images: Column, text_length: Column) -> Column:
    return (has_video | (images >= 5)) & (text_length < 1000)


def whole_word_pattern(word: Column) -> Column:
    """Pattern of a word between characters that are neither letters, digits nor underscores, of any script."""
    escaped = F.regexp_replace(F.lower(word), r"([^\p{L}\p{N}_\s])", r"\\$1")
    return F.concat(F.lit(r"(^|[^\p{L}\p{N}_])"), escaped, F.lit(r"([^\p{L}\p{N}_]|$)"))


def tagged(docs: DataFrame, keywords: DataFrame, *texts: str) -> DataFrame:
    """(row of docs, name) for each keyword (column name) that occurs as a whole word in the lower-cased texts: every pair is tried, by substring before the pattern; for keywords that are a dimension. Beyond it tagged_by_token() is linear."""
    text = F.lower(F.concat_ws(" ", *texts))
    return docs.join(small(keywords), text.contains(F.lower("name")) & F.regexp_like(text, whole_word_pattern(F.col("name"))))


def tagged_by_token(docs: DataFrame, key: str, keywords: DataFrame, *texts: str) -> DataFrame:
    """(key, name) as tagged(), for keywords of one token of letters, digits and underscores: a hash join of distinct tokens, linear in the text."""
    tokens = F.array_distinct(F.regexp_extract_all(F.lower(F.concat_ws(" ", *texts)), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))
    names = keywords.select("name", F.lower("name").alias("token"))
    return docs.select(key, F.explode(tokens).alias("token")).join(names, "token").select(key, "name")


def tagged_by_substring(docs: DataFrame, keywords: DataFrame, *texts: str) -> DataFrame:
    """(row of docs, name) for each keyword that occurs anywhere in the texts, joined without separators; null texts count as empty."""
    text = F.lower(F.concat(*[F.coalesce(F.col(t), F.lit("")) for t in texts]))
    return docs.join(small(keywords), text.contains(F.lower(F.col("name"))))
