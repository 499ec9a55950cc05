"""Queries on vacancies, keywords, programmes, pages and their themes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import classify
from ..operators import grams, keywords, regions, search, themes, upsert
from ..sources import config, feeds, scorer
from .market import ANALYSES, KEYWORDS, PROGRAMMES, VACANCIES, Market
from .registry import query

# Vacancies and keywords.

_ORDER = "ORDER BY application_deadline DESC NULLS LAST, last_seen DESC NULLS FIRST, id"
_TAGGED = "id IN (SELECT id FROM tags WHERE tag IN ('R')) AND id IN (SELECT id FROM tags WHERE tag IN ('F', 'X')) AND id NOT IN (SELECT id FROM tags WHERE tag IN ('A'))"


@query(f"WITH {VACANCIES} SELECT id, application_deadline, last_seen FROM vacancies WHERE {_TAGGED} {_ORDER}")
def j05_vacancies_by_tag(m: Market):
    """Any of these, any of those, none of a third list."""
    return search.vacancies(m.vacancies(), "id", m.tags(), include=["R"], industries=["F", "X"], exclude=["A"]).select("id", "application_deadline", "last_seen")


@query(f"WITH {VACANCIES} SELECT id, application_deadline FROM vacancies WHERE application_deadline >= TIMESTAMP '2000-01-01' {_ORDER} LIMIT 300 OFFSET 300")
def p11_active_vacancies(m: Market):
    """Second page of 300."""
    found = search.vacancies(m.vacancies(), "id", m.tags(), active_at=F.lit("2000-01-01").cast("timestamp_ntz"))
    return search.paged(found, "2", 300).select("id", "application_deadline")


@query(f"WITH {VACANCIES} SELECT v.id, v.title, v.last_seen, c.c_custkey AS keyword_id, c.c_name AS keyword FROM vacancies AS v JOIN orders AS o ON o.o_orderkey = v.id JOIN customer AS c ON c.c_custkey = o.o_custkey WHERE v.last_seen IS NOT NULL")
def j01_vacancy_keywords(m: Market):
    """Vacancies, bridge, keyword."""
    links = m.table("orders").select(F.col("o_orderkey").alias("vacancy_id"), F.col("o_custkey").alias("keyword_id"))
    names = m.table("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return search.vacancy_keywords(m.vacancies(), links, names).select("id", "title", "last_seen", "keyword_id", "keyword")


@query(f"WITH {VACANCIES} SELECT id, title, salary_from, last_seen FROM vacancies WHERE last_seen IS NOT NULL ORDER BY last_seen DESC, id")
def p19_vacancies_seen(m: Market):
    return m.vacancies().where("last_seen is not null").orderBy(F.desc("last_seen"), "id").select("id", "title", "salary_from", "last_seen")


_WHOLE_WORDS = rf"""WITH {KEYWORDS} SELECT d.doc_id, k.name FROM documents AS d JOIN keywords AS k
    ON regexp_matches(lower(d.text || ' ' || d.source), '(^|[^\p{{L}}\p{{N}}_])' || regexp_replace(lower(k.name), '([^\p{{L}}\p{{N}}_\s])', '\\\1', 'g') || '([^\p{{L}}\p{{N}}_]|$)')"""


@query(_WHOLE_WORDS)
def x14_whole_words(m: Market):
    """Keywords as whole words, any characters."""
    return classify.tagged(m.table("documents"), m.keywords(), "text", "source").select("doc_id", "name")


@query(
    rf"""WITH {KEYWORDS} SELECT d.doc_id, k.name FROM documents AS d JOIN keywords AS k
    ON list_contains(regexp_extract_all(lower(d.text || ' ' || d.source), '[\p{{L}}\p{{N}}_]+'), lower(k.name)) WHERE k.name <> 'c++'"""
)
def x14_whole_words_by_token(m: Market):
    """J13, X14 as a hash join of tokens."""
    return classify.tagged_by_token(m.table("documents"), "doc_id", m.keywords().where("name <> 'c++'"), "text", "source")


@query(_WHOLE_WORDS)
def x14_whole_words_by_automaton(m: Market):
    """All keywords in one pass over a text."""
    return keywords.tagged(m.table("documents"), "doc_id", m.keywords(), "text", "source")


@query(
    r"""WITH keywords AS (SELECT DISTINCT array_to_string(string_split(text, ' ')[1:4], ' ') AS name FROM benchmark),
    held AS MATERIALIZED (SELECT d.doc_id, k.name, lower(d.text) AS text FROM documents AS d JOIN keywords AS k ON contains(lower(d.text), lower(k.name)))
    SELECT doc_id, name FROM held AS k WHERE regexp_matches(text, '(^|[^\p{L}\p{N}_])' || regexp_replace(lower(k.name), '([^\p{L}\p{N}_\s])', '\\\1', 'g') || '([^\p{L}\p{N}_]|$)')"""
)
def x14_phrases(m: Market):
    """Keywords of several words, here the beginnings of the benchmark's passages."""
    phrases = m.table("benchmark").select(F.array_join(F.slice(F.split("text", " "), 1, 4), " ").alias("name"))
    return keywords.tagged(m.table("documents"), "doc_id", phrases, "text")


_SUBSTRINGS = f"WITH {KEYWORDS} SELECT d.doc_id, k.name FROM documents AS d JOIN keywords AS k ON contains(lower(d.text || d.source), lower(k.name))"


@query(_SUBSTRINGS)
def x15_substrings(m: Market):
    return classify.tagged_by_substring(m.table("documents"), m.keywords(), "text", "source").select("doc_id", "name")


@query(_SUBSTRINGS)
def x15_substrings_by_trigrams(m: Market):
    """Only rows that hold all trigrams of a keyword are looked at, those of a keyword that is one trigram not even then."""
    docs = m.table("documents").select("doc_id", F.concat("text", "source").alias("joined"))
    return grams.tagged(docs, grams.index(docs, "doc_id", ["joined"]), m.keywords(), "joined")


@query("SELECT DISTINCT p_brand AS name, 'https://jobs.example/search?limit=1000&keywords[]=' || p_brand AS url FROM part")
def x25_search_urls(m: Market):
    """A search address for each keyword, here each brand."""
    from ..functions import parse

    return m.table("part").select(F.col("p_brand").alias("name")).distinct().select("name", parse.search_url("https://jobs.example/search", F.col("name")).alias("url"))


@query(
    f"""WITH {KEYWORDS}, wanted AS (SELECT doc_id, unnest(list_distinct([lang, lower(source), left(text, 3), 'the'])) AS name FROM documents)
    SELECT doc_id, CAST(id AS BIGINT) AS id FROM wanted JOIN keywords USING (name)"""
)
def x16_named_tags(m: Market):
    """Listed names that the dimension has, exactly so."""
    rows = m.table("documents").select("doc_id", F.array(F.col("lang"), F.lower("source"), F.left("text", F.lit(3)), F.lit("the")).alias("names"))
    return feeds.named(rows, "doc_id", "names", m.keywords())


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) + i AS vacancy_portal_id, 'Job ' || i AS title, CAST(i AS DOUBLE) * 100 AS salary_from, event_type AS company_name FROM events, (SELECT unnest([1, 2]) AS i)")
def s09_json_vacancies(m: Market):
    """An array of records in a JSON response."""
    k = F.get_json_object("props", "$.k").cast("long")
    one = lambda i: F.concat(F.lit('{"id":'), (k + i).cast("string"), F.lit(f',"positionTitle":"Job {i}","salaryFrom":{i}00.0,"employerName":"'), F.col("event_type"), F.lit('"}'))
    body = F.concat(F.lit('{"vacancies":['), one(1), F.lit(","), one(2), F.lit("]}"))
    return feeds.vacancies(m.table("events").select("event_id", body.alias("body"))).select("event_id", F.col("vacancy_portal_id").cast("long").alias("vacancy_portal_id"), "title", "salary_from", "company_name")


# Programmes.


@query(
    f"""WITH {PROGRAMMES} SELECT p.id, c.name AS channel_name, pg_rating, imdb_rating FROM programmes AS p JOIN channels AS c ON c.id = p.channel_id
    WHERE CAST(start_time AS DATE) BETWEEN DATE '2026-04-05' AND DATE '2026-04-18' AND NOT coalesce(pg_rating = 'R', false) AND imdb_rating >= '7.5' AND c.name <> 'tv3'"""
)
def p09_programmes(m: Market):
    """Unrated programmes stay, ratings compare as text."""
    out = search.programmes(m.programmes().drop("channel"), m.channels(), date_from="2026-04-05", date_to="2026-04-18", min_rating="7.5", not_channel="tv3")
    return out.select("id", "channel_name", "pg_rating", "imdb_rating")


@query(f"WITH {PROGRAMMES} SELECT p.id FROM programmes AS p WHERE CAST(start_time AS DATE) BETWEEN DATE '2026-04-05' AND DATE '2026-04-18' AND TRY_CAST(imdb_rating AS DOUBLE) >= 7.5 AND pg_rating = 'R' AND channel_id = 1")
def p10_programmes_by_number(m: Market):
    """P10 with numbers; the default exclusion switched off."""
    return search.programmes(m.programmes().drop("channel"), m.channels(), date_from="2026-04-05", date_to="2026-04-18", rating="R", not_rating="", min_rating="7.5", channel="filmzone", numeric=True).select("id")


_CLASS = """CASE WHEN contains(lower(title_lv), 'filma') THEN ['movie', '1.0', 'film word in title: filma'] WHEN contains(lower(title_lv), 'seriāls') THEN ['not_movie', '0.95', 'other programme: seriāls']
  WHEN contains(channel, 'filmzone') AND d >= 60 THEN ['movie', '0.9', 'film channel, 60 minutes or more'] WHEN contains(channel, 'filmzone') AND d IS NULL THEN ['unknown', '0.0', 'film channel, no duration']
  WHEN NOT contains(channel, 'filmzone') AND d >= 80 THEN ['movie', '0.8', '80 minutes or more'] WHEN d < 45 THEN ['not_movie', '0.85', 'under 45 minutes'] ELSE ['unknown', '0.0', 'no rule applies'] END"""


@query(f"WITH {PROGRAMMES} SELECT id, r[1] AS content_type, CAST(r[2] AS DOUBLE) AS confidence, r[3] AS reasoning FROM (SELECT id, {_CLASS} AS r FROM (SELECT *, greatest(duration_minutes, 0) + 0 * duration_minutes AS d FROM programmes))")
def x20_classified_programmes(m: Market):
    """Ordered rules, first hit."""
    verdict = classify.programme(F.col("title_lv"), F.col("description_lv"), F.col("channel"), F.col("duration_minutes"))
    return m.programmes().withColumn("c", verdict).select("id", "c.content_type", "c.confidence", "c.reasoning")


@query(f"WITH {PROGRAMMES} SELECT id, r[1] AS content_type FROM (SELECT id, start_time, {_CLASS} AS r FROM (SELECT *, duration_minutes AS d FROM programmes)) WHERE r[1] <> CASE WHEN id % 2 = 0 THEN 'movie' ELSE 'unknown' END AND start_time >= TIMESTAMP '2026-04-10'")
def k13_reclassified(m: Market):
    """Since a day, only what changes."""
    stored = m.programmes().where(F.col("start_time") >= F.lit("2026-04-10").cast("date")).withColumn("content_type", F.when(F.col("id") % 2 == 0, "movie").otherwise("unknown"))
    new = classify.programme(F.col("title_lv"), F.col("description_lv"), F.col("channel"), F.col("duration_minutes"))["content_type"]
    return upsert.diff_update(stored, {"content_type": new}).select("id", "content_type")


@query(f"WITH {PROGRAMMES} SELECT id, title_lv FROM programmes WHERE NOT CASE WHEN id % 9 = 0 THEN 'De Facto' WHEN id % 13 = 0 THEN 'Panorāma' ELSE title_lv END IN ('Panorāma', 'De Facto')")
def p13_listed_titles(m: Market):
    """Titles of local programmes are left out."""
    title = F.when(F.col("id") % 9 == 0, "De Facto").when(F.col("id") % 13 == 0, "Panorāma").otherwise(F.col("title_lv"))
    return m.programmes().withColumn("title_lv", title).where(~F.col("title_lv").isin(list(classify.EXCLUDED_TITLES))).select("id", "title_lv")


@query("SELECT DISTINCT p_brand AS channel, CAST(DATE '2026-04-24' + CAST(i AS INTEGER) AS DATE) AS day FROM part, (SELECT unnest(generate_series(-7, 6)) AS i)")
def s13_day_frontier(m: Market):
    """Each channel, here each brand, and day of two weeks."""
    return feeds.day_frontier(m.table("part").select(F.col("p_brand").alias("name")).distinct(), "2026-04-24")


# Pages.


@query("SELECT page_id, href FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a [^>]*href=\"([^\"]*)\"', 1)) AS href FROM pages) WHERE starts_with(href, '/t')")
def s11_links(m: Market):
    return feeds.links_under(m.table("pages").select("page_id", "html"), "/t")


_BARE = r"regexp_replace(regexp_replace(regexp_replace(html, '(?s)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', '', 'g'), '<[^>]*>', chr(10), 'g'), '\s*\n\s*', '', 'g')"


@query(
    rf"""SELECT page_id, CASE WHEN trim(title) <> '' THEN trim(title) ELSE 'No Title Found' END AS title, n_img AS image_count, n_video AS video_count, length(bare) AS text_length, n_video > 0 OR contains(lower(bare), 'video') AS has_video
    FROM (SELECT page_id, regexp_replace(regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1), '<[^>]*>', '', 'g') AS title, {_BARE} AS bare,
      len(regexp_extract_all(html, '<img[ >]')) - len(regexp_extract_all(html, '<img [^>]*alt="emotion"')) AS n_img, len(regexp_extract_all(html, '<video[ >]')) AS n_video FROM pages)"""
)
def s17_page_features(m: Market):
    """Title, media and text length of a page."""
    return m.table("pages").select("page_id", *feeds.page_features(F.col("html")))


@query(rf"SELECT page_id, (n_img >= 5 OR page_id % 3 = 0) AND length(bare) < 2000 AND page_id % 3 = 0 AND length(bare) < 1000 AS heavy FROM (SELECT page_id, {_BARE} AS bare, len(regexp_extract_all(html, '<img[ >]')) AS n_img FROM pages)")
def p20_media_heavy(m: Market):
    """P20 over page features; every third page counts as one with a video."""
    page = m.table("pages").select("page_id", *feeds.page_features(F.col("html")))
    return page.select("page_id", classify.is_media_heavy(F.col("page_id") % 3 == 0, F.col("image_count"), F.col("text_length")).alias("heavy"))


@query("SELECT 'p' || (p_partkey - p_partkey % 30) AS start, 'p' || p_partkey AS url, CAST(p_partkey % 30 + 1 AS INTEGER) AS n FROM part WHERE p_partkey % 30 < 20")
def s15_page_chain(m: Market):
    """The chains of next pages from the first of each listing; 20 of 30 pages are followed."""
    k = F.col("p_partkey")
    on = F.concat(F.lit('<link rel="next" href="p'), (k + 1).cast("string"), F.lit('">'))
    pages = m.table("part").select(F.concat(F.lit("p"), k.cast("string")).alias("url"), F.when(k % 30 != 29, on).otherwise("<p>end</p>").alias("html"), k)
    return feeds.chain(pages.select("url", feeds.next_page(F.col("html")).alias("next_url")), pages.where(k % 30 == 0).select("url"))


@query(
    rf"""SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'old ' || page_id ELSE url END AS url, n_img AS image_count, n_video AS video_count, length(bare) AS text_length, n_video > 0 OR contains(lower(bare), 'video') AS has_video
    FROM (SELECT page_id, url, {_BARE} AS bare, len(regexp_extract_all(html, '<img[ >]')) - len(regexp_extract_all(html, '<img [^>]*alt="emotion"')) AS n_img, len(regexp_extract_all(html, '<video[ >]')) AS n_video FROM pages)"""
)
def k12_page_features(m: Market):
    """Pages are kept or created, their four features overwritten."""
    features = feeds.page_features(F.col("html"))[1:]
    batch = m.table("pages").select("page_id", "url", *features)
    names = batch.columns[2:]
    none = [F.lit(None).cast(t).alias(c) for c, t in batch.dtypes[2:]]
    stored = m.table("pages").where("page_id % 2 = 0").select("page_id", F.concat(F.lit("old "), F.col("page_id").cast("string")).alias("url"), *none)
    return upsert.upsert(stored, batch, ["page_id"], names)


# Themes.


@query(
    f"""WITH {ANALYSES}
    SELECT p.doc_id AS id FROM documents AS p
    WHERE ((SELECT count(*) FROM analyses AS a WHERE a.page_id = p.doc_id AND model_tier = 'expensive' AND NOT theme_match) = (SELECT count(*) FROM themes)
           AND NOT EXISTS (SELECT 1 FROM reviews AS r JOIN analyses AS a ON a.id = r.page_analysis_id WHERE a.page_id = p.doc_id AND NOT analysis_approved))
       OR EXISTS (SELECT 1 FROM reviews AS r JOIN analyses AS a ON a.id = r.page_analysis_id WHERE a.page_id = p.doc_id AND a.theme_id = 1 AND a.theme_match AND NOT analysis_approved)"""
)
def a08_kid_friendly(m: Market):
    """Conditional count against a scalar, and two existence tests in an OR."""
    pages = m.table("documents").select(F.col("doc_id").alias("id"))
    return themes.kid_friendly(pages, m.analyses(), m.reviews(), m.themes())


@query(f"WITH {ANALYSES} SELECT page_id FROM analyses WHERE page_id % 5 <> 0 OR theme_id = 1 GROUP BY page_id HAVING count(*) >= 2 OR count(*) FILTER (theme_match) > 0")
def a07_done_pages(m: Market):
    return themes.done(m.analyses().where("page_id % 5 <> 0 or theme_id = 1"), 2)


@query(f"WITH {ANALYSES} SELECT d.doc_id AS page_id, t.id AS theme_id, t.analysis_order FROM documents AS d CROSS JOIN themes AS t WHERE NOT EXISTS (SELECT 1 FROM analyses AS a WHERE a.page_id = d.doc_id AND a.theme_id = t.id)".replace("t.id AS theme_id", "CAST(t.id AS BIGINT) AS theme_id"))
def j14_missing_themes(m: Market):
    return themes.missing(m.table("documents").select(F.col("doc_id").alias("id")), m.themes(), m.analyses())


@query(f"WITH {ANALYSES} SELECT page_id, arg_min(name, analysis_order) AS theme FROM analyses AS a JOIN themes AS t ON t.id = a.theme_id WHERE theme_match GROUP BY page_id")
def w03_first_match(m: Market):
    """The first theme in order that matches."""
    named = m.analyses().join(F.broadcast(m.themes().select(F.col("id").alias("theme_id"), "name", "analysis_order")), "theme_id")
    return themes.first_match(named)


@query(f"WITH {ANALYSES} SELECT a.page_id, t.name FROM analyses AS a JOIN themes AS t ON t.id = a.theme_id WHERE NOT EXISTS (SELECT 1 FROM analyses AS b JOIN themes AS u ON u.id = b.theme_id WHERE b.page_id = a.page_id AND b.theme_match AND u.analysis_order < t.analysis_order)")
def c04_until_match(m: Market):
    """Analyses up to a page's first match."""
    named = m.analyses().join(F.broadcast(m.themes().select(F.col("id").alias("theme_id"), "name", "analysis_order")), "theme_id")
    return themes.until_match(named).select("page_id", "name")


@query("SELECT doc_id AS id FROM documents ORDER BY n_chars DESC, doc_id LIMIT 100")
def c03_within_budget(m: Market):
    """A budget of requests, taken in order before anything is scored."""
    pages = m.table("documents").select(F.col("doc_id").alias("id"), "n_chars")
    return themes.within_budget(pages, [F.desc("n_chars"), F.col("id")], 100).select("id")


_CALLS = """WITH p AS (SELECT doc_id, lower(coalesce(text, '')) AS t, length(coalesce(text, '')) AS len, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS n FROM documents),
    f AS (SELECT *, len % 7 <> 0 AS a1, len % 5 <> 0 AS a2, contains(t, 'clown') AS refused, CAST(contains(t, 'idiot') AS INTEGER) AS low, CAST(contains(t, 'idiot') AS INTEGER) + CAST(contains(t, 'scum') AS INTEGER) AS high,
      CAST(contains(t, 'trash') AS INTEGER) AS kid, CASE WHEN len % 7 <> 0 THEN contains(t, 'clown') OR contains(t, 'idiot') ELSE len % 5 <> 0 AND contains(t, 'clown') END AS stopped FROM p),
    calls AS (
      SELECT n, doc_id AS page_id, 'toxicity' AS theme, 'cheap' AS model_tier, 0 AS step, a1 AS answered, refused, low AS hits FROM f
      UNION ALL SELECT n, doc_id, 'kid_unfriendly', 'cheap', 1, a2, refused, 0 FROM f WHERE NOT a1
      UNION ALL SELECT n, doc_id, 'toxicity', 'expensive', 2, a1, refused, high FROM f WHERE NOT stopped
      UNION ALL SELECT n, doc_id, 'kid_unfriendly', 'expensive', 3, a2, refused, kid FROM f WHERE NOT stopped AND NOT (a1 AND (refused OR high > 0))
    ), spent AS (
      SELECT *, CASE WHEN answered THEN refused OR hits > 0 END AS theme_match, CASE WHEN answered THEN CASE WHEN refused THEN 1.0 ELSE 1 - pow(0.5, hits + 1) END END AS confidence_score,
        CAST(sum(CAST(answered AS INTEGER)) OVER (ORDER BY n, step) AS BIGINT) AS spent FROM calls
    ), made AS (SELECT * FROM spent WHERE spent - CAST(answered AS INTEGER) < {budget})
    SELECT page_id, theme, model_tier, theme_match, CAST(confidence_score AS DOUBLE) AS confidence_score, spent, coalesce(max_by(theme_match, step) OVER w, false) OR max(step) OVER w = 3 AS complete FROM made WINDOW w AS (PARTITION BY n)"""


def _model(lexicon):
    """A model that answers some texts only on no attempt, and refuses some."""

    def ask(theme, text):
        if len(text or "") % {"toxicity": 7, "kid_unfriendly": 5}[theme] == 0:
            raise ConnectionError
        if "clown" in (text or "").lower():
            raise scorer.Blocked
        hits = sum(w in (text or "").lower() for w in lexicon.get(theme, ()))
        return hits > 0, 1 - 0.5 ** (hits + 1)

    return lambda rows: scorer.scored(rows, scorer.attempted(ask, sleep=lambda seconds: None))


@query(_CALLS.replace("{budget}", "400"))
def c03_answers_within_budget(m: Market):
    """The longest pages first, until 400 calls were answered; calls that fail twice cost nothing, refused texts match."""
    pages = m.table("documents").select(F.col("doc_id").alias("id"), "text", (-F.col("n_chars")).alias("place"))
    made = themes.calls_within_budget(pages, ["place", "id"], m.themes(), _model({"toxicity": ("idiot",)}), _model({"toxicity": ("idiot", "scum"), "kid_unfriendly": ("trash",)}), 400)
    return made.select("page_id", "theme", "model_tier", "theme_match", "confidence_score", "spent", "complete")


@query("SELECT doc_id AS page_id, CAST(1 AS BIGINT) AS theme_id, 1.0 AS confidence_score, true AS theme_match, 'content_analyzer' AS model, 'cheap' AS model_tier FROM documents WHERE n_chars < 1000 AND (doc_id % 4 = 0 OR doc_id % 9 >= 5)".replace("1.0 AS", "CAST(1 AS DOUBLE) AS"))
def c05_media_heavy_results(m: Market):
    pages = m.table("documents").select(F.col("doc_id").alias("id"), (F.col("doc_id") % 4 == 0).alias("has_video"), (F.col("doc_id") % 9).alias("image_count"), F.col("n_chars").alias("text_length"))
    return themes.media_heavy_results(pages, 1)


@query(f"WITH {ANALYSES} SELECT doc_id AS id FROM documents WHERE doc_id IN (SELECT page_id FROM analyses WHERE theme_id = 2 AND model_tier = 'cheap')")
def c06_reanalysed(m: Market):
    """Only pages that have an analysis for the target theme."""
    pages = m.table("documents").select(F.col("doc_id").alias("id"))
    return themes.unfinished(pages, m.analyses().where("model_tier = 'cheap'"), 2, target_theme=2, reanalyse=True)


@query(f"WITH {ANALYSES} SELECT doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT page_id FROM analyses GROUP BY page_id HAVING count(*) >= 2 OR count(*) FILTER (theme_match) > 0)")
def u03_unfinished(m: Market):
    """Pages less those that are done."""
    return themes.unfinished(m.table("documents").select(F.col("doc_id").alias("id")), m.analyses(), 2)


_HAS = "CAST(contains(t, '{}') AS INTEGER)"


def _cascade_sql(cheap: str) -> str:
    has = {w: _HAS.format(w) for w in ("idiot", "scum", "clown", "trash")}
    return f"""WITH p AS (SELECT doc_id, lower(coalesce(text, '')) AS t, {cheap} AS cheap FROM documents),
    low AS (SELECT doc_id AS page_id, 'toxicity' AS theme, contains(t, 'idiot') AS theme_match, 1 - pow(0.5, {has["idiot"]} + 1) AS confidence_score, 'cheap' AS model_tier FROM p WHERE cheap),
    high AS (SELECT doc_id, {has["idiot"]} + {has["scum"]} AS a, {has["clown"]} + {has["trash"]} AS b FROM p WHERE doc_id NOT IN (SELECT page_id FROM low WHERE theme_match))
    SELECT * FROM low UNION ALL SELECT doc_id, 'toxicity', a > 0, 1 - pow(0.5, a + 1), 'expensive' FROM high
    UNION ALL SELECT doc_id, 'kid_unfriendly', b > 0, 1 - pow(0.5, b + 1), 'expensive' FROM high WHERE a = 0"""


def _cascade(m: Market, cheap_tier=None):
    pages = m.table("documents").select(F.col("doc_id").alias("id"), "text")
    run = lambda lexicon: lambda rows: scorer.scored(rows, scorer.lexicon_scorer(lexicon))
    return themes.cascade(pages, m.themes(), run({"toxicity": ("idiot",)}), run({"toxicity": ("idiot", "scum"), "kid_unfriendly": ("clown", "trash")}), cheap_tier=cheap_tier)


@query(_cascade_sql("true"))
def s23_cascade(m: Market):
    """Two tiers with a lexicon as the scorer."""
    return _cascade(m)


@query(_cascade_sql("doc_id % 3 <> 0"))
def c07_tier_switch(m: Market):
    """Listings that switch the cheap tier off go to the expensive one at once."""
    return _cascade(m, F.col("id") % 3 != 0)


@query(
    f"""WITH {ANALYSES}, s AS (SELECT * FROM analyses WHERE page_id % 2 = 0), b AS (SELECT page_id, theme_id, NOT theme_match AS theme_match, 'again' AS model_tier, -id AS id FROM analyses WHERE page_id % 3 = 0)
    SELECT coalesce(s.page_id, b.page_id) AS page_id, CAST(coalesce(s.theme_id, b.theme_id) AS BIGINT) AS theme_id, coalesce(b.theme_match, s.theme_match) AS theme_match, coalesce(b.model_tier, s.model_tier) AS model_tier,
    coalesce(s.id, b.id) AS id FROM s FULL JOIN b ON b.page_id = s.page_id AND b.theme_id = s.theme_id"""
)
def k11_analyses(m: Market):
    """An analysis is updated or created by page and theme."""
    a = m.analyses().select("page_id", "theme_id", "theme_match", "model_tier", "id")
    batch = a.where("page_id % 3 = 0").select("page_id", "theme_id", (~F.col("theme_match")).alias("theme_match"), F.lit("again").alias("model_tier"), (-F.col("id")).alias("id"))
    return upsert.upsert(a.where("page_id % 2 = 0"), batch, ["page_id", "theme_id"], ["theme_match", "model_tier"])


_CONFIG = '{"kinds": [{"name": "view", "tier": "cheap", "weight": 2}, {"name": "click", "tier": "expensive"}, {"name": "signup", "tier": "cheap", "weight": 5, "note": "left out"}]}'


@query("SELECT k.tier, k.weight, count(*) AS n FROM events AS e JOIN (VALUES ('view', 'cheap', 2), ('click', 'expensive', NULL), ('signup', 'cheap', 5)) AS k(name, tier, weight) ON k.name = e.event_type GROUP BY 1, 2")
def s22_config(m: Market):
    """A configured dimension, from the environment or a file, joined with events."""
    kinds = config.dimension(m.spark, config.load("KINDS", environment={"KINDS": _CONFIG})["kinds"], "name string, tier string, weight int")
    return m.table("events").join(regions.small(kinds), F.col("event_type") == F.col("name")).groupBy("tier", "weight").agg(F.count("*").alias("n"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) > 50 AS theme_match, CAST(json_extract(props, '$.k') AS DOUBLE) / 100 AS confidence_score FROM events")
def x23_replies(m: Market):
    """Fenced JSON with a trailing comma."""
    k = F.get_json_object("props", "$.k").cast("double")
    reply = F.concat(F.lit('```json\n{"violence": '), (k > 50).cast("string"), F.lit(', "confidence_score": '), (k / 100).cast("string"), F.lit(",\n}\n```"))
    rows = m.table("events").select("event_id", F.lit("violence").alias("theme"), reply.alias("reply"))
    return scorer.replies(rows).select("event_id", "theme_match", "confidence_score")
