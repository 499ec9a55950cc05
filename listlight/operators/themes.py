"""Pages, the themes they were analysed for, and reviews of the analyses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stored import drop, numbered, running, small, written


def kid_friendly(pages: DataFrame, analyses: DataFrame, reviews: DataFrame, themes: DataFrame) -> DataFrame:
    """Pages whose expensive analyses are false for as many as there are themes and without a rejected review, or whose match of kid_unfriendly a reviewer rejected."""
    a = analyses.join(small(themes.select(F.col("id").alias("theme_id"), F.col("name").alias("theme"))), "theme_id")
    rejected = a.join(reviews.where("not analysis_approved").select(F.col("page_analysis_id").alias("id")).distinct().withColumn("rejected", F.lit(True)), "id", "left")
    # All that the conditions ask, in one aggregation by page.
    facts = rejected.groupBy("page_id").agg(
        F.count_if((F.col("model_tier") == "expensive") & ~F.col("theme_match")).alias("clear"),
        F.coalesce(F.bool_or("rejected"), F.lit(False)).alias("any_rejected"),
        F.coalesce(F.bool_or(F.col("rejected") & (F.col("theme") == "kid_unfriendly") & F.col("theme_match")), F.lit(False)).alias("overridden"),
    )
    total = themes.agg(F.count("*").alias("themes"))
    joined = pages.join(facts, F.col("id") == F.col("page_id"), "left").crossJoin(F.broadcast(total))  # total is one row
    clear = (F.coalesce("clear", F.lit(0)) == F.col("themes")) & ~F.coalesce("any_rejected", F.lit(False))
    return joined.where(clear | F.coalesce("overridden", F.lit(False))).select(pages.columns)


def done(analyses: DataFrame, themes: int) -> DataFrame:
    """page_id of pages analysed for all themes or matched by one."""
    counts = analyses.groupBy("page_id").agg(F.count("*").alias("n"), F.count_if("theme_match").alias("matches"))
    return counts.where((F.col("n") >= themes) | (F.col("matches") > 0)).select("page_id")


def missing(pages: DataFrame, themes: DataFrame, analyses: DataFrame, most: int = 1000) -> DataFrame:
    """page_id, theme_id, analysis_order: themes (at most `most`, more are an error) that a page wasn't analysed for."""
    if themes.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} themes")
    listed = F.broadcast(themes.agg(F.sort_array(F.collect_list(F.struct("analysis_order", F.col("id").alias("theme_id")))).alias("all")))
    pairs = pages.select(F.col("id").alias("page_id")).crossJoin(listed).select("page_id", F.explode("all").alias("t")).select("page_id", "t.theme_id", "t.analysis_order")
    return pairs.join(analyses.select("page_id", "theme_id"), ["page_id", "theme_id"], "left_anti")


def until_match(results: DataFrame) -> DataFrame:
    """results (page_id, analysis_order, name, theme_match) up to each page's first match in order, that one included."""
    w = Window.partitionBy("page_id").orderBy("analysis_order", "name")
    before = F.coalesce(F.max(F.col("theme_match").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return results.withColumn("matched_before", before).where("matched_before = 0").drop("matched_before")


def first_match(results: DataFrame) -> DataFrame:
    """page_id, theme: the first theme in order that matches."""
    return results.where("theme_match").groupBy("page_id").agg(F.min_by("name", F.struct("analysis_order", "name")).alias("theme"))


def within_budget(pages: DataFrame, order: list[Column], budget: int) -> DataFrame:
    """The first `budget` pages in order: a request each."""
    return pages.orderBy(*order).limit(budget)


def _asked(rows: DataFrame, scorer, tier: str, step: int, name: str) -> DataFrame:
    """One call for each of rows (n, page_id, theme, text), written, so that no model is asked twice: its answer, and whether there was one."""
    keep = ["n", "page_id", "theme", "theme_match", "confidence_score"]
    return written(scorer(rows).select(*keep, F.lit(tier).alias("model_tier"), F.lit(step).alias("step"), F.col("theme_match").isNotNull().alias("answered")), name)


def calls_within_budget(pages: DataFrame, order: list[str], themes: DataFrame, cheap, expensive, budget: int, *, cheap_tier: Column | None = None, most: int = 100) -> DataFrame:
    """The calls of models that a run over pages (id, text, order columns) makes until `budget` of them were answered: n (the page's place in order), page_id, theme,
    theme_match, confidence_score, model_tier, step (of the page), answered, spent (answers up to and with this call), complete (the page's analysis came to its end).

    A page is looked at by the cheap scorer up to the first theme that it answers; unless that matches, by the expensive one theme by theme up to
    the first match. A scorer maps (n, page_id, theme, text) to theme_match (null: no answer, which costs nothing; a blocked reply is an answer) and confidence_score. Before each call
    the run ends if the budget is spent, so of a page in the middle some calls are made and it is not complete. cheap_tier: as for cascade().

    Pages are taken in waves that can't overspend: as many as the rest of the budget allows if each needed all its calls; when not even one page surely fits, the next one's
    calls are made one by one. So a run makes the calls that a run page by page makes, in some log(budget) waves. Themes are few (more than `most` are an error). The order must tell all pages apart.
    """
    names = [r["name"] for r in themes.orderBy("analysis_order", "name").limit(most + 1).collect()]
    if len(names) > most:
        raise ValueError(f"more than {most} themes")
    tier = F.coalesce(F.lit(True) if cheap_tier is None else cheap_tier, F.lit(True))
    queue = written(numbered(pages.select("id", "text", *[c for c in order if c not in ("id", "text")], tier.alias("cheap_tier")), order).select("n", F.col("id").alias("page_id"), "text", "cheap_tier"), "queue")
    total, left, at, calls = queue.count(), budget, 1, []
    worst = 1 + len(names)  # answers that a page may need

    def one_wave(wave: DataFrame, allowed: int) -> int:
        """Answers to the calls of a wave of pages, at most `allowed` (which one page alone may exceed)."""
        spent, step = 0, 0
        for name, scorer in (("cheap", cheap), ("expensive", expensive)):
            open_pages = wave.where("cheap_tier") if name == "cheap" else wave
            matched = [c.where(F.col("theme_match") & (F.col("model_tier") == "cheap")).select("n") for c in calls[begun:]]
            for found in matched:
                open_pages = open_pages.join(found, "n", "left_anti")
            for theme in names:
                if spent >= allowed:
                    return spent
                answers = _asked(open_pages.select("n", "page_id", F.lit(theme).alias("theme"), "text"), scorer, name, step, "calls")
                calls.append(answers)
                step += 1
                spent += answers.where("answered").count()
                over = answers.where("answered" if name == "cheap" else "theme_match").select("n")
                open_pages = open_pages.join(over, "n", "left_anti")
        return spent

    while left > 0 and at <= total and names:
        size, begun = max(1, left // worst), len(calls)
        left -= one_wave(queue.where(F.col("n").between(at, at + size - 1)), left)
        at += size
        if len(calls) > 8 * worst:  # few tables, however many waves
            merged = written(_union(calls), "calls")
            drop(*calls)
            calls = [merged]
    empty = "n long, page_id long, theme string, theme_match boolean, confidence_score double, model_tier string, step int, answered boolean"
    made = _union(calls) if calls else pages.sparkSession.createDataFrame([], empty)
    summed = running(made.withColumn("answer", F.col("answered").cast("long")), ["n", "step"], {"spent": "answer"}).drop("answer")
    due = F.col("spent") - F.col("answered").cast("long") < budget  # a call that fails isn't tried once the budget is spent
    last = F.max(F.struct("step", "theme_match", "model_tier", "theme", "answered")).over(Window.partitionBy("n"))
    ended = (F.col("last.theme_match") & F.col("last.answered")) | ((F.col("last.model_tier") == "expensive") & (F.col("last.theme") == names[-1] if names else F.lit(True)))
    every = summed.withColumn("due", due).where("due").withColumn("last", last)
    return every.withColumn("complete", F.coalesce(ended, F.lit(False))).drop("due", "last")


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def media_heavy_results(pages: DataFrame, theme_id: int) -> DataFrame:
    """Analyses of pages that are all media: matched without a model."""
    heavy = (F.col("has_video") | (F.col("image_count") >= 5)) & (F.col("text_length") < 1000)
    return pages.where(heavy).select(
        F.col("id").alias("page_id"), F.lit(theme_id).cast("long").alias("theme_id"), F.lit(1.0).alias("confidence_score"),
        F.lit(True).alias("theme_match"), F.lit("content_analyzer").alias("model"), F.lit("cheap").alias("model_tier"),
    )


def cascade(pages: DataFrame, themes: DataFrame, cheap, expensive, *, cheap_tier: Column | None = None) -> DataFrame:
    """Analyses of pages in two tiers: the cheap scorer looks at the first theme; what it doesn't match goes to the expensive one, theme by theme up to the first match.

    A scorer maps (page_id, theme, text) rows to theme_match and confidence_score columns: DataFrame to DataFrame.
    Pages of listings that switch the cheap tier off (cheap_tier false; null counts as true) go to the expensive one
    at once. The cheap scorer runs once, its answers are written before they decide.
    """
    ordered = themes.select(F.col("name").alias("theme"), "analysis_order")
    first = F.broadcast(ordered.orderBy("analysis_order", "theme").limit(1))
    tier = lambda df, name: df.withColumn("model_tier", F.lit(name))
    own = pages.select(F.col("id").alias("page_id"), "text", F.coalesce(F.lit(True) if cheap_tier is None else cheap_tier, F.lit(True)).alias("cheap_tier"))
    columns = ["page_id", "theme", "theme_match", "confidence_score", "model_tier"]
    low = tier(cheap(own.where("cheap_tier").select("page_id", "text").crossJoin(first)), "cheap")  # one theme
    low = written(low.select(columns), "cheap")
    rest = own.select("page_id", "text").join(low.where("theme_match").select("page_id"), "page_id", "left_anti")
    high = tier(expensive(rest.crossJoin(small(ordered))), "expensive")  # a row for each page and theme, of which there are few
    high = until_match(high.withColumnRenamed("theme", "name")).withColumnRenamed("name", "theme")
    return low.unionByName(high.select(columns))


def unfinished(pages: DataFrame, analyses: DataFrame, themes: int, *, target_theme: int | None = None, reanalyse: bool = False) -> DataFrame:
    """Pages to analyse: not done yet; with a target theme, those without an analysis for it, or with reanalyse those that have one."""
    if target_theme is None:
        return pages.join(done(analyses, themes), F.col("id") == F.col("page_id"), "left_anti")
    own = analyses.where(F.col("theme_id") == target_theme).select("page_id")
    return pages.join(own, F.col("id") == F.col("page_id"), "left_semi" if reanalyse else "left_anti")
