"""Scoring texts for themes: any function of a batch of (theme, text), here by a lexicon."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import parse

LEXICON = {"violence": ("attack", "weapon", "blood"), "kid_unfriendly": ("gambling", "casino", "alcohol")}


def lexicon_scorer(lexicon: dict[str, tuple[str, ...]] = LEXICON) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """theme_match where a word of the theme occurs; confidence grows with the number of words."""

    def score(batch: pd.DataFrame) -> pd.DataFrame:
        hits = [sum(w in (text or "").lower() for w in lexicon.get(theme, ())) for theme, text in zip(batch["theme"], batch["text"])]
        return pd.DataFrame({"theme_match": [h > 0 for h in hits], "confidence_score": [1 - 0.5 ** (h + 1) for h in hits]})

    return score


class Blocked(Exception):
    """The model refuses to answer on a text."""


def attempted(ask: Callable[[str, str], tuple[bool, float]], *, attempts: int = 2, sleep: Callable[[float], None] = time.sleep) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """A scorer that asks a model for (theme_match, confidence_score) of each theme and text.

    A blocked reply is a match of confidence 1.0. Other failures are tried again after 2^n seconds, `attempts` times
    in all; then the answer is null, and the page stays unanswered for the theme.
    """

    def one(theme: str, text: str):
        for n in range(attempts):
            try:
                return ask(theme, text)
            except Blocked:
                return True, 1.0
            except Exception:  # whatever the client of a model raises
                if n + 1 < attempts:
                    sleep(2.0**n)
        return None, None

    def score(batch: pd.DataFrame) -> pd.DataFrame:
        found = [one(theme, text) for theme, text in zip(batch["theme"], batch["text"])]
        return pd.DataFrame({"theme_match": pd.array([x for x, _ in found], "boolean"), "confidence_score": pd.array([y for _, y in found], "Float64")})

    return score


def scored(rows: DataFrame, scorer: Callable[[pd.DataFrame], pd.DataFrame]) -> DataFrame:
    """rows (page_id, theme, text, ...) with theme_match and confidence_score instead of text."""
    keep = [c for c in rows.columns if c != "text"]
    schema = ", ".join([*(f"`{c}` {t}" for c, t in rows.select(*keep).dtypes), "theme_match boolean, confidence_score double"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.concat([b[keep].reset_index(drop=True), scorer(b).reset_index(drop=True)], axis=1)

    return rows.mapInPandas(run, schema)


def replies(rows: DataFrame, column: str = "reply") -> DataFrame:
    """rows with theme_match, confidence_score, reasoning_summary read from a model's reply: a JSON object with the theme's name as a key."""
    fields = F.from_json(parse.repaired_json(F.col(column)), "map<string,string>")
    return rows.withColumns(
        {"theme_match": F.element_at(fields, F.col("theme")).try_cast("boolean"), "confidence_score": F.element_at(fields, F.lit("confidence_score")).try_cast("double"), "reasoning_summary": F.element_at(fields, F.lit("reasoning_summary"))}
    )
