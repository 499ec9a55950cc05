"""Calls of models within a budget of answers, against a run page by page."""

import random

import pytest

from listlight.operators import themes
from listlight.sources import scorer

THEMES = [(1, "a", 1), (2, "b", 2), (3, "c", 3)]


def answers(theme, text, tier):
    """What a text says of a theme: '+' a match, '-' none, '!' refused, '?' never an answer."""
    return text[{"cheap": 0, "expensive": 3}[tier] + "abc".index(theme)]


def one_by_one(pages, budget, cheap_off=()):
    """(page, tier, theme, answer, spent) of each call, and pages whose analysis ended."""
    calls, spent, ended = [], 0, set()
    for page, text in pages:
        stop = False
        for tier in ("cheap", "expensive"):
            if stop or (tier == "cheap" and page in cheap_off):
                continue
            for theme in "abc":
                if spent >= budget:
                    return calls, ended
                answer = answers(theme, text, tier)
                spent += answer != "?"
                calls.append((page, tier, theme, answer, spent))
                if answer in "+!":
                    stop = True
                    break
                if answer == "-" and tier == "cheap":
                    break
        ended.add(page)
    return calls, ended


def model(tier, folder):
    def ask(theme, text):
        answer = text[{"cheap": 0, "expensive": 3}[tier] + "abc".index(theme)]
        if answer == "?":
            raise ConnectionError
        with open(f"{folder}/asked", "a", encoding="utf-8") as f:
            f.write("x")
        if answer == "!":
            raise scorer.Blocked
        return answer == "+", 0.5

    return lambda rows: scorer.scored(rows, scorer.attempted(ask, sleep=lambda s: None))


@pytest.mark.parametrize("budget, kinds", [(0, "+-?!"), (1, "+-?!"), (7, "+--?!"), (23, "---?"), (60, "+---?!"), (10_000, "+-?!")])
def test_calls_are_those_of_a_run_page_by_page(spark, tmp_path, budget, kinds):
    rng = random.Random(budget)
    texts = ["".join(rng.choices(kinds, k=6)) for _ in range(40)]
    order = rng.sample(range(40), 40)
    rows = [(k, texts[k], order.index(k) // 2, k % 5 != 0) for k in range(40)]  # places tie, ids decide
    pages = spark.createDataFrame(rows, "id long, text string, place int, cheap boolean")
    in_order = sorted(((k, texts[k]) for k in range(40)), key=lambda p: (order.index(p[0]) // 2, p[0]))
    expected, ended = one_by_one(in_order, budget, {k for k in range(40) if k % 5 == 0})
    frame = spark.createDataFrame(THEMES, "id long, name string, analysis_order int")
    made = themes.calls_within_budget(pages, ["place", "id"], frame, model("cheap", tmp_path), model("expensive", tmp_path), budget, cheap_tier=pages["cheap"])
    got = made.orderBy("n", "step").collect()
    match = {"+": True, "!": True, "-": False, "?": None}
    assert [(r["page_id"], r["model_tier"], r["theme"], r["theme_match"], r["spent"]) for r in got] == [(p, tier, theme, match[a], s) for p, tier, theme, a, s in expected]
    assert {r["page_id"] for r in got if r["complete"]} == ended and all(r["complete"] == (r["page_id"] in ended) for r in got)
    asked = len((tmp_path / "asked").read_text()) if (tmp_path / "asked").exists() else 0
    assert asked == max((r["spent"] for r in got), default=0) <= budget  # no answer was paid for beyond the budget


def test_second_attempts_and_edges(spark):
    seen = {}

    def ask(theme, text):
        seen[theme, text] = seen.get((theme, text), 0) + 1
        if seen[theme, text] == 1:
            raise TimeoutError
        return False, 0.1

    import pandas as pd

    out = scorer.attempted(ask, sleep=lambda s: None)(pd.DataFrame({"theme": ["a", "a"], "text": ["x", "y"]}))
    assert list(out["theme_match"]) == [False, False] and set(seen.values()) == {2}
    frame = spark.createDataFrame(THEMES, "id long, name string, analysis_order int")
    pages = spark.createDataFrame([(1, None)], "id long, text string")
    none = lambda rows: scorer.scored(rows, scorer.lexicon_scorer({}))
    assert themes.calls_within_budget(pages.limit(0), ["id"], frame, none, none, 5).count() == 0
    assert themes.calls_within_budget(pages, ["id"], frame.limit(0), none, none, 5).count() == 0
    assert themes.calls_within_budget(pages, ["id"], frame, none, none, 50).count() == 4  # one cheap, three expensive
    with pytest.raises(ValueError):
        themes.calls_within_budget(pages, ["id"], frame, none, none, 50, most=2)
