"""Keywords by one automaton against each keyword by itself."""

import random
import time

from listlight.functions import classify
from listlight.operators import keywords

TEXTS = ["C++ and c, not c++11", "_the the_ the", "über Über ÜBER", "a\nb the", "", None, "наш Дом", "the cat in the hat", "x" * 1000, "cat-in", "½the 2the", "İstanbul", "data  science data science"]
NAMES = ["c++", "C++", "the", "über", "дом", "cat in the", "in the hat", "cat", "data science", "the cat in the hat", "-", "+", "i̇stanbul", "hat", "science", None, " ", ""]


def frames(spark, texts, names):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame([(n,) for n in names], "name string")


def both(spark, texts, names, **more):
    docs, words = frames(spark, texts, names)
    plain = {(r["doc_id"], r["name"]) for r in classify.tagged(docs, words.where("trim(name) <> ''"), "text").collect()}
    return plain, sorted((r["doc_id"], r["name"]) for r in keywords.tagged(docs, "doc_id", words, "text", **more).collect())


def test_same_as_every_pair(spark):
    plain, got = both(spark, TEXTS, NAMES)
    assert got == sorted(plain) and len(plain) > 12
    plain, got = both(spark, TEXTS, NAMES, most_chars=7)  # many automata
    assert got == sorted(plain)


def test_ten_thousand_keywords_of_several_words(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choices("abcdeé+-", k=rng.randint(1, 4)))
    names = sorted({" ".join(word() for _ in range(rng.randint(1, 3))) for _ in range(20_000)})[:10_000]
    texts = [" ".join(word() for _ in range(60)) for _ in range(40)]
    plain, got = both(spark, texts, names)
    assert len(names) == 10_000 and got == sorted(plain) and len(got) > 300


def test_empty_tables(spark):
    docs, words = frames(spark, TEXTS, NAMES)
    assert keywords.tagged(docs.limit(0), "doc_id", words, "text").count() == 0 == keywords.tagged(docs, "doc_id", words.limit(0), "text").count()


def test_time_is_linear_in_the_text():
    words = ["a" * k for k in range(1, 30)] + ["b" * k + "a" for k in range(300)]
    automaton = keywords._automaton("test", words)
    took = []
    for n in (200_000, 400_000):
        began = time.time()
        assert sum(1 for _ in automaton.iter("b" * n)) == 0
        took.append(time.time() - began)
    assert took[1] < 4 * took[0] + 0.2
