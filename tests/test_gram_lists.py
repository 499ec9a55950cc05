"""Lists of trigrams are made where rows are read, against plain Python."""

import random

import pyarrow as pa

from listlight.operators import grams, stored


def test_lists_are_made_in_the_tasks_that_read(spark):
    rng = random.Random(5)
    texts = ["", "ab", "a\0b\0", "\0\0\0", "😀😀😀😀", "aaaaaaa", *("".join(rng.choices("abč\n 😀", k=rng.randrange(40))) for _ in range(500))]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string").repartition(9)
    found = grams.index(df, "id", ["t"], buckets=2)
    assert len(found.postings.inputFiles()) == 9  # 2 before: tasks of a fixed number grew with the rows
    own = {}
    for k, t in enumerate(texts):
        for g in {t[i : i + 3] for i in range(len(t) - 2)}:
            own.setdefault(g, set()).add(k)
    got = {}
    for r in found.postings.collect():
        assert r["n"] == len(r["keys"]) == len(set(r["keys"])) and not got.setdefault(r["gram"], set()) & set(r["keys"])
        got[r["gram"]] |= set(r["keys"])
    assert got == own
    assert {r["gram"]: r["n"] for r in found.sizes.collect()} == {g: len(k) for g, k in own.items()}
    stored.close(spark)


def test_trigrams_of_keywords_are_named_to_the_scan(spark):
    docs = spark.createDataFrame([(1, "the end"), (2, "other"), (3, "no")], "id long, t string")
    found = grams.index(docs, "id", ["t"])
    names = spark.createDataFrame([("the",), ("end",)], "name string")
    tagged = grams.tagged_by_substring(docs, found, names, "t")
    assert sorted((r["id"], r["name"]) for r in tagged.collect()) == [(1, "end"), (1, "the"), (2, "the")]
    assert "In(gram" in tagged._jdf.queryExecution().executedPlan().toString()
    stored.close(spark)


def test_no_text_is_shuffled_and_a_keyword_of_one_trigram_looks_at_none(spark):
    rng = random.Random(8)
    texts = ["".join(rng.choices("abÄc d", k=rng.choice([0, 1, 2, 3, 200]))) for _ in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, t string").repartition(5)
    found = grams.index(docs, "id", ["t"])
    names = ["abc", "ABÄ", "a", "äb", "", " d", "abca", "Äb c", "zz", "zzzz", "abz"]
    held = lambda names: sorted((k, n) for k, t in enumerate(texts) for n in names if n.lower() in t.lower())
    frame = lambda names: spark.createDataFrame([(n,) for n in names], "name string")
    got = grams.tagged(docs, found, frame(names), "t")
    assert sorted((r["id"], r["name"]) for r in got.collect()) == held(names)
    assert "SortMergeJoin" not in got._jdf.queryExecution().executedPlan().toString()
    few = grams.tagged(docs, found, frame([n for n in names if len(n) < 4]), "t")
    assert sorted((r["id"], r["name"]) for r in few.collect()) == held([n for n in names if len(n) < 4])
    assert set(few.inputFiles()) == set(found.blocks.inputFiles())  # the index alone
    stored.close(spark)


def test_candidates_beyond_a_broadcast_are_found_by_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(grams, "MOST_SENT", 3)
    docs = spark.createDataFrame([(k % 10 if k % 7 else None, f"no. {k} of them" if k % 3 else None) for k in range(60)], "id long, t string").repartition(3)
    found = grams.index(docs, "id", ["t"])
    names = spark.createDataFrame([("of the",), ("no. 4",), ("THEM",)], "name string")
    got = sorted((str(r["id"]), r["name"]) for r in grams.tagged(docs, found, names, "t").collect())
    assert got == sorted((str(r["id"]), n) for r in docs.collect() if r["t"] for n in ("of the", "no. 4", "THEM") if n.lower() in r["t"])  # repeated and null keys too
    stored.close(spark)


def test_many_keywords_and_a_lower_case_that_is_longer(spark, monkeypatch):
    rng = random.Random(9)
    texts = ["İa", "xİax", *("".join(rng.choices("abcdefgh", k=rng.randrange(30))) for _ in range(100))]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    names = ["İa", *sorted({"".join(rng.choices("abcdefgh", k=rng.randrange(1, 6))) for _ in range(1500)})]
    found = grams.index(docs, "id", ["t"])
    assert len({n[k : k + 3] for n in names for k in range(len(n) - 2)}) < grams.MOST_PUSHED
    want = sorted((k, n) for k, t in enumerate(texts) for n in names if n.lower() in t.lower())
    for most in (1000, 5):
        monkeypatch.setattr(grams, "MOST_PUSHED", most)
        got = sorted((r["id"], r["name"]) for r in grams.tagged(docs, found, spark.createDataFrame([(n,) for n in names], "name string"), "t").collect())
        assert got == want  # "İa" has two characters, three in lower case
    stored.close(spark)


def test_blocks_of_many_characters_and_rows(monkeypatch):
    keys, texts = pa.array(range(70_000)), [chr(0x4E00 + k % 20_000) * 3 for k in range(70_000)]  # more places than two bytes hold
    found = {}
    for batch in grams._block(iter(range(9)), keys, texts):
        for r in batch.to_pylist():
            if r["gram"]:
                found[r["gram"]] = grams._places(r["places"], 70_000).tolist()
    assert len(found) == 20_000 and all(chr(0x4E00 + k) * 3 in found and found[chr(0x4E00 + k) * 3] == list(range(k, 70_000, 20_000)) for k in range(20_000))
    monkeypatch.setattr(grams, "_lists", lambda texts, made=grams._lists: made(texts) if len(texts) < 3 else None)
    halves = [b.to_pylist() for b in grams._block(iter(range(9)), pa.array([5, 6, 7]), ["abcd", "ab", "xabc"])]
    assert [r["keys"] for b in halves for r in b if r["gram"] is None] == [[5], [6, 7]] and len({r["block"] for b in halves for r in b}) == 2
