"""Many keywords, of any characters and many words, in texts: one automaton for all of them."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_CHARS = 1_000_000  # of the keywords of one automaton (some 60 MB in a Python worker)
_built: dict[str, ahocorasick.Automaton] = {}  # the last automaton of a Python worker


def _automaton(name: str, words: list[str]) -> ahocorasick.Automaton:
    if name not in _built:
        _built.clear()
        made = ahocorasick.Automaton()
        for k, word in enumerate(words):
            made.add_word(word, (k, len(word)))
        made.make_automaton()
        _built[name] = made
    return _built[name]


def _in_word(c: str) -> bool:
    """Letters, digits and underscores, of any script."""
    return c == "_" or c.isalnum()


def _chunks(keywords: DataFrame, most_chars: int) -> Iterator[list[tuple[str, list[str]]]]:
    """Lower-cased keywords with the names that they stand for, as many lists as keep each within most_chars or so; blank ones are left out."""
    by_word = keywords.where("trim(name) <> ''").groupBy(F.lower("name").alias("word")).agg(F.collect_set("name").alias("names"))  # spellings of one word
    chars = by_word.agg(F.sum(F.length("word"))).first()[0] or 0
    chunks = -(-chars // most_chars)
    for k in range(chunks):
        chunk = by_word.where(F.pmod(F.xxhash64("word"), F.lit(chunks)) == k).collect()  # bounded by most_chars
        if chunk:
            yield [(r["word"], r["names"]) for r in chunk]


def tagged(docs: DataFrame, key: str, keywords: DataFrame, *texts: str, most_chars: int = MOST_CHARS) -> DataFrame:
    """(key, name) for each row of docs and keyword (name) that occurs as a whole word in the lower-cased texts: neither a letter, digit nor underscore before or after it.

    The texts are joined by a space, null ones left out; blank and null keywords tag nothing. All keywords are looked for in one pass over a text, in time linear in it and its
    hits, by an automaton that travels by broadcast; beyond most_chars characters of keywords there are several, and a pass for each. Rows that share a key are tagged each by itself.
    """
    spark = docs.sparkSession
    rows = docs.select(key, F.lower(F.concat_ws(" ", *texts)).alias("text"))  # as Spark lowers the keywords too
    kind = f"`{key}` {rows.schema[0].dataType.simpleString()}, name string"
    out = spark.createDataFrame([], kind)
    for chunk in _chunks(keywords, most_chars):
        shared = spark.sparkContext.broadcast((uuid.uuid4().hex, [w for w, _ in chunk], [n for _, n in chunk]))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own, words, names = shared.value
            automaton = _automaton(own, words)
            for batch in batches:
                of, found = [], []
                for row, scalar in enumerate(batch.column(1)):
                    text, seen = scalar.as_py(), set()
                    for end, (k, size) in automaton.iter(text):
                        if k not in seen and not (end + 1 < len(text) and _in_word(text[end + 1])) and not (end >= size and _in_word(text[end - size])):
                            seen.add(k)
                    hits = [n for k in sorted(seen) for n in names[k]]
                    of += [row] * len(hits)
                    found += hits
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of, pa.int64())), pa.array(found, pa.string())], [key, "name"])

        out = out.union(rows.mapInArrow(run, kind))
    return out
