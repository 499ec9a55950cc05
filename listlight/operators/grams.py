"""Substring search by trigrams: lists of where each occurs, met before any text is looked at."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batches import in_batches
from .stored import drop, small, written

RAREST = 3  # trigrams of a word whose lists are met
BUCKETS = 64  # tasks that sum the sizes, at most
LIST_CHARS, LIST_ROWS = 2_000_000, 50_000  # texts of a block
MOST_PUSHED = 1000  # trigrams that are named to the scan
MOST_SENT = 1_000_000  # keys of rows to be looked at that travel by broadcast (some 180 MB); beyond it texts are shuffled


@dataclass
class Grams:
    """blocks: of each block of rows that were read together a row with their keys, and lists: gram, n, and the n places in keys that hold it; the "gram" of texts of fewer than three characters is the text."""

    key: str
    blocks: DataFrame
    buckets: int

    @property
    def own(self) -> DataFrame:
        """of, keys: the keys of each block."""
        return self.blocks.where("gram is null").select(F.col("block").alias("of"), "keys")

    @property
    def postings(self) -> DataFrame:
        """gram, keys, n: lists of n keys without repetition, several for a gram, one of each block."""
        lists = self.blocks.where("length(gram) = 3").select("block", "gram", "places", "n")

        def named(lists: pa.Table, own: pa.Table) -> pa.Table:
            keys = own["keys"].combine_chunks().flatten()
            places = [_places(p, len(keys)) for p in lists["places"].to_pylist()]
            ends = np.cumsum([0, *map(len, places)])
            made = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), keys.take(pa.array(np.concatenate([np.array([], np.int64), *places]))))
            return pa.table([lists["gram"], made, lists["n"]], ["gram", "keys", "n"])

        return lists.groupBy("block").cogroup(self.own.groupBy("of")).applyInArrow(named, f"gram string, keys {dict(self.blocks.dtypes)['keys']}, n long")

    @cached_property
    def sizes(self) -> DataFrame:
        """gram, n: how many keys each trigram has, summed when first asked for."""
        return written(self.blocks.where("length(gram) = 3").groupBy("gram").agg(F.sum("n").alias("n")).coalesce(self.buckets), "sizes")

    def drop(self) -> None:
        drop(self.blocks, *([self.sizes] if "sizes" in self.__dict__ else []))


def _text(columns: list[str], joint: str = "\n") -> Column:
    """The lower-cased texts in a row, apart from each other, so that no trigram of a word spans two."""
    return F.lower(F.concat_ws(joint, *[F.col(c).cast("string") for c in columns]))


def _width(n_rows: int) -> type:
    return np.uint16 if n_rows <= 1 << 16 else np.uint32


def _places(steps: bytes, n_rows: int) -> np.ndarray:
    """The ascending places of a list, which is stored as the first one and the steps from each to the next."""
    return np.cumsum(np.frombuffer(steps, _width(n_rows)), dtype=np.int64)


def _lists(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray] | None:
    """The trigrams of texts in order, where the list of each ends, and the places of the texts that hold each: each trigram with its place is one number, and these are sorted. None if there are too many numbers."""
    chars = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    known = np.zeros(int(chars.max(initial=0)) + 1, bool)
    known[chars] = True
    letters, n_rows = np.flatnonzero(known), len(texts)
    a = len(letters)
    if a**3 * n_rows >= 1 << 63:  # never for one text
        return None
    kind = np.uint32 if a**3 * n_rows < 1 << 32 else np.int64
    chars = np.take((np.cumsum(known) - 1).astype(kind), chars)
    row = np.repeat(np.arange(n_rows, dtype=kind), np.fromiter(map(len, texts), np.int64, n_rows))
    own = chars[:-2] * a
    for factor, part in ((1, chars[1:-1]), (a, chars[2:]), (n_rows, row[:-2])):
        own *= factor
        own += part
    own = own[row[2:] == row[:-2]]
    if not len(own):
        return [], np.zeros(1, np.int64), np.array([], kind)
    own.sort()
    own = own[np.r_[0, np.flatnonzero(own[1:] != own[:-1]) + 1]]
    gram = own // n_rows
    first = np.r_[0, np.flatnonzero(gram[1:] != gram[:-1]) + 1]
    codes = gram[first].astype(np.int64)
    joined = letters[np.stack([codes // (a * a), codes // a % a, codes % a], 1)].astype("<u4").tobytes().decode("utf-32-le")
    return [joined[k : k + 3] for k in range(0, len(joined), 3)], np.r_[first, len(gram)], own - gram * n_rows


def _block(number: Iterator[int], keys: pa.Array, texts: list[str]) -> Iterator[pa.RecordBatch]:
    """The rows of a block; of two or more where texts have too many characters."""
    made, n_rows = _lists(texts), len(texts)
    if made is None:
        half = n_rows // 2
        yield from _block(number, keys[:half], texts[:half])
        yield from _block(number, keys[half:], texts[half:])
        return
    block, (names, ends, places) = next(number), made
    whole: dict[str, list[int]] = {}
    for k, text in enumerate(texts):
        if len(text) < 3:
            whole.setdefault(text, []).append(k)
    more = np.array([k for w in whole.values() for k in w], np.int64)
    names, ends, places = [*names, *whole], np.r_[ends, ends[-1] + np.cumsum([len(w) for w in whole.values()], dtype=np.int64)], np.r_[places.astype(np.int64), more]
    starts, steps = ends[:-1], np.diff(places, prepend=0)
    steps[starts] = places[starts]
    steps, n = steps.astype(_width(n_rows)), len(names)
    stored = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((ends * steps.itemsize).astype(np.int32)), pa.py_buffer(steps)])
    columns = ["block", "gram", "places", "n", "keys"]
    none = pa.nulls(n, pa.list_(keys.type))
    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, block), pa.int64()), pa.array(names, pa.string()), stored, pa.array(np.diff(ends), pa.int64()), none], columns)
    own = pa.ListArray.from_arrays(pa.array([0, n_rows], pa.int32()), keys)
    yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.nulls(1, pa.string()), pa.nulls(1, pa.binary()), pa.array([n_rows], pa.int64()), own], columns)


def _posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keys, texts, size = [], [], 0
    first = TaskContext.get().partitionId() << 32
    number = iter(range(first, first + (1 << 32)))
    for batch in batches:
        new = [b.decode("utf-8", "replace") for b in batch.column(1).cast(pa.binary()).to_pylist()]
        keys.append(batch.column(0))
        texts += new
        size += sum(map(len, new))
        if size >= LIST_CHARS or len(texts) >= LIST_ROWS:
            yield from _block(number, pa.concat_arrays(keys), texts)
            keys, texts, size = [], [], 0
    if texts:
        yield from _block(number, pa.concat_arrays(keys), texts)


def index(rows: DataFrame, key: str, columns: list[str], *, buckets: int = BUCKETS) -> Grams:
    """The trigrams of the lower-cased columns of rows (key unique and not null, where rows are to be searched by it).

    A block is made of the rows that a task reads together (LIST_CHARS or LIST_ROWS, or a batch more), with numpy, and stored where it is made: no
    posting is shuffled or sorted by Spark, and a trigram of all texts has many lists of bounded length, so it is no hot one. A list is one value, of places in its block.
    """
    source = rows.select(F.col(key).alias("key"), _text(columns).alias("text"))
    schema = f"block long, gram string, places binary, n long, keys array<{dict(source.dtypes)['key']}>"
    return Grams(key, written(in_batches(source, _posted, schema), "grams", "zstd"), buckets)


def _held(found: Grams, wanted: dict[str, list[str]], short: dict[str, str] | None = None) -> DataFrame:
    """(key, name) of the rows that hold all trigrams of a name (wanted), or the word of one or two characters or none that it stands for (short).

    A row lies in one block, so lists meet block by block; trigrams are named to the scan. Words of one or two characters are where the trigrams are that hold them.
    """
    asked = sorted({g for grams in wanted.values() for g in grams})
    by_word: dict[str, list[str]] = {}
    for name, word in (short or {}).items():
        by_word.setdefault(word, []).append(name)
    lists = found.blocks.where("gram is not null").select("block", "gram", "places")
    part = lambda k, n: F.substring("gram", k, n)
    pairs, single = ([w for w in by_word if len(w) == n] for n in (2, 1))
    looked = [part(k, 2).isin(pairs) for k in (1, 2) if pairs] + [part(k, 1).isin(single) for k in (1, 2, 3) if single]
    if len(asked) <= MOST_PUSHED:
        lists = lists.where(reduce(lambda a, b: a | b, looked, F.col("gram").isin(asked)))
    else:
        named = found.blocks.sparkSession.createDataFrame([(g,) for g in asked], "asked string")
        lists = lists.join(F.broadcast(named), F.col("gram") == F.col("asked"), "left")
        lists = lists.where(reduce(lambda a, b: a | b, looked, F.col("asked").isNotNull())).drop("asked")
    kind = dict(found.blocks.dtypes)["keys"][len("array<") : -1]

    def meet(lists: pa.Table, own: pa.Table) -> pa.Table:
        keys = own["keys"].combine_chunks().flatten()
        at = {g: _places(p, len(keys)) for g, p in zip(lists["gram"].to_pylist(), lists["places"].to_pylist())}
        hits = {}
        for name, grams in wanted.items():
            if all(g in at for g in grams):
                hits[name] = reduce(lambda a, b: np.intersect1d(a, b, assume_unique=True), sorted((at[g] for g in grams), key=len))
        holds: dict[str, list[np.ndarray]] = {}
        for g, places in at.items():
            for word in {*g, g[:2], g[1:]} & by_word.keys():
                holds.setdefault(word, []).append(places)
        for word, names in by_word.items():
            some = np.arange(len(keys)) if not word else np.unique(np.concatenate(holds[word])) if word in holds else np.array([], np.int64)
            hits |= dict.fromkeys(names, some)
        of = np.concatenate([np.array([], np.int64), *hits.values()])
        names = pa.array(list(hits), pa.string()).take(pa.array(np.repeat(np.arange(len(hits)), [len(h) for h in hits.values()]), pa.int64()))
        return pa.table([keys.take(pa.array(of)), names], ["key", "name"])

    return lists.groupBy("block").cogroup(found.own.groupBy("of")).applyInArrow(meet, f"key {kind}, name string")


def _trigrams(word: str) -> list[str]:
    return list(dict.fromkeys(word[i : i + 3] for i in range(len(word) - 2)))


def candidates(found: Grams, word: str) -> DataFrame | None:
    """(key) of the rows that hold the rarest trigrams of a word; None for words of fewer than three characters, which any row may hold."""
    own = _trigrams(word)
    if not own:
        return None
    known = {r["gram"]: r["n"] for r in found.sizes.where(F.col("gram").isin(own)).collect()}  # of one word
    if len(known) < len(own):
        return found.blocks.select(F.explode("keys").alias("key")).where(F.lit(False))  # a trigram that no row holds
    return _held(found, {word: sorted(own, key=lambda g: (known[g], g))[:RAREST]}).select("key")


def search(rows: DataFrame, found: Grams, words: str, columns: list[str]) -> DataFrame:
    """As search.admin_search over the indexed columns: rows in which each word occurs in one of the columns at least; only candidates of the index are looked at."""
    lowered = words.lower().split()
    for keys in (candidates(found, w) for w in lowered):
        if keys is not None:
            rows = rows.join(small(keys.withColumnRenamed("key", "candidate")), F.col(found.key) == F.col("candidate"), "left_semi")
    for w in lowered:
        rows = rows.where(reduce(lambda a, b: a | b, [F.coalesce(F.lower(F.col(c).cast("string")).contains(w), F.lit(False)) for c in columns]))
    return rows


def tagged(rows: DataFrame, found: Grams, keywords: DataFrame, *texts: str, most: int = 10_000) -> DataFrame:
    """(key, name) for each row and keyword (column name) that occurs in the joined texts, lower-cased, of an index over the same joined text. Rows that share a key, or have none, are tagged each by itself.

    Words of up to three characters are held where their lists say so, and no text is looked at. Longer ones are looked for in the rows that hold all of their trigrams. Keywords are at most `most` (more are an error).
    """
    named = keywords.select("name", F.lower("name").alias("word")).where("name is not null").limit(most + 1).collect()
    if len(named) > most:
        raise ValueError(f"more than {most} keywords")
    words = {r["name"]: r["word"] for r in named}
    own = {name: _trigrams(word) for name, word in words.items()}
    sure = _held(found, {n: g for n, g in own.items() if len(words[n]) == 3}, {n: w for n, w in words.items() if len(w) < 3}).withColumnRenamed("key", found.key)
    longer = {n: g for n, g in own.items() if len(words[n]) > 3}
    if not longer:
        return sure
    perhaps = written(_held(found, longer).groupBy("key").agg(F.collect_set("name").alias("names")), "candidates").withColumnRenamed("key", "candidate")
    text = F.lower(F.concat(*[F.coalesce(F.col(t), F.lit("")) for t in texts]))
    looked = rows.select(found.key, *texts).join(small(perhaps, MOST_SENT), F.col(found.key).eqNullSafe(F.col("candidate"))).select(found.key, text.alias("text"), "names")
    held = looked.select(found.key, "text", F.explode("names").alias("name")).where(F.col("text").contains(F.lower("name"))).select(found.key, "name")
    return sure.unionByName(held)


def tagged_by_substring(rows: DataFrame, found: Grams, keywords: DataFrame, *texts: str, most: int = 10_000) -> DataFrame:
    """As classify.tagged_by_substring (rows with name, for each keyword that occurs in the joined texts) of an index over the same joined text; as tagged, with the other columns (key unique and not null)."""
    hits = tagged(rows, found, keywords, *texts, most=most).withColumnRenamed(found.key, "candidate")
    return rows.join(hits, F.col(found.key) == F.col("candidate")).drop("candidate")
