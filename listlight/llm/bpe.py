"""BPE encoding and decoding with a public vocabulary file (tokenizers JSON).

Text is normalised and split as the file says (NFC, white space, per-character lower case; contractions,
letters, single digits, other signs), special tokens in a text being cut out first. The distinct words of a
partition that have no ids yet are encoded together: an index maps each pair of neighbouring symbols to all
its positions, the ranks that have positions are applied in ascending order, and each merge updates the
lists of the pairs that it makes. Documents then gather the ids of their words.

Defined cases: a null or empty text has no ids and decodes to the empty string. Rows that share a doc_id are
encoded each by its own text. Memory is bounded: a partition forgets its words and runs beyond CACHE. Columns named
ids or decoded are replaced, others pass through if kept.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import in_batches

CACHE = 150_000  # runs between white space whose ids a partition remembers
TEXTS = 2 << 20  # characters of text encoded at once
FRESH = 1 << 16  # new words whose pairs are indexed at once
_SPACE = regex.compile(r"\s+")
_SEPARATOR = regex.compile(r"[\x1c-\x1f]")  # white space to str.split() but not to the file's pattern


@dataclass
class Vocabulary:
    """What is needed of a tokenizers JSON file of kind BPE with word ends."""

    vocab: dict[str, int]
    merges: list[tuple[str, str]]
    specials: dict[str, int]
    pattern: str
    end: str

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        model, split = whole["model"], whole["pre_tokenizer"]["pretokenizers"][0]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        return cls(model["vocab"], merges, {t["content"]: t["id"] for t in whole["added_tokens"]}, split["pattern"]["Regex"], model["end_of_word_suffix"])

    @cached_property
    def tokens(self) -> pa.Array:
        out = [""] * (max([*self.vocab.values(), *self.specials.values()]) + 1)
        for token, k in (self.vocab | self.specials).items():
            out[k] = token
        return pa.array(out, pa.string())

    @cached_property
    def bytes_to_ids(self) -> np.ndarray:
        """256 x 2: the symbol of each byte, inside and at the end of a word."""
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        others = [b for b in range(256) if b not in shown]
        char = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(others)}
        return np.array([[self.vocab[char[b]], self.vocab[char[b] + self.end]] for b in range(256)], np.int64)

    @cached_property
    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Keys left * size + right in ascending order with their ranks; by rank the key and the merged symbol."""
        n = len(self.tokens)
        key = np.array([self.vocab[a] * n + self.vocab[b] for a, b in self.merges], np.int64)
        made = np.array([self.vocab[a + b] for a, b in self.merges], np.int64)
        order = np.argsort(key)
        return key[order], order, key, made


def encode_words(words: list[bytes], v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all words in a row, where each word begins): the merges of a batch of distinct words by an index of pair positions."""
    if not words:
        return np.zeros(0, np.int32), np.zeros(1, np.int64)
    lengths = np.array([len(w) for w in words], np.int64)
    raw = np.frombuffer(b"".join(words), np.uint8)
    last = np.zeros(len(raw), np.int64)
    bounds = np.concatenate(([0], np.cumsum(lengths)))
    last[bounds[1:] - 1] = 1
    symbol = np.append(v.bytes_to_ids[raw, last], -1)  # a sentinel ends the row
    n, size = len(raw), len(v.tokens)
    following = np.arange(1, n + 2)
    following[bounds[1:] - 1] = n  # no pair crosses the end of a word
    before = np.arange(-1, n)
    before[bounds[:-1]] = n
    keys, ranks, key_of, made = v.pairs

    index: dict[int, list[np.ndarray]] = {}
    heap: list[int] = []

    def add(at: np.ndarray) -> None:
        """Enter the pairs that begin at these positions."""
        key = symbol[at] * size + symbol[following[at]]
        place = np.searchsorted(keys, key).clip(0, len(keys) - 1)
        known = keys[place] == key
        rank, at = ranks[place[known]], at[known]
        order = np.argsort(rank, kind="stable")
        rank, at = rank[order], at[order]
        cut = np.flatnonzero(np.concatenate(([True], rank[1:] != rank[:-1]))) if len(rank) else []
        for r, lo, hi in zip(rank[cut].tolist() if len(rank) else [], cut, [*cut[1:], len(rank)]):
            if r not in index:
                index[r] = []
                heapq.heappush(heap, r)
            index[r].append(at[lo:hi])

    start = np.arange(n)
    add(start[following[:n] < n])
    while heap:
        r = heapq.heappop(heap)
        lists = index.pop(r)
        at = lists[0] if len(lists) == 1 else np.concatenate(lists)  # a position entered twice merges once: all is read before it is written
        at = at[(symbol[at] * size + symbol[following[at]] == key_of[r]) & (symbol[at] >= 0)]
        if not len(at):
            continue
        if key_of[r] // size == key_of[r] % size and len(at) > 1:  # a pair of equal symbols may overlap itself: from the left, every other one
            at = np.unique(at)
            chained = np.concatenate(([False], following[at[:-1]] == at[1:]))
            run = np.cumsum(~chained) - 1
            nth = np.arange(len(at)) - np.flatnonzero(~chained)[run]
            at = at[nth % 2 == 0]
        gone = following[at]
        beyond = following[gone]
        symbol[at], symbol[gone] = made[r], -1
        following[at] = beyond
        inside = beyond < n
        before[beyond[inside]] = at[inside]
        left = before[at]
        left = left[left < n]
        new = np.concatenate((left[symbol[left] >= 0], at[inside]))
        if len(new):
            add(new)
    alive = symbol[:n] >= 0
    return symbol[:n][alive].astype(np.int32), np.concatenate(([0], np.cumsum(alive)))[bounds]


def _gather(values: np.ndarray, begin: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values[begin[k]:begin[k + 1]] for each k of at in a row, where each begins)."""
    long = begin[at + 1] - begin[at]
    upto = np.concatenate(([0], np.cumsum(long)))
    return values[np.arange(upto[-1]) - np.repeat(upto[:-1] - begin[at], long)], upto


@dataclass
class Encoder:
    """Ids of texts. Remembers the words it has met, and the runs between white space in which it met them."""

    v: Vocabulary

    def __post_init__(self):
        self.split = regex.compile(self.v.pattern)
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.v.specials, key=len, reverse=True))) + ")") if self.v.specials else None
        self.clear()

    def clear(self) -> None:
        none = np.zeros(0, np.int32), np.zeros(1, np.int64)
        self.words, self.runs = {}, {}
        self.word_ids, self.word_begin = none
        self.run_ids, self.run_begin = none

    def _parts(self, text: str) -> list[str]:
        """Runs between white space, special tokens apart."""
        if self.special and any(t in text for t in self.v.specials):
            return [r for part in self.special.split(text) for r in ([part] if part in self.v.specials else self._parts(part))]
        return text.split() if not _SEPARATOR.search(text) else _SPACE.sub(" ", text).split(" ")

    def _learn(self, runs: list[str]) -> None:
        """Ids of new runs: normalise and split each, encode the words not met before together."""
        number, fresh, flat, counts = self.words, [], [], []
        for run in runs:
            if run in self.v.specials:
                words = [run]
            else:  # NFC and the split don't reach across white space; lower case is by character, without final sigma
                words = self.split.findall(unicodedata.normalize("NFC", run).replace("Σ", "σ").lower())
            for w in words:
                at = number.get(w)
                if at is None:
                    at = number[w] = len(number)
                    fresh.append(w)
                flat.append(at)
            counts.append(len(words))
        if fresh:
            plain = [w for w in fresh if w not in self.v.specials]
            pieces = [encode_words([w.encode() for w in plain[lo : lo + FRESH]], self.v) for lo in range(0, max(len(plain), 1), FRESH)]
            ids, begin = np.concatenate([x for x, _ in pieces]), np.concatenate(([0], np.cumsum(np.concatenate([np.diff(b) for _, b in pieces]))))
            if len(plain) < len(fresh):
                where = {w: k for k, w in enumerate(plain)}
                each = [ids[begin[where[w]] : begin[where[w] + 1]] if w in where else np.array([self.v.specials[w]], np.int32) for w in fresh]
                ids, begin = np.concatenate(each), np.concatenate(([0], np.cumsum([len(x) for x in each])))
            self.word_begin = np.concatenate((self.word_begin, self.word_begin[-1] + begin[1:]))
            self.word_ids = np.concatenate((self.word_ids, ids))
        ids, upto = _gather(self.word_ids, self.word_begin, np.array(flat, np.int64))
        ends = upto[np.cumsum(counts)]
        self.run_begin = np.concatenate((self.run_begin, self.run_begin[-1] + ends))
        self.run_ids = np.concatenate((self.run_ids, ids))

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, how many each has)."""
        if len(self.runs) > CACHE:
            self.clear()
        known, fresh, each = self.runs, [], []
        for text in texts:
            own = self._parts(text) if text else []
            for r in [r for r in dict.fromkeys(own) if r not in known]:
                known[r] = len(known)
                fresh.append(r)
            each.append(np.fromiter(map(known.__getitem__, own), np.int32, len(own)))  # numbers need less room than the runs
        if fresh:
            self._learn(fresh)
        ids, upto = _gather(self.run_ids, self.run_begin, np.concatenate([np.zeros(0, np.int32), *each]))
        ends = upto[np.concatenate(([0], np.cumsum([len(own) for own in each]))).astype(np.int64)]
        return ids, np.diff(ends)


def _groups(texts: pa.Array) -> Iterator[tuple[int, int]]:
    sizes = np.cumsum(np.nan_to_num(pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.float64)))
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(sizes, (sizes[lo - 1] if lo else 0) + TEXTS, "right")))
        yield lo, hi
        lo = hi


def _passed(docs: DataFrame, first: str, keep: list[str], kind: str) -> tuple[DataFrame, str]:
    out = docs.select(F.col(first).alias("in"), *[F.col(c).alias(f"kept_{k}") for k, c in enumerate(keep)])
    return out, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema.fields[1:]), kind])


def _decoded(ids: pa.ListArray, tokens: pa.Array) -> pa.Array:
    """The tokens of each list, joined by a space; ids outside the vocabulary are left out."""
    offsets = np.asarray(ids.offsets) - np.asarray(ids.offsets)[0]
    flat = ids.flatten()
    inside = np.asarray(pc.fill_null(pc.and_(pc.greater_equal(flat, 0), pc.less(flat, len(tokens))), False))
    if not inside.all():
        offsets = np.concatenate(([0], np.cumsum(inside)))[offsets]
        flat = flat.filter(pa.array(inside))
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), tokens.take(flat)), " ")


def encode(docs: DataFrame, path: str, *, keep: list[str] | None = None, decoded: bool = False) -> DataFrame:
    """docs (the columns `keep`, by default all) with ids (array<int>) of text, no special tokens added. path: the vocabulary file, read on the driver.

    With decoded also what decode() makes of the ids, in the same Python worker: a second one for each task would hold the vocabulary again.
    """
    made = ["ids", *(["decoded"] if decoded else [])]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in made]
    docs, schema = _passed(docs.withColumn("text", F.col("text").cast("string")), "text", keep, "ids array<int>" + ", decoded string" * decoded)
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(path))  # 2 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in batches:
            for lo, hi in _groups(batch.column(0)):  # what is held at once stays small beside the executor's heap
                part = batch.slice(lo, hi - lo)
                ids, counts = encoder.encode(part.column(0).to_pylist())
                offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
                columns = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))]
                if decoded:
                    columns.append(_decoded(columns[0], shared.value.tokens))
                yield pa.RecordBatch.from_arrays([*part.columns[1:], *columns], [*part.schema.names[1:], *made])

    out = in_batches(docs, run, schema)
    return out.select(*[F.col(f"kept_{k}").alias(c) for k, c in enumerate(keep)], *made)


def decode(encoded: DataFrame, path: str, *, keep: list[str] | None = None) -> DataFrame:
    """encoded (ids, ...; the columns `keep`, by default all) with decoded: the tokens of ids, special ones too, joined by a space (the file names no decoder). Ids outside the vocabulary are left out."""
    keep = [c for c in (encoded.columns if keep is None else keep) if c != "decoded"]
    docs, schema = _passed(encoded, "ids", keep, "decoded string")
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = shared.value.tokens
        for batch in batches:
            for lo in range(0, len(batch), 1000):
                part = batch.slice(lo, 1000)
                ids = pc.fill_null(part.column(0), pa.scalar([], part.schema.field(0).type))
                text = _decoded(ids, tokens)
                yield pa.RecordBatch.from_arrays([*part.columns[1:], text], [*part.schema.names[1:], "decoded"])

    out = in_batches(docs, run, schema)
    return out.select(*[F.col(f"kept_{k}").alias(c) for k, c in enumerate(keep)], "decoded")
