"""Language-model scoring by cross-entropy difference.

A target and a background bigram model share one vocabulary: the words of both corpora, all others being one
unknown word. Each text gets, per token, the difference between its loss under the target and under the
background model; low values are like the target.

p(w | v) = max(c(v, w) - D, 0) / c(v) + left(v) * p(w), p(w) = (c(w) + 1) / (n + words): left(v) is what the
bigrams of v leave, so each distribution sums to one.

The counts are complete: every word and bigram of both corpora is kept, in tables; nothing that grows with
the input reaches the driver or is broadcast. Texts are taken in chunks of about AT_ONCE tokens, within which
each word and each bigram counts, asks and is answered once, so even the commonest one is sent no more
often than there are chunks. Keys (64-bit hashes) belong to as many ranges as the corpora need for a range
to fit into a task, and travel as one packed array for each chunk and range. Training sums the arrays of a
range; scoring looks a chunk's keys up in their ranges, and the answers go back to the chunk, which sums the
losses of its texts. Scoring takes the texts in ROUNDS parts, one after the other, so that the disk holds the
questions and answers of a part only.

Defined cases: a null or empty text, or one without words, has no tokens, losses of 0 and score 0. Without a
target (or background) text that model is uniform over the vocabulary. Rows that share an id are scored each
by its own text, repeated texts count as often as they occur, and columns named like the results are
replaced. A text longer than a chunk makes a chunk of its own; one of more than 2^28 words, whose arrays no Arrow binary
holds, is an error. Words are runs of letters, digits and
non-ASCII bytes, lower-cased (A-Z and Latin-1).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import drop, in_batches, written, written_apart
from .textbuf import ALNUM, hash_spans, lower_latin, mix, slices, spans, sums_by

AT_ONCE = 1 << 19  # tokens of a chunk
RANGE_BYTES = 1 << 23  # bytes of text for each range of keys
ROUNDS = 2  # parts in which texts are scored
DISCOUNT = 0.7
START = 0  # stands before a text's first word
PAIRS, WORDS = 0, 1  # kinds of keys
MADE = ("n_tokens", "target_loss", "background_loss", "score")
#: A row for each range, of packed arrays: keys (ascending), their counts in background and target; for words also their
#: counts as history (b, t) and of the distinct words after them (b, t).
COUNTS = "range long, keys binary, b binary, t binary, more binary"
_SECOND = np.uint64(0x9E3779B97F4A7C15)


def _words(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, word hashes, first word of each document)."""
    for lo, hi, buf, offs in slices(column):
        low = lower_latin(buf)
        starts, ends, first = spans(low, offs, ALNUM)
        yield lo, hi, hash_spans(low, starts, ends)[0], first


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[pa.RecordBatch], np.ndarray, np.ndarray]]:
    """(rows, word hashes, first word of each row) of about AT_ONCE tokens; column 0 is the text."""
    held, parts, counts, n = [], [], [], 0

    def chunk():
        return parts, np.concatenate(held), np.concatenate(([0], np.cumsum(np.concatenate(counts))))

    for batch in batches:
        for lo, hi, words, first in _words(batch.column(0)):
            held.append(words)
            parts.append(batch.slice(lo, hi - lo))
            counts.append(np.diff(first))
            n += len(words)
            if n >= AT_ONCE:
                yield chunk()
                held, parts, counts, n = [], [], [], 0
    if parts:
        yield chunk()


def _numbered(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct words, the most frequent first, and each token's place among them."""
    known, place, n = np.unique(words, return_inverse=True, return_counts=True)
    order = np.argsort(-n, kind="stable")
    rank = np.empty(len(order), np.int32)
    rank[order] = np.arange(len(order), dtype=np.int32)
    return known[order], rank[place]


class _Chunk:
    """Words and bigrams of a chunk, each once and in ascending order of their hashes, as places in `known`."""

    def __init__(self, words: np.ndarray, tokens: np.ndarray, first: np.ndarray):
        self.known, size = np.append(words, np.uint64(START)), len(words) + 1
        before = np.empty(len(tokens), np.int64)
        before[1:] = tokens[:-1]
        before[first[:-1][np.diff(first) > 0]] = size - 1
        pairs, at, n = np.unique(before * size + tokens, return_inverse=True, return_counts=True)
        key = _key(self.known[pairs // size], self.known[pairs % size])
        order = np.argsort(key)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.key, self.n, self.at = key[order], n[order], rank[at]
        self.v, self.w = pairs[order] // size, pairs[order] % size
        self.by_hash = np.argsort(self.known)


def _key(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix(v * _SECOND + mix(w))


def _range(hashes: np.ndarray, ranges: int) -> np.ndarray:
    """The range of each hash; it rises with the hash."""
    return ((hashes >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)


def _packed(values: np.ndarray, counts) -> pa.Array:
    """Consecutive values as binaries, of as many as `counts` says each."""
    offsets = np.concatenate(([0], np.cumsum(counts))) * values.itemsize
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def _flat(column: pa.ChunkedArray | pa.Array, kind) -> np.ndarray:
    """The values of all packed arrays of a column in a row."""
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    parts = []
    for x in chunks:
        _, offsets, data = x.buffers()
        if len(x) and data is not None:
            offsets = np.frombuffer(offsets, np.int32)
            parts.append(np.frombuffer(data, np.uint8)[offsets[x.offset] : offsets[x.offset + len(x)]])
    return np.concatenate(parts).view(kind) if parts else np.zeros(0, kind)


def _lengths(column: pa.ChunkedArray | pa.Array, kind) -> np.ndarray:
    return pc.binary_length(column).to_numpy().astype(np.int64) // np.dtype(kind).itemsize


def _summed(place: np.ndarray, n: np.ndarray, size: int) -> np.ndarray:
    return np.bincount(place, n, size).astype(np.int64)


def _sent(texts: DataFrame, ranges: int, target: bool) -> DataFrame:
    """range, v, after, w, n, target: the bigrams of each chunk by first word, how many follow it, these, and how often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, words, first in _chunks(batches):
            c = _Chunk(*_numbered(words), first)
            of = _range(c.key, ranges)
            order = np.lexsort((c.v, of))
            of, v = of[order], c.v[order]
            new = np.concatenate(([True], (of[1:] != of[:-1]) | (v[1:] != v[:-1]))) if len(of) else np.zeros(0, bool)
            starts = np.flatnonzero(new)
            found, n = np.unique(of, return_counts=True)
            firsts = np.unique(of[starts], return_counts=True)[1]
            after = np.diff(np.append(starts, len(of))).astype(np.int32)
            columns = [pa.array(found.astype(np.int64)), _packed(c.known[v[starts]], firsts), _packed(after, firsts), _packed(c.known[c.w[order]], n), _packed(c.n[order].astype(np.int32), n), pa.array(np.full(len(found), target))]
            yield from _in_slices(pa.RecordBatch.from_arrays(columns, ["range", "v", "after", "w", "n", "target"]))

    return in_batches(texts.select(F.col("text").cast("string").alias("text")), run, "range long, v binary, after binary, w binary, n binary, target boolean")


def _in_slices(batch: pa.RecordBatch, rows: int = 16) -> Iterator[pa.RecordBatch]:
    for lo in range(0, len(batch), rows):
        yield batch.slice(lo, rows)


def _counted(ranges: int):
    """The counts of a range's bigrams in both corpora, and what these bigrams say of their words."""

    def run(found: pa.Table) -> pa.Table:
        v = np.repeat(_flat(found["v"], np.uint64), _flat(found["after"], np.int32))
        w, n = _flat(found["w"], np.uint64), _flat(found["n"], np.int32)
        target = np.repeat(found["target"].to_numpy(), _lengths(found["n"], np.int32))
        keys, one, place = np.unique(_key(v, w), return_index=True, return_inverse=True)
        b, t = (_summed(place, np.where(x, n, 0), len(keys)) for x in (~target, target))
        words, at = np.unique(np.concatenate((v[one], w[one])), return_inverse=True)
        as_v, as_w = at[: len(keys)], at[len(keys) :]
        by_word = [_summed(as_w, x, len(words)) for x in (b, t)]
        by_history = np.stack([_summed(as_v, x, len(words)) for x in (b, t, b > 0, t > 0)], 1)
        of, size = np.unique(_range(words, ranges), return_counts=True)
        sizes = np.concatenate(([len(keys)], size))
        return pa.table(
            {
                "range": np.concatenate((found["range"].to_numpy()[:1], of.astype(np.int64))),
                "keys": _packed(np.concatenate((keys, words)), sizes),
                "b": _packed(np.concatenate((b, by_word[0])), sizes),
                "t": _packed(np.concatenate((t, by_word[1])), sizes),
                "more": _packed(by_history.ravel(), np.concatenate(([0], 4 * size))),
                "kind": pa.array([PAIRS] + [WORDS] * len(of), pa.int32()),
            }
        )

    return run


def _summed_words(found: pa.Table) -> pa.Table:
    words, place = np.unique(_flat(found["keys"], np.uint64), return_inverse=True)
    b, t = (_summed(place, _flat(found[c], np.int64), len(words)) for c in ("b", "t"))
    more = np.stack([_summed(place, x, len(words)) for x in _flat(found["more"], np.int64).reshape(-1, 4).T], 1)
    columns = [_packed(x.ravel(), [x.size]) for x in (words, b, t, more)]
    sums = [[int(b.sum())], [int(t.sum())], [int((b + t > 0).sum())]]
    return pa.table([found["range"][:1], *columns, *sums], names=["range", "keys", "b", "t", "more", "n_b", "n_t", "known"])


@dataclass
class DifferenceModel:
    """Both models as tables of COUNTS, b in the background and t in the target: a row for each range."""

    pairs: DataFrame
    words: DataFrame
    ranges: int
    n: tuple[int, int]  # tokens of target and background
    vocabulary: int  # distinct words

    def drop(self) -> None:
        drop(self.pairs, self.words)


def train(background: DataFrame, target: DataFrame) -> DifferenceModel:
    """Models of the text columns of both tables, counted over all rows."""
    size = sum(x.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0 for x in (background, target))
    ranges = max(1, -(-size // RANGE_BYTES))
    sent = _sent(background, ranges, False).union(_sent(target, ranges, True))
    pairs, parts = written_apart(sent.groupBy("range").applyInArrow(_counted(ranges), f"{COUNTS}, kind int"), "counts", "kind", [PAIRS, WORDS], "zstd")
    words = written(parts.groupBy("range").applyInArrow(_summed_words, f"{COUNTS}, n_b long, n_t long, known long"), "words", "zstd")
    drop(parts)
    n_b, n_t, known = words.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("n_b", "n_t", "known")]).first()
    return DifferenceModel(pairs, words.select(*pairs.columns), ranges, (n_t, n_b), known)


def _log_p(c: np.ndarray, by_word: np.ndarray, by_history: np.ndarray, distinct: np.ndarray, n: int, vocabulary: int) -> np.ndarray:
    """log p(w | v) of bigrams counted c, from the counts of w, of v and of the words after v."""
    left = np.where(by_history > 0, DISCOUNT * distinct / np.maximum(by_history, 1), 1.0)
    return np.log(np.maximum(c - DISCOUNT, 0) / np.maximum(by_history, 1) + left * (by_word + 1) / (n + vocabulary + 1))


def _code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each chunk: its distinct words, its tokens as places among them, and the other columns of its rows."""
    task = TaskContext.get().partitionId()
    for k, (parts, words, first) in enumerate(_chunks(batches)):
        known, tokens = _numbered(words)
        table = pa.Table.from_batches(parts).combine_chunks()
        others = [x.chunk(0) if x.num_chunks else pa.array([], x.type) for x in table.columns[1:]]
        rows = pa.StructArray.from_arrays([pa.array(np.diff(first)), *others], ["n_tokens", *table.column_names[1:]])
        rows = pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows)
        columns = [pa.array([(task << 32) + k]), rows, _packed(tokens, [len(tokens)]), _packed(known, [len(known)])]
        yield pa.RecordBatch.from_arrays(columns, ["chunk", "rows", "tokens", "words"])


def _decoded(words, tokens, n_tokens: np.ndarray) -> _Chunk:
    words, tokens = np.frombuffer(words.as_buffer(), np.uint64), np.frombuffer(tokens.as_buffer(), np.int32)
    return _Chunk(words, tokens, np.concatenate(([0], np.cumsum(n_tokens))))


def _asks(ranges: int):
    """From chunk, n, tokens, words: kind, range, chunk and the keys that the chunk asks for there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                c = _decoded(batch["words"][row], batch["tokens"][row], batch["n"][row].values.to_numpy())
                for kind, keys in ((PAIRS, c.key), (WORDS, c.known[c.by_hash])):
                    of, n = np.unique(_range(keys, ranges), return_counts=True)
                    columns = [pa.array(np.full(len(of), kind, np.int32)), pa.array(of.astype(np.int64)), pa.array(np.full(len(of), batch["chunk"][row].as_py())), _packed(keys, n)]
                    yield from _in_slices(pa.RecordBatch.from_arrays(columns, ["kind", "range", "chunk", "keys"]))

    return run


def _answers(asked: pa.Table, model: pa.Table) -> pa.Table:
    """The counts of the keys asked for, in their order; 0 for those unknown."""
    keys, n = _flat(asked["keys"], np.uint64), _lengths(asked["keys"], np.uint64)
    known = _flat(model["keys"], np.uint64)
    at = np.searchsorted(known, keys).clip(0, max(len(known) - 1, 0))
    hit = known[at] == keys if len(known) else np.zeros(len(keys), bool)
    columns = []
    for c, width in (("b", 1), ("t", 1), ("more", 4)):
        values = _flat(model[c], np.int64).reshape(-1, width)
        if width > 1 and len(asked) and asked["kind"][0].as_py() == PAIRS:
            values, width = values[:0], 0
        out = np.zeros((len(keys), width), np.int64)
        if len(values):
            out[hit] = values[at[hit]]
        columns.append((out.ravel(), width * n))
    size = 4 if all(x.max(initial=0) < 1 << 31 for x, _ in columns) else 8  # bytes of a count
    packed = [_packed(x.astype(f"<i{size}"), sizes) for x, sizes in columns]
    return pa.table([asked["chunk"], asked["kind"], asked["range"], pa.array(np.full(len(asked), size, np.int32)), *packed], names=["chunk", "kind", "range", "size", "b", "t", "more"])


def _counts(found: pa.Table, column: str) -> np.ndarray:
    """The counts of all answers of a chunk, in the order of ranges."""
    narrow = found["size"].to_numpy() == 4
    if narrow.all():
        return _flat(found[column], np.int32).astype(np.int64)
    return np.concatenate([_flat(found[column].slice(k, 1), np.int32 if few else np.int64).astype(np.int64) for k, few in enumerate(narrow)])


def _scored(docs: DataFrame, model: DifferenceModel) -> DataFrame:
    """docs (text, then others): the others with n_tokens and losses, as a written table."""
    fields = docs.schema.fields[1:]
    row = ", ".join(["n_tokens: bigint", *[f"{f.name}: {f.dataType.simpleString()}" for f in fields]])
    coded = written(in_batches(docs, _code, f"chunk long, rows array<struct<{row}>>, tokens binary, words binary"), "coded", "zstd")
    asked = in_batches(coded.select("chunk", F.col("rows.n_tokens").alias("n"), "tokens", "words"), _asks(model.ranges), "kind int, range long, chunk long, keys binary")
    counts = model.pairs.withColumn("kind", F.lit(PAIRS)).union(model.words.withColumn("kind", F.lit(WORDS)))
    both = asked.groupBy("kind", "range").cogroup(counts.groupBy("kind", "range"))
    answers = written(both.applyInArrow(_answers, "chunk long, kind int, range long, size int, b binary, t binary, more binary"), "answers", "zstd")
    n, vocabulary = model.n, model.vocabulary

    def losses(chunk: pa.Table, found: pa.Table) -> pa.Table:
        others = chunk["rows"].combine_chunks().flatten().flatten()
        size = others[0].to_numpy()
        c, first = _decoded(chunk["words"][0], chunk["tokens"][0], size), np.concatenate(([0], np.cumsum(size)))
        found = found.sort_by("range")
        pairs, words = (found.filter(pc.equal(found["kind"], k)) for k in (PAIRS, WORDS))
        more, out = np.empty((len(c.known), 4)), []
        more[c.by_hash] = _counts(words, "more").reshape(-1, 4)
        for k, corpus in enumerate(("t", "b")):  # in `more` b comes before t
            by_word = np.empty(len(c.known))
            by_word[c.by_hash] = _counts(words, corpus)
            log_p = _log_p(_counts(pairs, corpus), by_word[c.w], more[c.v, 1 - k], more[c.v, 3 - k], n[k], vocabulary)
            out.append(pa.array(-sums_by(log_p[c.at], first) / np.maximum(size, 1)))
        return pa.table([*others[1:], others[0], *out], names=[*[f.name for f in fields], *MADE[:3]])

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in fields], "n_tokens long, target_loss double, background_loss double"])
    out = written(coded.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(losses, schema), "scores")
    drop(coded, answers)
    return out


def score(docs: DataFrame, model: DifferenceModel, *, keep: list[str] | None = None, rounds: int = ROUNDS) -> DataFrame:
    """docs (the columns `keep`, by default all) with n_tokens, target_loss and background_loss (nats a token) and score, their difference."""
    keep = [c for c in (docs.columns if keep is None else keep) if c not in MADE]
    docs = docs.select(F.col("text").cast("string").alias("text"), *[F.col(c).alias(f"kept_{k}") for k, c in enumerate(keep)])
    turn = F.pmod(F.xxhash64("text"), F.lit(rounds))
    parts = [_scored(docs.where(turn == k) if rounds > 1 else docs, model) for k in range(rounds)]
    out = reduce(DataFrame.union, parts)
    difference = F.col("target_loss") - F.col("background_loss")
    return out.select(*[F.col(f"kept_{k}").alias(c) for k, c in enumerate(keep)], *MADE[:3], difference.alias("score"))
