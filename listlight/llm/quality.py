"""Quality: a factorisation machine over hashed words, structure statistics and metadata.

The features of a text are its hashed words (weight log(1 + count), scaled to unit length) and, one-hot by
quantile, statistics of its structure (shares of symbols, capitals, digits; lines; repeats; word lengths)
and, as metadata, its length in characters, the only metadata that may be an input (language, source and id may not). The score is linear plus low-rank pairwise interactions, by the identity
sum_{i<j} <v_i, v_j> x_i x_j = 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2), in time linear in the
features. Training is Adagrad in numpy on a bounded sample; a shift puts the threshold with the fewest errors
among all labelled documents, of any length, that the fit did not see at 0.5.

Defined cases: a null or empty text has statistics of zero and is scored by them. Without labels of both
classes the score is 1 where only good labels exist, else 0. Rows that share a doc_id are scored each by
its own text. Columns named score or predicted are replaced; all others pass through if kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import in_batches
from .samples import labelled_sample, unseen_logits
from .textbuf import ALNUM, NOT_SPACE, code_points, hash_spans, lists, lower_latin, mix, SLICE, slices, spans, sums_by

BITS, RANK, BINS = 17, 8, 8
STAT_WEIGHT = 0.5
STATS = ("log_chars", "log_words", "word_length", "symbols", "capitals", "digits", "punctuation", "exclamations", "bars", "lines_per_word", "repeated_lines", "distinct_words", "repeated_triples", "wide", "doubled_words", "longest_doubling")


def _kind(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars.encode())] = True
    return out


_KINDS = [_kind("#*$%&<>@^~"), _kind("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _kind("0123456789"), _kind(".,;:?\"'()"), _kind("!"), _kind("|")]
_NOT_NEWLINE = np.ones(256, bool)
_NOT_NEWLINE[10] = False


def _repeats(keys: np.ndarray, first: np.ndarray) -> np.ndarray:
    """By document, how many keys equal another one of the same document before them."""
    doc_of = np.repeat(np.arange(len(first) - 1, dtype=np.uint64), np.diff(first))
    x = mix(keys + doc_of * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(x, kind="stable")
    again = np.zeros(len(x), bool)
    again[order[1:]] = x[order[1:]] == x[order[:-1]]
    return sums_by(again, first)


def _doublings(w: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By document, how many words equal the word before them, and how many do so in a row at most."""
    same = np.zeros(len(w) + 1, bool)
    same[1:-1] = w[1:] == w[:-1]
    same[first] = False  # the first word of a document follows none
    upto = np.concatenate(([0], np.cumsum(same[:-1])))
    broken = np.maximum.accumulate(np.where(same[:-1], 0, upto[1:]))  # doublings before the row that a word stands in
    longest = np.zeros(len(first) - 1, np.int64)
    some = np.flatnonzero(np.diff(first))
    if len(some):
        longest[some] = np.maximum.reduceat(upto[1:] - broken, first[:-1][some])
    return upto[first[1:]] - upto[first[:-1]], longest


def features(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, row after the last, statistics, word buckets, their weights, where each document's buckets begin)."""
    for lo, hi, buf, offs in slices(column, SLICE // 4):  # a worker's arrays stay small beside the model
        low = lower_latin(buf)
        starts, ends, first = spans(low, offs, ALNUM)
        (w,) = hash_spans(low, starts, ends)
        raw_starts, raw_ends, raw_first = spans(buf, offs, NOT_SPACE)
        line_starts, line_ends, line_first = spans(buf, offs, _NOT_NEWLINE)
        (line,) = hash_spans(buf, line_starts, line_ends)
        n_docs = hi - lo
        doc_of = np.repeat(np.arange(n_docs), np.diff(first))

        key, count = np.unique((doc_of.astype(np.int64) << BITS) | (w >> np.uint64(64 - BITS)).astype(np.int64), return_counts=True)
        begin = np.searchsorted(key, np.arange(n_docs + 1, dtype=np.int64) << BITS)
        weight = np.log1p(count)
        norm = np.sqrt(sums_by(weight**2, begin))
        weight = (weight / np.repeat(np.maximum(norm, 1e-9), np.diff(begin))).astype(np.float32)

        chars = sums_by(code_points(buf), offs)
        n_words = np.maximum(np.diff(raw_first), 1)
        n_lines = np.maximum(np.diff(line_first), 1)
        some = np.maximum(chars, 1)
        shares = [sums_by(k[buf].astype(np.int64), offs) / some for k in _KINDS]
        triple = mix(np.arange(len(w), dtype=np.uint64))  # the last two words of a document begin none
        at = np.flatnonzero(doc_of[2:] == doc_of[:-2])
        triple[at] = w[at] + w[at + 1] * np.uint64(0x9E3779B97F4A7C15) + w[at + 2] * np.uint64(0xBF58476D1CE4E5B9)
        doubled, longest = _doublings(w, first)
        stats = np.stack(
            [
                np.log1p(chars),
                np.log1p(np.diff(raw_first)),
                sums_by(raw_ends - raw_starts, raw_first) / n_words,
                *shares,
                np.diff(line_first) / n_words,
                _repeats(line, line_first) / n_lines,
                np.diff(begin) / np.maximum(np.diff(first), 1),
                _repeats(triple, first) / np.maximum(np.diff(first), 1),
                (np.diff(offs) - chars) / some,
                doubled / np.maximum(np.diff(first), 1),
                np.log1p(longest),
            ],
            axis=1,
        )
        yield lo, hi, stats, key & ((1 << BITS) - 1), weight, begin


@dataclass
class QualityModel:
    edges: np.ndarray  # statistics x (BINS - 1)
    linear: np.ndarray  # 2**BITS + statistics * BINS
    factors: np.ndarray  # the same x RANK
    bias: float
    constant: float | None = None


def _edges(stats: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Between the bins of each statistic: the least value has a bin of its own (many documents have no bar, say); those above it are cut at quantiles, both classes weighing alike."""
    weight = np.where(labels == 1, 1 / max((labels == 1).sum(), 1), 1 / max((labels == 0).sum(), 1))
    out = np.empty((stats.shape[1], BINS - 1))
    for k, x in enumerate(stats.T):
        above = x > x.min()
        if not above.any():
            out[k] = np.inf
            continue
        order = np.argsort(x[above], kind="stable")
        values, upto = x[above][order], np.cumsum(weight[above][order])
        out[k] = values[np.searchsorted(upto, np.arange(BINS - 1) / (BINS - 1) * upto[-1]).clip(0, len(values) - 1)]
    return out


def _binned(stats: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Documents x statistics of feature numbers after those of the words."""
    cells = np.stack([np.searchsorted(edges[k], stats[:, k], "right") for k in range(len(STATS))], axis=1)
    return (1 << BITS) + np.arange(len(STATS)) * BINS + cells


def fit(stats: np.ndarray, words: list[np.ndarray], weights: list[np.ndarray], labels: np.ndarray, *, epochs: int = 6, seed: int = 3) -> tuple[QualityModel, np.ndarray]:
    """(model with the threshold at 0, places of the documents it has seen); a quarter of the documents stays unseen."""
    size = (1 << BITS) + len(STATS) * BINS
    if not (labels == 1).any() or not (labels == 0).any():
        constant = float(len(labels) > 0 and labels.max())
        return QualityModel(np.zeros((len(STATS), BINS - 1)), np.zeros(1), np.zeros((1, RANK)), 0.0, constant), np.arange(len(labels))
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(labels))
    parts = [order[labels[order] == y] for y in (0, 1)]
    used = np.concatenate([p[len(p) // 4 :] for p in parts])
    edges = _edges(stats[used], labels[used])
    cells = _binned(stats, edges)
    linear = np.zeros(size, np.float32)
    factors = rng.normal(0, 0.05, (size, RANK)).astype(np.float32)
    linear_moment, factor_moment = np.full(size, 0.1, np.float32), np.full((size, RANK), 0.1, np.float32)
    bias, bias_moment, rate, decay = 0.0, 0.1, 0.1, 1e-3

    def inputs(i):
        return np.concatenate((words[i], cells[i])), np.concatenate((weights[i], np.full(len(STATS), STAT_WEIGHT, np.float32)))

    def value(i):
        f, x = inputs(i)
        v = factors[f]
        s = x @ v
        return bias + linear[f] @ x + 0.5 * (s @ s - (x**2) @ (v**2).sum(axis=1)), f, x, v, s

    for _ in range(epochs):
        for i in rng.permutation(used):
            y, f, x, v, s = value(i)
            error = 1 / (1 + np.exp(-np.clip(y, -30, 30))) - labels[i]
            g = error * x + decay * linear[f]
            linear_moment[f] += g**2
            linear[f] -= rate * g / np.sqrt(linear_moment[f])
            g = error * (x[:, None] * s - v * (x**2)[:, None]) + decay * v
            factor_moment[f] += g**2
            factors[f] -= rate * g / np.sqrt(factor_moment[f])
            bias_moment += error**2
            bias -= rate * error / np.sqrt(bias_moment)
    return QualityModel(edges, linear, factors, float(bias)), used


def _fewest_errors(x: np.ndarray, zeros: np.ndarray, ones: np.ndarray) -> float:
    """The middle of the range of thresholds with the fewest errors."""
    errors = np.concatenate(([0], np.cumsum(ones - zeros)))  # of a threshold below x[k], less a constant
    best = np.flatnonzero(errors <= errors.min())
    edges = np.concatenate(([x[0] - 1], x, [x[-1] + 1]))
    return float((edges[best[0]] + edges[best[-1] + 1]) / 2)


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, stats, word, weight, begin in features(batch["text"]):
            counts = np.diff(begin)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"].slice(lo, hi - lo), batch["label"].cast(pa.int32()).slice(lo, hi - lo), lists(stats.ravel(), np.full(hi - lo, len(STATS)), pa.float64()), lists(word.astype(np.int32), counts, pa.int32()), lists(weight, counts, pa.float32())],
                ["doc_id", "label", "stats", "words", "weights"],
            )


def train(docs: DataFrame, labels: DataFrame, *, per_class: int = 3000, max_chars: int = 20_000) -> QualityModel:
    """Fit on a bounded sample (labelled_sample) of docs (doc_id, text) with labels (doc_id, quality); threshold from all labelled documents that the fit did not see."""
    sample = labelled_sample(docs, labels, "quality", per_class=per_class, max_chars=max_chars)
    schema = "doc_id long, label int, stats array<double>, words array<int>, weights array<float>"
    rows = in_batches(sample, _examples, schema).toArrow().combine_chunks().sort_by("doc_id")
    stats = np.array(rows["stats"].to_pylist()).reshape(-1, len(STATS))
    model, used = fit(stats, [np.asarray(x.values) for x in rows["words"]], [np.asarray(x.values) for x in rows["weights"]], rows["label"].to_numpy())
    if model.constant is None:
        shared = docs.sparkSession.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for lo, hi, *parts in features(batch["text"]):
                    yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(lo, hi - lo), pa.array(np.zeros(hi - lo, np.int32)), pa.array(_logits(shared.value, *parts))], ["doc_id", "group", "logit"])

        found = unseen_logits(docs, labels, "quality", rows["doc_id"].to_numpy()[used].tolist(), lambda texts: in_batches(texts, run, "doc_id long, group int, logit double"))
        if found and all(n.any() for n in found[0][1:]):
            model = replace(model, bias=model.bias - _fewest_errors(*found[0]))
    return model


def _logits(m: QualityModel, stats, word, weight, begin) -> np.ndarray:
    cells = _binned(stats, m.edges)
    linear, factors, squares = m.linear, m.factors, (m.factors**2).sum(axis=1)
    y = m.bias + sums_by(linear[word] * weight.astype(np.float64), begin) + STAT_WEIGHT * linear[cells].sum(axis=1)
    s = np.stack([sums_by(factors[word, k] * weight.astype(np.float64), begin) for k in range(RANK)], axis=1) + STAT_WEIGHT * factors[cells].sum(axis=1)
    q = sums_by(squares[word] * weight.astype(np.float64) ** 2, begin) + STAT_WEIGHT**2 * squares[cells].sum(axis=1)
    return y + 0.5 * ((s**2).sum(axis=1) - q)


def _scores(m: QualityModel, stats, word, weight, begin) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(_logits(m, stats, word, weight, begin), -30, 30)))


def score(docs: DataFrame, model: QualityModel, *, keep: list[str] | None = None) -> DataFrame:
    """docs (the columns `keep`, by default all) with score (double, 0 to 1) and predicted (int, 1 where score >= 0.5)."""
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("score", "predicted")]
    docs = docs.select(F.col("text").cast("string").alias("text"), *[F.col(c).alias(f"kept_{k}") for k, c in enumerate(keep)])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields[1:]) + ", score double"
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            scores = np.full(len(batch), m.constant or 0.0)
            for lo, hi, *parts in features(batch.column(0)) if m.constant is None else ():
                scores[lo:hi] = _scores(m, *parts)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(scores)], [*batch.schema.names[1:], "score"])

    scored = in_batches(docs, run, schema)
    return scored.select(*[F.col(f"kept_{k}").alias(c) for k, c in enumerate(keep)], "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
