"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

A word's embedding is the sum of the hashed vectors of the word and of its first four and five bytes.
Filters of widths 1, 2 and 3 slide over the words of the whole text, each keeps its largest value, and a
logistic layer reads these. The first component of an embedding starts as the smoothed log-odds of its
hash bucket among the training documents; everything is then trained by Adagrad. Thresholds are
calibrated by language on all labelled documents, of any length, that the fit did not see, and are folded into
the score, so that 0.5 is the threshold of every language. The language is guessed from frequent words of the
text itself.

Defined cases: a null or empty text, or one without words, pools to zero and gets the score of a text
without evidence. Without labels of both classes the score is 1 where only toxic labels exist, else 0.
Very long texts are read whole, in pieces. Rows that share a doc_id, and repeated rows, are scored each by its
own text. An empty table gives an empty result. Other columns pass through where the score is
added to the table; a column named score or predicted is replaced.
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
from .textbuf import ALNUM, hash_spans, lists, lower_latin, SLICE, slices, spans

BITS, DIM, FILTERS, WIDTHS = 18, 8, 6, (1, 2, 3)
COLUMNS = FILTERS * sum(WIDTHS)
PIECE = 1 << 15  # words whose filters are evaluated at once

#: Frequent words by which a language is guessed.
FREQUENT = {
    "en": "the of and to in is that it was for on with as are this be by from not at which or an have",
    "fr": "le la les de des du et un une que qui dans pour est pas sur par au avec ce il elle ne en",
    "de": "der die das und ist in den von zu mit nicht ein eine auf für dem des sich als auch es im",
    "es": "el la los las de del que y en un una es por con no para su al lo como más se o",
}
LANGUAGES = [*FREQUENT, "other"]


def _frequent_hashes() -> list[np.ndarray]:
    out = []
    for text in FREQUENT.values():
        buf = np.frombuffer(text.encode(), np.uint8)
        starts, ends, _ = spans(buf, np.array([0, len(buf)]), ALNUM)
        out.append(np.sort(hash_spans(buf, starts, ends)[0]))
    return out


@dataclass
class ToxicityModel:
    embedding: np.ndarray  # 2**BITS x DIM
    filters: np.ndarray  # DIM x COLUMNS; by width, offset, filter
    weights: np.ndarray
    bias: float
    thresholds: np.ndarray  # by LANGUAGES
    constant: float | None = None  # the score where there was nothing to learn from

    def table(self) -> np.ndarray:
        """Projections by bucket."""
        return (self.embedding @ self.filters).astype(np.float32, copy=False)


def _buckets(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, row after the last, words x 3 buckets, first word of each document, language of each document)."""
    frequent = _frequent_hashes()
    for lo, hi, buf, offs in slices(column, SLICE // 4):  # a worker's arrays stay small beside the model
        low = lower_latin(buf)
        starts, ends, first = spans(low, offs, ALNUM)
        whole, five, four = hash_spans(low, starts, ends, np.minimum(ends, starts + 5), np.minimum(ends, starts + 4))
        hits = np.zeros((hi - lo, len(LANGUAGES)))
        for k, known in enumerate(frequent):
            at = np.searchsorted(known, whole).clip(0, len(known) - 1)
            total = np.concatenate(([0], np.cumsum(known[at] == whole)))
            hits[:, k] = total[first[1:]] - total[first[:-1]]
        hits[:, -1] = hits.max(axis=1) == 0
        words = np.stack([(h >> np.uint64(64 - BITS)).astype(np.int32) for h in (whole, five ^ np.uint64(1 << 63), four)], axis=1)
        yield lo, hi, words, first, hits.argmax(axis=1)


def _slide(projected: np.ndarray) -> np.ndarray:
    """Words x COLUMNS of projections to words x filters of all widths; what lies past the end counts as zero."""
    out, at = [], 0
    for width in WIDTHS:
        y = projected[:, at : at + FILTERS].copy()
        for k in range(1, width):
            y[:-k] += projected[k:, at + k * FILTERS : at + (k + 1) * FILTERS]
        out.append(y)
        at += width * FILTERS
    return np.concatenate(out, axis=1)


def _pool(table: np.ndarray, words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The largest value of each filter over each document, at least 0. table: projections by bucket."""
    out = np.zeros((len(first) - 1, FILTERS * len(WIDTHS)), np.float32)
    doc_of = np.repeat(np.arange(len(first) - 1), np.diff(first))
    reach = max(WIDTHS) - 1
    for lo in range(0, len(words), PIECE):
        hi = min(len(words), lo + PIECE + reach)  # the next piece begins at lo + PIECE
        w, d = words[lo:hi], doc_of[lo:hi]
        projected = table[w[:, 0]] + table[w[:, 1]] + table[w[:, 2]]
        y, at = [], 0
        for width in WIDTHS:
            part = projected[:, at : at + FILTERS].copy()
            for k in range(1, width):
                part[:-k] += projected[k:, at + k * FILTERS : at + (k + 1) * FILTERS] * (d[k:] == d[:-k])[:, None]
            y.append(part)
            at += width * FILTERS
        n = min(PIECE, len(words) - lo)
        y, d = np.concatenate(y, axis=1)[:n], d[:n]
        begins = np.flatnonzero(np.concatenate(([True], d[1:] != d[:-1])))
        np.maximum.at(out, d[begins], np.maximum.reduceat(y, begins, axis=0))
    return out


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, words, first, language in _buckets(batch["text"]):
            flat = lists(words.ravel(), 3 * np.diff(first), pa.int32())
            yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(lo, hi - lo), batch["label"].cast(pa.int32()).slice(lo, hi - lo), pa.array(language, pa.int32()), flat], ["doc_id", "label", "language", "words"])


def fit(words: list[np.ndarray], labels: np.ndarray, *, epochs: int = 4, seed: int = 5) -> tuple[ToxicityModel, np.ndarray]:
    """(model without thresholds, places of the documents it has seen) from words (n x 3 buckets) of each document; a quarter of the documents stays unseen."""
    if not (labels == 1).any() or not (labels == 0).any():
        constant = float(len(labels) > 0 and labels.max())
        return ToxicityModel(np.zeros((1, DIM)), np.zeros((DIM, COLUMNS)), np.zeros(1), 0.0, np.zeros(len(LANGUAGES)), constant), np.arange(len(labels))
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(labels))
    parts = [order[labels[order] == y] for y in (0, 1)]
    used = np.concatenate([p[len(p) // 4 :] for p in parts])

    seen = np.ones((2, 1 << BITS))
    for i in used:
        seen[labels[i], np.unique(words[i])] += 1
    sizes = [(labels[used] == y).sum() for y in (0, 1)]
    odds = np.log(seen[1] / (sizes[1] + 2)) - np.log(seen[0] / (sizes[0] + 2))
    odds *= (seen[1] + seen[0] - 2) / (seen[1] + seen[0] + 6)  # rare buckets tell little
    touched = seen.sum(axis=0) > 2
    embedding = np.zeros((1 << BITS, DIM), np.float32)
    embedding[touched] = rng.normal(0, 0.01, (int(touched.sum()), DIM))
    embedding[:, 0] = np.where(touched, odds / 4, 0)
    filters = rng.normal(0, 0.1, (DIM, COLUMNS)).astype(np.float32)
    filters[0] = np.abs(filters[0]) + 0.3
    weights = np.full(FILTERS * len(WIDTHS), 0.3, np.float32)
    bias = -1.0
    moments = [np.full(x.shape, 0.1, np.float32) for x in (embedding, filters, weights)]
    bias_moment, rate = 0.1, 0.05
    class_weight = len(used) / (2 * np.array(sizes))
    for _ in range(epochs):
        for i in rng.permutation(used):
            w = words[i]
            if not len(w):
                continue
            e = embedding[w].sum(axis=1)
            y = _slide(e @ filters)
            top = y.argmax(axis=0)
            pooled = np.maximum(y[top, np.arange(y.shape[1])], 0)
            error = (1 / (1 + np.exp(-np.clip(pooled @ weights + bias, -30, 30))) - labels[i]) * class_weight[labels[i]]
            slope = error * weights * (pooled > 0)
            grad_filters, rows, grads, at = np.zeros_like(filters), [], [], 0
            for b, width in enumerate(WIDTHS):
                f = np.arange(b * FILTERS, (b + 1) * FILTERS)
                for k in range(width):
                    pos = top[f] + k
                    ok = pos < len(w)
                    pos, g = pos.clip(0, len(w) - 1), slope[f] * ok
                    span = slice(at + k * FILTERS, at + (k + 1) * FILTERS)
                    grad_filters[:, span] = e[pos].T * g
                    rows.append(pos)
                    grads.append((filters[:, span] * g).T)
                at += width * FILTERS
            words_hit, of = np.unique(w[np.concatenate(rows)], return_inverse=True)
            grad_embedding = np.zeros((len(words_hit), DIM), np.float32)
            np.add.at(grad_embedding, of.reshape(-1), np.repeat(np.concatenate(grads), 3, axis=0))
            moments[0][words_hit] += grad_embedding**2
            embedding[words_hit] -= rate * grad_embedding / np.sqrt(moments[0][words_hit])
            moments[1] += grad_filters**2
            filters -= rate * grad_filters / np.sqrt(moments[1])
            grad_weights = error * pooled
            moments[2] += grad_weights**2
            weights -= rate * grad_weights / np.sqrt(moments[2])
            bias_moment += error**2
            bias -= rate * error / np.sqrt(bias_moment)
    return ToxicityModel(embedding, filters, weights, float(bias), np.zeros(len(LANGUAGES))), used


def _threshold(x: np.ndarray, zeros: np.ndarray, ones: np.ndarray) -> float:
    """The middle of the gap between logits that best separates the classes (true less false positive rate)."""
    gain = np.cumsum(zeros) / max(1, zeros.sum()) - np.cumsum(ones) / max(1, ones.sum())
    best = np.flatnonzero(gain >= gain.max() - 1e-12)
    lo, hi = best[0], min(best[-1] + 1, len(x) - 1)
    return float((x[lo] + x[hi]) / 2)


def _thresholds(found: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]], prior: int = 20) -> np.ndarray:
    """By language; drawn to the common threshold as if `prior` toxic documents had set that one."""
    out = np.zeros(len(LANGUAGES))
    if not any(zeros.sum() for _, zeros, _ in found.values()) or not any(ones.sum() for *_, ones in found.values()):
        return out
    x, of = np.unique(np.concatenate([x for x, *_ in found.values()]), return_inverse=True)
    zeros, ones = (np.bincount(of, np.concatenate([f[k] for f in found.values()]), len(x)) for k in (1, 2))
    out[:] = common = _threshold(x, zeros, ones)
    for k, (x, zeros, ones) in found.items():
        n = int(ones.sum())
        if n and zeros.any():
            out[k] = (n * _threshold(x, zeros, ones) + prior * common) / (n + prior)
    return out


def _logits(model: ToxicityModel, table: np.ndarray, words: np.ndarray, first: np.ndarray) -> np.ndarray:
    return _pool(table, words, first) @ model.weights + model.bias


def train(docs: DataFrame, labels: DataFrame, *, per_class: int = 2000, max_chars: int = 20_000) -> ToxicityModel:
    """Fit on a bounded sample (labelled_sample) of docs (doc_id, text) with labels (doc_id, toxic); thresholds from all labelled documents that the fit did not see."""
    sample = labelled_sample(docs, labels, "toxic", per_class=per_class, max_chars=max_chars)
    rows = in_batches(sample, _tokens, "doc_id long, label int, language int, words array<int>").toArrow().combine_chunks().sort_by("doc_id")
    words = [np.asarray(x.values, dtype=np.int32).reshape(-1, 3) for x in rows["words"]]
    model, used = fit(words, rows["label"].to_numpy())
    if model.constant is None:
        shared = docs.sparkSession.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = shared.value.table()
            for batch in batches:
                for lo, hi, words, first, language in _buckets(batch["text"]):
                    logits = _logits(shared.value, table, words, first).astype(np.float64)
                    yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(lo, hi - lo), pa.array(language, pa.int32()), pa.array(logits)], ["doc_id", "group", "logit"])

        found = unseen_logits(docs, labels, "toxic", rows["doc_id"].to_numpy()[used].tolist(), lambda texts: in_batches(texts, run, "doc_id long, group int, logit double"))
        model = replace(model, thresholds=_thresholds(found))
    return model


def score(docs: DataFrame, model: ToxicityModel, *, keep: list[str] | None = None) -> DataFrame:
    """docs (the columns `keep`, by default all) with score (double, 0 to 1) and predicted (int, 1 where score >= 0.5), from the whole text alone."""
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("score", "predicted")]
    docs = docs.select(F.col("text").cast("string").alias("text"), *[F.col(c).alias(f"kept_{k}") for k, c in enumerate(keep)])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields[1:]) + ", score double"
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        table = m.table() if m.constant is None else None
        for batch in batches:
            scores = np.full(len(batch), m.constant or 0.0)
            for lo, hi, words, first, language in _buckets(batch.column(0)) if m.constant is None else ():
                logits = _logits(m, table, words, first) - m.thresholds[language]
                scores[lo:hi] = 1 / (1 + np.exp(-np.clip(logits.astype(np.float64), -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(scores)], [*batch.schema.names[1:], "score"])

    scored = in_batches(docs, run, schema)
    return scored.select(*[F.col(f"kept_{k}").alias(c) for k, c in enumerate(keep)], "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
