"""Quality rules as a bitmask ledger: measure once, store failure bits, judge by versioned policies.

measure() reads each text once and returns counts. ledger() evaluates every rule once on these counts and
stores one bit for each rule that fails. A policy is a set of rules, that is a mask: apply_policy() keeps
a document whose bits miss the mask, and ablation() finds by one bitwise aggregation how many documents
each policy drops, which rule drops alone, and what leaving a rule out would keep. Rules are added at the end,
so that stored bits keep their meaning; a policy that changes gets a version of its own.

Defined cases: a null or empty text has no words and fails few_words alone. Very long texts are measured whole,
in linear time. Rows that share a doc_id are
judged each by its own text. Other columns pass through where asked for; names that clash with a
measurement are replaced. An empty table gives an empty ledger.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import in_batches
from .textbuf import NOT_SPACE, code_points, hash_spans, mix, slices, spans, sums_by

MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_capitals",
    "n_bullets", "n_cut_lines", "n_wordy", "n_long_words", "n_run_chars",
)


def _set(*chars: int) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_SYMBOL = _set(*b"#*$%&|<>")
_NOT_NEWLINE = ~_set(10)
_CAPITAL = _set(*range(0x41, 0x5B))
_LETTER = _set(*range(0x41, 0x5B), *range(0x61, 0x7B))
_WORDY = _LETTER | _set(*range(0xC3, 0xF5))  # letters, and first bytes of longer characters from Latin on
_DASH = _set(*b"-*")
LONG_WORD, RUN = 30, 6


def _equal_to(keys: np.ndarray, earlier_only: bool) -> np.ndarray:
    """Where a key equals another (or one before it)."""
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    out = np.zeros(len(keys), bool)
    out[order[1:][same]] = True
    if not earlier_only:
        out[order[:-1][same]] = True
    return out


def _ends_with(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, suffix: bytes) -> np.ndarray:
    """Where buf[start:end] ends with the suffix."""
    out = ends - starts >= len(suffix)
    for k, c in enumerate(reversed(suffix)):
        out = out & (buf[np.maximum(ends - 1 - k, 0)] == c)
    return out


def _spread(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    out = np.zeros(len(at), bool)
    out[at] = values
    return out


def _in_runs(buf: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Characters, of any script, of words in runs of RUN or more equal ones of a document; begins: the first character of each document."""
    if not len(buf):
        return np.zeros(0, bool)
    c = np.frombuffer(buf.tobytes().decode().encode("utf-32-le"), np.uint32)
    new = np.concatenate(([True], c[1:] != c[:-1]))
    new[begins[:-1][begins[:-1] < len(c)]] = True
    begin = np.flatnonzero(new)
    length = np.diff(np.append(begin, len(c)))
    first = c[begin]
    return np.repeat((length >= RUN) & ((first >= 0x80) | NOT_SPACE[np.minimum(first, 0xFF)]), length)


def _doc_keys(n: np.ndarray) -> np.ndarray:
    return np.repeat(mix(np.arange(len(n), dtype=np.uint64)), n)


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts = []
        for lo, hi, buf, offs in slices(batch.column(0)):
            starts, ends, first = spans(buf, offs, NOT_SPACE)
            (w,) = hash_spans(buf, starts, ends)
            doc_of = np.repeat(np.arange(hi - lo), np.diff(first))
            at = np.flatnonzero(doc_of[2:] == doc_of[:-2])
            again = at[_equal_to(mix(w[at] + mix(w[at + 1] + mix(w[at + 2]))) + _doc_keys(np.diff(first))[at], False)]
            covered = np.zeros(len(w), bool)
            for k in range(3):
                covered[again + k] = True

            line_starts, line_ends, line_first = spans(buf, offs, _NOT_NEWLINE)
            with_word = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
            (line,) = hash_spans(buf, line_starts, line_ends)
            begin, end = np.searchsorted(starts, line_starts), np.searchsorted(starts, line_ends) - 1  # first and last word of each line
            begin, end = begin[with_word], end[with_word]
            head, tail = starts[begin], ends[end]
            bullet = (_DASH[buf[head]] & (ends[begin] - head == 1)) | _ends_with(buf, head, np.minimum(head + 3, ends[begin]), "\u2022".encode())
            cut = _ends_with(buf, starts[end], tail, b"...") | _ends_with(buf, starts[end], tail, "\u2026".encode())
            of_lines = lambda x: sums_by(_spread(x, with_word), line_first)
            wordy = np.concatenate(([0], np.cumsum(_WORDY[buf])))
            chars = np.concatenate(([0], np.cumsum(code_points(buf))))
            dup = np.zeros(len(line), bool)
            dup[with_word] = _equal_to((line + _doc_keys(np.diff(line_first)))[with_word], True)
            parts.append(
                [
                    np.diff(first),
                    sums_by(code_points(buf) * NOT_SPACE[buf], offs),
                    sums_by(_SYMBOL[buf], offs),
                    sums_by(dup, line_first),
                    sums_by(covered, first),
                    sums_by(with_word, line_first),
                    sums_by(_LETTER[buf], offs),
                    sums_by(_CAPITAL[buf], offs),
                    of_lines(bullet),
                    of_lines(cut),
                    sums_by(wordy[ends] > wordy[starts], first),
                    sums_by(chars[ends] - chars[starts] > LONG_WORD, first),
                    sums_by(_in_runs(buf, chars[offs]), chars[offs]),
                ]
            )
        columns = [pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*parts)] or [pa.array([], pa.int64())] * len(MEASURES)
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], *columns], [*batch.schema.names[1:], *MEASURES])


def measure(docs: DataFrame, *, keep: list[str] | None = None) -> DataFrame:
    """docs (the columns `keep`, by default all) with the MEASURES of text, all long. Words are [^\\x20\\x09-\\x0D]+."""
    keep = [c for c in (docs.columns if keep is None else keep) if c not in MEASURES]
    docs = docs.select(F.col("text").cast("string").alias("text"), *[F.col(c).alias(f"kept_{k}") for k, c in enumerate(keep)])
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields[1:]), *(f"{m} long" for m in MEASURES)])
    return in_batches(docs, _measure, schema).select(*[F.col(f"kept_{k}").alias(c) for k, c in enumerate(keep)], *MEASURES)


def rules() -> dict[str, Column]:
    """Each rule, in the order of its bit: true where a document fails."""
    n, words = F.col("n_words"), F.greatest(F.col("n_words"), F.lit(1))
    return {
        "few_words": n < 50,
        "repeated_words": F.col("n_repeat_words") * 100 > n * 50,
        "short_or_long_words": (n > 0) & ((F.col("word_chars") < 2 * n) | (F.col("word_chars") > 20 * n)),
        "symbols": F.col("n_symbols") * 100 > words * 20,
        "duplicate_lines": (F.col("n_dup_lines") >= 3) & (F.col("n_dup_lines") * 100 > F.col("n_lines") * 30),
        "capitals": (F.col("n_letters") >= 50) & (F.col("n_capitals") * 100 > F.col("n_letters") * 40),
        "bullets": (F.col("n_lines") >= 3) & (F.col("n_bullets") * 100 > F.col("n_lines") * 90),
        "cut_lines": (F.col("n_lines") >= 3) & (F.col("n_cut_lines") * 100 > F.col("n_lines") * 30),
        "no_letters": F.col("n_wordy") * 100 < n * 60,
        "long_words": F.col("n_long_words") * 100 > n * 10,
        "runs": F.col("n_run_chars") * 100 > F.col("word_chars") * 20,
    }


#: Versions of policies: rules whose failure drops a document.
POLICIES = {
    "base": ("few_words", "repeated_words"),
    "2": ("few_words", "repeated_words", "short_or_long_words", "symbols", "duplicate_lines", "capitals"),
    "3": ("few_words", "repeated_words", "short_or_long_words", "symbols", "duplicate_lines", "capitals", "bullets", "cut_lines", "no_letters", "long_words", "runs"),
}
LATEST = "3"


#: The rules by name, in the order of their bits: what rules() gives, without making its columns.
NAMES = POLICIES["3"]


def mask(names: tuple[str, ...]) -> int:
    return sum(1 << NAMES.index(x) for x in names)


def ledger(measured: DataFrame) -> DataFrame:
    """measured with failed_bits (long): bit k set where rule k fails."""
    bits = [F.when(rule, F.lit(mask((name,)))).otherwise(F.lit(0)).cast("long") for name, rule in rules().items()]
    return measured.withColumn("failed_bits", reduce(lambda a, b: a.bitwiseOR(b), bits))


def fails(policy: str) -> Column:
    return F.col("failed_bits").bitwiseAND(F.lit(mask(POLICIES[policy]))) != 0


def apply_policy(book: DataFrame, policy: str = LATEST, *, base: str = "base") -> DataFrame:
    """book with base_failed and kept (boolean): failure of the base policy, and neither that nor failure of `policy`."""
    return book.withColumn("base_failed", fails(base)).withColumn("kept", ~(fails(base) | fails(policy)))


def only_rule(policy: str = LATEST) -> Column:
    """The rule of a policy that alone drops a document, null if none or several do."""
    bits = F.col("failed_bits").bitwiseAND(F.lit(mask(POLICIES[policy])))
    return F.coalesce(*[F.when(bits == mask((name,)), F.lit(name)) for name in POLICIES[policy]])


def ablation(book: DataFrame, *policies: str) -> DataFrame:
    """policy, rule, failed, only_this (what only this rule drops, so what leaving it out would keep), dropped, rows; from one aggregation over distinct bits."""
    bits = book.groupBy("failed_bits").count()
    flags = [
        F.struct(F.lit(p).alias("policy"), F.lit(name).alias("rule"), F.lit(mask((name,))).cast("long").alias("bit"), F.lit(mask(POLICIES[p])).cast("long").alias("mask"))
        for p in policies or (LATEST,)
        for name in POLICIES[p]
    ]
    each = bits.withColumn("r", F.explode(F.array(*flags))).withColumn("bits", F.col("failed_bits").bitwiseAND(F.col("r.mask")))
    count_if = lambda c: F.coalesce(F.sum(F.when(c, F.col("count"))), F.lit(0))
    return each.groupBy(F.col("r.policy").alias("policy"), F.col("r.rule").alias("rule")).agg(
        count_if(F.col("bits").bitwiseAND(F.col("r.bit")) != 0).alias("failed"),
        count_if(F.col("bits") == F.col("r.bit")).alias("only_this"),
        count_if(F.col("bits") != 0).alias("dropped"),
        F.sum("count").alias("rows"),
    )
