"""Words of whole Arrow text batches as numpy spans and 64-bit hashes, without a Python object per word."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 20  # bytes of text handled at once; a longer document makes a slice of its own
WINDOW = 1 << 18  # bytes hashed at once
_U = np.uint64


def _seeded(shape, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 64, size=shape, dtype=np.uint64)


_BYTE = _seeded(256, 7)
_BASE = _U(0x9E3779B97F4A7C15)
_BASE_INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

#: Words [^\x20\x09-\x0D]+
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: Letters and digits of ASCII and every byte of longer characters.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: A-Z to a-z, all else as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def slices(column: pa.Array, most: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) in slices of about `most` bytes; a null counts as empty."""
    column = pc.fill_null(column, "") if column.null_count else column
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if not n:
        return
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + most, "right")) - 1)
        yield lo, hi, buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def spans(buf: np.ndarray, offs: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes `inside`, and where each document's runs begin (one more than documents)."""
    if not len(buf):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offs), np.int64)
    is_in = inside[buf]
    edge = np.empty(len(buf), bool)
    edge[0] = True
    np.not_equal(is_in[1:], is_in[:-1], out=edge[1:])
    edge[offs[:-1][offs[:-1] < len(buf)]] = True
    at = np.flatnonzero(edge)
    keep = is_in[at]
    starts = at[keep]
    ends = np.append(at[1:], len(buf))[keep]
    return starts, ends, np.searchsorted(starts, offs)


@lru_cache(4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _BASE), np.full(n, _BASE_INVERSE)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def hash_spans(buf: np.ndarray, starts: np.ndarray, *ends: np.ndarray) -> list[np.ndarray]:
    """64-bit hashes of buf[starts:e] for each e of ends; the spans do not overlap and ends[0] is the furthest."""
    out = [np.empty(len(starts), np.uint64) for _ in ends]
    i = 0
    while i < len(starts):
        base = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends[0], base + WINDOW, "right")))
        seg = buf[base : ends[0][j - 1]]
        size = 1 << max(18, (len(seg) - 1).bit_length())
        up, down = _powers(size)
        sums = np.zeros(len(seg) + 1, np.uint64)
        np.cumsum(_BYTE[seg] * up[: len(seg)], out=sums[1:])
        at = starts[i:j] - base
        first, scale = sums[at], down[at]
        for o, e in zip(out, ends):
            o[i:j] = mix((sums[e[i:j] - base] - first) * scale)
        i = j
    return out


def code_points(buf: np.ndarray) -> np.ndarray:
    """1 where a UTF-8 character begins."""
    return ((buf & 0xC0) != 0x80).astype(np.int64)


def sums_by(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of values[bounds[i]:bounds[i+1]] for each i, empty ranges 0."""
    total = np.concatenate(([0], np.cumsum(values, dtype=values.dtype if values.dtype.kind == "f" else np.int64)))
    return total[bounds[1:]] - total[bounds[:-1]]


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def lower_latin(buf: np.ndarray) -> np.ndarray:
    """A-Z and the capitals of Latin-1 in UTF-8, in lower case."""
    out = LOWER[buf]
    capital = (buf[1:] >= 0x80) & (buf[1:] <= 0x9E) & (buf[1:] != 0x97) & (buf[:-1] == 0xC3)
    out[1:][capital] += 0x20
    return out


def held_out(doc_id, folds: int, fold: int):
    """Column: crc32 of the id as text, mod folds, is fold."""
    from pyspark.sql import functions as F

    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))
