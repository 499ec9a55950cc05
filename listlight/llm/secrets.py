"""Secret scan: fixed patterns, and sliding-window Shannon entropy over candidate strings.

Base spans, leftmost and without overlap for each kind: assign (a name such as password or api_key, a
separator and a value of six characters or more), access (AKIA and capitals or digits, 20 characters or
more), hex (24 lower-case hex digits or more). The entropy pass takes runs of [A-Za-z0-9+/_=-] of WINDOW
characters or more, and their pieces between symbols of that length, slides a window over each, updates
sum(c * log2 c) from the counts that change, and takes the union of the windows at or over the threshold of
the character class of the run or piece. What base spans leave of it is reported, unless the allow-list covers it.

Defined cases: a null or empty text has no spans. Offsets are code points, the end exclusive. Spans are
sorted by start, then by kind in the order of KINDS. Rows that share a doc_id are scanned each by its own
text, and what stands in other rows of a batch never matters. A very long text is scanned in linear time. Runs of letters
alone, as long words are, or of digits alone are no candidates: such keys are found only by a fixed pattern.
Columns named spans or redacted are replaced, others pass through if kept.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import in_batches
from .textbuf import LOWER, code_points, slices, spans

KINDS = ("assign", "access", "hex", "entropy")
NAMES = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_ASSIGN = re.compile(rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE)
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
WINDOW = 24
#: Least entropy of a window, in bits a character, by class of the run: its characters besides digits.
THRESHOLDS = {"capital_hex": 3.0, "one_case": 3.6, "two_cases": 3.9, "symbols": 4.0}
#: Runs that are no secrets: UUIDs, dates and numbers, paths and names of words joined by symbols.
ALLOWED = re.compile(rb"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}|[0-9_=+/-]+|/?([A-Za-z]{1,20}[0-9]{0,4}|[0-9]{1,8})([_/=+-]+([A-Za-z]{1,20}[0-9]{0,4}|[0-9]{1,8}))*[_/=+-]*")


def _lut(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_HEX = _lut(b"0123456789abcdef")
_RUN = _lut(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-")
_SYMBOL = re.compile(rb"[+/_=-]")
_PIECE = re.compile(rb"[A-Za-z0-9]{%d,}" % WINDOW)
_TERM = [0.0] + [c * log2(c) for c in range(1, WINDOW + 1)]


def _class(run: bytes) -> str | None:
    """The class of a run; None for one without digits or without letters."""
    digits, lower, upper = re.search(rb"[0-9]", run), re.search(rb"[a-z]", run), re.search(rb"[A-Z]", run)
    if not digits or not (lower or upper):
        return None
    if re.search(rb"[+/_=-]", run):
        return "symbols"
    if lower and upper:
        return "two_cases"
    return "capital_hex" if upper and re.fullmatch(rb"[0-9A-F]+", run) else "one_case"


def entropy_spans(run: bytes) -> list[tuple[int, int]]:
    """The unions of the windows of a run, and of its pieces between symbols, that reach the threshold of the run's or piece's class."""
    found = _windows(run)
    if _SYMBOL.search(run):
        for m in _PIECE.finditer(run):
            found += [(m.start() + a, m.start() + b) for a, b in _windows(m[0])]
    return _union(found)


def _union(found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans that overlap or touch as one, by start."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if out and out[-1][1] >= a:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _left(a: int, b: int, covered: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The parts of a span that none of the spans (by start, apart from each other) covers."""
    out = []
    for k in range(max(bisect_right(covered, (a, a)) - 1, 0), len(covered)):
        p, q = covered[k]
        if p >= b:
            break
        if q > a:
            if p > a:
                out.append((a, p))
            a = q
    return out + [(a, b)] if a < b else out


def _windows(run: bytes) -> list[tuple[int, int]]:
    """The unions of a run's windows that reach its class's threshold."""
    kind = _class(run)
    if kind is None or len(run) < WINDOW or ALLOWED.fullmatch(run):
        return []
    least = WINDOW * (log2(WINDOW) - THRESHOLDS[kind])  # entropy >= threshold where sum(c log2 c) <= this
    counts, total, out = [0] * 256, 0.0, []
    for k, c in enumerate(run):
        total += _TERM[counts[c] + 1] - _TERM[counts[c]]
        counts[c] += 1
        if k + 1 >= WINDOW:
            if total <= least + 1e-9:
                if out and out[-1][1] >= k + 1 - WINDOW:
                    out[-1] = (out[-1][0], k + 1)
                else:
                    out.append((k + 1 - WINDOW, k + 1))
            gone = run[k + 1 - WINDOW]
            total += _TERM[counts[gone] - 1] - _TERM[counts[gone]]
            counts[gone] -= 1
    return out


def _scan(buf: np.ndarray, offs: np.ndarray) -> dict[int, list[tuple[int, int, str]]]:
    """By document with any: (start, end, kind) in bytes of the document, sorted."""
    found: dict[int, list[tuple[int, int, str]]] = {}

    def runs(inside: np.ndarray, least: int):
        starts, ends, _ = spans(buf, offs, inside)
        long = np.flatnonzero(ends - starts >= least)
        docs = np.searchsorted(offs, starts[long], "right") - 1
        return zip(docs.tolist(), starts[long].tolist(), ends[long].tolist())

    whole, low = buf.tobytes(), LOWER[buf].tobytes()
    named = set()
    for name in NAMES:
        at = low.find(name)
        while at >= 0:
            named.add(int(np.searchsorted(offs, at, "right")) - 1)
            at = low.find(name, at + 1)
    for d in sorted(named):
        for m in _ASSIGN.finditer(whole[offs[d] : offs[d + 1]]):
            if len(m[2]) >= 6:
                found.setdefault(d, []).append((m.start(), m.end(), "assign"))
    keyed, at = set(), whole.find(b"AKIA")
    while at >= 0:  # one that spans two documents must not hide the one after it
        keyed.add(int(np.searchsorted(offs, at, "right")) - 1)
        at = whole.find(b"AKIA", at + 1)
    for d in sorted(keyed):
        for m in _ACCESS.finditer(whole[offs[d] : offs[d + 1]]):
            if len(m[0]) >= 20:
                found.setdefault(d, []).append((m.start(), m.end(), "access"))
    for d, a, b in runs(_HEX, 24):
        found.setdefault(d, []).append((a - int(offs[d]), b - int(offs[d]), "hex"))
    base = {d: _union([(a, b) for a, b, _ in x]) for d, x in found.items()}
    for d, a, b in runs(_RUN, WINDOW):
        for x, y in entropy_spans(whole[a:b]):
            x, y = a + x - int(offs[d]), a + y - int(offs[d])
            left = _left(x, y, base.get(d, []))
            for p, q in left:
                if left == [(x, y)] or not ALLOWED.fullmatch(whole[offs[d] + p : offs[d] + q]):
                    found.setdefault(d, []).append((p, q, "entropy"))
    for x in found.values():
        x.sort(key=lambda s: (s[0], KINDS.index(s[2]), s[1]))
    return found


def _redacted(text: bytes, at: list[tuple[int, int, str]]) -> str:
    out, done = [], 0
    for a, b, kind in at:
        if a >= done:
            out += [text[done:a], f"[{kind}]".encode()]
        done = max(done, b)
    return b"".join([*out, text[done:]]).decode()


def scan(docs: DataFrame, *, keep: list[str] | None = None, redact: bool = False) -> DataFrame:
    """docs (the columns `keep`, by default all) with spans (array of kind, start, end); with redact also the text with each span replaced by its kind in brackets."""
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("spans", "redacted")]
    docs = docs.select(F.col("text").cast("string").alias("text"), *[F.col(c).alias(f"kept_{k}") for k, c in enumerate(keep)])
    extra = ["spans array<struct<kind: string, start: int, end: int>>", *(["redacted string"] if redact else [])]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields[1:]), *extra])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(0)
            for lo, hi, buf, offs in slices(text):
                found, rows, texts = _scan(buf, offs), [], []
                for d in range(hi - lo):
                    at = found.get(d, [])
                    own = buf[offs[d] : offs[d + 1]]
                    if at:
                        before = np.concatenate(([0], np.cumsum(code_points(own))))
                        rows.append([{"kind": k, "start": int(before[a]), "end": int(before[b])} for a, b, k in at])
                    else:
                        rows.append([])
                    if redact:
                        texts.append(_redacted(own.tobytes(), at) if at else text[lo + d].as_py())
                part = batch.slice(lo, hi - lo)
                more = [pa.array(rows, kind), *([pa.array(texts, pa.string())] if redact else [])]
                yield pa.RecordBatch.from_arrays([*part.columns[1:], *more], [*part.schema.names[1:], "spans", *(["redacted"] if redact else [])])

    out = in_batches(docs, run, schema)
    return out.select(*[F.col(f"kept_{k}").alias(c) for k, c in enumerate(keep)], "spans", *(["redacted"] if redact else []))
