"""Byte-level BPE encoding and decoding with a public file of ranks, by dynamic programming over byte prefixes.

A text is cut into pieces by the file's pattern; each piece is encoded by itself. Two neighbouring tokens may stand
in an encoding just if the merges, applied to their bytes alone, leave the border between them; and an encoding is
right just if all its neighbours may. So each byte prefix of a piece has exactly one last token: the one that ends
there and may follow the last token of what is before it. The table of last tokens is filled from left to right, a
piece's ids are read off from its end. The table of a prefix never changes by what follows: an append extends it. After an
edit the table is filled again from the edit to where as many entries as the longest token has bytes agree
with the old ones; from there on all do.

Defined cases: a null or empty text has no ids and decodes to no bytes. Rows that share a doc_id are encoded each by
its own text. Texts and pieces of any length are taken whole, in time linear in their bytes. Memory is bounded: a
partition forgets what it has learnt beyond CACHE. Columns named as the results are replaced, others pass through if kept.
An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice
from struct import pack

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import _passed
from .shared import in_batches

CACHE = 300_000  # pieces, and a million pairs of tokens, that a partition remembers
SHORT = 64  # characters of a piece that is remembered
LONG = 1 << 20  # characters of a text, or ids, from which it is taken part by part
REACH = 8  # bytes after a piece that the pattern may have looked at
BEGINS = 1 << 31  # marks the first byte of a piece in a stored table

#: Letters and digits of Unicode 17 and 18, which the rank files' library doesn't know as such.
NEWER = (
    "0558 058B-058C 088F 0C5C 0CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 10EC5-10EC7 10ED9-10EEE"
    " 11B0A 11DB0-11DDB 11DE0-11DE9 11DF1-11DF1 1246F 12475-1247F 12550-12686 16EA0-16EB8 16EBB-16ED3 16FF2-16FF6 187F8-187FF 18CD6-18CDA 18D09-18D20"
    " 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2"
    " 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F"
)
_NEWER = "".join("-".join(f"\\U{int(end, 16):08x}" for end in span.split("-")) for span in NEWER.split())


@dataclass
class Ranks:
    """A rank file: a token's id is its rank, merges of lower rank come first."""

    tokens: list[bytes]
    rank: dict[bytes, int]

    @classmethod
    def load(cls, path: str) -> Ranks:
        with open(path, "rb") as f:
            rank = {base64.b64decode(token): int(r) for token, r in map(bytes.split, f)}
        tokens = [b""] * (max(rank.values()) + 1)
        for token, r in rank.items():
            tokens[r] = token
        return cls(tokens, rank)

    def __post_init__(self):
        """The two halves that each token is merged from, and a trie of the tokens that merges make, read from their ends."""
        if any(bytes([b]) not in self.rank for b in range(256)):
            raise ValueError("the rank file lacks single bytes")
        self.longest = max(map(len, self.rank))
        self.halves: list[tuple[int, int] | None] = [None] * len(self.tokens)
        self.trie, self.ends = {}, [-1]
        for token, r in sorted(self.rank.items(), key=lambda x: x[1]):
            if len(token) > 1:
                pairs = ((self.rank.get(token[:i]), self.rank.get(token[i:])) for i in range(1, len(token)))
                self.halves[r] = next(((a, b) for a, b in pairs if a is not None and b is not None and self.made(a) < r and self.made(b) < r and self.apart(a, b, r)), None)
                if self.halves[r] is None:
                    continue  # no merges make it: only a piece that equals it is encoded so
            node = 0
            for byte in reversed(token):
                to = self.trie.get(node << 8 | byte)
                if to is None:
                    to = self.trie[node << 8 | byte] = len(self.ends)
                    self.ends.append(-1)
                node = to
            self.ends[node] = r

    def made(self, token: int) -> int:
        """When a token is made: by its rank; single bytes are there from the first."""
        return token if len(self.tokens[token]) > 1 else -1

    def apart(self, a: int, b: int, below: int = 1 << 62) -> bool:
        """Whether the merges of ranks under `below`, applied to the bytes of both tokens in a row, leave the border between them.

        From the last state back: at each step the later one of the two merges that made the neighbours of the border is undone. Until
        it was made (of equal ranks the left one is made first) no merge across the border may have been due.
        """
        tokens, rank, halves = self.tokens, self.rank, self.halves
        while True:
            across = rank.get(tokens[a] + tokens[b])
            if across is not None and across < below:
                return False
            of_a, of_b = halves[a], halves[b]
            if of_a is None and of_b is None:
                return True
            if of_b is None or (of_a is not None and a > b):
                below, a = a, of_a[1]
            else:
                below, b = b + 1, of_b[0]


class Encoder:
    """Ids of texts. Remembers short pieces, and which tokens may be neighbours."""

    def __init__(self, ranks: Ranks, pattern: str):
        self.ranks = ranks
        self.plain = regex.compile(pattern)
        known = {"\\p{L}": f"[\\p{{L}}--[{_NEWER}]]", "\\p{N}": f"[\\p{{N}}--[{_NEWER}]]"}
        self.exact = regex.compile("(?V1)" + re.sub(r"\\p\{[LN]\}", lambda m: known[m[0]], pattern))
        self.newer = re.compile(f"[{_NEWER}]")
        self.pieces: dict[str, bytes] = {}
        self.pairs: dict[int, bool] = {}

    def _split(self, text: str) -> regex.Pattern:
        return self.exact if not text.isascii() and self.newer.search(text) else self.plain

    def extend(self, piece: bytes, last: list[int], *, same_from: int | None = None, old: np.ndarray | None = None) -> int:
        """Fill last, whose entry i is the last token of the first i bytes (entry 0: -1), up to the piece's end; how many entries were worked out.

        old holds what the entries after `same_from` were, ending with the piece, before an edit in front of them: once the longest
        token's length of them agree, the rest is taken over.
        """
        trie, ends, pairs, apart, longest = self.ranks.trie, self.ranks.ends, self.pairs, self.ranks.apart, self.ranks.longest
        agreed, begun = 0, len(last)
        for i in range(begun, len(piece) + 1):
            node, j = 0, i
            while True:
                j -= 1
                node = trie[node << 8 | piece[j]]
                token = ends[node]
                if token < 0:
                    continue
                before = last[j]
                if before < 0:
                    break
                key = before << 24 | token
                may = pairs.get(key)
                if may is None:
                    if len(pairs) > 5 * CACHE:
                        pairs.clear()
                    may = pairs[key] = apart(before, token)
                if may:
                    break
            last.append(token)
            if old is not None and i > same_from:
                agreed = agreed + 1 if old[i - same_from - 1] == token else 0
                if agreed == longest:
                    last.extend(old[i - same_from :].tolist())
                    return i + 1 - begun
        return len(piece) + 1 - begun

    def ids(self, piece: bytes, last: list[int]) -> list[int]:
        """What the table of a whole piece says."""
        whole = self.ranks.rank.get(piece)
        if whole is not None:
            return [whole]
        tokens, out, i = self.ranks.tokens, [], len(piece)
        while i:
            out.append(last[i])
            i -= len(tokens[last[i]])
        out.reverse()
        return out

    def _learn(self, pieces: list[str]) -> dict[str, bytes]:
        """Ids of pieces that aren't remembered: in the order of their bytes, so that each goes on from the table of what it shares with the one before."""
        out, rank, last, before = {}, self.ranks.rank, [-1], b""
        for raw, piece in sorted((p.encode(), p) for p in pieces):
            whole = rank.get(raw)
            if whole is not None:
                out[piece] = whole.to_bytes(4, "little")
                continue
            if raw[: len(before)] != before:
                shared = 0
                for a, b in zip(raw, before):
                    if a != b:
                        break
                    shared += 1
                del last[shared + 1 :]
            self.extend(raw, last)
            out[piece] = pack(f"<{len(ids := self.ids(raw, last))}I", *ids)
            before = raw
        return out

    def _remember(self, pieces: set[str]) -> dict[str, bytes]:
        """The ids of these pieces, all that aren't remembered worked out together; long pieces are not remembered."""
        known = self.pieces
        fresh = self._learn([p for p in pieces if p not in known])
        if len(known) + len(fresh) > CACHE:
            fresh |= {p: known[p] for p in pieces if p in known}
            known.clear()
        known.update(islice(((p, ids) for p, ids in fresh.items() if len(p) <= SHORT), CACHE - len(known)))
        return fresh

    def _joined(self, pieces: list[str]) -> bytes:
        found = list(map(self.pieces.get, pieces))
        if None in found:
            fresh = self._remember(set(pieces))
            found = [self.pieces.get(p) or fresh[p] if f is None else f for p, f in zip(pieces, found)]
        return b"".join(found)

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """As encode, for texts that are held together; what is new in all of them is learnt at once."""
        out, group, size = [], [], 0
        for text in [*texts, None]:
            if text is not None and len(text) <= LONG // 16 and size + len(text) <= LONG:
                group.append(self._split(text).findall(text))
                size += len(text)
                out.append(group[-1])
                continue
            self._remember({p for pieces in group for p in pieces})
            out = [self._joined(o) if isinstance(o, list) else o for o in out]
            group, size = [], 0
            out.append(self.encode(text))
        return out[:-1]

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        pattern = self._split(text)
        if len(text) <= LONG:
            return self._joined(pattern.findall(text))
        found, out = (m[0] for m in pattern.finditer(text)), []
        while part := list(islice(found, LONG // 16)):
            out.append(self._joined(part))
        return b"".join(out)

    # The stored form: for each byte of the text the last token of its piece up to there, the first byte of a piece marked.

    def table(self, text: str | None) -> np.ndarray:
        return self.edit("", np.zeros(0, np.uint32), 0, 0, text or "")[1]

    def read(self, raw: bytes, table: np.ndarray) -> bytes:
        """The ids that a stored table holds, as encode gives them."""
        starts = [*np.flatnonzero(table & BEGINS).tolist(), len(raw)]
        out, last = [], (table & (BEGINS - 1)).tolist()
        for a, b in zip(starts, starts[1:]):
            out += self.ids(raw[a:b], [-1, *last[a:b]])
        return np.array(out, "<u4").tobytes()

    def edit(self, text: str, table: np.ndarray, start: int, stop: int, new: str) -> tuple[str, np.ndarray, int]:
        """(text with its characters from start to before stop replaced, its table, how many entries had to be worked out).

        Positions beyond the text count as its end. Pieces that end well before the edit stay; after it, splitting goes on until
        a piece begins where one began.
        """
        start = min(max(start, 0), len(text))
        stop = min(max(stop, start), len(text))
        raw, made = text.encode(), text[:start] + new + text[stop:]
        lo, hi = len(text[:start].encode()), len(text[:stop].encode())
        after, shift = lo + len(new.encode()), len(new.encode()) - (hi - lo)
        starts = np.flatnonzero(table & BEGINS)
        ends = np.append(starts[1:], len(raw))
        first = int(np.searchsorted(ends + REACH, lo, "right"))  # the first piece that may change
        at = int(starts[first]) if first < len(starts) else (len(raw) if not len(starts) else int(starts[-1]))
        begins = set(starts.tolist())
        out, worked = [table[:at]], 0
        tail = made[len(raw[:at].decode()) :]
        for m in self._split(made).finditer(tail):
            if at >= after and at - shift in begins:
                break
            piece = m[0].encode()
            end = at + len(piece)
            last = [-1]
            if at < lo and at in begins:  # up to the edit the old entries hold
                reach = min(lo, end, int(ends[np.searchsorted(starts, at)]))
                last += (table[at:reach] & (BEGINS - 1)).tolist()
            old, same = None, max(after, at)
            if same < end:
                was = same - shift, end - shift
                k = int(np.searchsorted(starts, was[0], "right")) - 1
                if k >= 0 and ends[k] >= was[1]:  # the rest of the piece was in one piece before
                    old = table[was[0] : was[1]] & (BEGINS - 1)
            worked += self.extend(piece, last, same_from=same - at, old=old)
            entries = np.array(last[1:], np.uint32)
            entries[0] |= BEGINS
            out.append(entries)
            at = end
        out.append(table[at - shift :] if at >= after else table[:0])
        return made, np.concatenate(out), worked


def decoded(ids: bytes, tokens: list[bytes]) -> bytes:
    """The bytes of ids (little-endian unsigned 32-bit integers); ids outside the file are left out."""
    flat = np.frombuffer(ids, "<u4")
    if len(flat) and int(flat.max()) >= len(tokens):
        flat = flat[flat < len(tokens)]
    return b"".join(b"".join(map(tokens.__getitem__, flat[lo : lo + LONG].tolist())) for lo in range(0, len(flat), LONG))


def _list(ids: list[bytes]) -> pa.ListArray:
    flat = np.frombuffer(b"".join(ids), "<u4").astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([len(x) // 4 for x in ids]))).astype(np.int32)), pa.array(flat, pa.int32()))


def encode(docs: DataFrame, path: str, pattern: str, *, keep: list[str] | None = None, packed: bool = False, decode: bool = False, table: bool = False) -> DataFrame:
    """docs (the columns `keep`, by default all) with ids of text: array<int>, or with packed binary of little-endian unsigned 32-bit integers.

    path: the rank file, read on the driver; pattern: what cuts texts into pieces. No special tokens. decode: also decoded (binary), what
    the ids stand for; table: also prefixes (binary), the stored table of last tokens, of four bytes for each of the text, which edited continues.
    """
    made = ["ids", *["decoded"] * decode, *["prefixes"] * table]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in made]
    kinds = ("ids binary" if packed else "ids array<int>") + ", decoded binary" * decode + ", prefixes binary" * table
    docs, schema = _passed(docs.withColumn("text", F.col("text").cast("string")), "text", keep, kinds)
    shared = docs.sparkSession.sparkContext.broadcast(Ranks.load(path))  # a few MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value, pattern)
        for batch in batches:
            tables = []
            if table:
                texts = [t.as_py() or "" for t in batch.column(0)]
                tables = [encoder.table(t) for t in texts]
                ids = [encoder.read(t.encode(), x) for t, x in zip(texts, tables)]
            else:
                ids = encoder.encode_all(batch.column(0).to_pylist())
            columns = [pa.array(ids, pa.binary()) if packed else _list(ids)]
            if decode:
                columns.append(pa.array([decoded(x, shared.value.tokens) for x in ids], pa.binary()))
            if table:
                columns.append(pa.array([x.astype("<u4").tobytes() for x in tables], pa.binary()))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *columns], [*batch.schema.names[1:], *made])

    out = in_batches(docs, run, schema)
    return out.select(*[F.col(f"kept_{k}").alias(c) for k, c in enumerate(keep)], *made)


def decode(encoded: DataFrame, path: str, *, keep: list[str] | None = None) -> DataFrame:
    """encoded (ids as encode gives them, in either form; the columns `keep`, by default all) with decoded (binary). Null ids decode to no bytes, null or unknown ones in a list are left out."""
    keep = [c for c in (encoded.columns if keep is None else keep) if c != "decoded"]
    is_list = not encoded.schema["ids"].dataType.typeName() == "binary"
    if is_list:
        encoded = encoded.withColumn("ids", F.filter(F.col("ids").cast("array<int>"), lambda x: x.isNotNull() & (x >= 0)))
    docs, schema = _passed(encoded, "ids", keep, "decoded binary")
    shared = docs.sparkSession.sparkContext.broadcast(Ranks.load(path).tokens)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.array(x.as_py() or [], "<u4").tobytes() if is_list else x.as_py() or b"" for x in batch.column(0)]
            raw = [decoded(x, shared.value) for x in ids]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(raw, pa.binary())], [*batch.schema.names[1:], "decoded"])

    out = in_batches(docs, run, schema)
    return out.select(*[F.col(f"kept_{k}").alias(c) for k, c in enumerate(keep)], "decoded")


def edited(encoded: DataFrame, edits: DataFrame, path: str, pattern: str, *, key: str = "doc_id") -> DataFrame:
    """encoded (key, text, prefixes, others) after edits (key, sequence, start, stop, replacement), with ids (array<int>), text and prefixes as encode would give them, and worked (long).

    An edit replaces the characters from start to before stop; start = stop = the text's length or more appends. The edits of
    a document are applied in the order of sequence, each to what the former left; those with a null position or replacement do nothing, nor do
    those of unknown documents. worked: entries of the table that had to be filled, the others were taken over. Documents that share a key get the same edits.
    """
    one = edits.where("start is not null and stop is not null and replacement is not null").select(key, F.struct("sequence", *[F.col(c).cast(t).alias(c) for c, t in (("start", "long"), ("stop", "long"), ("replacement", "string"))]).alias("e"))
    of_doc = one.groupBy(key).agg(F.sort_array(F.collect_list("e")).alias("edits"))  # what one document went through
    made = ["text", "ids", "prefixes", "worked"]
    keep = [c for c in encoded.columns if c not in made and c != "edits"]
    joined = encoded.select(*keep, F.col("text").cast("string").alias("text"), "prefixes").join(of_doc, key, "left")
    docs, schema = _passed(joined.select(F.struct("text", "prefixes", "edits").alias("doc"), *keep), "doc", keep, "text string, ids array<int>, prefixes binary, worked long")
    shared = docs.sparkSession.sparkContext.broadcast(Ranks.load(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value, pattern)
        for batch in batches:
            texts, tables, ids, counts = [], [], [], []
            for doc in batch.column(0).to_pylist():
                text, table, worked = doc["text"] or "", np.frombuffer(doc["prefixes"] or b"", "<u4"), 0
                for e in doc["edits"] or ():
                    text, table, n = encoder.edit(text, table, e["start"], e["stop"], e["replacement"])
                    worked += n
                texts.append(text if doc["text"] is not None or doc["edits"] else None)
                tables.append(table.astype("<u4").tobytes())
                ids.append(encoder.read(text.encode(), table))
                counts.append(worked)
            columns = [pa.array(texts, pa.string()), _list(ids), pa.array(tables, pa.binary()), pa.array(counts, pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *columns], [*batch.schema.names[1:], *made])

    out = in_batches(docs, run, schema)
    return out.select(*[F.col(f"kept_{k}").alias(c) for k, c in enumerate(keep)], *made)
