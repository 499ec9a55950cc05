"""Byte-level BPE against the public library and plain merging; appends and edits against encoding anew."""

import hashlib
import random
import time

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from listlight.llm import byte_bpe, queries
from tests.oracle import SF

ALPHABET = "aaab ' \n\t  srelvmtd12é世́‍😀\U000323e7՘　\x85\x1c!?.the ing"
ODD = [None, "", " ", "  \n\n x ", "don't I'LL we've 12345", "é" * 3, "x" * 50_000, " " * 30_000 + "y", "\x00\x01", "<|endoftext|>", "a\u0000b", "\U000323e7a1\U000323e7"]


@pytest.fixture(scope="module")
def ranks():
    return byte_bpe.Ranks.load(queries.RANKS)


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks.rank, special_tokens={})


@pytest.fixture(scope="module")
def encoder(ranks):
    return byte_bpe.Encoder(ranks, public_tokenizers.PATTERN)


def packed(ids) -> bytes:
    return np.array(ids, "<u4").tobytes()


def some_text(rng, most) -> str:
    return "".join(rng.choices(ALPHABET, k=rng.randint(0, most)))


def merged(piece: bytes, rank: dict) -> list[int]:
    """Plain merging: always the neighbours of least rank, from the left."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        least, i = min((rank.get(parts[i] + parts[i + 1], 1 << 40), i) for i in range(len(parts) - 1))
        if least == 1 << 40:
            break
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [rank[p] for p in parts]


def test_every_prefix_has_the_last_token_of_its_own_encoding(ranks, encoder):
    rng = random.Random(3)
    for piece in [b" " + bytes(rng.choices(b"theingra", k=40)) for _ in range(20)] + [b"a" * 50, "ßüé世界".encode(), b"\xff\xfe\x00"]:
        last = [-1]
        encoder.extend(piece, last)
        for n in range(1, len(piece) + 1):
            assert last[n] == merged(piece[:n], ranks.rank)[-1]


def test_small_rank_files_with_tokens_that_no_merge_makes():
    """'abc' can't be made, as 'bc' goes with 'd' first or not at all; a piece that equals it is one token all the same."""
    rank = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"xyz": 257, b"aa": 258, b"aaa": 259, b"ba": 260}
    tokens = [b""] * 261
    for token, r in rank.items():
        tokens[r] = token
    own = byte_bpe.Encoder(byte_bpe.Ranks(tokens, rank), r"\w+|\W+")
    library = tiktoken.Encoding("small", pat_str=r"\w+|\W+", mergeable_ranks=rank, special_tokens={})
    rng = random.Random(5)
    for text in ["xyz", "xyzz", "xxyz", *("".join(rng.choices("abxyz ", k=rng.randint(1, 12))) for _ in range(2000))]:
        assert own.encode(text) == packed(library.encode_ordinary(text)), text
    with pytest.raises(ValueError):
        byte_bpe.Ranks([b"a"], {b"a": 0})


def test_texts_against_the_library(encoder, library, ranks):
    rng = random.Random(1)
    for text in [*ODD, *(some_text(rng, 40) for _ in range(3000))]:
        ids = encoder.encode(text)
        assert ids == packed(library.encode_ordinary(text or "")), text
        assert byte_bpe.decoded(ids, ranks.tokens) == (text or "").encode()


def test_classes_of_all_characters_are_the_library_s(library, encoder):
    """A letter joins letters before it, a digit digits, another sign other signs: every character in each place."""
    for first in range(0x80, 0x110000, 97):
        chars = [chr(c) for c in range(first, min(first + 97, 0x110000)) if not 0xD800 <= c < 0xE000]
        if first % 5 == 0 or any(encoder.newer.search(c) for c in chars):
            text = "".join(f"a{c}a1{c}1!{c}! {c} " for c in chars)
            assert encoder.encode(text) == packed(library.encode_ordinary(text)), hex(first)


def test_long_texts_are_taken_in_parts(monkeypatch, ranks, library):
    monkeypatch.setattr(byte_bpe, "LONG", 64)
    monkeypatch.setattr(byte_bpe, "CACHE", 20)
    own = byte_bpe.Encoder(ranks, public_tokenizers.PATTERN)
    rng = random.Random(2)
    for _ in range(50):
        text = some_text(rng, 600)
        ids = own.encode(text)
        assert ids == packed(library.encode_ordinary(text)) and byte_bpe.decoded(ids, ranks.tokens) == text.encode()
        assert len(own.pieces) <= 20


def test_edits_and_appends_equal_encoding_anew(encoder):
    rng = random.Random(4)
    for k in range(1500):
        text = some_text(rng, 60) if k % 5 else "".join(rng.choices("abcdefgh", k=300))
        table = encoder.table(text)
        for _ in range(3):
            start = rng.randint(0, len(text))
            stop = rng.randint(start, min(len(text), start + 5))
            new = some_text(rng, 6)
            made, after, _ = encoder.edit(text, table, start, stop, new)
            assert made == text[:start] + new + text[stop:]
            assert (after == encoder.table(made)).all() and encoder.read(made.encode(), after) == encoder.encode(made), (text, start, stop, new)
            text, table = made, after


def test_edits_of_long_texts_work_out_few_entries(encoder):
    rng = random.Random(6)
    piece = "".join(rng.choices("abcdefgh", k=100_000))  # one piece
    words = " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(20_000))
    for text in (piece, words):
        table = encoder.table(text)
        for start, stop, new in ((1000, 1001, "z"), (0, 1, ""), (len(text), len(text), "zzz"), (50_000, 50_000, " and "), (70_000, 70_003, "")):
            _, _, worked = encoder.edit(text, table, start, stop, new)
            assert worked <= 5 * encoder.ranks.longest, (start, worked)


def test_long_pieces_take_linear_time(encoder):
    for piece in ("ab" * 100_000, "=" * 200_000, " " * 200_000, "é" * 100_000):
        began = time.time()
        encoder.encode(piece)
        assert time.time() - began < 5


def test_query_digests(spark, library):
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.op13_byte_bpe(spark, SF).collect()}
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for r in rows:
        ids = library.encode_ordinary(r["text"])
        assert got[r["doc_id"]] == (len(ids), hashlib.sha256(packed(ids)).hexdigest(), hashlib.sha256(r["text"].encode()).hexdigest())


def test_tables_with_odd_rows(spark, library):
    odd = spark.createDataFrame([(k if k != 3 else None, t, k, "x") for k, t in enumerate(ODD)] + [(1, "again", 0, "y")], "doc_id long, text string, ids int, kept string")
    coded = byte_bpe.encode(odd, queries.RANKS, public_tokenizers.PATTERN, decode=True)
    assert coded.columns == ["doc_id", "text", "kept", "ids", "decoded"]
    for r in coded.collect():
        assert r["ids"] == library.encode_ordinary(r["text"] or "") and bytes(r["decoded"]) == (r["text"] or "").encode()
    assert byte_bpe.encode(odd.limit(0), queries.RANKS, public_tokenizers.PATTERN, packed=True, table=True).count() == 0
    back = byte_bpe.decode(coded.drop("decoded").withColumn("decoded", F.lit(1)), queries.RANKS)
    assert all(bytes(r["decoded"]) == (r["text"] or "").encode() for r in back.collect())
    loose = spark.createDataFrame([(1, [72, None, 999_999, -5]), (2, None), (3, [])], "k int, ids array<int>")
    assert {r["k"]: bytes(r["decoded"]) for r in byte_bpe.decode(loose, queries.RANKS).collect()} == {1: library.decode_bytes([72]), 2: b"", 3: b""}
    raw = byte_bpe.encode(odd, queries.RANKS, public_tokenizers.PATTERN, packed=True)
    assert all(bytes(r["decoded"]) == (r["text"] or "").encode() for r in byte_bpe.decode(raw, queries.RANKS).collect())


def test_edited_tables(spark, library):
    docs = spark.createDataFrame([(1, "hello world", "a"), (2, None, "b"), (3, "", "c"), (4, "unchanged", "d"), (1, "hello there", "e"), (None, "no id", "f")], "doc_id long, text string, kept string")
    coded = byte_bpe.encode(docs, queries.RANKS, public_tokenizers.PATTERN, table=True)
    edits = [(1, 2, 5, 5, " brave new"), (1, 1, 0, 1, "J"), (2, 1, 0, 0, "now here"), (3, 1, 9, 99, "end"), (4, 1, None, 2, "x"), (4, 2, 1, 2, None), (99, 1, 0, 0, "lost"), (None, 1, 0, 0, "x")]
    out = byte_bpe.edited(coded, spark.createDataFrame(edits, "doc_id long, sequence int, start int, stop int, replacement string"), queries.RANKS, public_tokenizers.PATTERN)
    got = {r["kept"]: r for r in out.collect()}
    assert {k: r["text"] for k, r in got.items()} == {"a": "Jello brave new world", "b": "now here", "c": "end", "d": "unchanged", "e": "Jello brave new there", "f": "no id"}
    assert all(r["ids"] == library.encode_ordinary(r["text"]) for r in got.values()) and got["d"]["worked"] == 0
    again = byte_bpe.edited(out, spark.createDataFrame([(1, 1, 99, 99, "!")], "doc_id long, sequence int, start int, stop int, replacement string"), queries.RANKS, public_tokenizers.PATTERN)
    got = {r["kept"]: r for r in again.collect()}
    assert got["a"]["text"] == "Jello brave new world!" and got["a"]["ids"] == library.encode_ordinary("Jello brave new world!")
