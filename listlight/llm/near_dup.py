"""Near-duplicate documents: banded MinHash, sequential Bayesian verification, exact confirmation.

How it runs: documents with the same shingle set collapse to one representative by an aggregation.
Representatives meet in band buckets. First each member is compared with its bucket's smallest id (linear
in the bucket). Buckets whose members still lie in different components are then dealt out in square
blocks of bounded size, in which all pairs of different components are compared; a block returns the
links that join components, never all pairs. Both comparisons read the signatures batch by batch and
leave a pair as soon as the posterior probability that its similarity reaches the threshold falls under
`miss`; what survives is confirmed on the full shingle sets (64-bit hashes).

Defined cases: a null or empty text, or one without words, has no shingles, is linked with nothing and is
kept. Fewer words than `words` make one shingle of the whole sequence. A very long text is one set like any
other; blocks are bounded by the shingles that they hold. Rows that share a doc_id count as one document, whose
text is that with the most shingles (among equals the one whose set has the larger hash); each has its own n_shingles and the document's component. A
null doc_id takes no part in linking: component_id is null and kept true. Other columns are neither read nor
returned. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import components
from .shared import drop, in_batches, join_spread, written
from .textbuf import LOWER, NOT_SPACE, hash_spans, mix, slices, spans

BANDS, ROWS = 26, 5
HASHES = BANDS * ROWS
BLOCK = 256  # members of a bucket on each side of a block, or so
BLOCK_SHINGLES = 1 << 20  # their shingles (8 MB), or so; a larger set is a side of its own
HOT = 10_000  # groups that hold this part of all rows or more, so this many at most, are joined by a broadcast
PLAIN = "uncompressed"  # hashes don't compress, and a codec's direct buffers grow to the largest set
BROADCAST_IDS = 1_000_000  # ids (8 MB) up to which the texts to confirm are found by a broadcast
_rng = np.random.default_rng(11)
_MUL = (_rng.integers(0, 1 << 32, (HASHES, 1), dtype=np.uint32) | np.uint32(1)).astype(np.uint32)
_ADD = _rng.integers(0, 1 << 32, (HASHES, 1), dtype=np.uint32)
_WITHIN = _rng.integers(0, 1 << 64, (BANDS, ROWS), dtype=np.uint64) | np.uint64(1)
_PLACE = _rng.integers(0, 1 << 64, 64, dtype=np.uint64) | np.uint64(1)

FEATURES = "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>, sig binary"


def shingle_sets(buf: np.ndarray, offs: np.ndarray, words: int) -> Iterator[np.ndarray]:
    """For each document the sorted distinct 64-bit hashes of its shingles of lower-cased (A-Z) words."""
    starts, ends, first = spans(buf, offs, NOT_SPACE)
    (w,) = hash_spans(LOWER[buf], starts, ends)
    if len(w) >= words:
        full = mix(sum(w[k : len(w) - words + 1 + k] * _PLACE[k] for k in range(words)))
    for lo, hi in zip(first[:-1], first[1:]):
        n = hi - lo
        if n >= words:
            x = np.sort(full[lo : hi - words + 1])
            yield x[np.concatenate(([True], x[1:] != x[:-1]))]
        elif n:
            yield mix((w[lo:hi] * _PLACE[:n]).sum(keepdims=True) + np.uint64(n))
        else:
            yield w[:0]


def minhash(x: np.ndarray) -> np.ndarray:
    """The smallest value of each of HASHES permutations over a set of 64-bit hashes."""
    low = x.astype(np.uint32)
    sig = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(low), 2048):
        np.minimum(sig, (low[k : k + 2048] * _MUL + _ADD).min(axis=1), out=sig)
    return sig


def _set_hash(x: np.ndarray) -> tuple[int, int]:
    return (x.sum(), mix(x ^ _PLACE[0]).sum()) if len(x) else (0, 0)


def _features(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        band = np.arange(BANDS, dtype=np.uint64)
        for batch in batches:
            ids = batch.column(0)
            for lo, hi, buf, offs in slices(batch.column(1)):
                n, sets, bands, sigs = [], [], [], []
                for x in shingle_sets(buf, offs, words):
                    n.append(len(x))
                    sets.append(_set_hash(x))
                    if len(x):
                        sig = minhash(x)
                        bands.append(mix((sig.reshape(BANDS, ROWS) * _WITHIN).sum(axis=1) + band).view(np.int64))
                        sigs.append(sig.astype(np.uint16).tobytes())
                    else:
                        bands.append(None)
                        sigs.append(None)
                both = np.array(sets, np.uint64).reshape(-1, 2).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, hi - lo), pa.array(n, pa.int64()), pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(bands, pa.list_(pa.int64())), pa.array(sigs, pa.binary())],
                    ["doc_id", "n_shingles", "set_a", "set_b", "bands", "sig"],
                )

    return run


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, offs in slices(batch.column(1)):
                sets = list(shingle_sets(buf, offs, words))
                both = np.array([_set_hash(x) for x in sets], np.uint64).reshape(-1, 2).view(np.int64)
                columns = [pa.array([len(x) for x in sets], pa.int64()), pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array([x.tobytes() for x in sets], pa.binary())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *columns], ["doc_id", "n_shingles", "set_a", "set_b", "shingles"])

    return run


@lru_cache(8)
def least_matches(threshold: float, miss: float, batch: int = BANDS) -> list[tuple[int, int]]:
    """(hashes read, matches below which a pair is left): P(S >= threshold | matches) < miss under a uniform prior.

    The posterior is Beta(m + 1, n - m + 1), whose upper tail at t is P(Binomial(n + 1, t) <= m).
    """
    out = []
    for n in range(batch, HASHES + 1, batch):
        tail, m = 0.0, -1
        while tail < miss:
            m += 1
            tail += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append((n, m))
    return out


def _fixed(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, HASHES)


def _survivors(a: np.ndarray, b: np.ndarray, threshold: float, miss: float) -> np.ndarray:
    """Positions of the pairs (rows of a and b) that no batch of hashes rules out."""
    left, m, at = np.arange(len(a)), np.zeros(len(a), np.int64), 0
    for n, least in least_matches(threshold, miss):
        m = m + (a[left, at:n] == b[left, at:n]).sum(axis=1)
        left, m, at = left[m >= least], m[m >= least], n
    return left


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _prune(percent: int, miss: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = _survivors(_fixed(batch["sig"]), _fixed(batch["sig_b"]), percent / 100, miss)
            yield batch.select(["a", "b"]).take(pa.array(keep))

    return run


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch["shingles"], batch["shingles_b"])
            keep = [_linked(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), percent) for x, y in pairs]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _intersections(x: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of one sorted set with each of others (none empty)."""
    y = np.concatenate(others)
    same = x[np.searchsorted(x, y).clip(0, len(x) - 1)] == y
    return np.add.reduceat(same, np.concatenate(([0], np.cumsum([len(o) for o in others[:-1]]))).astype(np.int64), dtype=np.int64)


def _block_links(ids, comps, left, right, sigs, sets, percent: int, miss: float) -> list[tuple[int, int]]:
    """Links that join different components between the rows `left` and `right` of one block."""
    label, number, n = np.array(comps), np.array(ids), np.array([len(x) for x in sets])
    found = []
    for i in left:
        other = right[(label[right] != label[i]) & (number[right] != number[i])]
        if left is right:
            other = other[other > i]
        other = other[_survivors(np.broadcast_to(sigs[i], (len(other), HASHES)), sigs[other], percent / 100, miss)]
        if not len(other):
            continue
        both = _intersections(sets[i], [sets[k] for k in other])
        for k in other[100 * both >= percent * (n[i] + n[other] - both)]:
            if label[k] != label[i]:
                label[label == label[k]] = label[i]
                found.append((ids[i], ids[k]))
    return found


def _blocks(percent: int, miss: float):
    """Over rows sorted by block (bucket, i, j): the links of each block. Rows of a block may span batches; it has 2 BLOCK rows or so."""

    def solve(rows: list[tuple]) -> list[tuple[int, int]]:
        i, j = rows[0][1], rows[0][2]
        ids, comps, chunk = [r[3] for r in rows], [r[4] for r in rows], [r[5] for r in rows]
        sigs = np.frombuffer(b"".join(r[6] for r in rows), np.uint16).reshape(-1, HASHES)
        sets = [np.frombuffer(r[7], np.uint64) for r in rows]
        left = np.flatnonzero(np.array(chunk) == i)
        right = left if i == j else np.flatnonzero(np.array(chunk) == j)
        return _block_links(ids, comps, left, right, sigs, sets, percent, miss)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            found = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if rows and rows[0][:3] != row[:3]:
                    found += solve(rows)
                    rows = []
                rows.append(row)
            yield _links(found)
        yield _links(solve(rows) if rows else [])

    return run


def _links(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["a", "b"])


def _hot(groups: DataFrame, rows: str) -> Column:
    """Groups of so many rows that HOT of them would hold all."""
    total = groups.agg(F.coalesce(F.sum(rows), F.lit(0))).first()[0]
    return F.col(rows) * HOT >= F.lit(max(total, 2 * HOT))


def near_duplicates(docs: DataFrame, *, words: int = 5, percent: int = 85, miss: float = 1e-6) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs (doc_id, text); links have 100 * |A and B| >= percent * |A or B|.

    component_id is the smallest doc_id that links reach; kept marks that document. 26 bands of 5 hashes lose
    a pair of similarity 0.85 with probability 3e-7; `miss` bounds what a batch of the Bayesian test adds.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    features = written(in_batches(source, _features(words), FEATURES), "features", PLAIN)
    own = F.struct("n_shingles", "set_a", "set_b")
    twice = features.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("rows"), F.max(own).alias("of_doc")).where("rows > 1").drop("rows")
    twice = written(twice, "twice")
    table = features.withColumn("of_doc", own)  # what stands for the document
    if not twice.isEmpty():
        few = twice.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
        table = features.join(F.broadcast(twice) if few else twice, "doc_id", "left").withColumn("of_doc", F.coalesce("of_doc", own))
    with_set = table.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull() & (F.col("of_doc") == own))
    reps = written(with_set.groupBy("set_a", "set_b", "n_shingles").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "copies")
    of_reps = with_set.join(reps.select("rep").distinct(), with_set.doc_id == F.col("rep"), "left_semi")

    in_bands = of_reps.select("doc_id", "n_shingles", F.explode("bands").alias("bucket"))
    buckets = in_bands.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("shingles"), F.min("doc_id").alias("least")).where("n > 1")
    buckets = written(buckets, "buckets")
    of_bucket = join_spread(in_bands.select("bucket", "doc_id"), buckets, ["bucket"], _hot(buckets, "n"), F.xxhash64("doc_id", "bucket"))
    members = written(of_bucket.where("n is not null").select("bucket", "doc_id", "n", "shingles", "least"), "members")
    drop(buckets)

    stars = written(members.where("doc_id <> least").select(F.col("doc_id").alias("a"), F.col("least").alias("b")).distinct(), "stars")
    signed = with_set.select("doc_id", "n_shingles", "sig").dropDuplicates(["doc_id"])  # equal ones
    one = signed.toDF("a", "n_a", "sig")
    two = signed.toDF("b", "n_b", "sig_b")
    near_size = (F.col("n_a") * 100 >= F.col("n_b") * percent) & (F.col("n_b") * 100 >= F.col("n_a") * percent)
    centres = written(stars.groupBy("b").agg(F.count("*").alias("stars")).join(two, "b"), "centres")
    starred = join_spread(stars.join(one, "a"), centres, ["b"], _hot(centres, "stars"), F.xxhash64("a")).where(near_size).select("a", "b", "sig", "sig_b")
    likely = written(in_batches(starred, _prune(percent, miss), "a long, b long"), "likely")
    drop(stars, centres)

    def sets_of(ids: DataFrame) -> DataFrame:
        ids = written(ids.distinct(), "ids")
        few = ids.count() <= BROADCAST_IDS
        kept = source.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")
        each = in_batches(kept.select("doc_id", "text"), _sets(words), "doc_id long, n_shingles long, set_a long, set_b long, shingles binary")
        out = written(each.groupBy("doc_id").agg(F.max_by("shingles", own).alias("shingles")), "sets", PLAIN)
        drop(ids)
        return out

    sets = sets_of(likely.select(F.col("a").alias("doc_id")).union(likely.select("b")))
    pairs = likely.join(sets.toDF("a", "shingles"), "a").join(sets.toDF("b", "shingles_b"), "b")
    links = written(in_batches(pairs.select("a", "b", "shingles", "shingles_b"), _confirm(percent), "a long, b long"), "links")
    drop(likely, sets)
    roots = written(components(links), "roots")

    # Buckets of three or more whose members still lie in different components.
    rooted = members.where("n > 2").join(roots, F.col("doc_id") == F.col("node"), "left").select("bucket", "n", "shingles", "doc_id", F.coalesce("root", "doc_id").alias("comp"))
    still = rooted.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("bucket")
    rest = written(rooted.join(still, "bucket", "left_semi"), "open")
    open_sets = sets_of(rest.select("doc_id"))
    chunks = F.greatest(F.ceil(F.col("n") / BLOCK), F.least(F.col("n"), F.ceil(F.col("shingles") / BLOCK_SHINGLES))).cast("int")
    dealt = (
        rest.withColumn("chunks", chunks).drop("shingles").join(signed.select("doc_id", "sig"), "doc_id")
        .withColumn("chunk", F.pmod(F.xxhash64("doc_id", "bucket"), F.col("chunks")).cast("int"))
        .withColumn("with", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .select("bucket", F.least("chunk", "with").alias("i"), F.greatest("chunk", "with").alias("j"), "doc_id", "comp", "chunk", "sig")
        .join(open_sets, "doc_id")
        .select("bucket", "i", "j", "doc_id", "comp", "chunk", "sig", "shingles")
    )
    dealt = dealt.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    more = written(in_batches(dealt, _blocks(percent, miss), "a long, b long"), "links")
    drop(rest, open_sets, members)
    final = written(components(roots.union(more)), "roots")
    drop(roots, links, more)

    # Copies find the component of their set: those of hot sets by a broadcast.
    of_set = reps.join(final, F.col("rep") == F.col("node"), "left").select("set_a", "set_b", "n_shingles", "copies", F.coalesce("root", "rep").alias("component_id"))
    of_set = written(of_set, "components")
    drop(reps, final)
    rows = table.select("doc_id", "of_doc.set_a", "of_doc.set_b", F.col("of_doc.n_shingles").alias("size"), "n_shingles")
    out = join_spread(rows, of_set.withColumnRenamed("n_shingles", "size"), ["set_a", "set_b", "size"], _hot(of_set, "copies"), F.xxhash64("doc_id"))
    component = F.when(F.col("size") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), component)
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
