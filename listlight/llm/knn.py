"""Exact top-k by inner product: a Voronoi kNN join.

Vectors are quantised to integers and assigned to the nearest of some pivots. From the summaries of the
cells (ids, largest distance to the pivot) and of the query groups (queries of one cell) come bounds: for
q = p + a in group G and x = r + b in cell C, q.x lies within p.r +- (|a||r| + |p||b| + |a||b|). The k-th
best lower bound of a group, counting each id in one cell only, is a score that each of its queries surely reaches; a cell
whose upper bound lies below it is not needed for the group. Needed pairs of group and cell are solved
locally. Queries are a small part of the rows, so they are what is replicated: data rows are dealt once to
tiles of about BLOCK_BYTES, made of several cells or, of a hot cell, of a part, and each tile receives once the
queries of the groups that need one of its cells. It returns the k best ids per query, by the best score of
each; these are merged. Where the bounds exclude nothing (vectors of one length in many dimensions have no far
cells) a query row so travels once for each tile, packed in the fewest bytes that hold its components.

Defined cases: null vectors and those with null or non-finite components take no part, nor do rows without
a vec_id. Shorter vectors count as padded with zeros, empty ones as all zeros; more than MOST_DIMS components are an
error, as every row is padded to the longest. Rows that share a vec_id count as
one candidate with the better score, and no candidate of its own; repeated rows change nothing. Ties go to the
smaller vec_id. An empty table gives an empty result. Other columns are not read. Exact as long as sums fit 63 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import drop, in_batches, written

MOST_PIVOTS = 512
MOST_DIMS = 16_384
BLOCK_BYTES = 32 << 20  # of a tile's vectors as doubles
LEAST_ROWS = 4096  # of a tile, where there are so many
AT_ONCE = 1 << 21  # scores held at once


def _rows(column: pa.Array, dims: int) -> np.ndarray:
    """List column to an int64 matrix, padded with zeros."""
    out = np.zeros((len(column), dims), np.int64)
    offsets = np.asarray(column.offsets)
    long = np.diff(offsets)
    flat = np.asarray(column.flatten())
    out[np.repeat(np.arange(len(column)), long), np.arange(len(flat)) - np.repeat(offsets[:-1] - offsets[0], long)] = flat
    return out


def _packed(x: np.ndarray, kind: str) -> pa.Array:
    data = np.ascontiguousarray(x.astype(kind))
    offsets = (np.arange(len(x) + 1) * x.shape[1] * data.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def _unpacked(column: pa.Array, dims: int, kind: str) -> np.ndarray:
    if not len(column):
        return np.zeros((0, dims), kind)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int32)
    return np.frombuffer(data, np.uint8)[offsets[column.offset] : offsets[column.offset + len(column)]].view(kind).reshape(-1, dims)


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T in integers: in doubles where these are exact."""
    most = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * a.shape[1]
    return np.rint(a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64) if most < 1 << 53 else a.astype(np.int64) @ b.T.astype(np.int64)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, columns) of the k best of each row, ties to the smaller id; scores marked by the least integer don't count."""
    n = scores.shape[1]
    least = np.partition(scores, n - k, axis=1)[:, n - k] if n > k else np.full(len(scores), np.iinfo(np.int64).min)
    row, col = np.nonzero((scores >= least[:, None]) & (scores != np.iinfo(np.int64).min))
    order = np.lexsort((ids[col], -scores[row, col], row))
    row, col = row[order], col[order]
    begin = np.searchsorted(row, np.arange(len(scores)))
    keep = np.arange(len(row)) - begin[row] < k
    return row[keep], col[keep]


def _needed(pivots: np.ndarray, cells: dict[int, tuple[int, float]], groups: dict[int, float], k: int) -> list[tuple[int, int]]:
    """(group, cell) for each pair that the bounds don't exclude."""
    out = []
    at = np.array(sorted(cells), np.int64)
    if not len(at):
        return out
    n, radius = (np.array([cells[c][j] for c in at.tolist()], np.float64) for j in (0, 1))
    centre = pivots[at].astype(np.float64)
    size = np.sqrt((centre**2).sum(axis=1))
    for g, reach in groups.items():
        p = pivots[g].astype(np.float64)
        middle, slack = centre @ p, reach * size + np.sqrt(p @ p) * radius + reach * radius + 1e-6
        order = np.argsort(-(middle - slack))
        enough = np.searchsorted(np.cumsum(n[order]), k + 1)  # one of them may be the query itself
        floor = (middle - slack)[order[enough]] if enough < len(order) else -np.inf
        out += [(int(g), int(c)) for c in at[middle + slack >= floor]]
    return out


def _tiles(rows_of: dict[int, int], block: int) -> dict[int, tuple[int, int]]:
    """(first tile, tiles) of each cell: small cells share one until it is full, a large one has tiles of its own."""
    out, tile, held = {}, 0, 0
    for c, n in sorted(rows_of.items()):
        if n >= block:
            tile, held = tile + bool(held), 0
            out[c] = tile, -(-n // block)
            tile += out[c][1]
            continue
        out[c], held = (tile, 1), held + n
        if held >= block:
            tile, held = tile + 1, 0
    return out


def _solve(k: int, dims: int, kind: str):
    """Over rows (tile, is_query, vec_id, v) sorted by tile and is_query: the k best of each query in each tile."""

    def best(data: list[tuple[np.ndarray, np.ndarray]], ids: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
        of, rows = np.concatenate([d[0] for d in data]), np.concatenate([d[1] for d in data])
        order = np.argsort(of, kind="stable")
        of, rows = of[order], rows[order]
        begin = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
        known = of[begin]
        out = [[], [], []]
        step = max(1, AT_ONCE // len(of))
        for lo in range(0, len(ids), step):
            scores = _product(x[lo : lo + step], rows)
            if len(known) < len(of):
                scores = np.maximum.reduceat(scores, begin, axis=1)
            scores[ids[lo : lo + step, None] == known[None, :]] = np.iinfo(np.int64).min
            r, c = _best(scores, known, k)
            for o, v in zip(out, (ids[lo + r], known[c], scores[r, c])):
                o.append(v)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(o)) for o in out], ["query_id", "vec_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, data = None, []
        for batch in batches:
            tile, query, ids = (np.asarray(batch.column(j)) for j in range(3))
            x = _unpacked(batch.column(3), dims, kind)
            edges = np.flatnonzero((np.diff(tile) != 0) | (np.diff(query) != 0)) + 1
            for lo, hi in zip([0, *edges], [*edges, len(batch)]):
                if lo == hi:
                    continue
                if key != tile[lo]:
                    key, data = tile[lo], []
                if not query[lo]:
                    data.append((ids[lo:hi], x[lo:hi]))
                elif data:
                    if len(data) > 1:
                        data = [tuple(np.concatenate(part) for part in zip(*data))]
                    yield best(data, ids[lo:hi], x[lo:hi])

    return run


def nearest(vectors: DataFrame, is_query: Column, *, k: int = 5, scale: float = 256.0) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of the k best rows for each row of vectors (vec_id, embedding) where is_query holds.

    A component x counts as floor(scale * x); a score is the integer inner product.
    """
    spark = vectors.sparkSession
    e = F.col("embedding")
    usable = F.col("vec_id").isNotNull() & e.isNotNull() & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    ints = F.transform(e, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long"))
    table = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.coalesce(is_query, F.lit(False)).alias("query")).where(usable)
    table = written(table.select("vec_id", "query", ints.alias("v")), "ints")
    largest = F.max(F.array_max(F.transform("v", lambda x: F.greatest(x, -x - 1))))
    rows, dims, most = table.agg(F.count("*"), F.max(F.size("v")), largest).first()
    result = "query_id long, rank int, vec_id long, score long"
    if not rows:
        return spark.createDataFrame([], result)
    if dims > MOST_DIMS:
        raise ValueError(f"vectors of more than {MOST_DIMS} components")
    dims, kind = max(dims, 1), next(f"<i{w}" for w in (2, 4, 8) if (most or 0) < 1 << (8 * w - 1))

    some = table.orderBy(F.xxhash64("vec_id"), "vec_id").select("v").limit(max(8, min(MOST_PIVOTS, isqrt(rows) // 4))).toArrow().combine_chunks()
    pivots = np.unique(_rows(some["v"].combine_chunks() if some["v"].num_chunks != 1 else some["v"].chunk(0), dims), axis=0)
    shared = spark.sparkContext.broadcast(pivots)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value.astype(np.float64)
        for batch in batches:
            x = _rows(batch.column(2), dims).astype(np.float64)
            far = (x**2).sum(axis=1)[:, None] - 2 * x @ p.T + (p**2).sum(axis=1)
            cell = far.argmin(axis=1)
            reach = np.sqrt(((x - p[cell]) ** 2).sum(axis=1))
            columns = [*batch.columns[:2], _packed(_rows(batch.column(2), dims), kind), pa.array(cell.astype(np.int32)), pa.array(reach)]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "query", "v", "cell", "reach"])

    placed = written(in_batches(table, assign, "vec_id long, query boolean, v binary, cell int, reach double"), "cells")
    summary = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("reach").alias("radius"), F.max(F.when(F.col("query"), F.col("reach"))).alias("of_queries")).collect()  # a row for each pivot
    home = placed.groupBy("vec_id").agg(F.min("cell").alias("cell")).groupBy("cell").count()  # vectors of one id may lie in several cells
    ids = {r["cell"]: r["count"] for r in home.collect()}
    rows_of = {r["cell"]: r["n"] for r in summary}
    cells = {r["cell"]: (ids.get(r["cell"], 0), r["radius"]) for r in summary}
    groups = {r["cell"]: r["of_queries"] for r in summary if r["of_queries"] is not None}
    pairs = _needed(pivots, cells, groups, k)
    if not pairs:
        return spark.createDataFrame([], result)
    spread = -(-rows // (4 * spark.sparkContext.defaultParallelism))
    tiles = _tiles(rows_of, max(LEAST_ROWS, min(BLOCK_BYTES // (8 * dims), spread)))
    first_tile = F.broadcast(spark.createDataFrame([(c, *t) for c, t in tiles.items()], "cell int, tile int, tiles int"))  # a row for each pivot
    wanted = sorted({(g, *tiles[c]) for g, c in pairs})
    needs = F.broadcast(spark.createDataFrame(wanted, "cell int, tile int, tiles int"))  # pivots squared at most

    own = (F.col("tile") + F.pmod(F.xxhash64("vec_id"), F.col("tiles"))).cast("int").alias("tile")
    data = placed.join(first_tile, "cell").select(own, F.lit(False).alias("is_query"), "vec_id", "v")
    each = F.explode(F.sequence(F.col("tile"), F.col("tile") + F.col("tiles") - 1)).alias("tile")
    asked = placed.where("query").join(needs, "cell").select(each, F.lit(True).alias("is_query"), "vec_id", "v")
    dealt = data.union(asked).repartition("tile").sortWithinPartitions("tile", "is_query")
    local = in_batches(dealt, _solve(k, dims, kind), "query_id long, vec_id long, score long")
    drop(table)
    best = local.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
