"""Hard negatives of anchors, found exactly with a table of distances to pivots.

Vectors are quantised to integers. With M the largest squared length, a row x becomes (x, sqrt(M - |x|^2)) and an
anchor q becomes (q, 0): the squared distance of the two is |q|^2 + M - 2 q.x, so large products are small distances.
For each row the distances to some pivots are stored. By the triangle inequality |d(q,p) - d(x,p)| <= d(q,x) <= d(q,p) + d(x,p) for
each pivot p, which brackets the product. Rows lie in cells (of the nearest centre) whose least and largest distances to the
pivots bracket whole cells. Data rows are dealt to tiles of cells, anchors to the tiles of the cells whose bracket
meets what they look for; there brackets of single rows leave the survivors, whose products are worked out exactly.

Three rounds: the best rows of an anchor's own label in its own cell, which give a floor; those of other cells
above the floor; then, for each of the positives so found, the best rows of other labels within its range of scores.

Defined cases: rows whose vec_id, label or vector is null, or whose vector holds null or non-finite components, take
no part. Shorter vectors count as filled up with zeros, empty ones as all zeros; more than MOST_DIMS components are an
error, as every row is filled up. Repeated rows change nothing. Of rows that share a vec_id the one with the least label, then vector, is the
anchor; as candidates they count as one, by the best of the scores that qualify, and never for their own id. Ties go to the smaller vec_id. An
anchor without positives has no rows, nor has a positive without negatives in its range. An empty table gives an empty result. Other columns
are not read. Exact as long as sums fit 63 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .knn import BLOCK_BYTES, LEAST_ROWS, MOST_DIMS, _packed, _rows, _tiles, _unpacked
from .shared import drop, in_batches, written

PIVOTS = 8  # whose distances are stored
MOST_CENTRES = 512
AT_ONCE = 1 << 20  # pairs looked at at once
MIN, MAX = np.iinfo(np.int64).min, np.iinfo(np.int64).max
_WANTED = "array<struct<positive_id: long, positive_score: long, lo: long, hi: long>>"
_FOUND = "anchor_id long, positive_id long, positive_score long, vec_id long, score long"


def _spread_out(x: np.ndarray, n: int) -> np.ndarray:
    """n rows of x, each the farthest from those before it."""
    chosen = [0]
    far = ((x - x[0]) ** 2).sum(axis=1)
    while len(chosen) < min(n, len(x)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((x - x[chosen[-1]]) ** 2).sum(axis=1))
    return x[chosen]


class Pivots:
    """Centres as augmented vectors, the first PIVOTS of them the pivots; top: the largest squared length of a row."""

    def __init__(self, sample: np.ndarray, top: int):
        own = sample[(sample.astype(np.float64) ** 2).sum(axis=1) <= top].astype(np.float64)
        centres = _spread_out(own, max(PIVOTS, len(own) // 4))
        self.top, self.centres = float(top), centres
        self.size = (centres**2).sum(axis=1)
        self.height = np.sqrt(np.maximum(self.top - self.size, 0))
        self.n = min(PIVOTS, len(centres))

    def distances(self, x: np.ndarray, as_query: bool) -> np.ndarray:
        x = x.astype(np.float64)
        size = (x**2).sum(axis=1)
        height = np.zeros(len(x)) if as_query else np.sqrt(np.maximum(self.top - size, 0))
        return np.sqrt(np.maximum(size[:, None] - 2 * x @ self.centres.T + self.size + (height[:, None] - self.height) ** 2, 0))

    def bracket(self, dq: np.ndarray, q2: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bounds below and above of the products of queries (distances dq, squared lengths q2) with rows whose distances lie between least and most."""
        near, far = np.zeros((len(dq), len(least)), np.float32), np.full((len(dq), len(least)), np.inf, np.float32)
        for j in range(self.n):
            d, lo, hi = dq[:, j, None], least[None, :, j], most[None, :, j]
            np.maximum(near, d - hi, out=near)
            np.maximum(near, lo - d, out=near)
            np.minimum(far, d + hi, out=far)
        whole = (q2 + self.top)[:, None]
        slack, loose = (4e-6 * np.sqrt(whole)).astype(np.float32), 2e-6 * whole + 1  # of distances and sums kept in 32 bits
        return (whole - (far + slack) ** 2) / 2 - loose, (whole - np.maximum(near - slack, 0) ** 2) / 2 + loose


def _floats(column: pa.Array, n: int) -> np.ndarray:
    return _unpacked(column, n, "<f4")


def _place(shared, dims: int, kind: str):
    """Rows (vec_id, label, anchor, x): packed, with their distances to the pivots and cell, anchors also with theirs as queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots = shared.value
        for batch in batches:
            x = _rows(batch.column(3), dims)
            far = pivots.distances(x, False)
            as_query = _packed(pivots.distances(x, True)[:, : pivots.n], "<f4").to_pylist()
            asked = batch.column(2).to_pylist()
            columns = [*batch.columns[:2], _packed(x, kind), _packed(far[:, : pivots.n], "<f4"), pa.array(far.argmin(axis=1).astype(np.int32)), pa.array([q if a else None for q, a in zip(as_query, asked)], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "label", "v", "near", "cell", "asked"])

    return run


def _limits(n: int):
    """Least and largest distance to each pivot by cell, of a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, tuple[int, np.ndarray, np.ndarray]] = {}
        for batch in batches:
            cell, near = np.asarray(batch.column(0)), _floats(batch.column(1), n)
            for c in np.unique(cell).tolist():
                own = near[cell == c]
                count, lo, hi = found.get(c, (0, own[0], own[0]))
                found[c] = count + len(own), np.minimum(lo, own.min(axis=0)), np.maximum(hi, own.max(axis=0))
        if found:
            counts, least, most = zip(*found.values())
            floats = pa.list_(pa.float32())
            columns = [pa.array(list(found), pa.int32()), pa.array(counts, pa.int64()), pa.array(list(least), floats), pa.array(list(most), floats)]
            yield pa.RecordBatch.from_arrays(columns, ["cell", "n", "least", "most"])

    return run


def _towards(shared, summary: dict, tiles: dict[int, tuple[int, int]], dims: int, kind: str, home: bool | None):
    """Anchors (anchor_id, label, v, asked, cell, wanted) with the tiles of the cells whose bracket meets a range of wanted: of the own cell, of others, or (None) of all."""
    cells = np.array(sorted(summary), np.int32)
    least, most = (np.array([summary[c][k] for c in cells.tolist()], np.float32).reshape(len(cells), -1) for k in (1, 2))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots = shared.value
        for batch in batches:
            out = []
            for lo in range(0, len(batch), 256):
                part = batch.slice(lo, 256)
                q, dq = _unpacked(part.column(2), dims, kind).astype(np.float64), _floats(part.column(3), pivots.n)
                low, high = pivots.bracket(dq, (q**2).sum(axis=1), least, most)
                own = cells[None, :] == np.asarray(part.column(4))[:, None]
                for k, wanted in enumerate(part.column(5).to_pylist()):
                    meets = np.zeros(len(cells), bool)
                    for w in wanted:
                        meets |= (high[k] >= w["lo"]) & (low[k] <= w["hi"])
                    if home is not None:
                        meets = own[k] if home else meets & ~own[k]
                    spans = [tiles[c] for c in cells[meets].tolist()]
                    out.append(sorted({t for first, n in spans for t in range(first, first + n)}))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.int32()))], [*batch.schema.names, "tiles"])

    return run


class _Tile:
    """Data rows of a tile, repeated ones left out."""

    def __init__(self, parts: list[tuple], exact: bool):
        ids, label, x, near = (np.concatenate(p) for p in zip(*parts))
        order = np.argsort(ids, kind="stable")
        ids, label, x, near = ids[order], label[order], x[order], near[order]
        if (ids[1:] == ids[:-1]).any():
            seen, keep = set(), []
            for k, row in enumerate(zip(ids.tolist(), label.tolist(), map(bytes, x))):
                if row not in seen:
                    keep.append(k)
                    seen.add(row)
            ids, label, x, near = ids[keep], label[keep], x[keep], near[keep]
        self.ids, self.label, self.near = ids, label, near
        self.x = x.astype(np.float64 if exact else np.int64)
        self.unique = not (ids[1:] == ids[:-1]).any()


def _solve(shared, k: int, dims: int, kind: str, same: bool, exact: bool):
    """Over rows sorted by tile, data before anchors: for each anchor and range the k best rows of the tile within it, of the anchor's label (same) or of others."""

    def best(tile: _Tile, ids: np.ndarray, label: np.ndarray, q: np.ndarray, dq: np.ndarray, wanted: list) -> Iterator[tuple]:
        pivots = shared.value
        if same:  # anchors of one label at once, against the rows of that label
            groups = [(np.flatnonzero(label == c), np.flatnonzero(tile.label == c)) for c in np.unique(label)]
        else:
            groups = [(np.arange(len(ids)), None)]
        for own, rows in groups:
            of, near, x = (tile.ids, tile.near, tile.x) if rows is None else (tile.ids[rows], tile.near[rows], tile.x[rows])
            for lo in range(0, len(own) if len(of) else 0, step := max(1, AT_ONCE // max(len(of), 1))):
                at = own[lo : lo + step]
                yield from block(tile, ids[at], label[at], q[at], dq[at], [wanted[a] for a in at], rows, of, near, x, pivots)

    def block(tile, ids, label, q, dq, wanted, rows, of, near, x, pivots) -> Iterator[tuple]:
        q2 = (q.astype(np.float64) ** 2).sum(axis=1)
        low, high = pivots.bracket(dq, q2, near, near)
        floor = np.array([min(w["lo"] for w in ws) for ws in wanted], np.float64)[:, None]
        roof = np.array([max(w["hi"] for w in ws) for ws in wanted], np.float64)[:, None]
        lives = (high >= floor) & (low <= roof) & (of[None, :] != ids[:, None])
        if rows is None:
            lives &= tile.label[None, :] != label[:, None]
        if same and tile.unique and len(of) > k + 1:  # k + 1 rows, of which one may be the anchor, score as much as this
            lives &= high >= np.partition(low, len(of) - k - 1, axis=1)[:, [len(of) - k - 1]]
        if not lives.any():
            return
        if lives.mean() > 0.02:  # so many that one product of matrices costs less than picking them
            scores = q.astype(x.dtype) @ x.T
            scores = np.where(lives, np.rint(scores).astype(np.int64), MIN)
        else:
            scores = np.full(lives.shape, MIN)
            a, b = np.nonzero(lives)
            for lo in range(0, len(a), piece := max(1, AT_ONCE // dims)):
                i, j = a[lo : lo + piece], b[lo : lo + piece]
                scores[i, j] = np.rint((q[i].astype(x.dtype) * x[j]).sum(axis=1)).astype(np.int64)
        need = max(map(len, wanted))
        los, his = np.full((len(ids), need), MAX), np.full((len(ids), need), MIN + 1)
        for r, ws in enumerate(wanted):
            los[r, : len(ws)], his[r, : len(ws)] = [w["lo"] for w in ws], [w["hi"] for w in ws]
        least, lowest = los.min(axis=1), np.where(los == MAX, MAX, his).min(axis=1)
        if tile.unique and len(of) > k:  # the k best under the lowest upper end; all that any range needs lies above them
            under = np.where(scores <= lowest[:, None], scores, MIN)
            least = np.maximum(least, np.partition(under, len(of) - k, axis=1)[:, len(of) - k])
        row, col = np.nonzero((scores >= np.maximum(least, MIN + 1)[:, None]) & (scores <= his.max(axis=1)[:, None]))
        score = scores[row, col]
        order = np.lexsort((of[col], -score, row))
        row, col, score = row[order], col[order], score[order]
        for w in range(need):
            fits = (score >= los[row, w]) & (score <= his[row, w])
            r, c, s = row[fits], col[fits], score[fits]
            if not tile.unique:  # the best score of an id
                _, first = np.unique(np.stack([r, of[c]], axis=1), axis=0, return_index=True)
                first.sort()
                r, c, s = r[first], c[first], s[first]
            begin = np.searchsorted(r, np.arange(len(ids)))
            keep = np.arange(len(r)) - begin[r] < k
            r, c, s = r[keep], c[keep], s[keep]
            if len(r):
                of_range = [wanted[i][w] for i in r.tolist()]
                yield ids[r], np.array([o["positive_id"] for o in of_range]), np.array([o["positive_score"] for o in of_range]), of[c], s

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts, tile, n = None, [], None, shared.value.n
        for batch in batches:
            at, query, ids, label = (np.asarray(batch.column(j)) for j in range(4))
            x, near = _unpacked(batch.column(4), dims, kind), _floats(batch.column(5), n)
            edges = np.flatnonzero((np.diff(at) != 0) | (np.diff(query) != 0)) + 1
            for lo, hi in zip([0, *edges], [*edges, len(batch)]):
                if lo == hi:
                    continue
                if key != at[lo]:
                    key, parts, tile = at[lo], [], None
                if not query[lo]:
                    parts.append((ids[lo:hi], label[lo:hi], x[lo:hi], near[lo:hi]))
                    tile = None
                elif parts:
                    tile = tile or _Tile(parts, exact)
                    for found in best(tile, ids[lo:hi], label[lo:hi], x[lo:hi], near[lo:hi], batch.column(6).slice(lo, hi - lo).to_pylist()):
                        yield pa.RecordBatch.from_arrays([pa.array(f, pa.int64()) for f in found], [f.split()[0] for f in _FOUND.split(", ")])

    return run


def mine(vectors: DataFrame, is_anchor: Column, label: Column, *, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: float = 256.0) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each row of vectors (vec_id, embedding) where is_anchor holds and each of
    its `positives` best other rows of the same label, the `negatives` best rows of other labels with low * positive_score <= 100 * negative_score <= high * positive_score.

    A component c counts as floor(scale * c); a score is the integer inner product with the anchor.
    """
    spark = vectors.sparkSession
    result = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    e = F.col("embedding")
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & e.isNotNull() & F.forall(e, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    ints = F.transform(e, lambda c: F.floor(F.lit(float(scale)) * c.cast("double")).cast("long"))
    table = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"), "embedding")
    table = table.where(usable).select("vec_id", "label", "anchor", ints.alias("x"))
    largest = F.max(F.array_max(F.transform("x", lambda c: F.greatest(c, -c - 1))))
    length = F.aggregate("x", F.lit(0).cast("decimal(38,0)"), lambda s, c: (s + c.cast("decimal(19,0)") * c.cast("decimal(19,0)")).cast("decimal(38,0)"))
    rows, asked, dims, most, top = table.agg(F.count("*"), F.count_if("anchor"), F.max(F.size("x")), largest, F.max(length)).first()
    if not asked:
        return spark.createDataFrame([], result)
    if dims > MOST_DIMS:
        raise ValueError(f"vectors of more than {MOST_DIMS} components")
    dims, most = max(dims, 1), most or 0
    kind, exact = next(f"<i{w}" for w in (2, 4, 8) if most < 1 << (8 * w - 1)), (most + 1) ** 2 * dims < 1 << 53
    some = table.orderBy(F.xxhash64("vec_id"), "vec_id").select("x").limit(max(64, min(4 * MOST_CENTRES, isqrt(rows)))).toArrow().combine_chunks()["x"]
    shared = spark.sparkContext.broadcast(Pivots(_rows(some.chunk(0) if some.num_chunks else pa.array([], pa.list_(pa.int64())), dims), int(top)))
    n = shared.value.n
    placed = written(in_batches(table, _place(shared, dims, kind), "vec_id long, label long, v binary, near binary, cell int, asked binary"), "placed", "zstd")

    limits = in_batches(placed.select("cell", "near"), _limits(n), "cell int, n long, least array<float>, most array<float>")
    each = limits.select("cell", "n", F.posexplode(F.arrays_zip("least", "most")).alias("j", "d")).groupBy("cell", "j").agg(F.sum("n").alias("n"), F.min("d.least").alias("least"), F.max("d.most").alias("most"))
    cells: dict[int, tuple[int, list, list]] = {}
    for r in sorted(each.collect()):  # a row for each centre and pivot
        c = cells.setdefault(r["cell"], (r["n"], [], []))
        c[1].append(r["least"]), c[2].append(r["most"])
    spread = -(-rows // (4 * spark.sparkContext.defaultParallelism))
    tiles = _tiles({c: s[0] for c, s in cells.items()}, max(LEAST_ROWS, min(BLOCK_BYTES // (8 * dims), spread)))
    first_tile = F.broadcast(spark.createDataFrame([(c, *t) for c, t in tiles.items()], "cell int, tile int, tiles int"))  # a row for each centre
    own = (F.col("tile") + F.pmod(F.xxhash64("vec_id"), F.col("tiles"))).cast("int").alias("tile")
    none = F.lit(None).cast(_WANTED).alias("wanted")
    data = placed.join(first_tile, "cell").select(own, F.lit(False).alias("is_query"), "vec_id", "label", "v", "near", none)
    chosen = placed.where("asked is not null").groupBy("vec_id").agg(F.min(F.struct("label", "v", "asked", "cell")).alias("a"))
    anchors = written(chosen.select(F.col("vec_id").alias("anchor_id"), "a.label", "a.v", "a.asked", "a.cell"), "anchors")
    wanting = f"anchor_id long, label long, v binary, asked binary, cell int, wanted {_WANTED}"

    def found(asking: DataFrame, k: int, same: bool, home: bool | None) -> DataFrame:
        """For each anchor of asking and range of its wanted the k best rows of each tile that it has to visit."""
        towards = in_batches(asking, _towards(shared, cells, tiles, dims, kind, home), f"{wanting}, tiles array<int>")
        queries = towards.select(F.explode("tiles").alias("tile"), F.lit(True).alias("is_query"), F.col("anchor_id").alias("vec_id"), "label", "v", F.col("asked").alias("near"), "wanted")
        dealt = data.union(queries).repartition("tile").sortWithinPartitions("tile", "is_query")
        return in_batches(dealt, _solve(shared, k, dims, kind, same, exact), _FOUND)

    def of_range(lo: Column, hi: Column, positive: Column, score: Column) -> Column:
        return F.struct(positive.alias("positive_id"), score.alias("positive_score"), lo.cast("long").alias("lo"), hi.cast("long").alias("hi"))

    def first(candidates: DataFrame, k: int) -> DataFrame:
        """The k best of each anchor and positive, ids that were met in several tiles once."""
        once = candidates.groupBy("anchor_id", "positive_id", "positive_score", "vec_id").agg(F.max("score").alias("score"))
        place = F.row_number().over(Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("score"), "vec_id"))
        return once.withColumn("rank", place).where(F.col("rank") <= k)

    zero, any_score = F.lit(0).cast("long"), F.lit(MAX)
    anything = F.array(of_range(F.lit(MIN + 1), any_score, zero, zero))
    at_home = written(found(anchors.withColumn("wanted", anything), positives, True, True), "home")
    floors = first(at_home, positives).where(F.col("rank") == positives).select("anchor_id", F.col("score").alias("floor"))
    above = F.array(of_range(F.coalesce("floor", F.lit(MIN + 1)), any_score, zero, zero))
    elsewhere = written(found(anchors.join(floors, "anchor_id", "left").withColumn("wanted", above).drop("floor"), positives, True, False), "elsewhere")
    best = first(at_home.union(elsewhere), positives)
    score = F.col("score").cast("decimal(38,0)")
    ranges = of_range(F.ceil(score * low / 100), F.floor(score * high / 100), F.col("vec_id"), F.col("score"))
    wanted = best.groupBy("anchor_id").agg(F.collect_list(ranges).alias("wanted"))  # `positives` at most
    asking = written(anchors.join(wanted, "anchor_id"), "asking")
    drop(at_home, elsewhere)
    mined = written(found(asking, negatives, False, None), "mined")
    drop(asking, anchors, placed)
    return first(mined, negatives).select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
