"""Whitening of embeddings by the eigenvectors of their exact covariance.

A component c counts as the integer floor(scale * c) + shift. The fit list is each distinct integer vector once: n
vectors with sums S. Its vectors are centred exactly, as n * x - S in integers, before anything is multiplied;
divided by n they are the rows of an MLlib RowMatrix, whose Gram matrix over n is the covariance. That small matrix
is decomposed on the driver, and its components travel by broadcast to the rows, which are projected batch by batch.

Defined cases: null vectors and those that hold null or non-finite components take no part; a null vec_id is an id like
any other. Repeated rows count once in the fit and are each in the result, as are rows that share a vec_id. Shorter vectors (empty ones too) count as
filled up with zero components to the longest; more than MOST_DIMS dimensions are an error, as the covariance lies on the
driver. Components are numbered by falling eigenvalue; among equal ones any order is right. Those without variance (an eigenvalue under 1e-12 of the largest, so
all of them if the fit list has one vector) have no scale and are left out. The largest entry of a component is positive. An empty table
gives an empty result. Components so large that integers of 64 bits don't hold them or n times them are an error. Other columns pass through if kept, unless named as the results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import drop, in_batches, written

MOST_DIMS = 4096
NO_VARIANCE = 1e-12


@dataclass
class Whitening:
    """n vectors with sums per dimension; eigenvectors as columns, their eigenvalues, and the trace of the covariance."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float = 0.0

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exactly."""
        if len(x) and self.n * max(abs(int(x.min())), abs(int(x.max()))) >= 1 << 62:
            raise OverflowError("n times a component exceeds 64 bits")
        return self.n * x - self.sums

    def project(self, centred: np.ndarray) -> np.ndarray:
        return (centred / self.n) @ (self.components / np.sqrt(self.values))


def _usable(vectors: DataFrame, scale: float, shift: int) -> DataFrame:
    """vectors with x: the integer vector of embedding, for those that take part."""
    e = F.col("embedding")
    fine = e.isNotNull() & F.forall(e, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    ints = F.transform(e, lambda c: F.floor(F.lit(float(scale)) * c.cast("double")).cast("long") + F.lit(shift).cast("long"))
    return vectors.where(fine).withColumn("x", ints)


def _filled(rows: DataFrame, dims: int, shift: int) -> DataFrame:
    return rows.withColumn("x", F.concat("x", F.array_repeat(F.lit(shift).cast("long"), F.lit(dims) - F.size("x"))))


def _matrix(column: pa.Array | pd.Series, dims: int) -> np.ndarray:
    flat = np.concatenate(column.to_numpy()) if isinstance(column, pd.Series) and len(column) else np.asarray(column.flatten()) if isinstance(column, pa.Array) else np.zeros(0, np.int64)
    return flat.reshape(-1, dims)


def _sums(rows: DataFrame, dims: int) -> tuple[int, np.ndarray]:
    """(rows, exact sum of each dimension): a partial sum for each partition, added up by position."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = [0] * dims, 0
        for batch in batches:
            x = _matrix(batch.column(0), dims)
            low, high = x & 0xFFFFFFFF, x >> 32  # halves, so that no sum of a batch overflows
            total = [t + (int(h) << 32) + int(lo) for t, h, lo in zip(total, high.sum(axis=0), low.sum(axis=0))]
            n += len(x)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total], pa.list_(pa.int64()))], ["n", "sums"])

    parts = in_batches(rows.select("x"), run, "n long, sums array<long>")
    by_place = parts.select("n", F.posexplode("sums").alias("place", "part")).groupBy("place").agg(F.sum("n").alias("n"), F.sum("part").alias("total")).orderBy("place").collect()  # a row for each dimension
    return by_place[0]["n"], np.array([r["total"] for r in by_place], np.int64)


def _covariance(rows: DataFrame, n: int, dims: int) -> np.ndarray:
    """Gram matrix of centred rows (one column, array<double>) over n."""
    vectors = MLUtils.convertVectorColumnsFromML(rows.select(array_to_vector(F.col(rows.columns[0])).alias("v")), "v")
    return RowMatrix(vectors, n, dims).computeGramianMatrix().toArray() / n


def fit(vectors: DataFrame, *, components: int = 16, scale: float = 64.0, shift: int = 1_000_000) -> tuple[Whitening | None, DataFrame]:
    """(the whitening of vectors (embedding), None if none takes part; vectors with x, the integer vectors, for those that do)."""
    rows = _usable(vectors, scale, shift)
    longest, shortest = rows.agg(F.max(F.size("x")), F.min(F.size("x"))).first()
    if not longest:
        return None, rows
    if longest > MOST_DIMS:
        raise ValueError(f"vectors of more than {MOST_DIMS} dimensions")
    dims = longest
    if shortest < dims:
        rows = _filled(rows, dims, shift)
    listed = written(rows.select("x").distinct(), "fit", "zstd")
    n, sums = _sums(listed, dims)
    offsets = F.lit(sums.tolist())
    exact = F.zip_with("x", offsets, lambda x, s: (F.lit(n) * x - s).cast("double") / F.lit(float(n)))
    covariance = _covariance(listed.select(exact.alias("v")), n, dims)
    values, directions = np.linalg.eigh((covariance + covariance.T) / 2)
    order = [k for k in np.argsort(-values, kind="stable")[:components] if values[k] > NO_VARIANCE * max(values.max(), 0.0) and values[k] > 0]
    directions = directions[:, order]
    largest = np.abs(directions).argmax(axis=0)
    directions = directions * np.where(directions[largest, np.arange(len(order))] < 0, -1.0, 1.0)
    found = Whitening(n, sums, directions, values[order], float(np.trace(covariance)))
    if order:
        shared = vectors.sparkSession.sparkContext.broadcast(found)  # dims squared at most

        def project(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                x = _matrix(frame["x"], dims)
                yield pd.DataFrame({"w": list(shared.value.project(shared.value.centred(x)))})

        white = written(listed.mapInPandas(project, "w array<double>"), "white")
        means = list(white.agg(*[F.avg(F.col("w")[k]) for k in range(len(order))]).first())
        after = _covariance(white.select(F.zip_with("w", F.lit(means), lambda w, m: w - m).alias("v")), n, len(order))
        found.identity_error = float(np.abs(after - np.eye(len(order))).max())
        drop(white)
    drop(listed)
    return found, rows


def _deviation(centred: np.ndarray) -> list[int]:
    """Exact sum of squares of each row: in 64 bits where these hold it, else by Python's integers."""
    most = max((abs(int(centred.min())), abs(int(centred.max()))), default=0) if centred.size else 0
    if most * most * centred.shape[1] < 1 << 63:
        return (centred * centred).sum(axis=1).tolist()
    return [sum(v * v for v in row) for row in centred.tolist()]


def whiten(vectors: DataFrame, *, components: int = 16, scale: float = 64.0, shift: int = 1_000_000, keep: list[str] | None = None) -> DataFrame:
    """A row for each vector that takes part and each component: the columns `keep` (by default vec_id), component (from 1), n, deviation, whitened, explained, identity_error.

    deviation (decimal(38)): the sum over dimensions of (n * x - S) squared, exact. whitened: x - S / n on the component, over the root of its
    eigenvalue. explained: the eigenvalue's share of the trace. identity_error: the largest absolute entry of the whitened fit list's covariance minus the identity.
    """
    results = ("component", "n", "deviation", "whitened", "explained", "identity_error")
    keep = [c for c in (["vec_id"] if keep is None else keep) if c not in results]
    made = ", ".join(f"{c} {t}" for c, t in zip(results, ("int", "long", "decimal(38,0)", "double", "double", "double")))
    source = vectors.select("embedding", *[F.col(c).alias(f"kept_{k}") for k, c in enumerate(keep)])
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[1:])
    found, rows = fit(source, components=components, scale=scale, shift=shift)
    named = [F.col(f"kept_{k}").alias(c) for k, c in enumerate(keep)]
    if found is None or not len(found.values):
        empty = vectors.sparkSession.createDataFrame([], f"{kinds}, {made}" if keep else made)
        return empty.select(*named, *results)
    shared = vectors.sparkSession.sparkContext.broadcast(found)
    kept, dims = [f"kept_{k}" for k in range(len(keep))], len(found.sums)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            centred = shared.value.centred(_matrix(frame["x"], dims))
            yield frame[kept].assign(deviation=[Decimal(d) for d in _deviation(centred)], w=list(shared.value.project(centred)))

    result = rows.select("x", *kept).mapInPandas(run, ", ".join([kinds] * bool(keep) + ["deviation decimal(38,0), w array<double>"]))
    each = result.select(*kept, "deviation", F.posexplode("w").alias("place", "whitened"))  # a row for each component
    explained = F.lit((found.values / found.trace).tolist())[F.col("place")]
    return each.select(*named, (F.col("place") + 1).cast("int").alias("component"), F.lit(found.n).cast("long").alias("n"), "deviation", "whitened", explained.alias("explained"), F.lit(found.identity_error).alias("identity_error"))
