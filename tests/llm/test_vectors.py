"""Whitening and hard negatives against brute force in numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from listlight.llm import hard_negatives, queries, whitening
from tests.oracle import SF, connect, same

BAD = [(1000, None, 1), (1050, [0.1, None, 0.2], 2), (1100, [float("nan")] * 3, 3), (1150, [float("inf")] * 3, 4)]


def white(rows, components=16, scale=64, shift=1_000_000):
    """vec_id, component: everything that the operator returns, up to the sign."""
    dims = max(len(v) for _, v in rows)
    x = np.array([[int(np.floor(scale * c)) + shift for c in [*v, *[0.0] * (dims - len(v))]] for _, v in rows], object)
    listed = np.array(sorted(set(map(tuple, x))), object)
    n, sums = len(listed), listed.sum(axis=0)
    z = ((n * listed - sums) / n).astype(float)
    values, directions = np.linalg.eigh(z.T @ z / n)
    order = [k for k in np.argsort(-values)[:components] if values[k] > 1e-12 * values.max()]
    out = {}
    for (i, _), row in zip(rows, x):
        for c, k in enumerate(order):
            w = ((n * row - sums) / n).astype(float) @ directions[:, k] / np.sqrt(values[k])
            out.setdefault((i, c + 1), []).append((n, sum(int(v) ** 2 for v in n * row - sums), abs(w), values[k] / values.sum()))
    return out


def check_white(df, rows, **more):
    expected = white(rows, **more)
    got = {}
    for r in df.collect():
        got.setdefault((r["vec_id"], r["component"]), []).append((r["n"], int(r["deviation"]), abs(r["whitened"]), r["explained"]))
        assert r["identity_error"] < 1e-9
    assert set(got) == set(expected)
    for key, many in expected.items():
        assert np.allclose(np.array(sorted(got[key]), float), np.array(sorted(many), float), rtol=1e-9, atol=1e-9)


def test_whitening_of_driver_rows(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    out = queries.op11_whitening(spark, SF)
    assert dict(out.dtypes)["deviation"] == "bigint"
    check_white(out, [(r["vec_id"], [float(c) for c in r["embedding"]]) for r in table.collect()])
    signs = out.where("component = 1").select("vec_id", "whitened").collect()
    again = {r["vec_id"]: r["whitened"] for r in queries.op11_whitening(spark, SF).where("component = 1").collect()}
    assert all(abs(again[r["vec_id"]] - r["whitened"]) < 1e-6 for r in signs)


def test_whitening_of_repeated_short_and_bad_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(k, [float(np.float32(c)) for c in rng.normal(0, 1, 3)]) for k in range(60)]
    rows += [(7, [0.5, 0.25, -1.0])] * 40 + [(None, [0.5, 0.25, -1.0]), (70, [1.5]), (71, []), (72, [0.0, 0.0, 0.0])]
    df = spark.createDataFrame([(i, v, "x", 5) for i, v in rows] + [(i, v, "y", 6) for i, v, _ in BAD], "vec_id long, embedding array<float>, w string, n int").repartition(4)
    check_white(whitening.whiten(df), rows)
    wide = whitening.whiten(df, keep=["vec_id", "w", "n", "embedding"])
    assert wide.columns == ["vec_id", "w", "embedding", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert wide.count() == 3 * len(rows)


def test_whitening_without_variance_and_empty(spark):
    make = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert whitening.whiten(make([])).count() == 0 and whitening.whiten(make([(1, None)])).count() == 0
    assert whitening.whiten(make([(1, [0.5, 1.0])] * 3)).count() == 0  # one vector has no variance
    assert whitening.whiten(make([(1, []), (2, [])])).count() == 0
    flat = [(k, [float(k), 2.0 * k, 7.0]) for k in range(5)]  # one direction alone varies
    check_white(whitening.whiten(make(flat)), flat)
    big = [(k, [1e9 * k, -3e9 * k * k]) for k in range(1, 6)]
    check_white(whitening.whiten(make(big)), big)
    huge = [(k, [1e11 * k * k, -1e11 * k]) for k in range(1, 40)]  # squares beyond 64 bits
    check_white(whitening.whiten(make(huge)), huge)
    with pytest.raises(ValueError):
        whitening.whiten(make([(1, [0.0] * (whitening.MOST_DIMS + 1))]))


def mined(rows, low=30, high=90, scale=256, positives=5, negatives=10):
    x = [(i, lab, [int(np.floor(scale * c)) for c in v]) for i, v, lab in rows]
    out = []
    dot = lambda a, b: sum(p * q for p, q in zip(a, b))
    for a in sorted({i for i, *_ in x if i % 100 == 0}):
        lab, v = min((lb, u) for i, lb, u in x if i == a)
        mine, others = {}, {}
        for i, lb, u in x:
            if i != a:
                (mine if lb == lab else others).setdefault(i, []).append(dot(v, u))
        for s, p in sorted((-max(s), i) for i, s in mine.items())[:positives]:
            fit = sorted((-max(t for t in ts if low * -s <= 100 * t <= high * -s), i) for i, ts in others.items() if any(low * -s <= 100 * t <= high * -s for t in ts))
            out += [(a, p, k + 1, i, -s, -t) for k, (t, i) in enumerate(fit[:negatives])]
    return sorted(out)


def run(spark, rows, **more):
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, score string").repartition(5)
    return sorted(tuple(r) for r in hard_negatives.mine(df, F.col("vec_id") % 100 == 0, F.col("label"), **more).collect())


@pytest.mark.parametrize("least, at_once", [(4096, 1 << 20), (16, 64)])
def test_hard_negatives_of_hot_and_clustered_rows(spark, monkeypatch, least, at_once):
    """Clusters, one hot vector under many ids, a hot label, rows of one id: in one tile and in many."""
    monkeypatch.setattr(hard_negatives, "LEAST_ROWS", least)
    monkeypatch.setattr(hard_negatives, "AT_ONCE", at_once)
    rng = np.random.default_rng(4)
    centres = rng.normal(0, 1, (4, 5))
    rows = [(k, [float(c) for c in centres[k % 4] + rng.normal(0, 0.2, 5)], int(rng.integers(0, 3))) for k in range(400)]
    rows += [(k, [0.5, -0.25, 1.0, 0.0, 0.3], 1) for k in range(400, 560)]
    rows += [rows[5]] * 4 + [(9, [2.0] * 5, 0), (9, [1.0] * 5, 0), (100, [0.1] * 5, 2), (800, [0.0] * 5, 0), (900, [], 1), (901, [1.0], 0)]
    assert run(spark, rows) == mined(rows)
    assert run(spark, rows, low=-50, high=200, positives=2, negatives=3) == mined(rows, -50, 200, positives=2, negatives=3)


def test_hard_negatives_odd_rows(spark):
    good = [(k, [0.1 * k, 0.2], k % 2) for k in range(8)]
    rows = good + [(i, v, lab) for i, v, lab in BAD] + [(None, [0.1, 0.2], 0), (200, [0.3, 0.1], None)]
    assert run(spark, rows) == mined(good)
    assert run(spark, []) == [] and run(spark, [(1, [0.5], 1)]) == [] and run(spark, [(0, [0.5], 1)]) == []
    assert run(spark, [(0, [1.0], 1), (1, [1.0], 1), (2, [0.5], 2)]) == [(0, 1, 1, 2, 65536, 32768)]
    wide = [(k, [1e6 * (k % 7 - 3), 2e6 * (k % 5 - 2)], k % 3) for k in range(210)]  # eight bytes, products beyond doubles
    assert run(spark, wide) == mined(wide)


def test_brackets_hold_and_prune():
    rng = np.random.default_rng(2)
    centres = rng.normal(0, 300, (6, 16))
    x = np.rint(np.concatenate([c + rng.normal(0, 5, (200, 16)) for c in centres])).astype(np.int64)
    q = x[::50]
    top = int((x**2).sum(axis=1).max())
    pivots = hard_negatives.Pivots(x[::7], top)
    near = pivots.distances(x, False)[:, : pivots.n].astype(np.float32)
    low, high = pivots.bracket(pivots.distances(q, True)[:, : pivots.n].astype(np.float32), (q.astype(float) ** 2).sum(axis=1), near, near)
    exact = q @ x.T
    assert (low <= exact).all() and (exact <= high).all()
    best = np.sort(exact, axis=1)[:, -5]
    assert (high >= best[:, None]).mean() < 0.7  # rows of far clusters need no product


def test_oracle_of_hard_negatives(spark):
    same(queries.op12_hard_negatives(spark, SF), connect(), queries.ORACLES["op12_hard_negatives"])
