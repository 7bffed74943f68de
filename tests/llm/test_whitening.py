"""Whitening against exact integers and a dense eigendecomposition, with the edge cases."""

import math
from decimal import Decimal

import numpy as np
import pytest

from tests.conftest import SF
from weftline.llm import whitening

ROWS = "vec_id long, embedding array<double>, component int, n string, x int, id int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, "n", 2, 3) for i, v in rows], ROWS)


def model(rows):
    """Integer rows, exact deviations, eigenvalues and vectors."""
    x = [[math.floor(1024 * c) + 100_000 for c in v] for v in rows]
    n, d = len(x), len(x[0])
    s = [sum(r[j] for r in x) for j in range(d)]
    dev = [sum((n * r[j] - s[j]) ** 2 for j in range(d)) for r in x]
    c = np.array([[(n * r[j] - s[j]) / n for j in range(d)] for r in x])
    values, vectors = np.linalg.eigh(c.T @ c / n)
    return dev, c, values[::-1], vectors[:, ::-1]


def same_axes(got, ids, c, values, vectors, components):
    for k in range(components):
        part = {r.vec_id: r.whitened for r in got if r.component == k + 1}
        mine = np.array([part[i] for i in ids])
        want = c @ vectors[:, k] / math.sqrt(values[k])
        assert min(np.abs(mine - want).max(), np.abs(mine + want).max()) < 1e-7


def test_whole_table(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas()
    dev, c, values, vectors = model(np.stack(e["embedding"].to_numpy()).astype(float).tolist())
    got = whitening.op11_whitening(spark, SF).collect()
    assert len(got) == 8 * len(e)
    assert {r.vec_id: r.deviation for r in got} == dict(zip(e["vec_id"], dev, strict=True))
    same_axes(got, list(e["vec_id"]), c, values, vectors, 8)
    for r in got:
        assert r.n == len(e) and abs(r.explained / (values[r.component - 1] / values.sum()) - 1) < 1e-9 and r.identity_error < 1e-9
    white = np.array([[r.whitened for r in got if r.component == k] for k in range(1, 9)])
    assert np.abs(np.cov(white, bias=True) - np.eye(8)).max() < 1e-9


def test_odd_rows(spark):
    """Nulls, NaN, infinities, other lengths, repeats, null ids and extra columns."""
    rng = np.random.default_rng(3)
    good = [(k, [float(a) for a in rng.normal(size=3) * [5, 1, 0.2]]) for k in range(40)] + [(None, [1.0, 2.0, 3.0]), (7, [0.5, 0.5, 0.5]), (7, [0.5, 0.5, 0.5])]
    bad = [(90, None), (91, []), (92, [1.0, None, 2.0]), (93, [float("nan"), 1.0, 1.0]), (94, [1.0, float("inf"), 1.0]), (95, [1.0, 2.0]), (96, [1.0, 2.0, 3.0, 4.0]), (97, [1e300, 0.0, 0.0])]
    got = whitening.whiten(table(spark, good + bad)).collect()
    assert len(got) == 3 * len(good) and {r.n for r in got} == {len(good)}
    dev, c, values, vectors = model([v for _, v in good])
    assert sorted(r.deviation for r in got if r.component == 1) == sorted(map(Decimal, dev))
    assert len([r for r in got if r.vec_id is None]) == 3 and len([r for r in got if r.vec_id == 7]) == 9
    assert abs(sum(r.explained for r in got if r.vec_id == 0) - 1) < 1e-12
    for k in range(3):
        mine = sorted(abs(r.whitened) for r in got if r.component == k + 1)
        assert np.allclose(mine, sorted(np.abs(c @ vectors[:, k]) / math.sqrt(values[k])))


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]])
def test_without_variance(spark, rows):
    out = whitening.whiten(table(spark, rows))
    assert out.count() == 0 and out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_fewer_directions_than_dimensions(spark):
    rows = [(k, [float(k), 2.0 * k, 5.0, float(k % 3)]) for k in range(30)]
    got = whitening.whiten(table(spark, rows)).collect()
    assert {r.component for r in got} == {1, 2} and max(r.identity_error for r in got) < 1e-4


def test_large_numbers(spark):
    """Deviations beyond 64 bits are exact, beyond 38 digits null."""
    rows = [(k, [float(k * 10**6), 1.0]) for k in range(50)]
    dev = model([v for _, v in rows])[0]
    got = whitening.whiten(table(spark, rows)).collect()
    assert max(dev) > 2**63 and {r.vec_id: int(r.deviation) for r in got} == dict(enumerate(dev))
    far = whitening.whiten(table(spark, [(1, [2.0**51, 1.0]), (2, [-(2.0**51), 2.0]), (3, [0.0, 4.0])])).collect()
    assert len(far) >= 3 and abs(far[0].explained - 1) < 1e-4
