"""Whitening against numpy's own eigenvectors and whole-number sums."""

import math
from collections import Counter

import numpy as np
import pytest

from linestream.llm import whitening as w
from linestream.llm.common import table

SF = "/root/testdata/sf0.001"


def symmetric(values, seed=3):
    q, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(values), len(values))))
    return q @ np.diag(values) @ q.T


@pytest.mark.parametrize(
    "values",
    [
        np.arange(1.0, 65), [5.0] * 7, [1.0], [2.0, 1.0], [0.0] * 5, [9.0, 9, 9, 1, 1], np.geomspace(1, 1e-14, 40), [1e150, 1e149, 3],
        [1 + i * 1e-9 for i in range(20)], [3.0] + [0.0] * 30, np.geomspace(1e-200, 1e-190, 6), np.linspace(-3, 3, 17),
    ],
)
def test_components(values):
    v = symmetric(np.array(values, float))
    got, vectors = w.leading_components(v, 4)
    want = np.sort(np.linalg.eigvalsh(v))[::-1][:4]
    size = np.abs(v).max() or 1.0
    assert np.allclose(got / size, want / size, rtol=0, atol=1e-13 * len(v))
    assert np.abs(vectors.T @ vectors - np.eye(len(got))).max() < 1e-13 * len(v)
    assert np.abs(v @ vectors - vectors * got).max() < 1e-13 * len(v) * size


def test_diagonal_and_shift_on_an_eigenvalue():
    for v in (np.diag([4.0, 2.0, 2.0, 1.0, 0.0]), np.diag([1.0, 2, 3]), np.array([[2.0, 1], [1, 2]]), symmetric([1.0, 2, 3], 5)):
        got, vectors = w.leading_components(v, len(v))
        assert np.allclose(got, np.sort(np.linalg.eigvalsh(v))[::-1], atol=1e-14)
        assert np.abs(v @ vectors - vectors * got).max() < 1e-13


def test_polar_factor():
    v = symmetric([3.0, 1e-7, -1e-7, -2, 5])
    u = w.polar_factor(v)
    assert np.abs(u @ u - np.eye(5)).max() < 1e-13 and np.abs(u - u.T).max() < 1e-14
    assert np.linalg.eigvalsh(u @ v).min() > 0


def brute(rows, k=4):
    good = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    wide = max((len(v) for _, v in good), default=0)
    xs = [(i, tuple([math.floor(256 * float(c)) for c in v] + [0] * (wide - len(v)))) for i, v in good]
    fit = sorted({x for _, x in xs})
    if not wide or not fit:
        return [], None
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    mean = np.array([s / n for s in sums])
    centred = np.array(fit, float) - mean
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    total = np.trace(centred.T @ centred / n)
    out = []
    for i, x in xs:
        far = sum((n * c - s) ** 2 for c, s in zip(x, sums, strict=True))
        for j in range(len(values)):
            if values[j] > 1e-13 * values[0]:
                out.append((i, j + 1, n, far if far < 1 << 63 else None, abs((np.array(x, float) - mean) @ vectors[:, j]) / math.sqrt(values[j]), values[j] / total))
    return out, values


def compare(df, rows):
    got, (want, _) = df.collect(), brute(rows)
    assert Counter(tuple(r)[:4] for r in got) == Counter(r[:4] for r in want)
    key = lambda r: (r[0] is None, r[0], r[1], round(abs(r[4]), 5))
    for g, x in zip(sorted(map(tuple, got), key=key), sorted(want, key=key), strict=True):
        assert abs(abs(g[4]) - x[4]) < 1e-8 and abs(g[5] - x[5]) <= 1e-10
    assert len({r["identity_error"] for r in got}) <= 1 and all(r["identity_error"] < 1e-9 for r in got)
    return got


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.1"])
def test_given_vectors(spark, sf):
    df = table(spark, sf, "embeddings")
    got = compare(w.whiten(df), [(r["vec_id"], r["embedding"]) for r in df.collect()])
    signs = {}
    for r in got:  # one sign for all rows: the mean over the fit list is zero, so whitened values cancel out
        signs.setdefault(r["component"], []).append(r["whitened"])
    assert all(abs(np.mean(v)) < 0.2 for v in signs.values())


def test_odd_rows(spark):
    rng = np.random.default_rng(1)
    base = [(i, [float(c) for c in np.float32(rng.normal(size=6) * [9, 5, 3, 2, 1, 0.5])]) for i in range(60)]
    odd = [
        (100, None), (101, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (102, [float("nan")] * 6), (103, [float("inf")] + [0.0] * 5), (104, []),
        (105, [1.0, 2.0]), (106, [1.0, 2.0, 0.0, 0.0, 0.0, 0.0]), (None, base[0][1]), (None, None), (7, base[7][1]), (7, base[8][1]),
    ]
    rows = base + odd + [(200 + i, base[3][1]) for i in range(40)]
    df = spark.createDataFrame([(*r, "n", 1) for r in rows], "vec_id long, embedding array<double>, n string, component int")
    compare(w.whiten(df.repartition(5)), rows)


def test_few_dims_equal_vectors_and_no_rows(spark):
    make = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    line = [(i, [float(i), 2.0 * i, 0.0]) for i in range(9)]
    assert {r["component"] for r in w.whiten(make(line)).collect()} == {1}
    compare(w.whiten(make([(i, [i % 5 / 7, i % 3 / 5]) for i in range(30)])), [(i, [i % 5 / 7, i % 3 / 5]) for i in range(30)])
    for rows in ([(1, [1.0, 2.0])] * 4, [], [(1, None)], [(1, [])]):
        assert w.whiten(make(rows)).count() == 0


def test_deviations_beyond_a_long(spark):
    rows = [(i, [i * 1e7, float(i % 3)]) for i in range(50)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert {r["vec_id"]: r["deviation"] for r in w.whiten(df).collect()} == {r[0]: r[3] for r in brute(rows)[0]}
