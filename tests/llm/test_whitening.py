"""Whitening against exact determinants and numpy."""

import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import whitening as W

VECTORS = "vec_id long, embedding array<float>, label int, v string, id string, n string"


def determinant(m):
    m, out = [[Fraction(x) for x in row] for row in m], Fraction(1)
    for k in range(len(m)):
        at = next((i for i in range(k, len(m)) if m[i][k]), None)
        if at is None:
            return Fraction(0)
        if at != k:
            m[k], m[at], out = m[at], m[k], -out
        out *= m[k][k]
        for i in range(k + 1, len(m)):
            f = m[i][k] / m[k][k]
            m[i] = [a - f * b for a, b in zip(m[i], m[k], strict=True)]
    return out


def gram(rng, d, rank, size=50):
    a = [[rng.randint(-size, size) for _ in range(d)] for _ in range(rank)]
    return [[sum(r[i] * r[j] for r in a) for j in range(d)] for i in range(d)]


def test_polynomial_is_the_determinant(spark):
    rng = random.Random(1)
    for d, rank, size in ((1, 1, 9), (2, 1, 5), (5, 5, 10 ** 9), (6, 3, 100), (7, 0, 1), (8, 20, 10 ** 20)):
        m = gram(rng, d, rank, size)
        poly = W.polynomial(spark, m)
        assert poly[-1] == 1 and len(poly) == d + 1
        for x in (0, 1, -3, 10 ** 6):
            shifted = [[(x if i == j else 0) - m[i][j] for j in range(d)] for i in range(d)]
            assert sum(c * x ** k for k, c in enumerate(poly)) == determinant(shifted)


def test_polynomial_modulo_a_small_prime_with_row_exchanges():
    m = np.array([[0, 0, 1], [0, 2, 0], [1, 0, 0]])
    assert W.polynomial_mod(m, 7).tolist() == [2, 6, 5, 1]  # (x - 2)(x - 1)(x + 1)


def product(roots):
    poly = [1]
    for r in roots:
        poly = [a - r * b for a, b in zip([0, *poly], [*poly, 0], strict=True)]
    return poly


def test_roots_with_multiplicities():
    rng = random.Random(2)
    for _ in range(40):
        roots = [rng.choice([0, 1, 2, 3, 10 ** 6, 10 ** 6 + 1, 10 ** 30]) for _ in range(rng.randint(1, 9))]
        want = [(r, roots.count(r)) for r in sorted({r for r in roots if r}, reverse=True)]
        got = W.largest_roots(product(roots), 99)
        assert [n for _, n in got] == [n for _, n in want]
        for (x, _), (r, _) in zip(got, want, strict=True):
            assert abs(x - r) <= r * Fraction(1, 1 << 99)
        for m in (0, 1, 2, 10 ** 6):
            assert W.roots_above(product(roots), m, 0) == sum(r > m for r in roots)
            assert W.roots_above(product(roots), 2 * m + 1, 1) == sum(2 * r > 2 * m + 1 for r in roots)


def test_components_of_close_and_equal_eigenvalues(spark):
    m = [[0] * 5 for _ in range(5)]
    for i, x in enumerate((7, 10 ** 20, 10 ** 20, 10 ** 20 + 1, 0)):
        m[i][i] = x
    found = W.components(spark, m, 32)
    assert [round(e) for e, _ in found] == [10 ** 20 + 1, 10 ** 20, 10 ** 20, 7]
    u = np.array([v for _, v in found])
    assert np.allclose(u @ u.T, np.eye(4), atol=1e-15)
    assert np.allclose(u[0], [0, 0, 0, 1, 0], atol=1e-15) and np.allclose(u[3], [1, 0, 0, 0, 0], atol=1e-15)


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, "a", "b", "c") for i, v in rows], VECTORS)


def expected(rows, most=32):
    x = np.floor(64 * np.array([v for _, v in rows], dtype="float32").astype("float64")).astype("int64") + 1000000
    n, z = len(x), len(x) * x - x.sum(axis=0)
    e, u = np.linalg.eigh((z / n).T @ (z / n) / n)
    e, u = e[::-1][:most], u[:, ::-1][:, :most]
    return n, (z.astype(object) ** 2).sum(axis=1), (z / n) @ u / np.sqrt(e), e / np.trace((z / n).T @ (z / n) / n)


def vectors(seed, n, d):
    rng = np.random.RandomState(seed)
    a = (rng.normal(size=(n, d)) * np.linspace(1, 3, d)) @ rng.normal(size=(d, d)) / 4
    return [(i, [float(np.float32(x)) for x in row]) for i, row in enumerate(a)]


@pytest.mark.parametrize("n,d", [(300, 6), (200, 40)])
def test_whitening_equals_numpy(spark, n, d):
    rows = vectors(d, n, d)
    odd = [(1000, None), (1001, [None] + [1.0] * (d - 1)), (1002, [float("nan")] * d), (1003, [1.0] * (d - 1) + [float("-inf")]),
           (1004, []), (1005, [1.0] * (d + 1)), (1006, [1e30] * d)]
    got = W.by_component(W.whiten(table(spark, rows + odd).repartition(3)))
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    got = got.orderBy("vec_id", "component").collect()
    n_, deviation, w, explained = expected(rows)
    k = min(32, d)
    assert len(got) == n * k and {r["n"] for r in got} == {n_}
    mine = np.array([r["whitened"] for r in got]).reshape(n, k)
    signs = np.sign((mine * w).sum(axis=0))
    assert np.abs(mine - signs * w).max() < 1e-9
    assert [r["deviation"] for r in got[::k]] == deviation.tolist()
    assert [r["explained"] for r in got[:k]] == pytest.approx(explained.tolist(), rel=1e-9)
    assert len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-10


def test_large_entries_are_exact(spark):
    rows = [(i, [float(np.float32(x)) for x in (10.0 ** 14 * (i % 3), -i, 1e9 * i)]) for i in range(7)]
    out = W.whiten(table(spark, rows)).orderBy("vec_id").collect()
    x = [[int(64 * c) for c in v] for _, v in rows]
    sums = [sum(c) for c in zip(*x, strict=True)]
    want = [sum((7 * a - s) ** 2 for a, s in zip(v, sums, strict=True)) for v in x]
    assert [r["deviation"] for r in out] == [w if w < 1 << 63 else None for w in want]
    assert max(abs(r["identity_error"]) for r in out) < 1e-9


def test_tables_without_variance(spark):
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(1, [0.5, 0.5]), (2, [0.5, 0.5])], [(1, [])]):
        assert W.by_component(W.whiten(table(spark, rows))).collect() == []
    line = W.by_component(W.whiten(table(spark, [(None, [1.0, 2.0]), (2, [3.0, 4.0]), (2, [3.0, 4.0])]))).collect()
    assert sorted(r["component"] for r in line) == [1, 1, 1] and {r["explained"] for r in line} == {1.0}


def test_sums_over_many_rows(spark):
    """Batches and tasks add up."""
    rows = spark.range(30000).select(F.col("id").alias("vec_id"), F.array(
        (F.col("id") % 7).cast("float"), ((F.col("id") * 31) % 11).cast("float")).alias("embedding")).repartition(7)
    n, sums, m = W.scatter(*W.usable(rows, "vec_id", "embedding"))
    x = [(64 * (i % 7), 64 * (i * 31 % 11)) for i in range(30000)]
    assert (n, sums) == (30000, [sum(a) for a in zip(*x, strict=True)])
    assert m[0][1] == n * sum(a * b for a, b in x) - sums[0] * sums[1] == m[1][0]
