"""Whitening of embeddings through the exact characteristic polynomial.

Entries become whole numbers, so the scatter matrix (n times the sums of
products less the products of sums, which is n squared times the covariance)
is a matrix of integers, summed without rounding: each task adds up its own
vectors and sends one number for each pair of dimensions.

From there the work depends on the dimension alone. The matrix's polynomial is
found modulo as many primes as its coefficients need, one Hessenberg reduction
each, and put together by Chinese remaindering; the primes are rows of a Spark
job. Its roots are real, so by Descartes' rule the sign changes after a shift
count the roots above a number exactly, repeated ones included; bisection with
that count isolates the largest ones and the sign of the polynomial refines
them, all in whole numbers. Each root then gives its eigenvectors by inverse
iteration on the null space with ``DIGITS`` decimal digits, a row of a second
Spark job. The vectors go through the result in one last pass over the rows.
"""

from __future__ import annotations

from decimal import Decimal, localcontext
from fractions import Fraction
from math import comb, gcd, isqrt

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.store import keep

SCALE = 64
COMPONENTS = 32
#: Roots closer than 2 ** -CLUSTER of their size count as one; roots are known to 2 ** -REFINED of theirs.
CLUSTER, REFINED = 100, 180
#: Decimal digits of the inverse iteration.
DIGITS = 100
#: An entry whose whole number is as large as this has no place in a long.
LIMIT = 1 << 62
_HALF = 60


# ---------------------------------------------------------------------------
# whole vectors and their scatter
# ---------------------------------------------------------------------------

def usable(vectors: DataFrame, id_col: str, vector: str) -> tuple[DataFrame, int]:
    """(id, v) of the rows that have a place in the space, and its dimension:
    the commonest length of vectors without null, non-finite or over-long entries (of several, the greatest).
    Vectors of other lengths are in no common space and go like null ones."""
    v = F.col(f"`{vector}`").cast("array<double>")
    fine = v.isNotNull() & ~F.exists(v, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) >= float(LIMIT // SCALE)))
    kept = vectors.select(F.col(f"`{id_col}`").alias("id"), F.when(fine, v).alias("v")).filter("v is not null")
    top = kept.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    d = top["d"] if top else 0
    return kept.filter(F.size("v") == d), d


def _whole(batch, d: int) -> np.ndarray:
    """floor(SCALE * c) of a batch's vectors, as int64."""
    column = batch.column(batch.schema.get_field_index("v"))
    return np.floor(SCALE * column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)).astype("int64")


def _products(y: np.ndarray) -> np.ndarray:
    """Exact y' y as Python integers."""
    top = int(np.abs(y).max(initial=0))
    rows = (1 << 53) // (top * top) if top else len(y)
    if rows < 1:
        whole = y.astype(object)
        return whole.T.dot(whole)
    out = np.zeros((y.shape[1], y.shape[1]), dtype=object)
    for at in range(0, len(y), rows):  # sums below 2 ** 53 are exact in floating point
        part = y[at:at + rows].astype("float64")
        out += (part.T @ part).astype("int64").astype(object)
    return out


def scatter(kept: DataFrame, d: int) -> tuple[int, list[int], list[list[int]]]:
    """n, the sums of the whole vectors, and n times the sums of products less the products of sums."""

    def run(batches):
        import pyarrow as pa

        n, sums, products = 0, np.zeros(d, dtype=object), np.zeros((d, d), dtype=object)
        for batch in batches:
            y = _whole(batch, d)
            n += len(y)
            sums += y.astype(object).sum(axis=0) if len(y) else 0
            products += _products(y)
        if n:
            i, j = np.triu_indices(d)
            values = [n, *sums, *products[i, j]]
            yield pa.RecordBatch.from_arrays([
                pa.array([-1] * (d + 1) + i.tolist(), pa.int32()), pa.array([-1, *range(d)] + j.tolist(), pa.int32()),
                pa.array([Decimal(v >> _HALF) for v in values], pa.decimal128(38, 0)),
                pa.array([Decimal(v & (1 << _HALF) - 1) for v in values], pa.decimal128(38, 0))], names=["i", "j", "hi", "lo"])

    parts = kept.select("v").mapInArrow(run, "i int, j int, hi decimal(38,0), lo decimal(38,0)")
    # a row for each pair of dimensions
    total = {(r["i"], r["j"]): (int(r["hi"]) << _HALF) + int(r["lo"])
             for r in parts.groupBy("i", "j").agg(F.sum("hi").alias("hi"), F.sum("lo").alias("lo")).collect()}
    n, sums = total.get((-1, -1), 0), [total.get((-1, j), 0) for j in range(d)]
    return n, sums, [[n * total[min(i, j), max(i, j)] - sums[i] * sums[j] for j in range(d)] for i in range(d)] if n else []


# ---------------------------------------------------------------------------
# the characteristic polynomial
# ---------------------------------------------------------------------------

def primes_below(top: int):
    """Odd primes below ``top``, downwards."""
    small = [p for p in range(3, isqrt(top) + 1, 2) if all(p % q for q in range(3, isqrt(p) + 1, 2))]
    for p in range(top - 1 if top % 2 == 0 else top - 2, 2, -2):
        if all(p % q for q in small if q * q <= p):
            yield p


def polynomial_mod(matrix: np.ndarray, p: int) -> np.ndarray:
    """Coefficients, constant first, of det(x - matrix) modulo the prime ``p``
    below 2 ** 31: reduction to Hessenberg form, then its recurrence."""
    h, d = matrix % p, len(matrix)
    for m in range(1, d - 1):
        below = np.flatnonzero(h[m:, m - 1])
        if not len(below):
            continue
        if below[0]:
            k = m + below[0]
            h[[m, k]] = h[[k, m]]
            h[:, [m, k]] = h[:, [k, m]]
        f = h[m + 1:, m - 1] * pow(int(h[m, m - 1]), -1, p) % p
        h[m + 1:] = (h[m + 1:] - f[:, None] * h[m] % p) % p
        h[:, m] = (h[:, m] + (h[:, m + 1:] * f % p).sum(axis=1)) % p
    polys = np.zeros((d + 1, d + 1), dtype="int64")
    polys[0, 0] = 1
    for k in range(1, d + 1):
        factors, run = np.zeros(k, dtype="int64"), 1
        factors[k - 1] = h[k - 1, k - 1]
        for i in range(k - 1, 0, -1):
            run = run * int(h[i, i - 1]) % p
            factors[i - 1] = int(h[i - 1, k - 1]) * run % p
        polys[k, 1:] = polys[k - 1, :-1]
        polys[k] = (polys[k] - (factors[:, None] * polys[:k] % p).sum(axis=0)) % p
    return polys[d]


def polynomial(spark: SparkSession, matrix: list[list[int]]) -> list[int]:
    """Coefficients, constant first, of det(x - matrix) for a symmetric
    integer matrix without negative eigenvalues."""
    d, trace = len(matrix), sum(matrix[i][i] for i in range(len(matrix)))
    # Maclaurin: no elementary symmetric sum of the eigenvalues is larger
    bound = max(comb(d, k) * trace ** k // d ** k + 1 for k in range(d + 1))
    primes, product = [], 1
    for p in primes_below(1 << 31):
        if product > 2 * bound:
            break
        primes.append(p)
        product *= p

    def run(batches):
        import pyarrow as pa

        whole = np.array(matrix, dtype=object).reshape(d, d)
        for batch in batches:
            ps = batch.column(0).to_pylist()
            found = [polynomial_mod((whole % p).astype("int64"), p).tolist() for p in ps]
            yield pa.RecordBatch.from_arrays([pa.array(ps, pa.int64()), pa.array(found, pa.list_(pa.int64()))], names=["p", "c"])

    tasks = min(len(primes), 2 * spark.sparkContext.defaultParallelism)
    rows = spark.createDataFrame([(p,) for p in primes], "p long").repartition(tasks).mapInArrow(run, "p long, c array<long>")
    out, modulus = [0] * (d + 1), 1
    for r in rows.collect():  # as many rows as primes
        p, inverse = r["p"], pow(modulus, -1, r["p"])
        out = [x + modulus * ((c - x) * inverse % p) for x, c in zip(out, r["c"], strict=True)]
        modulus *= p
    return [x - modulus if 2 * x > modulus else x for x in out]


# ---------------------------------------------------------------------------
# its roots
# ---------------------------------------------------------------------------

def roots_above(poly: list[int], m: int, k: int) -> int:
    """Roots above ``m / 2 ** k`` of a polynomial with real roots only, with
    their multiplicities: sign changes after the shift (Descartes)."""
    c = [x << (k * (len(poly) - 1 - i)) for i, x in enumerate(poly)]
    for low in range(len(c) - 1):
        for i in range(len(c) - 2, low - 1, -1):
            c[i] += m * c[i + 1]
    signs = [x > 0 for x in c if x]
    return sum(a != b for a, b in zip(signs, signs[1:], strict=False))


def _sign(poly: list[int], m: int, k: int) -> int:
    value = 0
    for i, x in enumerate(reversed(poly)):
        value = value * m + (x << (k * i))
    return (value > 0) - (value < 0)


def largest_roots(poly: list[int], most: int) -> list[tuple[Fraction, int]]:
    """(root, multiplicity) of the ``most`` largest positive roots, falling,
    each within 2 ** -REFINED of its size; the polynomial has no other than
    real, non-negative roots. Roots that differ by less than 2 ** -CLUSTER of their size come as one."""
    while len(poly) > 1 and not poly[0]:
        poly = poly[1:]
    if len(poly) == 1:
        return []
    top = -poly[-2] + 1  # the sum of the roots, and one
    found, total = [], 0
    # intervals (low, high] / 2 ** k with the counts of roots above their ends
    stack = [(0, top, 0, len(poly) - 1, 0)]
    while stack and total < most:
        low, high, k, above_low, above_high = stack.pop()
        n = above_low - above_high
        if not n:
            continue
        if n > 1 and (low == 0 or (high - low) << CLUSTER > high):
            low, mid, high, k = 2 * low, low + high, 2 * high, k + 1
            above = roots_above(poly, mid, k)
            stack += [(low, mid, k, above_low, above), (mid, high, k, above, above_high)]
            continue
        if n == 1:
            sign = _sign(poly, high, k)
            while sign and (low == 0 or (high - low) << REFINED > high):
                low, mid, high, k = 2 * low, low + high, 2 * high, k + 1
                s = _sign(poly, mid, k)
                if s == 0:
                    low = high = mid
                    break
                low, high = (low, mid) if s == sign else (mid, high)
            if sign == 0:
                low = high
        found.append((Fraction(low + high, 2 << k), n))
        total += n
    return found


# ---------------------------------------------------------------------------
# components
# ---------------------------------------------------------------------------

def null_vectors(matrix: list[list[int]], root: Fraction, n: int) -> list[list[float]]:
    """``n`` orthonormal vectors that ``matrix`` stretches by ``root``: inverse
    iteration, by elimination with row exchanges in decimals."""
    d = len(matrix)
    with localcontext() as context:
        context.prec = DIGITS
        a = np.array([[Decimal(x) for x in row] for row in matrix], dtype=object)
        shift = Decimal(root.numerator) / Decimal(root.denominator)
        for i in range(d):
            a[i, i] -= shift
        tiny = (shift or Decimal(1)).scaleb(-DIGITS + 10)
        rng = np.random.RandomState(d)
        b = np.array([[Decimal(int(x)) for x in row] for row in rng.randint(1, 1 << 30, (d, n))], dtype=object)
        steps = []
        for k in range(d):
            at = max(range(k, d), key=lambda i: abs(a[i, k]))
            a[[k, at]] = a[[at, k]]
            if not a[k, k]:
                a[k, k] = tiny
            f = a[k + 1:, k] / a[k, k]
            a[k + 1:, k + 1:] -= f[:, None] * a[k, k + 1:]
            steps.append((at, f))
        for _ in range(3):
            for k, (at, f) in enumerate(steps):
                b[[k, at]] = b[[at, k]]
                b[k + 1:] -= f[:, None] * b[k]
            for k in range(d - 1, -1, -1):
                b[k] = (b[k] - a[k, k + 1:].dot(b[k + 1:]) if k < d - 1 else b[k]) / a[k, k]
            for j in range(n):
                for i in range(j):
                    b[:, j] -= b[:, i] * b[:, i].dot(b[:, j])
                b[:, j] /= b[:, j].dot(b[:, j]).sqrt()
        out = []
        for j in range(n):
            v = b[:, j]
            if v[max(range(d), key=lambda i: abs(v[i]))] < 0:
                v = -v
            out.append([float(x) for x in v])
    return out


def components(spark: SparkSession, matrix: list[list[int]], most: int) -> list[tuple[Fraction, list[float]]]:
    """(eigenvalue, unit eigenvector) of the ``most`` largest positive
    eigenvalues of a symmetric integer matrix without negative ones, falling.
    The largest entry of a vector is positive."""
    g = gcd(*[x for row in matrix for x in row]) or 1
    small = [[x // g for x in row] for row in matrix]
    roots = largest_roots(polynomial(spark, small), most)
    if not roots:
        return []

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = batch.to_pylist()
            found = [null_vectors(small, Fraction(int(r["num"]), int(r["den"])), r["n"]) for r in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.list_(pa.float64())))], names=["k", "v"])

    asked = [(k, str(x.numerator), str(x.denominator), n) for k, (x, n) in enumerate(roots)]
    rows = (spark.createDataFrame(asked, "k int, num string, den string, n int").repartition(len(asked), "k")
            .mapInArrow(run, "k int, v array<array<double>>"))
    vectors = {r["k"]: r["v"] for r in rows.collect()}  # at most `most` vectors, and the rest of a cluster
    return [(x * g, v) for k, (x, _) in enumerate(roots) for v in vectors[k]][:most]


def _float(x: Fraction) -> float:
    return x.numerator / x.denominator


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", most: int = COMPONENTS) -> DataFrame:
    """vec_id, n, deviation, whitened array<double>, explained array<double>,
    identity_error of every usable row. An entry c counts as the whole number floor(SCALE * c)
    (any shift of all entries gives the same result). ``deviation`` is null where it has no place in a long. Directions
    without variance cannot be scaled to 1 and are left out, so fewer than
    ``most`` components come where the data spans less; without any (one vector only, or
    equal ones) the arrays are empty and identity_error is null. Repeated rows count each; a null id stays null."""
    spark = vectors.sparkSession
    kept, d = usable(vectors, id_col, vector)
    n, sums, matrix = scatter(kept, d) if d else (0, [], [])
    found = components(spark, matrix, most) if n else []
    trace = sum(matrix[i][i] for i in range(d)) if n else 0
    explained = [_float(e / trace) for e, _ in found]
    # whitened = (n y - sums) . scaled, with e / n ** 2 the variance
    scaled = np.array([[x / _float(e) ** 0.5 for x in v] for e, v in found]).reshape(len(found), d).T
    width = len(found)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            y = _whole(batch, d)
            if not len(y):
                continue
            top = n * int(np.abs(y).max(initial=0)) + max(map(abs, sums), default=0)
            if d * top * top < 1 << 63:
                z = n * y - np.array(sums, dtype="int64")
                deviation = (z * z).sum(axis=1).tolist()
            else:
                z = n * y.astype(object) - np.array(sums, dtype=object)
                deviation = [x if x < 1 << 63 else None for x in (z * z).sum(axis=1).tolist()]
            w = (z.astype("float64") @ scaled).ravel()
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(deviation, pa.int64()),
                pa.ListArray.from_arrays(pa.array(range(0, len(w) + 1, width) if width else [0] * (len(y) + 1), pa.int32()),
                                         pa.array(w, pa.float64()))], names=["vec_id", "deviation", "whitened"])

    id_type = vectors.schema[id_col].dataType.simpleString()
    if not d:
        out = vectors.limit(0).select(F.col(f"`{id_col}`").alias("vec_id"), F.lit(0).cast("long").alias("deviation"),
                                      F.array().cast("array<double>").alias("whitened"))
    else:
        out = keep(kept.mapInArrow(run, f"vec_id {id_type}, deviation long, whitened array<double>"), "whitened")
    error = identity_error(out, width) if width else None
    return out.select("vec_id", F.lit(n).cast("long").alias("n"), "deviation", "whitened",
                      F.array(*[F.lit(x) for x in explained]).cast("array<double>").alias("explained"),
                      F.lit(error).cast("double").alias("identity_error"))


def identity_error(whitened: DataFrame, width: int) -> float:
    """Largest absolute entry of the covariance of the column ``whitened`` less the identity."""

    def run(batches):
        import pyarrow as pa

        n, sums, products = 0, np.zeros(width), np.zeros((width, width))
        for batch in batches:
            w = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            n, sums, products = n + len(w), sums + w.sum(axis=0), products + w.T @ w
        if n:
            yield pa.RecordBatch.from_arrays([
                pa.array(range(width + 1 + width * width), pa.int32()),
                pa.array([float(n), *sums, *products.ravel()], pa.float64())], names=["k", "x"])

    parts = whitened.select("whitened").mapInArrow(run, "k int, x double").groupBy("k").agg(F.sum("x").alias("x"))
    x = np.zeros(width + 1 + width * width)
    for r in parts.collect():  # a row for each pair of components
        x[r["k"]] = r["x"]
    mean = x[1:width + 1] / x[0]
    return float(np.abs(x[width + 1:].reshape(width, width) / x[0] - np.outer(mean, mean) - np.eye(width)).max())


def by_component(whitened: DataFrame) -> DataFrame:
    """One row for each vector and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    return (whitened.select("vec_id", "n", "deviation", "identity_error",
                            F.posexplode(F.arrays_zip("whitened", "explained")).alias("__k", "__x"))
            .select("vec_id", (F.col("__k") + 1).alias("component"), "n", "deviation", F.col("__x.whitened").alias("whitened"),
                    F.col("__x.explained").alias("explained"), "identity_error"))
