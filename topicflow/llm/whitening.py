"""Embedding whitening by the exact characteristic polynomial.

1. Entries become integers, so the scatter matrix (n times the sum of products
   minus the product of sums, n^2 times the covariance: the centred scatter
   itself, as integers don't round) is exact. Tasks multiply 20-bit limbs in
   blocks whose sums a double holds exactly, and Spark adds the limbs up.
2. Its characteristic polynomial is computed modulo many 31-bit primes, each by
   a Hessenberg reduction in a task of its own; Chinese remaindering gives the
   integer coefficients (a bound from the trace says how many primes suffice).
3. All roots of a symmetric matrix are real, so the sign changes of the
   polynomial shifted by ``a`` count the roots above ``a`` exactly. Bisection
   isolates the largest roots to 2^-200; roots closer than 2^-100 count as one
   multiple root.
4. Null-space inverse iteration: the scatter minus a root is all but singular;
   solving with it in fixed-point integers of some hundred bits gives the
   components, which are rounded to doubles at the end.

The driver holds what depends on the dimension alone: the scatter matrix, the
polynomial, the components. Vectors never reach it.

Edge cases: null vectors, vectors with null or non-finite entries, empty
vectors, and vectors with an entry of 2^50 or more in size (whose integer does
not fit) are dropped; if lengths differ, vectors of the most frequent length
(the longer of two equally frequent) are kept; components of eigenvalue 0,
which the polynomial shows exactly, can't be whitened and have no rows, so
equal vectors or a single one give an empty result, as an empty table does;
repeated rows and null ids are rows like others; ``deviation`` is a decimal,
which the query narrows to a long (null beyond a long's range); other columns
are not read.
"""
from __future__ import annotations

import math
import random
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
LIMB = 20                  # bits of a limb; BLOCK products of two limbs fit into a double exactly
BLOCK = 1 << 12
FLUSH = 1 << 20            # vectors of a task summed up before its sums are sent
FINE = 200                 # binary places of a root
CLOSE = 100                # roots that agree to so many places are one multiple root
GUARD = 160                # extra bits of the fixed-point elimination
RESULT = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


# --- 1. exact scatter


def limbs(y: np.ndarray) -> list[np.ndarray]:
    """Signed base-2^LIMB digits of an integer matrix, as doubles."""
    out = []
    while True:
        low = ((y + (1 << (LIMB - 1))) & ((1 << LIMB) - 1)) - (1 << (LIMB - 1))
        out.append(low.astype(np.float64))
        y = (y - low) >> LIMB
        if not y.any():
            return out


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim)


def scatter_batches(dim: int):
    """(i, j, shift, total): sums of products of entries i <= j over a task's
    vectors, 2^(LIMB * shift) each; entry ``dim`` is the constant 1."""
    upper = np.triu_indices(dim + 1)

    def emit(total):
        for shift, t in total.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array(upper[0], pa.int32()), pa.array(upper[1], pa.int32()),
                 pa.array(np.full(len(upper[0]), shift), pa.int32()), pa.array(t[upper], pa.int64())],
                ["i", "j", "shift", "total"])

    def run(batches):
        total: dict[int, np.ndarray] = {}
        seen = 0
        for b in batches:
            y = matrix(b.column(0), dim)
            for k in range(0, len(y), BLOCK):
                part = y[k:k + BLOCK]
                digits = limbs(np.column_stack([part, np.ones(len(part), np.int64)]))
                for p, u in enumerate(digits):
                    for q, v in enumerate(digits):
                        total[p + q] = total.get(p + q, 0) + (u.T @ v).astype(np.int64)
            seen += len(y)
            if seen >= FLUSH:
                yield from emit(total)
                total, seen = {}, 0
        yield from emit(total)
    return run


def moments(vectors: DataFrame, dim: int) -> tuple[int, list[int], list[list[int]]]:
    """(n, sums, sums of products) of an integer array column ``y``, exact."""
    rows = (vectors.select("y").mapInArrow(scatter_batches(dim), "i int, j int, shift int, total long")
            .groupBy("i", "j", "shift").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("t")).collect())   # dim^2 rows
    g = [[0] * (dim + 1) for _ in range(dim + 1)]
    for r in rows:
        g[r["i"]][r["j"]] += int(r["t"]) << (LIMB * r["shift"])
    for i in range(dim + 1):
        for j in range(i):
            g[i][j] = g[j][i]
    return g[dim][dim], g[dim][:dim], [row[:dim] for row in g[:dim]]


# --- 2. characteristic polynomial


def is_prime(n: int) -> bool:
    """Miller-Rabin; the bases are enough below 3,215,031,751."""
    for p in (2, 3, 5, 7):
        if n % p == 0:
            return n == p
    s = (n - 1 & 1 - n).bit_length() - 1
    for a in (2, 3, 5, 7):
        x = pow(a, n - 1 >> s, n)
        if x not in (1, n - 1) and all((x := x * x % n) != n - 1 for _ in range(s - 1)):
            return False
    return True


def primes_beyond(bound: int) -> list[int]:
    """The largest 31-bit primes whose product exceeds ``bound``."""
    out, product, n = [], 1, (1 << 31) - 1
    while product <= bound:
        if is_prime(n):
            out.append(n)
            product *= n
        n -= 2
    return out


def polynomial_mod(a: np.ndarray, p: int) -> np.ndarray:
    """Characteristic polynomial (constant term first) of an integer matrix
    modulo a 31-bit prime."""
    h = np.array(a % p, dtype=np.int64)
    d = len(h)
    for k in range(d - 2):                                   # similar matrix, zero below the subdiagonal
        at = np.flatnonzero(h[k + 1:, k])
        if not len(at):
            continue
        r = k + 1 + int(at[0])
        if r != k + 1:
            h[[r, k + 1]] = h[[k + 1, r]]
            h[:, [r, k + 1]] = h[:, [k + 1, r]]
        u = h[k + 2:, k] * pow(int(h[k + 1, k]), -1, p) % p
        h[k + 2:] = (h[k + 2:] - u[:, None] * h[k + 1] % p) % p
        h[:, k + 1] = (h[:, k + 1] + (h[:, k + 2:] * u % p).sum(axis=1)) % p
    polys = np.zeros((d + 1, d + 1), np.int64)               # of the leading minors
    polys[0, 0] = 1
    for k in range(1, d + 1):
        polys[k, 1:] = polys[k - 1, :-1]
        t, weights = 1, [int(h[k - 1, k - 1])]
        for i in range(k - 2, -1, -1):
            t = t * int(h[i + 1, i]) % p
            weights.append(t * int(h[i, k - 1]) % p)
        w = np.array(weights, np.int64)[:, None]
        polys[k] = (polys[k] - (w * polys[k - 1::-1][:k] % p).sum(axis=0)) % p
    return polys[d]


def characteristic_polynomial(spark: SparkSession, a: list[list[int]]) -> list[int]:
    """Integer coefficients, constant term first, of a positive semi-definite
    integer matrix. One task per group of primes."""
    d, trace = len(a), sum(a[i][i] for i in range(len(a)))
    most = max(math.comb(d, k) * (trace ** k // d ** k + 1) for k in range(d + 1))       # Maclaurin's inequality
    primes = primes_beyond(2 * most + 1)
    table = np.array(a, dtype=object)

    def run(batches):
        for b in batches:
            ps = b.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([polynomial_mod(table, p).tolist() for p in ps], pa.list_(pa.int64()))],
                                             ["p", "c"])
    frame = spark.createDataFrame([(p,) for p in primes], "p long")
    spread = frame.repartition(max(1, min(len(primes), C.partitions(spark))), "p")
    got = {r["p"]: r["c"] for r in spread.mapInArrow(run, "p long, c array<long>").collect()}       # grows with the dimension alone
    product = math.prod(primes)
    basis = [(product // p) * pow(product // p, -1, p) for p in primes]
    out = []
    for k in range(d + 1):
        c = sum(got[p][k] * e for p, e in zip(primes, basis)) % product
        out.append(c - product if 2 * c > product else c)
    return out


# --- 3. roots


def above(poly: list[int], a: int) -> int:
    """Roots above ``a`` with multiplicity, all roots being real: the sign
    changes of the coefficients of poly(x + a)."""
    c = list(poly)
    for i in range(len(c) - 1):
        for j in range(len(c) - 2, i - 1, -1):
            c[j] += a * c[j + 1]
    signs = [v > 0 for v in c if v]
    return sum(s != t for s, t in zip(signs, signs[1:]))


def right_of(poly: list[int], a: int, sign: bool) -> bool:
    """Whether ``a`` is at or right of the one root of an interval: the
    polynomial is zero there or has the sign it has right of the root."""
    v = 0
    for c in reversed(poly):
        v = v * a + c
    return v == 0 or (v > 0) == sign


def largest_roots(poly: list[int], most: int, fine: int = FINE, close: int = CLOSE) -> list[tuple[int, int]]:
    """(root in units of 2^-fine, multiplicity) by falling root, as many as
    hold ``most`` of the positive roots (the last may hold more)."""
    d = len(poly) - 1
    scaled = [c << (fine * (d - k)) for k, c in enumerate(poly)]
    zero = next(k for k, c in enumerate(poly) if c)
    rest = scaled[zero:]                                      # without the roots that are 0
    top = max(1, -poly[d - 1]) << fine if d else 1            # the trace
    found: list[tuple[int, int]] = []
    todo = [(0, top, d - zero, 0)]                            # roots in (low, high]: counts above low and above high
    while todo and sum(m for _, m in found) < most:
        low, high, n_low, n_high = todo.pop()
        n = n_low - n_high
        if n == 0:
            continue
        if high - low == 1:
            found.append((high, n))
            continue
        if n == 1:
            while high - low > 1:
                mid = (low + high) >> 1
                if right_of(rest, mid, n_high % 2 == 0):
                    high = mid
                else:
                    low = mid
            found.append((high, 1))
            continue
        mid = (low + high) >> 1
        n_mid = above(rest, mid)
        if high - low <= 1 << (fine - close) and n_low > n_mid > n_high:
            found.append((mid, n))                            # too close to be told apart
            continue
        todo += [(low, mid, n_low, n_mid), (mid, high, n_mid, n_high)]       # the upper half first
    merged: list[tuple[int, int]] = []
    for root, m in found:
        if merged and merged[-1][0] - root <= 1 << (fine - close):
            merged[-1] = (merged[-1][0], merged[-1][1] + m)
        else:
            merged.append((root, m))
    return merged


# --- 4. components


def eliminate(a: list[list[int]], root: int, fine: int):
    """LU factors of (a * 2^fine - root) in fixed point, with row order."""
    d = len(a)
    m = np.array([[(v << fine) - (root if i == j else 0) for j, v in enumerate(row)] for i, row in enumerate(a)], dtype=object)
    bits = max(int(abs(v)).bit_length() for v in m.flat) + GUARD
    m = m << GUARD
    order = np.arange(d)
    for k in range(d):
        r = k + int(np.argmax(np.abs(m[k:, k])))
        if r != k:
            m[[k, r]] = m[[r, k]]
            order[[k, r]] = order[[r, k]]
        if m[k, k] == 0:
            m[k, k] = 1                                       # the root is exact
        if k + 1 < d:
            f = (m[k + 1:, k] << bits) // m[k, k]
            m[k + 1:, k + 1:] -= (f[:, None] * m[k, k + 1:][None]) >> bits
            m[k + 1:, k] = f
    return m, order, bits


def solve(factors, b: np.ndarray) -> np.ndarray:
    """A solution up to a factor, rescaled to the bits of the factors."""
    m, order, bits = factors
    v = b[order].copy()
    for k in range(1, len(v)):
        v[k] -= int((m[k, :k] * v[:k]).sum()) >> bits
    v = v << bits
    for k in range(len(v) - 1, -1, -1):
        if k + 1 < len(v):
            v[k] -= int((m[k, k + 1:] * v[k + 1:]).sum())
        v[k] = v[k] // m[k, k]
    return rescale(v, bits)


def rescale(v: np.ndarray, bits: int) -> np.ndarray:
    over = max(int(abs(x)).bit_length() for x in v) - bits
    return v >> over if over > 0 else v << -over


def null_vectors(a: list[list[int]], root: int, multiplicity: int, fine: int = FINE) -> list[np.ndarray]:
    """Orthonormal basis (doubles) of the space of a root, by inverse
    iteration from seeded starts."""
    factors = eliminate(a, root, fine)
    bits, d = factors[2], len(a)
    draw = random.Random(d)
    basis: list[np.ndarray] = []
    for _ in range(multiplicity):
        v = np.array([draw.getrandbits(64) - (1 << 63) for _ in range(d)], dtype=object)
        for _ in range(3):
            v = solve(factors, rescale(v, bits))
            for u in basis:                                   # unit vectors of 2^bits
                v = v - ((u * int((u * v).sum())) >> 2 * bits)
        basis.append((v << bits) // max(1, math.isqrt(int((v * v).sum()))))
    out = []
    for u in basis:
        w = np.array([float(Fraction(int(x), 1 << bits)) for x in u])
        out.append(w if w[np.argmax(np.abs(w))] > 0 else -w)
    return out


# --- whitening


class Whitening:
    """Sums, components, and eigenvalues of the integer scatter matrix."""

    def __init__(self, spark: SparkSession, n: int, sums: list[int], products: list[list[int]], most: int):
        d = len(sums)
        scatter = [[n * products[i][j] - sums[i] * sums[j] for j in range(d)] for i in range(d)]
        self.n, self.sums, self.trace = n, sums, sum(scatter[i][i] for i in range(d))
        self.roots: list[Fraction] = []                       # n^2 times the covariance's eigenvalues
        vectors: list[np.ndarray] = []
        if self.trace:
            unit = math.gcd(*(v for row in scatter for v in row))
            small = [[v // unit for v in row] for row in scatter]
            for root, m in largest_roots(characteristic_polynomial(spark, small), most):
                vectors += null_vectors(small, root, m)
                self.roots += [Fraction(root * unit, 1 << FINE)] * m
        self.roots = self.roots[:most]
        self.vectors = np.array(vectors[:most]).reshape(-1, d)
        self.explained = [float(r / self.trace) for r in self.roots]

    def apply(self, y: np.ndarray):
        """(squared deviations times n^2 as exact ints, whitened matrix)."""
        n, top = self.n, int(np.abs(y).max(initial=0))
        far = n * top + max(map(abs, self.sums))
        kind = np.int64 if far * far * y.shape[1] < 1 << 62 else object
        t = y.astype(kind) * n - np.array(self.sums, dtype=kind)
        deviation = (t * t).sum(axis=1)
        scale = np.array([1 / math.sqrt(r) for r in self.roots])
        return [int(v) for v in deviation], (t.astype(np.float64) @ self.vectors.T) * scale


def whiten_batches(fit: Whitening):
    import decimal

    def run(batches):
        for b in batches:
            for k in range(0, b.num_rows, BLOCK):
                part = b.slice(k, BLOCK)
                deviation, w = fit.apply(matrix(part.column(1), len(fit.sums)))
                fits = [decimal.Decimal(v) if v < 10 ** 38 else None for v in deviation]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(fits, pa.decimal128(38, 0)), pa.array(list(w), pa.list_(pa.float64()))],
                    ["vec_id", "deviation", "w"])
    return run


def integers(vectors: DataFrame, id_col="vec_id", vec_col="embedding") -> DataFrame:
    """(vec_id, y): floor(SCALE * entry) of every usable vector."""
    good = F.expr("v is not null and size(v) > 0 and forall(v, c -> c is not null and not isnan(c) and abs(c) < 1125899906842624)")
    return (vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v")).where(good)
            .select("vec_id", F.expr(f"transform(v, c -> cast(floor({SCALE} * c) as bigint))").alias("y")))


def identity_error(whitened: DataFrame, k: int) -> float:
    """Largest entry of the whitened columns' covariance minus the identity;
    columns are centred before they are multiplied."""
    w = whitened.select(*[F.element_at("w", i + 1).alias(f"w{i}") for i in range(k)])
    mean = w.agg(*[F.avg(f"w{i}") for i in range(k)]).first()
    got = w.agg(*[F.avg((F.col(f"w{i}") - mean[i]) * (F.col(f"w{j}") - mean[j])) - F.lit(float(i == j))
                  for i in range(k) for j in range(i, k)]).first()
    return max(abs(v) for v in got)


def whiten(vectors: DataFrame, id_col="vec_id", vec_col="embedding", components: int = COMPONENTS) -> DataFrame:
    """RESULT rows, one per usable vector and component."""
    spark = vectors.sparkSession
    rows = integers(vectors, id_col, vec_col)
    size = rows.groupBy(F.size("y").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if size is None:
        return spark.createDataFrame([], RESULT)
    rows = rows.where(F.size("y") == size["d"])
    fit = Whitening(spark, *moments(rows, size["d"]), components)
    if not fit.roots:
        return spark.createDataFrame([], RESULT)
    wide = C.materialize(rows.mapInArrow(whiten_batches(fit), "vec_id long, deviation decimal(38,0), w array<double>"), "whitened")
    error = identity_error(wide, len(fit.roots))
    explained = F.array(*[F.lit(v) for v in fit.explained])
    return (wide.select("vec_id", "deviation", F.posexplode("w").alias("at", "whitened"))
            .select("vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(fit.n).cast("long").alias("n"), "deviation",
                    "whitened", F.element_at(explained, F.col("at") + 1).alias("explained"), F.lit(error).alias("identity_error")))


def op12_exact_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(C.read(spark, sf_dir, "embeddings")).withColumn("deviation", F.expr("try_cast(deviation as bigint)"))


QUERIES = {"op12_exact_whitening": op12_exact_whitening}
ORACLES: dict[str, str] = {}
