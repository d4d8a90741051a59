"""PCA whitening of vectors from exact integers: characteristic polynomial, isolated roots, inverse iteration.

Entries become integers x = floor(scale * c). Spark makes the list of distinct x vectors and adds up its count n, sums S
and products Q exactly (integers as limbs of 40 bits, so no sum can round or overflow). The scatter n * Q - S S' is n**2 times
the covariance and all the driver ever holds of the data: d**2 integers. Its characteristic polynomial
is worked out modulo primes below 2**31 by reduction to Hessenberg form, the primes being dealt to Spark tasks,
and put together by Chinese remainders; the coefficients are bounded beforehand (they are elementary symmetric
functions of non-negative roots, greatest when all are equal), so the number of primes proves them. All roots are
real: by Descartes' rule the sign changes of the polynomial shifted by a count the roots above a exactly, repeated roots included.
Bisection on integers isolates the greatest ones to `bits` bits. A component is found by inverse iteration on the scatter shifted by
its root, in decimal arithmetic of as many digits, orthogonal to the earlier ones of roots too close to tell.

Defined results: rows whose vector is null or holds null or non-finite entries are dropped; so are empty vectors and those whose length is
not the most frequent one (the longer of equals), which cannot be projected; repeated rows and ids come out as
often as they came in and count once in the fit; entries beyond 64-bit integers after scaling take their limit; a component
needs a positive eigenvalue, so there are as many as the rank where that is less than asked for, and no rows for one
distinct vector alone or an empty table; `deviation` is null where it does not fit 64 bits; null ids stay; other
columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal, localcontext
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palinode.llm.scratch import stored

_LIMB = 40


@dataclass
class Whitening:
    """n, integer sums, and per component the eigenvalue of x's covariance, its share of the trace and its unit vector."""

    n: int
    sums: list[int]
    scale: int
    eigenvalues: list[Fraction]
    explained: list[float]
    components: np.ndarray


# ---- vectors to integers -----------------------------------------------------------------------------

def integer_vectors(df: DataFrame, key: str, vector: str, scale: int) -> DataFrame:
    """(key, x): rows with finite vectors of the most frequent length, x as array<long>."""
    v = F.col("v")
    finite = F.forall(v, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < math.inf), F.lit(False)))
    rows = df.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v")).where(
        v.isNotNull() & (F.size(v) > 0) & finite)
    sizes = rows.groupBy(F.size(v).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = sizes["d"] if sizes else 0
    return rows.where(F.size(v) == d).select("key", F.transform(v, lambda c: F.floor(c * scale)).alias("x"))


def _limbs(value: int) -> tuple[int, int, int, int]:
    """Four numbers, all but the last of 40 bits, that make up the integer; the last has its sign."""
    mask = (1 << _LIMB) - 1
    return value & mask, value >> _LIMB & mask, value >> 2 * _LIMB & mask, value >> 3 * _LIMB


def _matrix(column: pa.Array) -> np.ndarray:
    flat = np.asarray(column.flatten())
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _partial_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(i, j, limbs) of a task: products of entries i <= j, sums as (-1, j), the count as (-1, -1)."""
    n, sums, products = 0, 0, 0
    for batch in batches:
        x = _matrix(batch.column(0))
        if not len(x):
            continue
        most = max(abs(int(x.min())), abs(int(x.max())), 1)
        run = (1 << 53) // (most * most)  # rows whose products add up exactly in doubles
        for at in range(0, len(x), max(run, 1)):
            part = x[at:at + max(run, 1)]
            exact = part.astype(np.float64) if run else part.astype(object)
            products = products + (exact.T @ exact).astype(np.int64 if run else object).astype(object)
            sums = sums + exact.sum(0).astype(np.int64 if run else object).astype(object)
        n += len(x)
    if n:
        d = len(sums)
        cells = [(-1, -1, n)] + [(-1, j, int(sums[j])) for j in range(d)]
        cells += [(i, j, int(products[i, j])) for i in range(d) for j in range(i, d)]
        i, j, values = zip(*cells)
        limbs = np.array([_limbs(v) for v in values], np.int64).T
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), *map(pa.array, limbs)],
                                         ["i", "j", "l0", "l1", "l2", "l3"])


def scatter_sums(distinct: DataFrame) -> tuple[int, list[int], list[list[int]]]:
    """(n, S, Q) of a table of integer vectors `x`, exact."""
    parts = distinct.select("x").mapInArrow(_partial_sums, "i int, j int, l0 long, l1 long, l2 long, l3 long")
    cells = parts.groupBy("i", "j").agg(*[F.sum(F.col(f"l{k}").cast("decimal(38,0)")).alias(f"l{k}") for k in range(4)])
    found = {(r["i"], r["j"]): sum(int(r[f"l{k}"]) << _LIMB * k for k in range(4)) for r in cells.collect()}  # d**2 numbers
    d = max((j for _, j in found), default=-1) + 1
    products = [[found[min(i, j), max(i, j)] for j in range(d)] for i in range(d)]
    return found.get((-1, -1), 0), [found[-1, j] for j in range(d)], products


# ---- characteristic polynomial ---------------------------------------------------------------------

def _is_prime(n: int) -> bool:
    """Strong probable prime to four bases, which is exact below 3.2e9."""
    if n < 2 or n % 2 == 0:
        return n == 2
    s = (n - 1 & 1 - n).bit_length() - 1
    for a in (2, 3, 5, 7):
        x = pow(a, n - 1 >> s, n)
        if a % n and x != 1 and all(pow(a, (n - 1 >> s) << k, n) != n - 1 for k in range(s)):
            return False
    return True


def primes_below(top: int, product_over: int) -> list[int]:
    """Greatest primes below `top` whose product is greater than `product_over`."""
    out, product, p = [], 1, top - 1
    while product <= product_over:
        if _is_prime(p):
            out.append(p)
            product *= p
        p -= 1
    return out


def _mod_inverse(a: np.ndarray, p: np.ndarray) -> np.ndarray:
    return np.array([pow(int(x), -1, int(q)) if x else 0 for x, q in zip(a, p)], np.int64)


def charpoly_mod(matrix: list[list[int]], primes: np.ndarray) -> np.ndarray:
    """Coefficients (constant first, leading 1 last) of det(x I - matrix) modulo every prime, all primes side by side."""
    d, p = len(matrix), primes.astype(np.int64)
    a = np.array([[[v % int(q) for v in row] for row in matrix] for q in p], np.int64)
    q1, q2, every = p[:, None], p[:, None, None], np.arange(len(p))
    for m in range(1, d - 1):
        pivot = m + np.argmax(a[:, m:, m - 1] != 0, 1)
        a[every, m], a[every, pivot] = a[every, pivot].copy(), a[every, m].copy()
        a[every, :, m], a[every, :, pivot] = a[every, :, pivot].copy(), a[every, :, m].copy()
        u = a[:, m + 1:, m - 1] * _mod_inverse(a[:, m, m - 1], p)[:, None] % q1
        a[:, m + 1:] = (a[:, m + 1:] - u[:, :, None] * a[:, m:m + 1] % q2) % q2
        a[:, :, m] = (a[:, :, m] + (a[:, :, m + 1:] * u[:, None, :] % q2).sum(2)) % q1
    polys = [np.ones((len(p), 1), np.int64)]  # of the leading blocks of growing size
    for k in range(d):
        poly = np.zeros((len(p), k + 2), np.int64)
        poly[:, 1:] = polys[k]
        poly[:, :-1] = (poly[:, :-1] - a[:, k, k, None] * polys[k]) % q1
        chain = np.ones(len(p), np.int64)
        for i in range(1, k + 1):
            chain = chain * a[:, k - i + 1, k - i] % p
            by = a[:, k - i, k] * chain % p
            poly[:, :k - i + 1] = (poly[:, :k - i + 1] - by[:, None] * polys[k - i]) % q1
        polys.append(poly)
    return polys[d]


def characteristic_polynomial(spark: SparkSession, matrix: list[list[int]]) -> list[int]:
    """Exact coefficients, constant first, of a symmetric matrix of integers without negative eigenvalues."""
    d, trace = len(matrix), sum(matrix[i][i] for i in range(len(matrix)))
    # the k-th elementary symmetric function of non-negative roots is at most C(d, k) (trace / d)**k
    bound = max(math.comb(d, k) * (-(-trace // d)) ** k for k in range(d + 1))
    primes = primes_below(1 << 31, 2 * bound)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 32):
                some = np.asarray(batch.column(0))[at:at + 32]
                if len(some):
                    coefficients = charpoly_mod(matrix, some)
                    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(list(coefficients), pa.list_(pa.int64()))], ["p", "c"])

    dealt = spark.createDataFrame([(p,) for p in primes], "p long").repartition(-(-len(primes) // 32))
    value, product = [0] * (d + 1), 1
    for r in dealt.mapInArrow(run, "p long, c array<long>").collect():  # d + 1 numbers a prime
        p = r["p"]
        inverse = pow(product, -1, p)
        value = [v + product * ((c - v) * inverse % p) for v, c in zip(value, r["c"])]
        product *= p
    return [v if 2 * v < product else v - product for v in value]


# ---- roots and components ----------------------------------------------------------------------------

def _roots_above(coefficients: list[int], a: int) -> int:
    """Roots greater than `a` of a polynomial with real roots only, repeated ones counted as often."""
    c = list(coefficients)
    for i in range(len(c) - 1):  # Taylor shift: coefficients of p(y + a)
        for j in range(len(c) - 2, i - 1, -1):
            c[j] += a * c[j + 1]
    signs = [v > 0 for v in c if v]
    return sum(x != y for x, y in zip(signs, signs[1:]))


def greatest_roots(coefficients: list[int], k: int, bits: int = 160) -> list[Fraction]:
    """The k greatest roots, falling, those at 0 left out, each to a relative 2**-bits of the greatest. The polynomial has
    non-negative real roots only."""
    d = len(coefficients) - 1
    top = max(1, -coefficients[d - 1] if d else 1)  # the sum of the roots
    shift = max(0, bits - top.bit_length() + d.bit_length())
    scaled = [c << shift * (d - i) for i, c in enumerate(coefficients)]  # roots times 2**shift
    seen: dict[int, int] = {}

    def above(a: int) -> int:
        if a not in seen:
            seen[a] = _roots_above(scaled, a)
        return seen[a]

    roots = []
    for i in range(1, min(k, _roots_above(coefficients, 0)) + 1):
        low, high = 0, (top << shift) + 1
        for a, count in seen.items():  # what is known from the roots before
            low, high = (max(low, a), high) if count >= i else (low, min(high, a))
        while high - low > 1:
            middle = (low + high) // 2
            low, high = (middle, high) if above(middle) >= i else (low, middle)
        roots.append(Fraction(2 * low + 1, 2 << shift))
    return roots


def _solve(matrix: list[list[Decimal]], order: list[int], v: list[Decimal]) -> list[Decimal]:
    d = len(matrix)
    y = [v[i] for i in order]
    for i in range(d):
        row = matrix[i]
        y[i] -= sum((row[j] * y[j] for j in range(i)), Decimal(0))
    for i in reversed(range(d)):
        row = matrix[i]
        y[i] = (y[i] - sum((row[j] * y[j] for j in range(i + 1, d)), Decimal(0))) / row[i]
    return y


def _factor(matrix: list[list[Decimal]], least: Decimal) -> tuple[list[list[Decimal]], list[int]]:
    """LU with row pivots; a pivot that vanishes becomes `least`, which the shift leaves open anyway."""
    m, order = [list(r) for r in matrix], list(range(len(matrix)))
    for k in range(len(m)):
        best = max(range(k, len(m)), key=lambda i: abs(m[i][k]))
        m[k], m[best], order[k], order[best] = m[best], m[k], order[best], order[k]
        head = m[k]
        if abs(head[k]) < least:
            head[k] = least
        for i in range(k + 1, len(m)):
            row = m[i]
            if row[k]:
                f = row[k] / head[k]
                row[k] = f
                for j in range(k + 1, len(m)):
                    row[j] -= f * head[j]
    return m, order


def components(matrix: list[list[int]], roots: list[Fraction], digits: int = 60, rounds: int = 3) -> np.ndarray:
    """Unit eigenvectors of a symmetric integer matrix for isolated eigenvalues, by inverse iteration."""
    d = len(matrix)
    with localcontext() as context:
        context.prec = digits

        def unit(v: list[Decimal], others: list[list[Decimal]]) -> list[Decimal]:
            for _ in range(2):  # twice, as one pass leaves what it cancels
                for o in others:
                    dot = sum((a * b for a, b in zip(v, o)), Decimal(0))
                    v = [a - dot * b for a, b in zip(v, o)]
            length = sum((a * a for a in v), Decimal(0)).sqrt()
            return [a / length for a in v]

        found: list[list[Decimal]] = []
        for r, root in enumerate(roots):
            value = Decimal(root.numerator) / Decimal(root.denominator)
            tiny = Decimal(roots[0].numerator) / Decimal(roots[0].denominator) * Decimal(10) ** (5 - digits)
            shifted = [[Decimal(x) - (value if i == j else 0) for j, x in enumerate(row)] for i, row in enumerate(matrix)]
            lu, order = _factor(shifted, tiny)
            # orthogonal to earlier components: exact ones are so anyhow, those of equal roots must be
            v = unit([Decimal(1) + Decimal((i * i + 7 * i + 13 * r) % 31) / 31 for i in range(d)], found)
            for _ in range(rounds):
                v = unit(_solve(lu, order, v), found)
            found.append(v)
        return np.array([[float(a) for a in v] for v in found]).reshape(len(found), d)


# ---- whitening ---------------------------------------------------------------------------------------

def fit_whitening(distinct: DataFrame, most: int = 4, scale: int = 256) -> Whitening:
    """Whitening of a table of distinct integer vectors `x`."""
    n, sums, products = scatter_sums(distinct)
    d = len(sums)
    scatter = [[n * products[i][j] - sums[i] * sums[j] for j in range(d)] for i in range(d)]
    common = math.gcd(*[v for row in scatter for v in row]) if d else 0
    if not common:  # no or equal vectors
        return Whitening(n, sums, scale, [], [], np.zeros((0, d)))
    reduced = [[v // common for v in row] for row in scatter]
    roots = greatest_roots(characteristic_polynomial(distinct.sparkSession, reduced), most)
    trace = sum(reduced[i][i] for i in range(d))
    return Whitening(n, sums, scale, [r * common / n**2 for r in roots], [float(r / trace) for r in roots],
                     components(reduced, roots))


def with_whitened(rows: DataFrame, model: Whitening, vector: str = "x") -> DataFrame:
    """`rows` with `deviation` (long) and `whitened` (array of doubles, one per component) of an integer vector."""
    n, sums = model.n, model.sums
    mean = np.array([s / n for s in sums]) if n else np.zeros(0)
    loads = model.components.T / np.array([math.sqrt(e) for e in model.eigenvalues])
    others = [f for f in rows.schema.fields if f.name != vector]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(vector))
            if not len(x):
                continue
            most = n * max(abs(int(x.min())), abs(int(x.max()))) + max(map(abs, sums))
            small = most * most * len(sums) < 1 << 63
            centred = x.astype(np.int64 if small else object) * n - np.array(sums, np.int64 if small else object)
            deviation = [v if v < 1 << 63 else None for v in (centred * centred).sum(1).tolist()]
            whitened = (x - mean) @ loads
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(f.name) for f in others], batch.column(vector), pa.array(deviation, pa.int64()),
                 pa.array(list(whitened), pa.list_(pa.float64()))], names)

    names = [*[f.name for f in others], vector, "deviation", "whitened"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in others), f"`{vector}` array<long>",
                        "deviation long, whitened array<double>"])
    return rows.select(*[f"`{f.name}`" for f in others], f"`{vector}`").mapInArrow(run, schema)


def identity_error(distinct: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the covariance of the fit list's whitened values minus the identity."""
    k = len(model.eigenvalues)

    def entry(i: int, j: int) -> Column:
        return F.abs(F.covar_pop(F.get("whitened", i), F.get("whitened", j)) - float(i == j))

    worst = [entry(i, j) for i in range(k) for j in range(i, k)]
    return with_whitened(distinct, model).agg(F.array_max(F.array(*worst)).alias("e")).first()["e"] if k else 0.0


def whiten(df: DataFrame, key: str = "vec_id", vector: str = "embedding", most: int = 4, scale: int = 256) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error): a row per kept row and component."""
    rows = stored(integer_vectors(df, key, vector, scale), "whitening-rows")
    distinct = stored(rows.select("x").distinct(), "whitening-fit")
    model = fit_whitening(distinct, most, scale)
    k = len(model.eigenvalues)
    if not k:
        rows = rows.where("false")
    out = with_whitened(rows, model) if k else rows.select("key", F.lit(None).cast("long").alias("deviation"),
                                                           F.array().cast("array<double>").alias("whitened"))
    explained = F.array(*[F.lit(e) for e in model.explained]).cast("array<double>")
    return out.select("key", "deviation", F.posexplode("whitened").alias("at", "value")).select(
        F.col("key").alias(key), (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation",
        F.col("value").alias("whitened"), F.get(explained, F.col("at")).alias("explained"),
        F.lit(identity_error(distinct, model)).alias("identity_error"))
