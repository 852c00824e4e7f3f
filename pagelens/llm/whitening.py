"""Whitening of embeddings by the leading components of their covariance."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelens.llm.common import bounded_batches, unused

#: Entries are fixed-point numbers: ``floor(SCALE * c) + SHIFT``.
SCALE, SHIFT = 1024, 100_000
#: Entries of this magnitude and more would leave the fixed-point range; they count as not finite.
TOO_LARGE = float(2**40)


@dataclass(frozen=True)
class WhiteningParams:
    """``components``: kept at most. ``max_dims``: the covariance, its square in
    doubles, is the only thing that reaches the driver; wider vectors are refused."""

    components: int = 8
    max_dims: int = 4096


@dataclass
class Whitening:
    """A fit: ``n`` vectors with the exact sums ``total`` of their fixed-point
    entries, the trace of the covariance, the leading eigenvalues and, a row each,
    their unit eigenvectors."""

    n: int
    total: list[int]
    trace: float
    values: np.ndarray
    vectors: np.ndarray


def householder(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal and off-diagonal of the tridiagonal matrix similar to symmetric ``a``, and the unit normals of the reflections that lead there."""
    a = a.copy()
    d = len(a)
    normals = []
    for k in range(d - 2):
        x = a[k + 1 :, k].copy()
        length = np.linalg.norm(x)
        v = np.zeros(d - k - 1)
        if length > 0 and np.any(x[1:]):
            v = x
            v[0] += np.copysign(length, x[0])
            v /= np.linalg.norm(v)
            sub = a[k + 1 :, k + 1 :]
            p = 2 * (sub @ v)
            w = p - (v @ p) * v
            sub -= np.outer(v, w) + np.outer(w, v)
            a[k + 1 :, k] -= 2 * v * (v @ a[k + 1 :, k])
            a[k, k + 1 :] = a[k + 1 :, k]
        normals.append(v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), normals


def count_above(diag: np.ndarray, off: np.ndarray, x: np.ndarray) -> np.ndarray:
    """How many eigenvalues of the tridiagonal matrix exceed each ``x``: the positive pivots of its Sturm sequence."""
    tiny = np.finfo(float).tiny * max(1.0, float(np.max(off * off, initial=0.0)))
    q = diag[0] - x
    q = np.where(np.abs(q) < tiny, -tiny, q)
    above = (q > 0).astype(int)
    for k in range(1, len(diag)):
        q = diag[k] - x - off[k - 1] ** 2 / q
        q = np.where(np.abs(q) < tiny, -tiny, q)
        above += q > 0
    return above


def leading_values(diag: np.ndarray, off: np.ndarray, m: int) -> np.ndarray:
    """The ``m`` largest eigenvalues, falling, by bisection on the Sturm counts until neighbouring doubles are reached."""
    reach = np.r_[np.abs(off), 0] + np.r_[0, np.abs(off)]
    low, high = np.full(m, (diag - reach).min()), np.full(m, (diag + reach).max())
    slack = np.finfo(float).eps * max(abs(low[0]), abs(high[0]))
    low, high = low - 2 * slack, high + 2 * slack
    rank = np.arange(1, m + 1)
    for _ in range(2100):
        mid = low + (high - low) / 2
        if np.all((mid <= low) | (mid >= high)):
            break
        many = count_above(diag, off, mid) >= rank
        low, high = np.where(many, mid, low), np.where(many, high, mid)
    return low + (high - low) / 2


def solve_shifted(diag: np.ndarray, off: np.ndarray, shift: float, b: np.ndarray, tiny: float) -> np.ndarray:
    """``(T - shift) x = b`` by elimination with row exchanges; a pivot of zero becomes ``tiny``."""
    n = len(diag)
    p, q, r, x = diag - shift, np.r_[off, 0.0], np.zeros(n), b.copy()  # a row's first, second and third entries
    below = np.r_[off, 0.0]
    for k in range(n - 1):
        if abs(below[k]) > abs(p[k]):
            # row k + 1 is (below, p, q); it becomes the pivot row
            low = (p[k], q[k], x[k])
            p[k], q[k], r[k], x[k] = below[k], p[k + 1], q[k + 1], x[k + 1]
            f = low[0] / p[k]
            p[k + 1], q[k + 1], x[k + 1] = low[1] - f * q[k], -f * r[k], low[2] - f * x[k]
        else:
            pivot = p[k] = p[k] if abs(p[k]) > tiny else tiny
            f = below[k] / pivot
            p[k + 1] -= f * q[k]
            x[k + 1] -= f * x[k]
    for k in range(n - 1, -1, -1):
        after = (q[k] * x[k + 1] if k + 1 < n else 0.0) + (r[k] * x[k + 2] if k + 2 < n else 0.0)
        x[k] = (x[k] - after) / (p[k] if abs(p[k]) > tiny else tiny)
    return x


def leading_vectors(diag: np.ndarray, off: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors of the tridiagonal matrix, one a row, by inverse iteration; those of a cluster of values are kept orthogonal to each other."""
    n = len(diag)
    size = max(float(np.max(np.abs(diag))) + 2 * float(np.max(np.abs(off), initial=0.0)), np.finfo(float).tiny)
    tiny = np.finfo(float).eps * size
    rng = np.random.default_rng(7)
    out = np.zeros((len(values), n))
    begin = 0
    for j, value in enumerate(values):
        if j and values[j - 1] - value > 1e-3 * size:
            begin = j
        near = out[begin:j]
        shift = value - tiny * (j - begin)  # equal shifts would give equal vectors
        best, least = None, np.inf
        for _ in range(8):
            x = rng.standard_normal(n)
            for _ in range(4):
                x = x - near.T @ (near @ x)
                length = np.max(np.abs(x))
                if not 0 < length < np.inf:
                    break
                x = solve_shifted(diag, off, shift, x / length, tiny)
                x /= np.max(np.abs(x))
                for _ in range(2):
                    x = x - near.T @ (near @ x)
                x /= np.linalg.norm(x)
            else:
                rest = diag * x - value * x
                rest[:-1] += off * x[1:]
                rest[1:] += off * x[:-1]
                wrong = np.linalg.norm(rest)
                if wrong < least:
                    best, least = x, wrong
                if least <= 64 * tiny:
                    break
        if best is None:
            raise ArithmeticError("inverse iteration did not settle")
        out[j] = best
    return out


def leading_components(v: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``m`` largest eigenvalues of symmetric ``v``, falling, and their unit eigenvectors, one a row; any will do for zero."""
    m, size = min(m, len(v)), float(np.max(np.abs(v)))
    if size == 0:
        return np.zeros(m), np.eye(len(v))[:m]
    diag, off, normals = householder(v / size)
    values = leading_values(diag, off, m)
    x = leading_vectors(diag, off, values)
    for k in range(len(normals) - 1, -1, -1):
        u = normals[k]
        x[:, k + 1 :] -= 2 * np.outer(x[:, k + 1 :] @ u, u)
    return values * size, x


def usable(vector: str) -> Column:
    """A vector that is not null, not empty and holds finite numbers in the fixed-point range alone."""
    good = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < TOO_LARGE))
    return F.coalesce(F.col(vector).isNotNull() & (F.size(vector) > 0) & good, F.lit(False))


def fixed(vectors: pd.Series) -> np.ndarray:
    """Vectors as rows of fixed-point entries."""
    return np.floor(SCALE * np.stack(vectors.to_numpy()).astype(np.float64)).astype(np.int64) + SHIFT


def offsets(x: np.ndarray, n: int, total: np.ndarray) -> np.ndarray:
    """``n * x - S``, exact: in 64 bits while that suffices, else in Python's integers."""
    most = max(1, int(np.abs(x).max(initial=0)))
    if n * most < 2**62 and max(map(abs, total.tolist()), default=0) < 2**62:
        return n * x - total.astype(np.int64)
    return n * x.astype(object) - total


def fit_whitening(df: DataFrame, vector: str = "embedding", params: WhiteningParams = WhiteningParams()) -> Whitening | None:
    """Sums, covariance (centred before multiplying) and leading components of all usable vectors; ``None`` without any.

    Each task adds up what it has read; sums are combined by dimension and
    products by cell before the driver gets them, so that a covariance, of fixed
    size, is all that reaches it. Null, empty and non-finite vectors are left out.
    Where vectors differ in length, those of the commonest length (the shortest
    of equally common ones) are fitted.
    """
    bounded_batches(df.sparkSession)
    rows = df.where(usable(vector)).select(F.col(vector).alias("v"))
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if sizes is None:
        return None
    d = int(sizes["d"])
    if d > params.max_dims:
        raise ValueError(f"vectors of {d} dimensions; max_dims is {params.max_dims}")
    rows = rows.where(F.size("v") == d)

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, total = 0, np.zeros(d, object)
        for pdf in batches:
            if len(pdf):
                n += len(pdf)
                total = total + fixed(pdf["v"]).sum(axis=0).astype(object)
        if n:
            yield pd.DataFrame({"i": range(d), "n": n, "s": [str(s) for s in total]})

    sums = rows.mapInPandas(add, "i int, n long, s string").groupBy("i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).orderBy("i").collect()
    n, total = int(sums[0]["n"]), np.array([int(r["s"]) for r in sums], object)

    def multiply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        products = np.zeros((d, d))
        for pdf in batches:
            if len(pdf):
                y = offsets(fixed(pdf["v"]), n, total).astype(np.float64) / n
                products += y.T @ y
        if products.any():
            i, j = np.triu_indices(d)
            yield pd.DataFrame({"i": i.astype(np.int32), "j": j.astype(np.int32), "p": products[i, j]})

    cells = rows.mapInPandas(multiply, "i int, j int, p double").groupBy("i", "j").agg(F.sum("p").alias("p")).toPandas()
    v = np.zeros((d, d))
    v[cells["i"], cells["j"]] = v[cells["j"], cells["i"]] = cells["p"].to_numpy(np.float64) / n
    values, vectors = leading_components(v, params.components)
    return Whitening(n, [int(s) for s in total], float(np.trace(v)), values, vectors)


def whiten(df: DataFrame, fit: Whitening | None, vector: str = "embedding", out: str = "whitened", deviation: str = "deviation") -> DataFrame:
    """``df``, usable vectors of the fit's length only, with ``out``, the coordinates over the root of the eigenvalues, and ``deviation``, the exact ``sum((n * x - S) ** 2)`` as decimal(38,0).

    Coordinates of components without variance (eigenvalues within rounding of
    zero) are null. The projection, one row of numbers for each component, is
    broadcast with the code. Columns called like an output are replaced.
    """
    kind = f"struct<{out}:array<double>,{deviation}:decimal(38,0)>"
    if fit is None:
        return df.where("false").withColumns({out: F.lit(None).cast("array<double>"), deviation: F.lit(None).cast("decimal(38,0)")})
    bounded_batches(df.sparkSession)
    n, total = fit.n, np.array(fit.total, object)
    alive = fit.values > np.finfo(float).eps * len(fit.total) * max(float(fit.values[0]), 1e-300)
    scale = np.where(alive, 1 / np.sqrt(np.where(alive, fit.values, 1.0)), np.nan)
    vectors = fit.vectors

    @F.pandas_udf(kind)
    def project(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        from decimal import Decimal

        for v in batches:
            if not len(v):
                yield pd.DataFrame({out: [], deviation: []})
                continue
            off = offsets(fixed(v), n, total)
            y = (off.astype(np.float64) / n) @ vectors.T * scale
            most = int(max(abs(int(off.max())), abs(int(off.min()))))
            exact = off if most * most * off.shape[1] < 2**62 else off.astype(object)
            yield pd.DataFrame({out: [[None if c != c else c for c in row] for row in y.tolist()], deviation: [Decimal(int(s)) for s in (exact * exact).sum(axis=1)]})

    same = df.where(usable(vector) & (F.size(vector) == len(fit.total)))
    both = unused("both", df)
    return same.withColumn(both, project(vector)).withColumns({out: F.col(f"{both}.{out}"), deviation: F.col(f"{both}.{deviation}")}).drop(both)


def identity_error(whitened: DataFrame, column: str = "whitened") -> float:
    """The largest entry, by magnitude, of the covariance of the coordinates minus the identity, over the components that have variance.

    Whitened vectors are centred already: their sum is that of ``n * x - S``,
    which is zero in whole numbers.
    """

    def multiply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        products, n = None, 0
        for pdf in batches:
            if len(pdf):
                y = np.array([list(r) for r in pdf["y"]], float)
                products = y.T @ y if products is None else products + y.T @ y
                n += len(y)
        if n:
            i, j = np.indices(products.shape)
            yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "p": products.ravel(), "n": n})

    cells = whitened.select(F.col(column).alias("y")).mapInPandas(multiply, "i int, j int, p double, n long").groupBy("i", "j").agg((F.sum("p") / F.sum("n")).alias("p"))
    gap = cells.where(~F.isnan("p")).agg(F.max(F.abs(F.col("p") - (F.col("i") == F.col("j")).cast("double")))).first()[0]
    return float(gap or 0.0)
