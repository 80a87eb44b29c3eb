"""Whitening of embeddings by spectrum slicing.

The covariance is summed on the executors; what is left is a matrix as large as the dimension squared, whatever the rows. Its
leading eigenvalues are sliced apart: by Sylvester's law the signs of D in an LDLᵀ factorization of the matrix less a
shift count the eigenvalues above the shift, so bisection isolates each one in an interval of its own. There Rayleigh
quotient iteration converges, cubically, to the pair, and two more counts on both sides of it certify its number.
Eigenvalues too close to be told apart are one interval, whose vectors are found together.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.llm.common import saved, slices

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 16
EPS = np.finfo(float).eps
#: Eigenvalues closer than this share of the norm have their vectors made orthogonal together.
CLOSE = 1e-7
NAMES = ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def inertia(a: np.ndarray, shift: float) -> int:
    """How many eigenvalues of a symmetric matrix lie above ``shift``: positive pivots of LDLᵀ with Bunch and Kaufman's pivots of one or two rows."""
    m, n, above, k = a - shift * np.eye(len(a)), len(a), 0, 0
    bound = (1 + math.sqrt(17)) / 8
    floor = EPS * max(float(np.abs(a).max(initial=0.0)), abs(shift), 1e-300)

    def swap(i: int, j: int) -> None:
        if i != j:
            m[[i, j], k:] = m[[j, i], k:]
            m[k:, [i, j]] = m[k:, [j, i]]

    while k < n:
        two = False
        if k + 1 < n:
            below = np.abs(m[k + 1 :, k])
            r = k + 1 + int(below.argmax())
            lam = below[r - k - 1]
            if abs(m[k, k]) < bound * lam:
                row = np.abs(m[r, k:])
                row[r - k] = 0
                sigma = row.max()
                if abs(m[k, k]) * sigma < bound * lam * lam:
                    if abs(m[r, r]) >= bound * sigma:
                        swap(k, r)
                    else:
                        swap(k + 1, r)
                        two = True
        if two:
            # A pivot of two rows has one eigenvalue on either side of zero.
            above += 1
            block, c = m[k : k + 2, k : k + 2], m[k + 2 :, k : k + 2]
            m[k + 2 :, k + 2 :] -= c @ np.linalg.solve(block, c.T)
            k += 2
        else:
            d = m[k, k] if abs(m[k, k]) > floor else -floor
            above += int(d > 0)
            c = m[k + 1 :, k].copy()
            m[k + 1 :, k + 1 :] -= np.outer(c, c / d)
            k += 1
    return above


@dataclass
class Slice:
    """Eigenvalues ``first`` to ``last`` (from 1, falling) lie above ``lo`` and not above ``hi``."""

    lo: float
    hi: float
    first: int
    last: int


def isolate(a: np.ndarray, most: int, tol: float) -> list[Slice]:
    """Slices of one of the ``most`` leading eigenvalues each, or of several that lie within ``tol``."""
    reach = float(np.abs(a).sum(1).max()) + tol
    todo, out = [Slice(-reach, reach, 1, len(a))], []
    while todo:
        s = todo.pop()
        if s.first > most:
            continue
        if s.first == s.last or s.hi - s.lo <= tol:
            out.append(s)
            continue
        mid = (s.lo + s.hi) / 2
        upper = inertia(a, mid)
        if upper >= s.first:
            todo.append(Slice(mid, s.hi, s.first, upper))
        if upper < s.last:
            todo.append(Slice(s.lo, mid, upper + 1, s.last))
    return sorted(out, key=lambda s: s.first)


def solve(a: np.ndarray, shift: float, x: np.ndarray) -> np.ndarray:
    try:
        y = np.linalg.solve(a - shift * np.eye(len(a)), x)
    except np.linalg.LinAlgError:
        y = np.linalg.solve(a - (shift + EPS * max(np.abs(a).max(), abs(shift))) * np.eye(len(a)), x)
    return y / np.abs(y).max()


def pair_in(a: np.ndarray, s: Slice, norm: float, rng: np.random.Generator) -> tuple[float, np.ndarray]:
    """The one pair of a slice: Rayleigh quotients from its middle; where they leave the slice, it is halved by a count and they start again."""
    lo, hi = s.lo, s.hi
    while True:
        x, shift = rng.standard_normal(len(a)), (lo + hi) / 2
        for step in range(12):
            x = solve(a, shift, x)
            x /= np.linalg.norm(x)
            rho = float(x @ a @ x)
            if np.linalg.norm(a @ x - rho * x) <= 4 * EPS * norm * math.sqrt(len(a)):
                break
            if step:
                shift = rho
        if lo < rho <= hi or hi - lo <= 8 * EPS * norm:
            return rho, x
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if inertia(a, mid) >= s.first else (lo, mid)


def leading(a: np.ndarray, most: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` largest eigenvalues that are not zero to double precision, falling, and their unit vectors as rows; each number is certified by counts."""
    norm = float(np.abs(a).sum(1).max(initial=0.0))
    if not norm:
        return np.zeros(0), np.zeros((0, len(a)))
    rng, tol = np.random.default_rng(7), 256 * EPS * norm
    values, rows = [], []
    for s in isolate(a, most, tol):
        size = s.last - s.first + 1
        if size == 1:
            found = [pair_in(a, s, norm, rng)]
        else:
            # Too close to be told apart: inverse iteration on all of them, then the quotients inside their space.
            x = rng.standard_normal((len(a), size))
            for _ in range(6):
                x = np.linalg.qr(solve(a, (s.lo + s.hi) / 2, x))[0]
            w, v = np.linalg.eigh(x.T @ a @ x)
            found = [(float(w[k]), x @ v[:, k]) for k in range(size - 1, -1, -1)]
        values += [f[0] for f in found]
        rows += [f[1] for f in found]
    # Vectors of close values are turned inside the space that they span, where rounding has left them askew.
    first = 0
    for k in range(1, len(values) + 1):
        if k == len(values) or values[k - 1] - values[k] > CLOSE * norm:
            if k - first > 1:
                x = np.linalg.qr(np.array(rows[first:k]).T)[0]
                w, v = np.linalg.eigh(x.T @ a @ x)
                values[first:k], rows[first:k] = w[::-1].tolist(), list((x @ v[:, ::-1]).T)
            first = k
    gap = 64 * EPS * norm * math.sqrt(len(a))
    for k, e in enumerate(values):
        near = [j for j, x in enumerate(values) if abs(x - e) <= 2 * gap]
        if inertia(a, values[near[0]] + gap) > near[0] or inertia(a, values[near[-1]] - gap) <= near[-1]:
            raise ArithmeticError(f"eigenvalue {k + 1} is not certified")
    keep = [k for k, e in enumerate(values[:most]) if e > len(a) * EPS * norm]
    return np.array([values[k] for k in keep]), np.array([rows[k] for k in keep]).reshape(len(keep), len(a))


def vectors(batch: pa.RecordBatch, at: int, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows whose vector is usable, and floor(64 c) of its entries: not null, ``dim`` finite entries, and each of them fits a long."""
    col = batch.column(at)
    right = np.flatnonzero(pc.fill_null(pc.equal(pc.list_value_length(col), dim), False).to_numpy(zero_copy_only=False))
    flat = col.take(pa.array(right)).flatten()
    c = np.floor(SCALE * flat.cast(pa.float64()).fill_null(math.nan).to_numpy(zero_copy_only=False).reshape(len(right), dim))
    with np.errstate(invalid="ignore"):
        good = (np.abs(c) < 2.0**62).all(1)
    return right[good], c[good].astype(np.int64)


@dataclass
class Whitening:
    """What the fit list says: its size, sums of floor(64 c), eigenvalues and unit vectors (rows), trace, and the measured identity error."""

    n: int
    sums: list[int]
    values: np.ndarray
    rows: np.ndarray
    trace: float
    identity_error: float = 0.0

    def apart(self, u: np.ndarray) -> np.ndarray:
        """n u - sums, exact: machine integers where they are large enough, Python's where they are not."""
        if self.n * (int(np.abs(u).max(initial=0)) + 1) < 1 << 62:
            return self.n * u - np.array(self.sums, np.int64)
        return self.n * u.astype(object) - np.array(self.sums, object)

    def centred(self, u: np.ndarray) -> np.ndarray:
        return self.apart(u).astype(float) / self.n

    def whiten(self, u: np.ndarray) -> np.ndarray:
        return self.centred(u) @ self.rows.T / np.sqrt(self.values)

    def deviation(self, u: np.ndarray) -> list[int | None]:
        """Sum of squares of n u - sums, exact; None where it is beyond a long."""
        d = self.apart(u)
        if d.dtype != object and int(np.abs(d).max(initial=0)) ** 2 * max(len(self.sums), 1) < 1 << 62:
            return (d * d).sum(1).tolist()
        return [s if s < 1 << 63 else None for s in (sum(int(x) ** 2 for x in row) for row in d)]


def dimension(df: DataFrame, col: str) -> int:
    """The length that most vectors have, the longer of two as frequent ones; 0 without vectors."""
    found = df.where(F.col(col).isNotNull()).groupBy(F.size(col).alias("d")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), F.col("d").desc()).first()
    return found[0] if found else 0


def fit(df: DataFrame, dim: int, *, col: str = "embedding", components: int = COMPONENTS) -> Whitening:
    """Three passes over the distinct vectors: sums, centred covariance, covariance of what comes out."""
    def whole(batches):
        for b in slices(batches):
            _, u = vectors(b, 0, dim)
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in u], pa.binary())], ["u"])

    # Equal vectors are summed up before the shuffle, so one that a third of the rows hold is a row a task.
    rows = saved(df.select(F.col(col)).mapInArrow(whole, "u binary").distinct())
    read = lambda b: np.frombuffer(b"".join(b.column(0).to_pylist()), np.int64).reshape(-1, dim)

    def sums(batches):
        for b in slices(batches, 100_000):
            # Halves of 32 bits, so that no sum of a batch overflows.
            u = read(b)
            high, low = (u >> 32).sum(0), (u & 0xFFFFFFFF).sum(0)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim)), pa.array(high), pa.array(low), pa.array(np.full(dim, len(u)))], ["i", "high", "low", "n"])

    big = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    found = rows.mapInArrow(sums, "i long, high long, low long, n long").groupBy("i").agg(big("high"), big("low"), F.sum("n").alias("n")).collect()
    at = {r["i"]: (int(r["high"]) << 32) + int(r["low"]) for r in found}
    out = Whitening(found[0]["n"] if found else 0, [at.get(i, 0) for i in range(dim)], np.zeros(0), np.zeros((0, dim)), 0.0)
    if not out.n:
        return out

    def products(make):
        def run(batches):
            total = None
            for b in slices(batches, 10_000):
                y = make(read(b))
                total = y.T @ y if total is None else total + y.T @ y
            if total is not None:
                i, j = np.indices(total.shape)
                yield pa.RecordBatch.from_arrays([pa.array(i.ravel()), pa.array(j.ravel()), pa.array(total.ravel())], ["i", "j", "v"])

        return run

    def covariance(make, size: int) -> np.ndarray:
        v = np.zeros((size, size))
        for r in rows.mapInArrow(products(make), "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
            v[r["i"], r["j"]] = r["v"] / out.n
        return (v + v.T) / 2

    v = covariance(out.centred, dim)
    out.trace = float(np.trace(v))
    out.values, out.rows = leading(v, components)
    if len(out.values):
        # With a column of ones the products hold the means too, and the covariance is centred.
        k = len(out.values)
        w = covariance(lambda u: np.column_stack([out.whiten(u), np.ones(len(u))]), k + 1)
        out.identity_error = float(np.abs(w[:k, :k] - np.outer(w[k, :k], w[k, :k]) - np.eye(k)).max())
    return out


def whiten(df: DataFrame, *, id_col: str = "vec_id", col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error): every usable row on each leading component, up to ``components``.

    Rows whose vector is null, holds null or non-finite entries or entries beyond a long, or has another length than most, are left out. The fit
    counts each distinct vector once; repeated rows and ids have results of their own; other columns are ignored. Components of eigenvalue zero do not
    exist, so one distinct vector alone, empty vectors and an empty table give an empty result. A deviation beyond a long is null.
    """
    kind = df.schema[id_col].dataType.simpleString()
    kind = {"bigint": "long"}.get(kind, kind)
    dim = dimension(df, col)
    model = fit(df, dim, col=col, components=components) if dim else None
    schema = f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None or not len(model.values):
        return df.sparkSession.createDataFrame([], schema).withColumnRenamed("id", id_col)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        k = len(m.values)
        for b in slices(batches):
            at, u = vectors(b, 1, dim)
            ids = b.column(0).take(pa.array(np.repeat(at, k)))
            deviation = pa.array(m.deviation(u), pa.int64()).take(pa.array(np.repeat(np.arange(len(at)), k)))
            every = len(at) * k
            yield pa.RecordBatch.from_arrays([ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(at))), pa.array(np.full(every, m.n)), deviation, pa.array(m.whiten(u).ravel()), pa.array(np.tile(m.values / m.trace, len(at))), pa.array(np.full(every, m.identity_error))], NAMES)

    out = df.select(F.col(id_col).alias("id"), F.col(col).alias("v")).mapInArrow(run, schema)
    return out.withColumnRenamed("id", id_col)
