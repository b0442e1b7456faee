r"""Operator 11: embedding whitening on the leading principal components, found by the Jacobi-Davidson method.

An entry c becomes the whole number x = floor(256 c). The fit list holds each distinct vector x once: n vectors with the sums
S. Its covariance V (divisor n) is never formed: a product V u is a pass over the fit list in which each task centres its vectors, multiplies
them with a block of directions and adds up its share; the driver gets one number for each dimension and direction.

The subspace starts with a few random directions. Each step takes the Ritz pairs of the subspace (Rayleigh-Ritz on the products that are
kept with it), locks those whose residual is at double precision, and widens the subspace by approximate solutions of the
correction equation (I - QQ') (V - theta I) (I - QQ') t = -r for the leading ones still open, Q the locked vectors and the pair's own. MINRES solves it
without a factorisation; the pairs' iterations run side by side, so that each inner step is one pass for all. A pair is done when |V u - theta u|
is at most 32 eps sqrt(trace * largest eigenvalue), which is what a product in double precision can be trusted to; a subspace that has become too wide is restarted with its best Ritz vectors.

Defined cases: rows whose vector is null or has a null, NaN or infinite entry are dropped; a shorter vector has zeros at its end; entries beyond 2^52 / 256
count as that bound, so that x is exact; a component without variance (all vectors equal, fewer dimensions than components) can not be whitened and gives no rows, so neither does a table
whose fit list has one vector; repeated rows give equal rows; an empty table gives none; other columns are ignored, whatever their names; a deviation that does not fit in a
long is null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stavelake.llm.common import Scratch, table, written

SCALE = 256
LARGEST = 1 << 52
COMPONENTS = 4
EPS = float(np.finfo(float).eps)


@dataclass(frozen=True)
class Solver:
    """start: random directions at first; inner: MINRES steps of a correction; widest: directions of a subspace before its restart."""

    start: int = 8
    inner: int = 3
    widest: int = 40
    steps: int = 500
    tolerance: float = 32 * EPS
    seed: int = 11


def clean_vectors(embeddings: DataFrame, vector: str = "embedding") -> DataFrame:
    """(vec_id, x) of the rows whose entries are all finite."""
    values = F.transform(F.col(vector), lambda c: c.cast("double"))
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    rows = embeddings.select("vec_id", values.alias("v")).filter(F.col("v").isNotNull() & ~F.exists("v", bad))
    bound = float(LARGEST // SCALE)
    return rows.select("vec_id", F.transform("v", lambda c: F.floor(F.greatest(F.least(c, F.lit(bound)), F.lit(-bound)) * SCALE).cast("long")).alias("x"))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    """The vectors of a column as rows; shorter ones end with zeros."""
    size = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (size == d).all():
        return flat.reshape(-1, d)
    out = np.zeros((len(size), d), np.int64)
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def _blocks(batches: Iterator[pa.RecordBatch], d: int, column: int = 0) -> Iterator[np.ndarray]:
    for b in batches:
        for low in range(0, b.num_rows, 1024):
            yield _matrix(b.slice(low, 1024).column(column), d)


@dataclass
class Fit:
    """The fit list: its table (x), dimensions, n, and the exact sums of each dimension."""

    x: DataFrame
    d: int
    n: int
    sums: list[int]

    @property
    def mean(self) -> np.ndarray:
        # Whole part and rest apart, so a mean is right to the last bit.
        return np.array([s // self.n + (s % self.n) / self.n for s in self.sums])

    def summed(self, share: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
        """The sum over the fit list of what ``share`` gives for a block of centred vectors: ``size`` numbers, added up on the executors."""
        d, mean = self.d, self.mean

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, lost = np.zeros(size), np.zeros(size)
            for block in _blocks(batches, d):  # compensated: what an addition rounds away is kept for the next
                part = share(block - mean).reshape(-1) - lost
                after = total + part
                total, lost = after, (after - total) - part
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(total)], names=["place", "part"])

        parts = self.x.mapInArrow(run, "place long, part double").groupBy("place").agg(F.sum("part").alias("whole")).collect()
        out = np.zeros(size)
        for r in parts:
            out[r["place"]] = r["whole"]
        return out

    def product(self, u: np.ndarray) -> np.ndarray:
        """V u for the columns of u: one pass."""
        return self.summed(lambda c: c.T @ (c @ u), self.d * u.shape[1]).reshape(self.d, -1) / self.n


def fit_list(vectors: DataFrame, scratch: Scratch) -> Fit:
    """Each distinct x once. Vectors that end in zeros are equal with and without them."""
    d = vectors.agg(F.max(F.size("x"))).first()[0] or 0
    full = F.when(F.size("x") == d, F.col("x")).otherwise(F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(d) - F.size("x"))))
    x = scratch.written(vectors.select(full.alias("x")).distinct(), "fit")
    if not d:
        return Fit(x, 0, x.count(), [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # High and low halves of 26 bits, so that no sum of a task leaves a long.
        n, high, low = 0, np.zeros(d, np.int64), np.zeros(d, np.int64)
        for block in _blocks(batches, d):
            n, high, low = n + len(block), high + (block >> 26).sum(axis=0), low + (block & ((1 << 26) - 1)).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d)), pa.array(high), pa.array(low), pa.array(np.full(d, n))], names=["place", "high", "low", "n"])

    wide = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low", "n")]
    rows = {r["place"]: r for r in x.mapInArrow(run, "place long, high long, low long, n long").groupBy("place").agg(*wide).collect()}
    return Fit(x, d, int(rows[0]["n"]) if rows else 0, [(int(rows[i]["high"]) << 26) + int(rows[i]["low"]) for i in range(d)] if rows else [])


def _orthonormal(basis: np.ndarray, new: np.ndarray) -> np.ndarray:
    """The part of the new directions that the basis does not hold, orthonormal; what is dependent goes."""
    out = basis
    for t in new.T:
        size = np.linalg.norm(t)
        if not size > 0 or not np.isfinite(size):
            continue
        t = t / size
        for _ in range(3):
            t = t - out @ (out.T @ t)
        left = np.linalg.norm(t)
        if left > 1e-10:
            t = t / left
            t = t - out @ (out.T @ t)
            out = np.column_stack([out, t / np.linalg.norm(t)])
    return out[:, basis.shape[1] :]


class _Minres:
    """MINRES for one correction equation: ``direction`` is what to multiply next, ``advance`` takes its product."""

    def __init__(self, q: np.ndarray, theta: float, residual: np.ndarray) -> None:
        self.q, self.theta = q, theta
        rhs = self._apart(-residual)
        self.beta = np.linalg.norm(rhs)
        self.done = not self.beta > 0
        self.t = np.zeros_like(rhs)
        self.v, self.before = (rhs / self.beta if not self.done else rhs), np.zeros_like(rhs)
        self.w, self.w_before = np.zeros_like(rhs), np.zeros_like(rhs)
        self.eta, self.cosines, self.sines, self.last = self.beta, (1.0, 1.0), (0.0, 0.0), 0.0
        self.goal = 1e-3 * self.beta

    def _apart(self, x: np.ndarray) -> np.ndarray:
        x = x - self.q @ (self.q.T @ x)
        return x - self.q @ (self.q.T @ x)

    def advance(self, product: np.ndarray) -> None:
        x = self._apart(product - self.theta * self.v)
        alpha = self.v @ x
        x = self._apart(x - alpha * self.v - self.last * self.before)
        beta = np.linalg.norm(x)
        (c, c_before), (s, s_before) = self.cosines, self.sines
        delta, rho2, rho3 = c * alpha - c_before * s * self.last, s * alpha + c_before * c * self.last, s_before * self.last
        rho = np.hypot(delta, beta)
        if not rho > EPS * abs(self.theta):
            self.done = True
            return
        self.cosines, self.sines = (delta / rho, c), (beta / rho, s)
        w = (self.v - rho2 * self.w - rho3 * self.w_before) / rho
        self.w, self.w_before = w, self.w
        self.t = self.t + self.cosines[0] * self.eta * w
        self.eta = -self.sines[0] * self.eta
        self.before, self.last = self.v, beta
        self.done = not (abs(self.eta) > self.goal and beta > EPS * abs(self.theta))
        if not self.done:
            self.v = x / beta


def jacobi_davidson(product: Callable[[np.ndarray], np.ndarray], d: int, trace: float, wanted: int, solver: Solver = Solver()) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues, falling, and their unit eigenvectors (columns) of the symmetric operator ``product``."""
    wanted = min(wanted, d)
    locked, values = np.zeros((d, 0)), []
    basis = _orthonormal(locked, np.random.default_rng(solver.seed).normal(size=(d, min(d, max(solver.start, wanted)))))
    image = product(basis)
    for _ in range(solver.steps):
        small = basis.T @ image
        theta, s = np.linalg.eigh((small + small.T) / 2)
        theta, s = theta[::-1], s[:, ::-1]
        goal = solver.tolerance * np.sqrt(trace * max([theta[0], *values]))
        ritz, moved = basis @ s, image @ s
        residual = moved - ritz * theta
        residual = residual - locked @ (locked.T @ residual)
        size = np.linalg.norm(residual, axis=0)
        # Leading pairs are locked in their order, so a later one is never taken for an earlier one.
        ready = 0
        while ready < len(theta) and len(values) + ready < wanted and size[ready] <= goal:
            ready += 1
        if ready:
            locked = np.column_stack([locked, ritz[:, :ready]])
            values += list(theta[:ready])
            basis, image, ritz, moved, residual, theta = ritz[:, ready:], moved[:, ready:], ritz[:, ready:], moved[:, ready:], residual[:, ready:], theta[ready:]
        if len(values) >= wanted:
            break
        if basis.shape[1] + wanted > max(solver.widest, 2 * wanted):
            keep = max(solver.start, wanted)
            basis, image = ritz[:, :keep], moved[:, :keep]
        open_pairs = range(min(wanted - len(values), len(theta)))
        solves = [_Minres(np.column_stack([locked, ritz[:, i]]), theta[i], residual[:, i]) for i in open_pairs]
        for _ in range(solver.inner):
            going = [m for m in solves if not m.done]
            if not going:
                break
            for m, p in zip(going, product(np.column_stack([m.v for m in going])).T):
                m.advance(p)
        new = _orthonormal(np.column_stack([locked, basis]), np.column_stack([m.t for m in solves]))
        if not new.shape[1]:
            new = _orthonormal(np.column_stack([locked, basis]), np.random.default_rng(solver.seed + basis.shape[1]).normal(size=(d, 1)))
            if not new.shape[1]:
                raise ArithmeticError(f"residuals {size[:wanted]} stay above {goal} in the whole space")
        basis, image = np.column_stack([basis, new]), np.column_stack([image, product(new)])
    else:
        raise ArithmeticError(f"residuals {size[:wanted]} are above {goal} after {solver.steps} steps")
    order = np.argsort(values)[::-1]
    return np.array(values)[order], locked[:, order]


def whitened(embeddings: DataFrame, components: int = COMPONENTS, vector: str = "embedding", solver: Solver = Solver()) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each vector and component."""
    spark = embeddings.sparkSession
    schema = f"vec_id {dict(embeddings.dtypes)['vec_id']}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    with Scratch(spark) as scratch:
        vectors = scratch.written(clean_vectors(embeddings, vector), "vectors")
        fit = fit_list(vectors, scratch)
        trace = float(fit.summed(lambda c: (c * c).sum(), 1)[0]) / fit.n if fit.d and fit.n else 0.0
        if not trace > 0:
            return spark.createDataFrame([], schema)
        e, u = jacobi_davidson(fit.product, fit.d, trace, components, solver)
        has = e > fit.d * EPS * trace
        e, u = e[has], u[:, has]
        k, d, n, mean, sums = len(e), fit.d, fit.n, fit.mean, fit.sums
        onto = u / np.sqrt(e)
        moments = fit.summed(lambda c: np.vstack([(c @ onto).sum(axis=0), (c @ onto).T @ (c @ onto)]), (k + 1) * k).reshape(k + 1, k) / n
        error = float(np.abs(moments[1:] - np.outer(moments[0], moments[0]) - np.eye(k)).max())
        explained = e / trace
        whole = max(abs(s) for s in sums) < 1 << 62
        total = np.array(sums, np.int64 if whole else object)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for low in range(0, b.num_rows, 1024):
                    part = b.slice(low, 1024)
                    x = _matrix(part.column(1), d)
                    # Exact in longs where the largest possible sum fits, in Python's whole numbers else.
                    reach = float(n) * max(float(np.abs(x).max(initial=0)), 1.0) + max(float(abs(s)) for s in sums)
                    gap = n * x - total if whole and reach < 2.0**62 else x.astype(object) * n - np.array(sums, object)
                    if float(d) * reach * reach < 2.0**62:
                        deviation = pa.array((gap * gap).sum(axis=1).astype(np.int64))
                    else:
                        deviation = pa.array([v if v < 1 << 63 else None for v in (sum(int(g) * int(g) for g in row) for row in gap)], pa.int64())
                    rows = pa.array(np.repeat(np.arange(part.num_rows), k))
                    place = np.tile(np.arange(k), part.num_rows)
                    yield pa.RecordBatch.from_arrays(
                        [
                            part.column(0).take(rows), pa.array(place + 1, pa.int32()), pa.array(np.full(len(place), n)), deviation.take(rows), pa.array(((x - mean) @ onto).reshape(-1)),
                            pa.array(explained[place]), pa.array(np.full(len(place), error)),
                        ],
                        names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                    )

        return written(vectors.mapInArrow(run, schema), "whitened")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(table(spark, sf_dir, "embeddings"))
