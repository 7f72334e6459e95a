"""Whitening of embeddings by matrix-free block subspace iteration.

The covariance is never formed. With X the centred rows and Q a block of orthonormal directions,
a pass over the rows adds up X^T (X Q) in the tasks, by matrix products of numpy over Arrow batches,
and Spark sums the tasks' blocks. On the driver, which holds blocks of as many rows as a vector has
entries, a Rayleigh-Ritz step turns the block to its best directions and tells their residuals
|V u - e u| from the same pass; QR makes the next block. The passes end when the residuals of all
wanted components are at rounding. Where eigenvalues lie so close that a pass gains less than GAIN,
the block is doubled; a block of the whole width is exact after one pass.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Written

COMPONENTS = 8
#: Width of the first block by the wanted components; residual, by the largest eigenvalue, at which a component is certified.
WIDTH, CERTIFIED = 4, 1e-12
#: A pass that lessens the largest residual by less than this factor doubles the block.
GAIN, MOST_PASSES = 10.0, 200
#: Components whose eigenvalue is below this share of the trace have no direction.
NOTHING = 1e-12
#: Entries become integers by these; those beyond LARGEST cannot.
SCALE, SHIFT, LARGEST = 1024, 100_000, float(1 << 52)
LONG = (1 << 63) - 1


def integers(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, x array<long>) of the rows that have a whole vector of finite entries, x = floor(1024 c) + 100000.

    Vectors that are null or hold a null or non-finite entry go. An entry too large for x to be
    exact counts as not finite. Lengths are as they are, see whiten().
    """
    v = F.col(vector_col).cast("array<double>")
    ok = F.forall(v, lambda c: F.coalesce(F.abs(c * SCALE) < LARGEST, F.lit(False)))  # NaN is above all numbers
    whole = df.select(F.col(id_col).alias("vec_id"), v.alias("v")).where(v.isNotNull() & ok)
    return whole.select("vec_id", F.transform("v", lambda c: F.floor(c * SCALE).cast("long") + SHIFT).alias("x"))


def _matrix(batch: pa.RecordBatch, name: str = "x") -> np.ndarray:
    column = batch.column(name)
    return np.asarray(column.flatten()).reshape(len(column), -1)


def _added(x: DataFrame, block: Callable[[np.ndarray], np.ndarray], rows: int, width: int, kind: str) -> np.ndarray:
    """The sum over all batches of a block (rows, width): added up in each task, then by Spark row by row of the block."""
    dtype = np.int64 if kind == "long" else np.float64
    names = [f"c{j}" for j in range(width)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((rows, width), dtype)
        seen = False
        for b in batches:
            if b.num_rows:
                total += block(_matrix(b))
                seen = True
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(rows, dtype=np.int32)), *[pa.array(total[:, j]) for j in range(width)]], ["row", *names])

    parts = x.select("x").mapInArrow(run, f"row int, {', '.join(f'{c} {kind}' for c in names)}")
    out = np.zeros((rows, width), dtype)
    for r in parts.groupBy("row").agg(*[F.sum(c).alias(c) for c in names]).collect():  # as many rows as a vector has entries
        out[r["row"]] = [r[c] for c in names]
    return out


class Fit:
    """n, the exact sums S, and the leading components of the covariance of x."""

    def __init__(self, x: DataFrame, k: int = COMPONENTS, seed: int = 1):
        """x: integers() of a table, written; k components at most."""
        self.n, self.sums, self.vectors, self.values, self.trace, self.passes, self.widths = 0, [], np.zeros((0, 0)), np.zeros(0), 0.0, 0, []
        head = x.select(F.size("x").alias("d")).limit(1).collect()
        d = head[0]["d"] if head else 0
        if not d:
            return
        both = _added(x, lambda m: np.column_stack([m.sum(axis=0), np.full(m.shape[1], len(m))]), d, 2, "long")
        self.n, self.sums = int(both[0, 1]), [int(s) for s in both[:, 0]]
        self.mean = np.array([float(Fraction(s, self.n)) for s in self.sums])
        self._iterate(x, d, min(k, d), np.random.default_rng(seed))

    def _iterate(self, x: DataFrame, d: int, k: int, random: np.random.Generator) -> None:
        mean, width, last = self.mean, min(d, max(WIDTH * k, k + 8)), np.inf
        q = np.linalg.qr(random.standard_normal((d, width)))[0]
        while True:

            def block(m: np.ndarray, q: np.ndarray = q) -> np.ndarray:
                c = m - mean
                return np.column_stack([c.T @ (c @ q), (c * c).sum(axis=0)])

            y = _added(x, block, d, q.shape[1] + 1, "double") / self.n
            vq, self.trace = y[:, :-1], float(y[:, -1].sum())
            self.passes += 1
            self.widths.append(q.shape[1])
            small = q.T @ vq
            e, turn = np.linalg.eigh((small + small.T) / 2)
            order = np.argsort(e)[::-1]
            e, turn = e[order], turn[:, order]
            u, vu = q @ turn, vq @ turn
            residual = float(np.linalg.norm(vu[:, :k] - u[:, :k] * e[:k], axis=0).max())
            whole = q.shape[1] == d and self.passes > 1
            if whole or residual <= CERTIFIED * max(e[0], 0.0) or self.trace == 0.0:
                break
            if self.passes == MOST_PASSES:
                raise RuntimeError(f"components did not settle in {MOST_PASSES} passes")
            grown = random.standard_normal((d, min(d, 2 * q.shape[1]) - q.shape[1])) if last < np.inf and residual * GAIN > last else np.zeros((d, 0))
            last = residual
            q = np.linalg.qr(np.column_stack([vu / max(e[0], np.finfo(float).tiny), grown]))[0]
        keep = int((e[:k] > NOTHING * self.trace).sum()) if self.trace > 0 else 0
        self.values, self.vectors, self.residual = e[:keep], u[:, :keep], residual
        # what the rounded mean leaves of the sums, exactly, so that projections are centred once more
        left = np.array([float(Fraction(s, self.n) - Fraction(float(m))) for s, m in zip(self.sums, mean)])
        self.rest = left @ self.vectors

    def project(self, m: np.ndarray) -> np.ndarray:
        """Whitened rows: centred, on the components, by the roots of the eigenvalues."""
        return ((m - self.mean) @ self.vectors - self.rest) / np.sqrt(self.values)

    def deviations(self, m: np.ndarray) -> list[int | None]:
        """The sum of (n x - S)^2 of each row, exact; null where it is no long."""
        n, s = self.n, self.sums
        size = float(np.abs((m - self.mean) * float(n)).max(initial=0.0)) + 1.0
        if size * size * m.shape[1] < LONG / 2 and float(np.abs(m).max(initial=0)) * n < LONG / 2:
            c = m * np.int64(n) - np.array(s, dtype=np.int64)
            return (c * c).sum(axis=1).tolist()
        sums = (sum((n * v - t) ** 2 for v, t in zip(row, s)) for row in m.tolist())
        return [v if v <= LONG else None for v in sums]


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = COMPONENTS) -> DataFrame:
    """For each row that integers() keeps and each component: vec_id, component, n, deviation, whitened, explained, identity_error.

    n rows are the fit list, repeated ones and those of null ids among them. Vectors whose length is
    not the most frequent one (the larger of equally frequent ones) count as such with null entries,
    and go. Components are numbered
    from 1 by falling eigenvalue; those without variance (fewer than k dimensions vary, one row,
    equal rows) have no rows. deviation is null where it does not fit a long. identity_error is the
    largest entry, by size, of the covariance of the whitened columns minus the identity, from a pass
    of its own. Other columns of the input are not read. An empty table gives no rows.
    """
    made = Written(integers(df, id_col, vector_col), "vectors")
    sizes = made.df.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    x = made.df.where(F.size("x") == (sizes[0]["d"] if sizes else 0))
    fit = Fit(x, k)
    count = len(fit.values)
    kind = df.select(F.col(id_col).alias("vec_id")).schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not count:
        return x.select("vec_id").where(F.lit(False)).selectExpr("vec_id", *[f"cast(null as {c.split()[1]}) {c.split()[0]}" for c in schema.split(", ")[1:]])
    error = float(np.abs(_added(x, lambda m: (w := fit.project(m)).T @ w, count, count, "double") / fit.n - np.eye(count)).max())
    explained = fit.values / fit.trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            m = _matrix(b)
            each = np.repeat(np.arange(len(m)), count)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("vec_id").take(pa.array(each)),
                    pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), len(m))),
                    pa.array(np.full(len(each), fit.n, dtype=np.int64)),
                    pa.array(fit.deviations(m), pa.int64()).take(pa.array(each)),
                    pa.array(fit.project(m).reshape(-1)),
                    pa.array(np.tile(explained, len(m))),
                    pa.array(np.full(len(each), error)),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return x.mapInArrow(run, schema)
