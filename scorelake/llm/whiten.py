"""Embedding whitening by incremental eigendecomposition.

A partition keeps the eigendecomposition of its vectors' scatter and takes vectors in by centred rank-one updates: each solves a secular
equation, after deflation. The partitions' spectra are combined by successive rank-one updates, in a tree; Rayleigh-Ritz steps over all
vectors then refine the leading components.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelake.llm.common import drop, ship, written

EPS = float(np.finfo(float).eps)
#: A vector's entry c becomes the whole number floor(SCALE * c).
SCALE = 256
#: Vectors of a block: its centred rows are turned (QR) into at most as many as there are dimensions, of the same scatter, and these are the
#: rank-one updates. With 1, each vector is an update of its own.
BLOCK_ROWS = 8192
#: Spectra that one task combines.
FAN_IN = 16
#: Columns beside the wanted ones that the refinement carries, and the passes that it takes at most.
GUARD, PASSES = 8, 6
SPECTRUM = "part long, n long, sums array<long>, values array<double>, vectors array<double>"


def secular_roots(d: np.ndarray, z2: np.ndarray) -> np.ndarray:
    """delta[i, j] = d[j] - root[i] for the roots of 1 + sum(z2 / (d - x)) = 0, of which one lies after each d. d rises, z2 is positive.

    Each root is found as a distance from the nearer pole, so differences from all poles are good to the last bits. Steps interpolate the sums
    of the poles on either side by one pole each; a step out of the bracket is replaced by its middle.
    """
    k = len(d)
    rows = np.arange(k)
    gap = np.append(np.diff(d), z2.sum())
    left = np.tri(k, dtype=bool)
    z_left, z_right = np.where(left, z2, 0.0), np.where(left, 0.0, z2)
    middle = d + gap / 2
    at_middle = 1 + (z2 / (d - middle[:, None])).sum(1)
    near = (at_middle >= 0) | (rows == k - 1)
    origin = np.where(near, d, np.append(d[1:], d[-1]))
    apart = d - origin[:, None]
    lo, hi = np.where(near, 0.0, -gap / 2), np.where(near, np.where(rows == k - 1, gap, gap / 2), 0.0)
    tau = np.where(near, gap / 2, -gap / 2)
    after = np.minimum(rows + 1, k - 1)
    for _ in range(60):
        t = apart - tau[:, None]
        a, b = z_left / t, z_right / t
        psi, phi = a.sum(1), b.sum(1)
        f = 1 + psi + phi
        done = np.abs(f) <= EPS * k * (1 + np.abs(psi) + np.abs(phi))
        if done.all():
            break
        lo, hi = np.where(f < 0, tau, lo), np.where(f > 0, tau, hi)
        slope_a, slope_b = (a / t).sum(1), (b / t).sum(1)
        d0, d1 = t[rows, rows], t[rows, after]
        q, s = slope_a * d0 * d0, np.where(rows == k - 1, 0.0, slope_b * d1 * d1)
        c = f - slope_a * d0 - np.where(rows == k - 1, 0.0, slope_b * d1)
        with np.errstate(all="ignore"):
            # The last root has one pole only: c + q / (d0 - x) = 0.
            p = c * (d0 + d1) + q + s
            m = d0 * d1 * f
            root = np.sqrt(np.maximum(p * p - 4 * m * c, 0))
            step = np.where(p <= 0, (p - root) / (2 * c), 2 * m / (p + root))
            step = np.where(rows == k - 1, d0 + q / c, step)
            new = tau + step
        inside = np.isfinite(new) & (new > lo) & (new < hi)
        new = np.where(inside, new, (lo + hi) / 2)
        stuck = new == tau
        tau = np.where(done, tau, new)
        if (done | stuck).all():
            break
    return apart - tau[:, None]


def rank_one(d: np.ndarray, u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, rising, and eigenvectors of u diag(d) u^T + v v^T."""
    z = u.T @ v
    length = float(np.sqrt(z @ z))
    if length == 0:
        return d, u
    tolerance = 8 * EPS * max(abs(d[-1]), length * length)
    d, u = d.copy(), u.copy()
    # Deflation: of eigenvalues that can't be told apart all but one are turned so that v has no part in them; and so are small parts.
    edges = np.flatnonzero(np.diff(d) > tolerance) + 1
    for a, b in zip([0, *edges], [*edges, len(d)], strict=True):
        if b - a > 1 and np.count_nonzero(z[a:b]) > 0:
            w = z[a:b].copy()
            size = np.sqrt(w @ w)
            w[-1] += size if w[-1] >= 0 else -size
            own = u[:, a:b]
            own -= np.outer(own @ w, w * (2 / (w @ w)))
            z[a : b - 1], z[b - 1] = 0.0, -np.copysign(size, w[-1])
    live = np.abs(z) * length > tolerance
    x, y = d[live], z[live]
    k = len(x)
    if not k:
        return d, u
    delta = secular_roots(x, y * y)
    # The parts for which the roots found are the exact ones, so that the new vectors are orthogonal to the last bits.
    below = np.tri(k, k, -1, dtype=bool).T  # i < j
    span = x[:, None] - x
    under = np.where(below, span, np.vstack([span[1:], np.ones(k)]))
    under[-1] = 1.0
    exact = np.sqrt(np.abs(np.prod(-delta / under, axis=0)))
    turn = np.copysign(exact, y) / delta
    turn /= np.sqrt((turn * turn).sum(1))[:, None]
    diagonal = np.arange(k)
    d[live] = x - delta[diagonal, diagonal]
    u[:, live] = u[:, live] @ turn.T
    order = np.argsort(d, kind="stable")
    return d[order], u[:, order]


@dataclass
class Spectrum:
    """How many vectors, their sums, exact while they fit 64 bits, and the eigendecomposition of their scatter about their mean."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    vectors: np.ndarray

    @classmethod
    def none(cls, dims: int) -> Spectrum:
        return cls(0, np.zeros(dims, np.int64), np.zeros(dims), np.eye(dims))

    def _take(self, rows: np.ndarray, n: int, sums: np.ndarray) -> None:
        """Takes in n vectors of these sums, of which rows (any number) have the scatter about their mean."""
        for r in rows:
            self.values, self.vectors = rank_one(self.values, self.vectors, r)
        if self.n and n:
            shift = sums / n - self.sums / self.n
            self.values, self.vectors = rank_one(self.values, self.vectors, shift * np.sqrt(self.n * (n / (self.n + n))))
        self.n, self.sums = self.n + n, self.sums + sums

    def add(self, x: np.ndarray) -> None:
        """Takes in the rows of x, whole numbers."""
        sums = x.sum(0)
        y = x - sums / len(x)
        self._take(np.linalg.qr(y, mode="r") if len(y) > x.shape[1] else y if len(y) > 1 else y[:0], len(x), sums)

    def merge(self, other: Spectrum) -> None:
        self._take(np.sqrt(np.maximum(other.values, 0))[:, None] * other.vectors.T, other.n, other.sums)


def _matrix(b: pa.RecordBatch | pa.Array, dims: int) -> np.ndarray:
    return np.asarray(b.flatten().to_numpy(zero_copy_only=False), np.int64).reshape(-1, dims)


def _blocks(batches: Iterator[pa.RecordBatch], dims: int, block: int) -> Iterator[np.ndarray]:
    held, n = [], 0
    for b in batches:
        x = _matrix(b.column(0), dims)
        for a in range(0, len(x), block):
            held.append(x[a : a + block])
            n += len(held[-1])
            if n >= block:
                yield np.concatenate(held)
                held, n = [], 0
    if n:
        yield np.concatenate(held)


def partition_spectra(fit: DataFrame, dims: int, block: int = BLOCK_ROWS) -> DataFrame:
    """SPECTRUM rows, one a partition of fit, whose one column holds vectors of whole numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Spectrum.none(dims)
        for x in _blocks(batches, dims, block):
            own.add(x)
        if own.n:
            columns = [[TaskContext.get().partitionId()], [own.n], [own.sums], [own.values], [own.vectors.ravel()]]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.list_(pa.int64())), pa.array(columns[3], pa.list_(pa.float64())), pa.array(columns[4], pa.list_(pa.float64()))], ["part", "n", "sums", "values", "vectors"])

    return fit.mapInArrow(run, SPECTRUM)


def combined(spectra: DataFrame, dims: int) -> Spectrum:
    """One spectrum of all: FAN_IN at a time a task, until one row of it is left."""

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("part")
        own = Spectrum.none(dims)
        for r in rows.itertuples():
            own.merge(Spectrum(int(r.n), np.array(r.sums), np.array(r.values), np.array(r.vectors).reshape(dims, dims)))
        return pd.DataFrame({"part": [rows["part"].iloc[0] // FAN_IN], "n": [own.n], "sums": [own.sums], "values": [own.values], "vectors": [own.vectors.ravel()]})

    spectra = written(spectra, "spectra")
    top = spectra.agg(F.max("part")).first()[0]
    while top is not None and top > 0:
        after = written(spectra.groupBy(F.floor(F.col("part") / FAN_IN)).applyInPandas(merge, SPECTRUM), "spectra")
        drop(spectra)
        spectra, top = after, top // FAN_IN
    row = spectra.first()
    drop(spectra)
    return Spectrum(row.n, np.array(row.sums), np.array(row["values"]), np.array(row.vectors).reshape(dims, dims)) if row else Spectrum.none(dims)


def _summed(fit: DataFrame, work: object, size: int) -> np.ndarray:
    """The sum over partitions of fit of work(blocks), arrays of `size` numbers: a number a place, added up by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = work(batches)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size), pa.int32()), pa.array(total.ravel(), pa.float64())], ["place", "value"])

    out = np.zeros(size)
    for r in fit.mapInArrow(run, "place int, value double").groupBy("place").agg(F.sum("value").alias("value")).collect():
        out[r["place"]] = r["value"]
    return out


def refined(fit: DataFrame, whole: Spectrum, components: int) -> tuple[np.ndarray, np.ndarray]:
    """The leading eigenvalues, falling, and eigenvectors of the covariance. A pass multiplies the covariance by a few columns, vectors
    centred first, and solves the small problem in their span; residuals that rounding doesn't explain join the span of a further pass."""
    dims = len(whole.sums)
    mean, n = whole.sums / whole.n, whole.n
    basis = np.linalg.qr(whole.vectors[:, ::-1][:, : min(dims, components + GUARD)])[0]
    for _ in range(PASSES):
        m = basis.shape[1]

        def work(batches: Iterator[pa.RecordBatch], basis: np.ndarray = basis) -> np.ndarray:
            total = np.zeros((dims, m))
            for x in _blocks(batches, dims, BLOCK_ROWS):
                y = x - mean
                total += y.T @ (y @ basis)
            return total

        image = _summed(fit, work, dims * m).reshape(dims, m) / n
        small = basis.T @ image
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        vectors = basis @ turn
        rest = (image @ turn - vectors * values)[:, :components]
        if np.abs(rest).max(initial=0) <= 64 * EPS * max(values[0], 0) or m == dims:
            break
        basis = np.linalg.qr(np.hstack([vectors, rest]))[0][:, :dims]
    return values[:components], vectors[:, :components]


def whole_numbers(vector: Column) -> Column:
    """floor(SCALE * c) of each entry, as long."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE).cast("long"))


def usable(vector: Column) -> Column:
    """Whether a vector isn't null and holds neither null nor NaN nor infinity."""
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == float("inf"))
    return F.coalesce(~F.exists(vector, bad), F.lit(False))


def whiten(vectors: DataFrame, components: int = 4, id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK_ROWS) -> DataFrame:
    """id_col, component, n, deviation, whitened, explained, identity_error of every usable row and component up to `components`.

    Entries become whole numbers; each distinct vector is fitted once (n of them). deviation is the sum of (n * x - sums)^2, exact, null
    where it passes 63 bits; whitened is the centred vector's projection on the component over the square root of its eigenvalue;
    identity_error is the largest absolute entry of whitened's covariance over the fitted vectors minus the identity.

    Rows whose vector is null, or holds null, NaN or infinity, give nothing. Nor do rows of another length than most have (of lengths as
    common, the greatest): they have no covariance with the others. Components of no variance beyond rounding (copies of one vector, linear
    dependence) have no whitened value and are left out; so an empty table, and one of a single distinct vector, give no rows. Repeated rows
    and null ids give a row each. Other columns aren't read.
    """
    spark = vectors.sparkSession
    ship(spark)
    schema = f"id {dict(vectors.dtypes)[id_col]}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    names = [id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"]
    rows = vectors.select(vectors[id_col].alias("id"), vectors[vector_col].alias("vector")).where(usable(F.col("vector"))).select("id", whole_numbers(F.col("vector")).alias("x"))
    common = rows.groupBy(F.size("x").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    if common is None or common["dims"] < 1:
        return spark.createDataFrame([], schema).toDF(*names)
    dims = int(common["dims"])
    rows = rows.where(F.size("x") == dims)
    fit = written(rows.select("x").distinct(), "vectors")
    whole = combined(partition_spectra(fit, dims, block), dims)
    n, sums, mean = whole.n, whole.sums, whole.sums / whole.n
    e, axes = refined(fit, whole, min(components, dims))
    trace = float(whole.values.sum()) / n
    held = e > dims * 64 * EPS * max(trace, 0)
    e, axes = e[held], axes[:, held]
    k = len(e)
    to_white = axes / np.sqrt(e)
    if not k:
        drop(fit)
        return spark.createDataFrame([], schema).toDF(*names)

    def squares(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros((k + 1, k))
        for x in _blocks(batches, dims, BLOCK_ROWS):
            w = (x - mean) @ to_white
            total[:k] += w.T @ w
            total[k] += w.sum(0)
        return total

    found = _summed(fit, squares, (k + 1) * k).reshape(k + 1, k) / n
    error = float(np.abs(found[:k] - np.outer(found[k], found[k]) - np.eye(k)).max())
    drop(fit)
    explained = e / trace

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, BLOCK_ROWS):
                part = b.slice(a, BLOCK_ROWS)
                x = _matrix(part.column(1), dims)
                m = len(x)
                white = (x - mean) @ to_white
                off = n * x - sums  # wraps around, and so does the sum of squares: right whenever the result fits
                deviation = (off * off).sum(1)
                fits = ((n * x.astype(float) - sums) ** 2).sum(1) < 2.0**63 * (1 - 1e-9)
                each = np.repeat(np.arange(m), k)
                columns = [
                    part.column(0).take(pa.array(each)),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, n, np.int64)),
                    pa.array(deviation[each], pa.int64(), mask=~fits[each]),
                    pa.array(white.ravel()),
                    pa.array(np.tile(explained, m)),
                    pa.array(np.full(m * k, error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["id", *names[1:]])

    return rows.mapInArrow(score, schema).toDF(*names)
