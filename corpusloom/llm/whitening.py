"""Embedding whitening: one-sided Jacobi SVD of the R that blockwise TSQR makes of the centred rows."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.knn_join import quantised
from corpusloom.session import prepare, stash

#: Added to floor(64 * component), so that all entries of a fit list are positive.
SHIFT = 1_000_000
#: Rows that are factored at a time, and triangles that one task of the tree puts together.
ROWS, FAN = 4096, 64
#: Cosine of two columns below which they count as orthogonal, and sweeps over all pairs of columns at most.
ORTHOGONAL, SWEEPS = 1e-15, 60
LONG = 2**63


def entries(batch: pa.RecordBatch, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the vectors that take part, and their x = floor(64 * c) + SHIFT, exact in doubles."""
    rows, scaled = quantised(batch["embedding"], dim)
    return rows, scaled + SHIFT


@dataclass
class Fit:
    """What all tasks know of the fit list: its size, the sum of each dimension, and once fitted the components."""

    n: int
    sums: list[int]
    components: np.ndarray | None = None  # a column each, by falling deviation
    deviations: np.ndarray | None = None  # of the data along each component
    explained: np.ndarray | None = None

    @property
    def dim(self) -> int:
        return len(self.sums)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S/n: whole parts first, so that nothing of the difference is lost."""
        whole = np.array([s // self.n for s in self.sums], float)
        rest = np.array([(s % self.n) / self.n for s in self.sums])
        return (x - whole) - rest

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.components / self.deviations

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """The sum over dimensions of (n*x - S)**2 for each row, exact; null where it exceeds a long."""
        most = max((max(abs(self.n * int(a) - s), abs(self.n * int(b) - s)) for a, b, s in zip(x.min(0), x.max(0), self.sums)), default=0)
        if most * most * self.dim < LONG:
            gaps = self.n * x.astype(np.int64) - np.array(self.sums, np.int64)
            return (gaps * gaps).sum(1).tolist()
        exact = [sum((self.n * int(v) - s) ** 2 for v, s in zip(row, self.sums)) for row in x]
        return [d if d < LONG else None for d in exact]


def dimension(vectors: DataFrame) -> int:
    """The most frequent length of a vector (the larger, if two are); 0 without vectors."""
    lengths = vectors.where("embedding IS NOT NULL").groupBy(F.size("embedding").alias("dim")).agg(F.count(F.lit(1)).alias("n"))
    found = lengths.orderBy(F.desc("n"), F.desc("dim")).first()
    return found["dim"] if found else 0


def _sums(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[pa.RecordBatch]:
    n, sums = 0, np.zeros(dim, np.int64)
    for batch in batches:
        rows, x = entries(batch, dim)
        n += len(rows)
        sums += x.astype(np.int64).sum(0)
    yield pa.record_batch({"d": pa.array(range(-1, dim), pa.int32()), "s": pa.array([n, *sums.tolist()], pa.int64())})


def summed(vectors: DataFrame, dim: int) -> Fit:
    """Rows and sums: a number for each dimension comes to the driver. Sums are decimals, as n may be large."""
    found = vectors.mapInArrow(partial(_sums, dim=dim), "d int, s long").groupBy("d").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    have = {r["d"]: int(r["s"]) for r in found.collect()}  # dim + 1 numbers
    return Fit(have.get(-1, 0), [have.get(d, 0) for d in range(dim)])


def triangle(rows: np.ndarray) -> np.ndarray:
    """R of a QR factorisation, as a square matrix."""
    r = np.linalg.qr(rows, mode="r")
    return np.vstack([r, np.zeros((rows.shape[1] - len(r), rows.shape[1]))])


def _factor(batches: Iterator[pa.RecordBatch], fit: Fit) -> Iterator[pa.RecordBatch]:
    """One triangle for a whole partition: blocks of rows are stacked below the triangle so far and factored again."""
    r = np.zeros((fit.dim, fit.dim))
    for batch in batches:
        for part in (batch.slice(a, ROWS) for a in range(0, batch.num_rows, ROWS)):
            _, x = entries(part, fit.dim)
            r = triangle(np.vstack([r, fit.centred(x)]))
    yield pa.record_batch({"r": pa.array([r.tobytes()], pa.binary())})


def _together(table: pa.Table, dim: int) -> pa.Table:
    # the order of the triangles changes R's rounding only; sorted, a recomputed task gives the same bytes
    r = np.zeros((dim, dim))
    for each in sorted(x.as_py() for x in table["r"]):
        r = triangle(np.vstack([r, np.frombuffer(each).reshape(dim, dim)]))
    return pa.table({"r": pa.array([r.tobytes()], pa.binary())})


def tsqr(vectors: DataFrame, fit: Fit) -> np.ndarray:
    """R of all centred rows: a triangle for each partition, then a tree of FAN triangles a task. One comes to the driver."""
    found = stash(vectors.mapInArrow(partial(_factor, fit=fit), "r binary"), "triangles")
    dim, left = fit.dim, found.count()
    while left > 1:
        groups = -(-left // FAN)
        dealt = found.withColumn("g", F.pmod(F.xxhash64("r"), F.lit(groups))).groupBy("g")
        found = stash(dealt.applyInArrow(lambda t: _together(t, dim), "r binary"), "triangles")
        left = found.count()
    only = found.first()
    return np.frombuffer(only["r"]).reshape(dim, dim) if only else np.zeros((dim, dim))


def rounds_of_pairs(n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of n columns in rounds of disjoint pairs: one column stays, the others go round a table."""
    ring = [*range(n), *([-1] * (n % 2))]
    for _ in range(len(ring) - 1):
        half = len(ring) // 2
        pairs = [(a, b) for a, b in zip(ring[:half], ring[: half - 1 : -1]) if a >= 0 and b >= 0]
        if pairs:
            yield tuple(np.array(pairs).T)
        ring = [ring[0], ring[-1], *ring[1:-1]]


def jacobi(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(singular values, right singular vectors as columns) of a square matrix, by falling value.

    Plane rotations make pairs of columns orthogonal until all are; the rotations' product is V and the columns' lengths
    are the values, which come out accurate relative to each, small ones too. The largest entry of each vector is made
    positive.
    """
    u, v = r.T.copy(), np.eye(len(r))  # rows of u and v are the columns
    scale = np.abs(u).max(initial=0.0)
    if scale > 0:
        u /= scale  # squares neither overflow nor vanish
    for _ in range(SWEEPS):
        worst = 0.0
        for a, b in rounds_of_pairs(len(r)):
            x, y = u[a], u[b]
            xx, yy, xy = (x * x).sum(1), (y * y).sum(1), (x * y).sum(1)
            size = np.sqrt(xx * yy)
            turn = np.abs(xy) > ORTHOGONAL * size
            if not turn.any():
                continue
            a, b, x, y, xx, yy, xy, size = a[turn], b[turn], x[turn], y[turn], xx[turn], yy[turn], xy[turn], size[turn]
            worst = max(worst, float((np.abs(xy) / size).max()))
            zeta = (yy - xx) / (2 * xy)
            t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
            c = (1 / np.hypot(1.0, t))[:, None]
            s = c * t[:, None]
            u[a], u[b] = c * x - s * y, s * x + c * y
            v[a], v[b] = c * v[a] - s * v[b], s * v[a] + c * v[b]
        if worst <= 4 * ORTHOGONAL:
            break
    values = np.sqrt((u * u).sum(1)) * scale
    order = np.argsort(-values, kind="stable")
    v = v[order]
    signs = np.sign(v[np.arange(len(v)), np.abs(v).argmax(1)])
    return values[order], (v * signs[:, None]).T


def fitted(vectors: DataFrame, k: int) -> Fit | None:
    """The first k components of the fit list; None where no vector takes part or all are equal.

    Components along which the list does not vary, to the precision of doubles, are left out: they can't be whitened.
    """
    dim = dimension(vectors)
    fit = summed(vectors, dim)
    if not fit.n or not dim:
        return None
    values, v = jacobi(tsqr(vectors, fit))
    kept = int((values > values.max() * dim * np.finfo(float).eps).sum()) if values.max() > 0 else 0
    total = float((values * values).sum())
    k = min(k, kept)
    fit.components, fit.deviations = v[:, :k], values[:k] / np.sqrt(fit.n)
    fit.explained = values[:k] ** 2 / total if total else values[:k]
    return fit if k else None


def _products(batches: Iterator[pa.RecordBatch], fit: Fit) -> Iterator[pa.RecordBatch]:
    k = fit.components.shape[1]
    total = np.zeros((k + 1, k))
    for batch in batches:
        w = fit.whitened(entries(batch, fit.dim)[1])
        total[0] += w.sum(0)
        total[1:] += w.T @ w
    at = np.arange(total.size)
    yield pa.record_batch({"at": pa.array(at.astype(np.int32)), "s": pa.array(total.ravel())})


def identity_error(vectors: DataFrame, fit: Fit) -> float:
    """The largest entry of (covariance of the whitened rows minus identity), measured by a pass over all rows."""
    k = fit.components.shape[1]
    found = vectors.mapInArrow(partial(_products, fit=fit), "at int, s double").groupBy("at").agg(F.sum("s").alias("s"))
    total = np.zeros((k + 1, k))
    for r in found.collect():  # (k + 1) * k numbers
        total.ravel()[r["at"]] = r["s"]
    mean = total[0] / fit.n
    return float(np.abs(total[1:] / fit.n - np.outer(mean, mean) - np.eye(k)).max())


def _rows(batches: Iterator[pa.RecordBatch], fit: Fit, error: float) -> Iterator[pa.RecordBatch]:
    k = fit.components.shape[1]
    for batch in batches:
        rows, x = entries(batch, fit.dim)
        if not len(rows):
            continue
        each = np.repeat(np.arange(len(rows)), k)
        yield pa.record_batch(
            {
                "vec_id": batch["vec_id"].take(pa.array(rows[each])),
                "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(rows))),
                "n": pa.array(np.full(len(each), fit.n, np.int64)),
                "deviation": pa.array(fit.deviation(x), pa.int64()).take(pa.array(each)),
                "whitened": pa.array(fit.whitened(x).ravel()),
                "explained": pa.array(np.tile(fit.explained, len(rows))),
                "identity_error": pa.array(np.full(len(each), error)),
            }
        )


SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, k: int = 32) -> DataFrame:
    """Rows of ``vectors`` (vec_id, embedding) along the first k whitened components: a row each, in the SCHEMA above.

    x = floor(64 * component) + SHIFT. The centred rows of each partition are compressed to a triangle R block by block,
    triangles meet in a tree, and one-sided Jacobi rotations on the last one's columns give components and standard
    deviations; covariances are never formed. whitened is x - S/n along the component over its deviation; explained is
    the component's share of the variance; deviation is exact, and null where it exceeds a long. identity_error is
    measured on the whitened rows. Memory is bounded by dimension**2, whatever the number of rows.

    Defined cases: vectors that are null or empty, hold null or non-finite entries, or have another length than most
    take no part and have no rows; a null vec_id stays null; repeated rows count each; components without variance are
    left out, so equal vectors, a single one and an empty table give an empty result; other columns are ignored.
    """
    spark = prepare(vectors.sparkSession)
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    fit = fitted(vectors.select("embedding"), k)
    if fit is None:
        return spark.createDataFrame([], SCHEMA)
    error = identity_error(vectors.select("embedding"), fit)
    return vectors.mapInArrow(partial(_rows, fit=fit, error=error), SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
