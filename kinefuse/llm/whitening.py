"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation (Golub and Kahan, 1965).

The centred rows X are never multiplied into a covariance. Starting from a unit vector v, the method
takes u = X v and v = X' u in turn, each orthogonal to all earlier ones, so that U' X V is upper
bidiagonal. The singular values of that small matrix are those of X; its right vectors, carried back by
V, are the components.

A left vector has an entry for each row of X and stays where the rows are: it is X w for a short
vector w, and only w is kept. One pass over the rows takes a candidate u = X w, its products with all earlier left
vectors and with X, and sums them over partitions; full reorthogonalisation of u is then a
combination of short vectors, and is done again in a second pass where the first one cancelled much.

Rows are kept as integers floor(64 c); all exact figures come from them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinefuse.llm.queries import llm_query, table
from kinefuse.llm.shipping import ship
from kinefuse.storage import write_and_read

SCALE = 64
COMPONENTS = 32
#: Entries beyond this take the nearest long that is within it, as longs must hold their sums.
LARGEST = 1 << 52
#: What is left of a vector, relative to the largest singular value, that counts as nothing.
NOTHING = 1e-11
#: Values of a run of rows that a task holds at once.
RUN_VALUES = 1 << 20


def integer_rows(embeddings: DataFrame, column: str = "embedding") -> DataFrame:
    """vec_id, y (array of long: floor(64 * entry)) of the rows that are used.

    Left out are null vectors and those with null or non-finite entries. Vectors must have one length;
    those of another than the most frequent one (of the longest among ties) are left out too, as are empty ones.
    """
    entries = F.col(column).cast("array<double>")
    sound = F.forall(entries, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    scaled = lambda c: F.floor(F.least(F.greatest(c * SCALE, F.lit(-float(LARGEST))), F.lit(float(LARGEST)))).cast("long")
    rows = embeddings.where(F.col(column).isNotNull() & (F.size(column) > 0) & sound).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(entries, scaled).alias("y"))
    rows = write_and_read(rows, "integer-rows")
    lengths = rows.groupBy(F.size("y").alias("n")).agg(F.count("*").alias("rows"))
    usual = lengths.agg(F.max(F.struct("rows", "n"))["n"]).first()[0]
    return rows.where(F.size("y") == (usual or 0))


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    lists = batch.column("y")
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        if batch.num_rows:
            width = max(1, len(batch.column("y").flatten()) // batch.num_rows)
            step = max(1, RUN_VALUES // width)
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                yield part, _matrix(part)


@dataclass(frozen=True)
class Fit:
    """Rows n and sums S by dimension of the fit list."""

    n: int
    sums: tuple[int, ...]

    def centred(self, y: np.ndarray) -> np.ndarray:
        """y - S/n, each rounded once to a double."""
        mean = np.array([np.longdouble(s // self.n) for s in self.sums])
        rest = np.array([np.longdouble(s % self.n) / self.n for s in self.sums])
        return ((y - mean.astype(np.int64)) - rest).astype(np.float64)

    def deviations(self, y: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n * y - S)**2, exact; null where a long cannot hold it."""
        reach = self.n * int(np.abs(y).max(initial=0)) + max(map(abs, self.sums))
        if reach**2 * y.shape[1] < 2**63:
            away = self.n * y - np.array(self.sums, np.int64)
            return (away * away).sum(axis=1).tolist()
        away = self.n * y.astype(object) - np.array(self.sums, object)
        found = (away * away).sum(axis=1).tolist()
        return [x if x < 2**63 else None for x in found]


def fit_list(rows: DataFrame) -> Fit:
    """Exact sums; a row a dimension comes to the driver."""
    ship(rows.sparkSession)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, y in _runs(batches):
            # A run has at most 2**20 values of 2**52 each: as two halves their sums stay within a long.
            high, low = y >> 26, y & ((1 << 26) - 1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(y.shape[1])), pa.array(high.sum(axis=0)), pa.array(low.sum(axis=0)), pa.array(np.full(y.shape[1], len(y)))], ["at", "high", "low", "n"]
            )

    exact = lambda name: F.sum(F.col(name).cast("decimal(38,0)")).alias(name)
    found = rows.select("y").mapInArrow(partial, "at long, high long, low long, n long").groupBy("at").agg(exact("high"), exact("low"), exact("n")).collect()
    found = sorted(found, key=lambda r: r.at)
    return Fit(int(found[0].n) if found else 0, tuple((int(r.high) << 26) + int(r.low) for r in found))


def summed(rows: DataFrame, width: int, partial) -> np.ndarray:
    """Sum over all rows of partial(centred-to-be integers), an array of `width` doubles; one row a task meets by place."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width)
        for _, y in _runs(batches):
            total += partial(y)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width)), pa.array(total)], ["at", "value"])

    out = np.zeros(width)
    for row in rows.select("y").mapInArrow(emit, "at long, value double").groupBy("at").agg(F.sum("value").alias("value")).collect():
        out[row.at] = row.value
    return out


@dataclass(frozen=True)
class Components:
    """vectors (dimensions by components), eigenvalues of the covariance, its trace."""

    vectors: np.ndarray
    eigenvalues: np.ndarray
    trace: float


def _small(basis: np.ndarray, products: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Singular value decomposition of U' X V, which is bidiagonal but for what a fresh start has in common with the vectors before."""
    return np.linalg.svd(np.triu(products.T @ basis))


def _start(v: np.ndarray, basis: np.ndarray) -> np.ndarray | None:
    """The part of v that is orthogonal to the basis, as a unit vector; nothing if the basis holds all of it."""
    for _ in range(3):
        v = v - basis @ (basis.T @ v)
    size = np.linalg.norm(v)
    return v / size if size > 1e-8 else None


def bidiagonalised(rows: DataFrame, fit: Fit, components: int = COMPONENTS) -> Components:
    """The leading right singular vectors of the centred rows, fewer if their rank is lower.

    Steps end when the space is used up, or when as many leading triplets as wanted have settled and stay
    the same for as many steps more from a fresh start, which finds further vectors of repeated values. Each
    step is one pass over the rows. What comes to the driver is a few numbers a dimension and step.
    """
    d = len(fit.sums)
    rng = np.random.default_rng(0)
    trace = float(summed(rows, 1, lambda y: np.array([(fit.centred(y) ** 2).sum()]))[0])
    if trace == 0:
        return Components(np.empty((d, 0)), np.empty(0), 0.0)
    basis, short, products = np.empty((d, 0)), np.empty((d, 0)), np.empty((d, 0))  # V, W with U = X W, X'U
    v, beta, settled = _start(rng.standard_normal(d), basis), 0.0, None

    def taken(w: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
        """Products of u = X w with the left vectors X held and with itself, and X'u."""
        k = held.shape[1]

        def partial(y: np.ndarray) -> np.ndarray:
            x = fit.centred(y)
            u = x @ w
            return np.concatenate(((x @ held).T @ u, [u @ u], x.T @ u))

        out = summed(rows, k + 1 + d, partial)
        return out[:k], float(out[k]), out[k + 1 :]

    while v is not None and basis.shape[1] < d:
        w = v - beta * short[:, -1] if beta else v
        for _ in range(3):
            along, square, z = taken(w, short)
            w, z = w - short @ along, z - products @ along
            left = square - along @ along
            if left > 0.25 * square or left <= NOTHING**2 * trace:
                break
        alpha = np.sqrt(max(left, 0.0))
        # A v in the null space has no left vector.
        scale = 1 / alpha if alpha > NOTHING * np.sqrt(trace) else 0.0
        basis, short, products = np.column_stack([basis, v]), np.column_stack([short, w * scale]), np.column_stack([products, z * scale])
        rest = products[:, -1]
        for _ in range(2):
            rest = rest - basis @ (basis.T @ rest)
        beta = float(np.linalg.norm(rest))
        left_vectors, values, _ = _small(basis, products)
        away = products @ left_vectors[:, :components]
        away = np.linalg.norm(away - basis @ (basis.T @ away), axis=0)
        done = len(values) >= components and (away <= 1e-15 * values[0]).all()
        if done and settled is not None and np.allclose(settled[1], values[:components], rtol=1e-13, atol=0):
            if len(values) >= settled[0] + components:
                break
        elif done:
            settled, beta = (len(values), values[:components]), 0.0
        if beta > NOTHING * values[0]:
            v = rest / beta
        else:
            v, beta = _start(rng.standard_normal(d), basis), 0.0
    _, values, right = _small(basis, products)
    keep = np.flatnonzero(values > NOTHING * values[0])[:components]
    vectors = basis @ right[keep].T
    return Components(vectors / np.linalg.norm(vectors, axis=0), values[keep] ** 2 / fit.n, trace / fit.n)


def identity_error(rows: DataFrame, fit: Fit, found: Components) -> float:
    """Largest entry of the covariance of the whitened rows minus the identity; their means are taken off first."""
    k = len(found.eigenvalues)
    if not k:
        return 0.0
    scaled = found.vectors / np.sqrt(found.eigenvalues)
    mean = summed(rows, k, lambda y: (fit.centred(y) @ scaled).sum(axis=0)) / fit.n

    def products(y: np.ndarray) -> np.ndarray:
        white = fit.centred(y) @ scaled - mean
        return (white.T @ white).ravel()

    return float(np.abs(summed(rows, k * k, products).reshape(k, k) / fit.n - np.eye(k)).max())


WHITENED = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(embeddings: DataFrame, components: int = COMPONENTS, column: str = "embedding") -> DataFrame:
    """A row for each used vector and component, see WHITENED; the model is fitted on all used vectors.

    For which vectors are used see `integer_rows`; repeated rows and ids count each, null ids as well. Components are numbered from 1 by
    falling variance; there are fewer than asked for where the rank is lower, and none without any spread,
    when there is no row. deviation is exact, and null where a long cannot hold it. Other columns are left out.
    """
    rows = integer_rows(embeddings, column)
    fit = fit_list(rows)
    if not fit.n:
        return rows.sparkSession.createDataFrame([], WHITENED)
    found = bidiagonalised(rows, fit, components)
    error, explained = identity_error(rows, fit, found), found.eigenvalues / (found.trace or 1.0)
    scaled = found.vectors / np.sqrt(found.eigenvalues)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = scaled.shape[1]
        for part, y in _runs(batches):
            count = len(y)
            ids = part.column("vec_id").take(pa.array(np.repeat(np.arange(count), k)))
            deviations = pa.array(fit.deviations(y), pa.int64()).take(pa.array(np.repeat(np.arange(count), k)))
            arrays = [ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), count)), pa.array(np.full(count * k, fit.n)), deviations]
            arrays += [pa.array((fit.centred(y) @ scaled).ravel()), pa.array(np.tile(explained, count)), pa.array(np.full(count * k, error))]
            yield pa.RecordBatch.from_arrays(arrays, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(emit, WHITENED)


@llm_query()
def op11_whitening(spark: SparkSession, folder: str) -> DataFrame:
    """All embeddings on their leading components."""
    return whiten(table(spark, folder, "embeddings"))
