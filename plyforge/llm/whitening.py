"""Whitening of embeddings by matrix-free block subspace iteration.

The covariance matrix is never formed. One Spark pass over the centred rows
gives its product with a block of columns, Xᵀ(XQ): tasks send sums of so many
numbers as the block has, Spark adds them up, and only the block reaches the
driver. There, QR keeps the basis orthonormal and Rayleigh-Ritz finds the best
components inside it; the next block is what the residuals add to the basis. It
ends when a pass over the rows shows that the residuals of all components are
as small as rounding leaves them.

Entries are whole numbers, floor(64 c) + 1,000,000. Their sums are exact, and a
row is centred as (n x - S) / n, so that nothing is lost to the large offset.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

SCALE, OFFSET = 64, 1_000_000
ROWS = 2000  # rows multiplied at a time


def usable(vector: Column) -> Column:
    """Whether a vector is there and holds finite numbers alone."""
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False))


def whole_rows(table: DataFrame, key: str, vector: str) -> tuple[DataFrame, int]:
    """(key, x) of the usable rows of the width that most of them have (the smaller on ties), and that width."""
    rows = table.select(F.col(f"`{key}`").alias("key"), F.col(f"`{vector}`").cast("array<double>").alias("v")).filter(usable(F.col("v")))
    widths = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"))
    common = widths.filter("d > 0").orderBy(F.desc("n"), "d").limit(1).collect()  # one row
    d = common[0].d if common else 0
    x = F.transform("v", lambda c: F.floor(SCALE * c) + OFFSET)
    return rows.filter(F.size("v") == d).select("key", x.alias("x")), d


def matrix(batch: pa.RecordBatch, d: int) -> np.ndarray:
    column = batch.column(batch.schema.get_field_index("x"))
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(batch), d)


@dataclass
class Totals:
    """What the first pass tells of the fit list: rows, sums and extremes by dimension."""

    n: int
    sums: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n x - S, exact."""
        return self.n * x - self.sums

    def fits(self) -> bool:
        """Whether every row's sum of squares is sure to fit in 64 bits."""
        most = [max(abs(self.n * int(a) - int(s)), abs(self.n * int(b) - int(s))) for a, b, s in zip(self.low, self.high, self.sums, strict=True)]
        return sum(m * m for m in most) < 1 << 63


def totals(rows: DataFrame, d: int) -> Totals:
    """Exact; d rows reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, low, high = 0, np.zeros(d, np.int64), np.full(d, np.iinfo(np.int64).max), np.full(d, np.iinfo(np.int64).min)
        for batch in batches:
            if len(batch):
                x = matrix(batch, d)
                n, sums, low, high = n + len(x), sums + x.sum(axis=0), np.minimum(low, x.min(axis=0)), np.maximum(high, x.max(axis=0))
        if n:
            yield pa.RecordBatch.from_pydict({"i": np.arange(d), "n": np.full(d, n), "s": sums, "low": low, "high": high})

    parts = rows.select("x").mapInArrow(run, "i long, n long, s long, low long, high long")
    got = sorted(parts.groupBy("i").agg(F.sum("n"), F.sum("s"), F.min("low"), F.max("high")).collect())
    n = got[0][1] if got else 0
    return Totals(n, *(np.array([r[k] for r in got], np.int64) for k in (2, 3, 4)))


def covariance_times(rows: DataFrame, about: Totals, block: np.ndarray) -> np.ndarray:
    """The covariance times a block of columns, Xᵀ(XQ) / n of the centred rows: one pass, d times the block's columns numbers to the driver."""
    d, b = block.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((d, b))
        for batch in batches:
            for k in range(0, len(batch), ROWS):
                x = about.centred(matrix(batch.slice(k, ROWS), d)) / about.n
                out += x.T @ (x @ block)
        yield pa.RecordBatch.from_pydict({"at": np.arange(d * b), "v": out.ravel()})

    sums = rows.select("x").mapInArrow(run, "at long, v double").groupBy("at").agg(F.sum("v").alias("v"))
    got = sums.toPandas().sort_values("at")
    return got["v"].to_numpy().reshape(d, b) / about.n


@dataclass
class Whitening:
    """Components as columns, falling eigenvalues, the trace, and what was measured of both."""

    about: Totals
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    residual: float
    identity_error: float
    passes: int


def beyond(basis: np.ndarray, block: np.ndarray) -> np.ndarray:
    """Orthonormal columns that span what block adds to the basis; none where it adds nothing but rounding."""
    size = np.linalg.norm(block, axis=0)
    block = block[:, size > 0] / size[size > 0]
    for _ in range(2):  # once more, for what rounding left
        block = block - basis @ (basis.T @ block)
    if not block.shape[1]:
        return block
    u, s, _ = np.linalg.svd(block, full_matrices=False)
    u = u[:, s > 1e-10]
    u = u - basis @ (basis.T @ u)
    return np.linalg.qr(u)[0] if u.shape[1] else u


def rayleigh_ritz(u: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Falling Ritz values of an orthonormal basis u with images w = V u, the Ritz vectors and their images."""
    h = u.T @ w
    values, turn = np.linalg.eigh((h + h.T) / 2)
    return values[::-1], u @ turn[:, ::-1], w @ turn[:, ::-1]


def residuals(values: np.ndarray, u: np.ndarray, w: np.ndarray) -> np.ndarray:
    return np.linalg.norm(w - u * values, axis=0)


def measured(rows: DataFrame, about: Totals, values: np.ndarray, vectors: np.ndarray, images: np.ndarray, residual: float, passes: int) -> Whitening:
    """The certified components with the trace, and how far the covariance of the whitened rows is from the identity."""
    sure = values > len(vectors) * np.finfo(float).eps * values[0]
    h = vectors[:, sure].T @ images[:, sure]  # the covariance of the projections, as the last pass found it
    error = np.abs(h / np.sqrt(np.outer(values[sure], values[sure])) - np.eye(int(sure.sum())))
    trace = float(variances(rows, about).sum())
    return Whitening(about, vectors, np.where(sure, values, 0.0), trace, residual, float(error.max()) if error.size else 0.0, passes)


def fit(rows: DataFrame, d: int, components: int = 32, block: int = 64, basis: int = 256, tolerance: float = 1e-14, most_passes: int = 200, seed: int = 7) -> Whitening | None:
    """The leading components of rows (whole_rows); None without rows.

    block columns are multiplied in a pass, basis is how many the driver keeps
    before it starts again from the best; both are cut to d. A component is
    certified when |V q - e q| is at most tolerance * sqrt(d) * e_1, as measured
    by a pass over the rows with the component itself. Where most_passes don't
    certify all, it is an error. Components of equal eigenvalues are any
    orthonormal ones of their space.
    """
    about = totals(rows, d)
    if not about.n:
        return None
    k, b = min(components, d), min(max(block, components), d)
    rng = np.random.default_rng(seed)
    new = np.linalg.qr(rng.standard_normal((d, b)))[0]
    u, w, passes = np.zeros((d, 0)), np.zeros((d, 0)), 0
    while passes < most_passes:
        if new.shape[1]:
            u, w, passes = np.concatenate([u, new], axis=1), np.concatenate([w, covariance_times(rows, about, new)], axis=1), passes + 1
        values, u, w = rayleigh_ritz(u, w)
        bound = tolerance * np.sqrt(d) * max(values[0], np.finfo(float).tiny)
        if (residuals(values, u, w)[:k] <= bound).all() or u.shape[1] == d:
            u = np.linalg.qr(u[:, : max(k, b)])[0]
            values, u, w = rayleigh_ritz(u, covariance_times(rows, about, u))
            passes += 1
            most = float(residuals(values, u, w)[:k].max())
            if most <= bound:
                return measured(rows, about, values[:k], u[:, :k], w[:, :k], most, passes)
        if u.shape[1] + b > max(basis, 2 * b):
            values, u, w = values[: max(k, b)], u[:, : max(k, b)], w[:, : max(k, b)]
        new = beyond(u, (w - u * values)[:, :b])
        if not new.shape[1] and u.shape[1] < d:  # the basis holds an invariant space
            new = beyond(u, rng.standard_normal((d, b)))
    raise RuntimeError(f"{k} components were not certified in {most_passes} passes")


def variances(rows: DataFrame, about: Totals) -> np.ndarray:
    """Each dimension's variance: the covariance's diagonal, of which the trace is the sum."""
    d = len(about.sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(d)
        for batch in batches:
            for k in range(0, len(batch), ROWS):
                x = about.centred(matrix(batch.slice(k, ROWS), d)) / about.n
                out += (x * x).sum(axis=0)
        yield pa.RecordBatch.from_pydict({"i": np.arange(d), "v": out})

    got = rows.select("x").mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).toPandas().sort_values("i")
    return got["v"].to_numpy() / about.n


def whiten(table: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = 32, **more) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error): one row for each usable row and component.

    Rows whose vector is null, empty or holds a null or a number that is not
    finite have no rows, nor have those of another width than most vectors;
    none of these takes part in the fit. Keys may be null or repeat: every row
    counts and gives its own rows. deviation, the exact sum of (n x - S)², is a
    long, or decimal(38,0) where it may not fit. A component without variance
    (a constant or dependent dimension) has a null `whitened`, an `explained` of
    0 and no part in identity_error. An empty table gives no rows. Other columns
    of the table, whatever their names, take no part. more: see fit().
    """
    kind = table.schema[key].dataType.simpleString()
    rows, d = whole_rows(table, key, vector)
    model = fit(rows, d, components, **more) if d else None
    exact = model.about.fits() if model else True
    schema = f"key {kind}, component int, n long, deviation {'long' if exact else 'decimal(38,0)'}, whitened double, explained double, identity_error double"
    if model is None:
        return table.sparkSession.createDataFrame([], schema).withColumnRenamed("key", key)
    about, k = model.about, len(model.values)
    sure = model.values > 0
    turn = model.vectors[:, sure] / np.sqrt(model.values[sure])
    share = model.values / model.trace if model.trace > 0 else np.zeros(k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), ROWS):
                batch = whole.slice(at, ROWS)
                x, m = about.centred(matrix(batch, d)), len(batch)
                out, known = np.zeros((m, k)), np.broadcast_to(sure, (m, k))
                out[:, sure] = (x / about.n) @ turn
                squares = (x * x).sum(axis=1) if exact else (x.astype(object) ** 2).sum(axis=1)
                each = np.repeat(np.arange(m), k)
                column = batch.column(batch.schema.get_field_index("key"))
                yield pa.RecordBatch.from_arrays(
                    [
                        column.take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, about.n)),
                        pa.array(squares).take(pa.array(each)) if exact else pa.array(squares.tolist(), pa.decimal128(38, 0)).take(pa.array(each)),
                        pa.array(out.ravel(), mask=~known.ravel()), pa.array(np.tile(share, m)), pa.array(np.full(m * k, model.identity_error)),
                    ],
                    ["key", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.mapInArrow(run, schema).withColumnRenamed("key", key)
