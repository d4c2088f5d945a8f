"""Hilbert-curve ordering: several metadata dimensions, one order, equal runs.

Each dimension is quantised to cells of about equally many rows, the cells'
Hilbert index gives the order, and runs of it become the shards. Rows close in
all dimensions lie in the same shard, so its minima and maxima are narrow in
every dimension and a reader skips most files for a filter on any of them.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .common import materialize, small


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert index of the rows of cells (n x d, each under 2 ** bits), by Skilling's transform."""
    x = cells.T.astype(np.int64).copy()
    d = len(x)
    for b in range(bits - 1, 0, -1):
        q, low = 1 << b, (1 << b) - 1
        for i in range(d):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(high, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
    for i in range(1, d):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        turn = np.where(x[d - 1] & (1 << b), turn ^ ((1 << b) - 1), turn)
    x ^= turn
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


def text_rank(col: Column) -> Column:
    """A number that orders strings by their first six bytes."""
    head = F.rpad(F.substring(F.hex(F.encode(F.substring(col, 1, 6), "UTF-8")), 1, 12), 12, "0")
    return F.conv(head, 16, 10).cast("double")


def with_hilbert(df: DataFrame, dims: dict[str, Column], bits: int = 5, out: str = "hilbert", accuracy: int = 1000) -> DataFrame:
    """Add the Hilbert index of numeric dimensions.

    A dimension's cells are cut at its approximate quantiles over all rows
    (2 ** bits - 1 numbers reach the driver, whatever the input's size). A null
    falls into cell 0. bits * len(dims) must be under 63.
    """
    if bits * len(dims) > 62:
        raise ValueError("bits * dimensions must be at most 62")
    parts = [i / (1 << bits) for i in range(1, 1 << bits)]
    cuts = df.agg(*[F.percentile_approx(c.cast("double"), parts, accuracy).alias(n) for n, c in dims.items()]).first()
    cuts = [np.sort(np.array(cuts[n] or [], float)) for n in dims]  # a value that fills several shares spans their cells, so few values still use the upper bits

    @F.pandas_udf("long")
    def index(parts: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for x in parts:
            cells = np.stack([np.searchsorted(cut, x.iloc[:, i].to_numpy(float, na_value=-np.inf), side="right") if len(cut) else np.zeros(len(x), int) for i, cut in enumerate(cuts)], axis=1)
            yield pd.Series(hilbert_index(cells, bits))

    return df.withColumn(out, index(F.struct(*[c.cast("double").alias(f"d{i}") for i, c in enumerate(dims.values())])))


def positions(df: DataFrame, order: list[str], parts: int) -> tuple[DataFrame, int]:
    """Add `position`, the rank from 0 of each row in a total order, and count the rows.

    Rows are dealt by range and sorted within their partitions; only the row
    count of each partition comes to the driver.
    """
    m, p, i, begin = (f"_{uuid.uuid4().hex}" for _ in range(4))  # names that no input has
    ranged = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    table = materialize(ranged.withColumn(m, F.monotonically_increasing_id()), "ranked")
    table = table.withColumn(p, F.shiftright(m, 33)).withColumn(i, F.col(m).bitwiseAND((1 << 33) - 1))
    counts = sorted((r[0], r[1]) for r in table.groupBy(p).count().collect())
    starts, total = [], 0
    for number, n in counts:
        starts.append((number, total))
        total += n
    begins = small(df.sparkSession, starts, f"{p} long, {begin} long")
    return table.join(F.broadcast(begins), p).withColumn("position", F.col(begin) + F.col(i)).drop(m, p, i, begin), total


def hilbert_shards(df: DataFrame, dims: dict[str, Column], key: str, shards: int = 8, bits: int = 5, parts: int | None = None) -> DataFrame:
    """Add hilbert, shard and slot: the order along the curve cut into runs of equal row counts.

    Counts of two shards differ by one row at most, so no group of equal rows,
    however large, makes a shard larger than the others: it continues in the
    next one. Rows of equal index are ordered by a hash of all columns and the
    key; rows equal in all columns are interchangeable. An empty table gives an
    empty result; null keys sort first. Columns of the input named hilbert,
    shard, slot or position are replaced; all others stay.
    """
    df = df.drop("hilbert", "shard", "slot", "position")
    parts = parts or max(df.rdd.getNumPartitions(), 1)
    tie, row = (f"_{uuid.uuid4().hex}" for _ in range(2))
    tied = with_hilbert(df, dims, bits).withColumn(tie, F.xxhash64(*df.columns)).withColumn(row, F.monotonically_increasing_id())
    placed, n = positions(tied, ["hilbert", tie, key, row], parts)
    shard = F.expr(f"int(position * {shards} div {max(n, 1)})")
    first = F.expr(f"(shard * {max(n, 1)}L + {shards - 1}) div {shards}")
    return placed.withColumn("shard", shard).withColumn("slot", F.col("position") - first).drop("position", tie, row)


def write_shards(df: DataFrame, path: str, shards: int = 8) -> None:
    """Write rows that carry shard and slot as one ordered Parquet file for each shard."""
    df.repartitionById(shards, F.col("shard").cast("int")).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def shard_bounds(df: DataFrame, columns: list[str]) -> DataFrame:
    """Each shard's row count and minimum and maximum of the given columns, for pruning."""
    return df.groupBy("shard").agg(F.count("*").alias("n_rows"), *[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("min", F.min), ("max", F.max))])
