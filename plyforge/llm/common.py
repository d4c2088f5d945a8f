"""What the corpus operators share: scratch space, files by URI, text buffers."""

from __future__ import annotations

import ctypes
import gc
import os
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from plyforge.operators.tables import shared_folder


def scratch(spark: SparkSession, name: str) -> str:
    """A new, unused path for one run's files below the shared folder."""
    return f"{shared_folder(spark)}/plyforge/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it again.

    It cuts the lineage: a lost executor costs nothing that was written.
    """
    path = path or scratch(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def batches_of(spark: SparkSession, rows: int = 2000) -> Iterator[None]:
    """Within it, Spark hands texts to Python in batches of so many rows (its default of 10,000 may be a lot of text)."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def frugal(f: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """f for mapInArrow, handing its task's free memory back to the system: workers live on for other tasks, and what they keep adds up."""

    def run(batches: Iterator) -> Iterator:
        try:
            yield from f(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc has it
                trim(0)

    return run


def open_fs(uri: str) -> tuple[fs.FileSystem, str]:
    if "://" not in uri:
        uri = "file://" + (uri.removeprefix("file:") if uri.startswith("file:") else os.path.abspath(uri))
    return fs.FileSystem.from_uri(uri)


class FileStream:
    """Write byte pieces under a temporary name; close() moves the file into place.

    Tasks that run twice write the same bytes; the last move wins.
    """

    def __init__(self, uri: str):
        self.store, self.path = open_fs(uri)
        self.store.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.part = f"{self.path}.{uuid.uuid4().hex[:8]}.part"
        self.out = self.store.open_output_stream(self.part, compression=None)

    def write(self, x) -> int:
        x = memoryview(x).cast("B") if not isinstance(x, bytes) else x
        self.out.write(x)
        return len(x)

    def close(self) -> None:
        self.out.close()
        self.store.move(self.part, self.path)


def write_file(uri: str, parts) -> int:
    """A file of byte pieces, and its size."""
    out = FileStream(uri)
    size = sum(out.write(x) for x in parts)
    out.close()
    return size


def map_file(uri: str, dtype) -> np.ndarray:
    """A read-only memory map of a file of equal items.

    Maps need a shared folder that is mounted (file://); a file of another
    store is held in memory instead.
    """
    store, path = open_fs(uri)
    if isinstance(store, fs.LocalFileSystem):
        return np.memmap(path, dtype=dtype, mode="r") if os.path.getsize(path) else np.empty(0, dtype)
    with store.open_input_stream(path, compression=None) as source:
        return np.frombuffer(source.read(), dtype)


def read_range(uri: str, start: int, length: int) -> bytes:
    store, path = open_fs(uri)
    with store.open_input_file(path) as source:
        source.seek(start)
        return source.read(length)


def text_column(batch: pa.RecordBatch, name: str = "text") -> pa.Array:
    """The column with nulls as empty texts."""
    col = batch.column(batch.schema.get_field_index(name))
    return pc.fill_null(col, "")


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string array's UTF-8 bytes, and its n + 1 offsets into them (no copy)."""
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, at, data = texts.buffers()
    ends = np.frombuffer(at, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return whole[ends[0] : ends[-1]], ends - ends[0]


def runs(texts: pa.Array, most_bytes: int = 3 << 20) -> list[tuple[int, int]]:
    """Ranges (from, to) that cut an array into runs of about most_bytes; a longer text is its own run."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    out, k = [], 0
    while k < len(ends):
        stop = max(k + 1, int(np.searchsorted(ends, (ends[k - 1] if k else 0) + most_bytes, side="right")))
        out.append((k, stop))
        k = stop
    return out


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Runs of bytes outside 0x20 and 0x09-0x0D, and n + 1 offsets of each text's words."""
    lists = pc.ascii_split_whitespace(texts)
    words = lists.flatten()
    ends = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]).astype(np.int64)
    full = pc.not_equal(words, "")
    if not pc.all(full).as_py():  # leading or trailing white space leaves empty pieces
        kept = full.to_numpy(zero_copy_only=False)
        ends = np.concatenate([[0], np.cumsum(kept)])[ends]
        words = words.filter(full)
    return words, ends


def gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions start, start + 1, ... of each run, one run after another."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + lengths, lengths)


def small(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    """A DataFrame of few rows that the driver has."""
    return spark.createDataFrame(rows, schema)


def join_by_key(rows: DataFrame, about: DataFrame, key: str, n: str, total: int, least: int = 1000, most_hot: int = 50_000) -> DataFrame:
    """rows joined to about (one row a key, with the number n of the key's rows; n goes) without a task that one key fills.

    Keys of over max(least, total / most_hot) rows are hot. As no more than
    most_hot keys can be, their part of `about` is broadcast and their rows
    stay where they are; only the rows of other keys are shuffled.
    """
    bound = max(least, total // most_hot)
    hot, cold = about.filter(F.col(n) > bound).drop(n), about.filter(F.col(n) <= bound).drop(n)
    here = rows.join(F.broadcast(hot), key)
    return here.unionByName(rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key))
