"""Large mesh files: binary STL read by ranges of triangles, and one STL or PLY file written in a stream."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

CORNERS = [f"{v}{x}" for v in "abc" for x in "xyz"]
#: A binary STL's head, and its record of a triangle.
HEAD, RECORD = 84, np.dtype([("normal", "<f4", 3), ("corners", "<f4", (3, 3)), ("flags", "<u2")])
STEP = 100_000  # triangles held at a time


def opened(path: str) -> tuple[fs.FileSystem, str]:
    if "://" not in path:
        path = "file://" + (path.removeprefix("file:") if path.startswith("file:") else os.path.abspath(path))
    return fs.FileSystem.from_uri(path)


def stl_triangles(path: str) -> int | None:
    """How many triangles a binary STL has; None for any other file."""
    store, name = opened(path)
    info = store.get_file_info(name)
    if not info.is_file or info.size < HEAD:
        return None
    with store.open_input_file(name) as source:
        n = int.from_bytes(source.read(HEAD)[80:], "little")
    return n if info.size == HEAD + RECORD.itemsize * n else None


class Triangles(InputPartition):
    def __init__(self, start: int, stop: int):
        self.start, self.stop = start, stop


class StlReader(DataSourceReader):
    def __init__(self, path: str, per_task: int):
        self.path, self.per_task = path, per_task

    def partitions(self) -> list[InputPartition]:
        n = stl_triangles(self.path)
        if n is None:
            raise ValueError(f"{self.path} is no binary STL file")
        return [Triangles(k, min(k + self.per_task, n)) for k in range(0, n, self.per_task)] or [Triangles(0, 0)]

    def read(self, partition: Triangles) -> Iterator[pa.RecordBatch]:
        store, name = opened(self.path)
        with store.open_input_file(name) as source:
            source.seek(HEAD + RECORD.itemsize * partition.start)
            for k in range(partition.start, partition.stop, STEP):
                n = min(STEP, partition.stop - k)
                t = np.frombuffer(source.read(RECORD.itemsize * n), RECORD, n)["corners"].astype(float).reshape(n, 9)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(k, k + n)), *[pa.array(np.ascontiguousarray(c)) for c in t.T]], ["fid", *CORNERS])


class StlFile(DataSource):
    """spark.read.format("stl_file").load(path): (fid, ax ... cz) of one binary STL, `per_task` triangles a task."""

    @classmethod
    def name(cls) -> str:
        return "stl_file"

    def schema(self) -> str:
        return "fid long, " + ", ".join(f"{c} double" for c in CORNERS)

    def reader(self, schema) -> StlReader:
        return StlReader(self.options["path"], int(self.options.get("per_task", 1_000_000)))


def read_stl(spark: SparkSession, path: str, per_task: int = 1_000_000) -> DataFrame:
    """(fid, ax ... cz) of a binary STL of any size, in its order; an empty one has no rows, another file is an error."""
    spark.dataSource.register(StlFile)
    return spark.read.format("stl_file").option("per_task", per_task).load(path)


def head_of(kind: str, n: int) -> bytes:
    if kind == "stl":
        return bytes(80) + n.to_bytes(4, "little")
    order = "big" if kind == "ply_big" else "little"
    return f"ply\nformat binary_{order}_endian 1.0\nelement vertex {3 * n}\nproperty double x\nproperty double y\nproperty double z\nelement face {n}\nproperty list uchar int vertex_indices\nend_header\n".encode()


def write_mesh(triangles: DataFrame, path: str, kind: str = "stl") -> int:
    """Write (fid, ax ... cz) as one file, in the order of fid, and return the number of triangles.

    kind: stl (binary, single precision), ply or ply_big (binary, double precision, three vertices a triangle). Triangles with a
    null coordinate are left out. One task writes, as one file is one stream; it holds STEP triangles at most. The
    file is moved into place when it is whole.
    """
    if kind not in ("stl", "ply", "ply_big"):
        raise ValueError("meshes are written as stl, ply or ply_big")
    rows = triangles.select("fid", *CORNERS).dropna(subset=CORNERS)
    n = rows.count()
    if n >= 1 << 32:
        raise ValueError(f"{n} triangles don't fit in one file")
    if not n:  # Spark runs no task for no rows
        store, name = opened(path)
        store.create_dir(name.rpartition("/")[0], recursive=True)
        with store.open_output_stream(name, compression=None) as out:
            out.write(head_of(kind, 0))
        return 0
    order = ">" if kind == "ply_big" else "<"
    face = np.dtype([("n", "u1"), ("at", f"{order}i4", 3)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, name = opened(path)
        store.create_dir(name.rpartition("/")[0], recursive=True)
        part = f"{name}.{uuid.uuid4().hex[:8]}.part"
        with store.open_output_stream(part, compression=None) as out:
            out.write(head_of(kind, n))
            for batch in batches:
                t = np.stack([batch.column(i + 1).to_numpy() for i in range(9)], axis=1)
                if kind == "stl":
                    record = np.zeros(len(t), RECORD)
                    a, b, c = (t[:, k : k + 3] for k in (0, 3, 6))
                    normal = np.cross(b - a, c - a)
                    size = np.linalg.norm(normal, axis=1, keepdims=True)
                    record["corners"], record["normal"] = t.reshape(-1, 3, 3), normal / np.where(size > 0, size, 1)
                    out.write(record.tobytes())
                else:
                    out.write(t.astype(f"{order}f8").tobytes())
            for k in range(0, n if kind != "stl" else 0, STEP):
                record = np.zeros(min(STEP, n - k), face)
                record["n"], record["at"] = 3, 3 * k + np.arange(3 * len(record)).reshape(-1, 3)
                out.write(record.tobytes())
        store.move(part, name)
        yield pa.RecordBatch.from_arrays([pa.array([n])], ["n"])

    rows.repartition(1).sortWithinPartitions("fid").mapInArrow(run, "n long").collect()
    return n
