"""Readers and writers: layer images, toolpath text, meshes, calibration profiles and settings."""

from __future__ import annotations

import copy
import json
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

from plyforge.functions import names
from plyforge.operators.layers import layer_images
from plyforge.operators.tables import written

from . import meshfiles


def read_layer_images(spark: SparkSession, directory: str, layer_height: float = 0.2) -> DataFrame:
    """(build_id, path, layer_number, z_height, image) of a folder's layer images, one a layer.

    Paths are chosen by their names in a listing that reads no content; the choice is a table, and the driver gets no
    path. Files of a folder with an image's ending are decoded where they are and meet the choice by a join, which Spark
    broadcasts while the listing is small. Files that don't decode are left out.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(directory).select(F.lit(directory).alias("build_id"), "path")
    chosen = written(layer_images(listed, layer_height))
    ending = "{" + ",".join("".join(f"[{c}{c.upper()}]" for c in e) for e in names.IMAGE_ENDINGS) + "}"
    decoded = spark.read.format("image").option("dropInvalid", True).option("pathGlobFilter", f"*.{ending}").load(directory)
    same = lambda c: F.regexp_replace(c, "^file:/+", "/")
    origin = F.url_decode(F.replace(F.col("image.origin"), F.lit("+"), F.lit("%2B")))  # the image source writes paths as URIs
    return chosen.withColumn("_k", same("path")).join(decoded.select(same(origin).alias("_k"), "image"), "_k").select("build_id", "path", "layer_number", "z_height", "image")


def read_programs(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, text): toolpath files' lines from 1 on, at LF, CRLF or CR. A missing path is an error."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.regexp_replace("value", r"(\r\n|\r|\n)$", "").alias("t"))
    lines = whole.select("file", F.posexplode(F.split("t", r"\r\n|\r|\n")).alias("i", "text"))
    return lines.select("file", (F.col("i") + 1).cast("long").alias("line_no"), "text")


# ---- meshes


def parse_mesh(name: str, data: bytes) -> np.ndarray:
    """A file's triangles (n, 3, 3), by its ending: stl (binary or text), obj, ply (text or binary)."""
    kind = name.rpartition(".")[2].lower()
    if kind == "stl":
        n = int.from_bytes(data[80:84], "little") if len(data) >= 84 else -1
        if len(data) == 84 + 50 * n:
            record = np.dtype([("normal", "<f4", 3), ("corners", "<f4", (3, 3)), ("flags", "<u2")])
            return np.frombuffer(data, record, n, 84)["corners"].astype(float)
        rows = [line.split()[1:4] for line in data.decode("utf-8", "replace").splitlines() if line.split()[:1] == ["vertex"]]
        return np.array(rows, float).reshape(-1, 3, 3)
    if kind == "obj":
        points, faces = [], []
        for line in data.decode("utf-8", "replace").splitlines():
            part = line.split()
            if part[:1] == ["v"]:
                points.append([float(x) for x in part[1:4]])
            elif part[:1] == ["f"]:
                at = [int(x.split("/")[0]) for x in part[1:]]
                at = [i - 1 if i > 0 else len(points) + i for i in at]
                faces += [(at[0], at[k], at[k + 1]) for k in range(1, len(at) - 1)]
        return np.array(points, float)[np.array(faces, int)].reshape(-1, 3, 3) if faces else np.empty((0, 3, 3))
    if kind == "ply":
        return parse_ply(data)
    raise ValueError(f"{name}: no mesh format that is known")


#: PLY's number types.
PLY_TYPES = {"char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "i2", "int16": "i2", "ushort": "u2", "uint16": "u2", "int": "i4", "int32": "i4", "uint": "u4", "uint32": "u4", "float": "f4", "float32": "f4", "double": "f8", "float64": "f8"}
#: PLY's formats and their byte orders.
PLY_ORDERS = {"ascii": "", "binary_little_endian": "<", "binary_big_endian": ">"}


def parse_ply(data: bytes) -> np.ndarray:
    head, _, body = data.partition(b"end_header")
    body = body.partition(b"\n")[2]
    lines = [line.split() for line in head.decode().splitlines()]
    style = next(line[1] for line in lines if line[:1] == ["format"])
    parts: list[tuple[str, int, list[list[str]]]] = []
    for line in lines:
        if line[:1] == ["element"]:
            parts.append((line[1], int(line[2]), []))
        elif line[:1] == ["property"]:
            parts[-1][2].append(line[1:])
    if style not in PLY_ORDERS:
        raise ValueError(f"PLY format {style}")
    words, at, points, faces = iter(body.split()) if style == "ascii" else None, 0, [], []

    def number(kind: str) -> float:
        nonlocal at
        if words is not None:
            return float(next(words))
        t = np.dtype(PLY_ORDERS[style] + PLY_TYPES[kind])
        at += t.itemsize
        return np.frombuffer(body, t, 1, at - t.itemsize)[0].item()

    for name, n, props in parts:
        for _ in range(n):
            row = {p[-1]: [int(number(p[2])) for _ in range(int(number(p[1])))] if p[0] == "list" else number(p[0]) for p in props}
            if name == "vertex":
                points.append([row["x"], row["y"], row["z"]])
            elif name == "face":
                i = row.get("vertex_indices", row.get("vertex_index"))
                faces += [(i[0], i[k], i[k + 1]) for k in range(1, len(i) - 1)]
    return np.array(points, float)[np.array(faces, int)].reshape(-1, 3, 3) if faces else np.empty((0, 3, 3))


CORNERS = meshfiles.CORNERS


def read_triangles(spark: SparkSession, path: str) -> DataFrame:
    """(mesh, fid, ax ... cz) of mesh files. One binary STL is read by ranges (see meshfiles); else each file is parsed by one task."""
    if path.lower().endswith(".stl") and meshfiles.stl_triangles(path) is not None:
        return meshfiles.read_stl(spark, path).select(F.lit(path).alias("mesh"), "fid", *CORNERS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, data in zip(batch["path"], batch["content"], strict=True):
                t = parse_mesh(name, data).reshape(-1, 9)
                out = pd.DataFrame(t, columns=CORNERS)
                out.insert(0, "mesh", name)
                out.insert(1, "fid", np.arange(len(t)))
                yield out

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "mesh string, fid long, " + ", ".join(f"{c} double" for c in CORNERS))


def indexed(triangles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vertices, faces) with equal corners merged: vid is a hash of the coordinates."""
    ids = {v: F.xxhash64(*[F.col(f"{v}{x}") for x in "xyz"]) for v in "abc"}
    faces = triangles.select("mesh", "fid", *[i.alias(v) for v, i in ids.items()])
    corners = F.explode(F.array(*[F.struct(i.alias("vid"), *[F.col(f"{v}{x}").alias(x) for x in "xyz"]) for v, i in ids.items()]))
    return triangles.select("mesh", corners.alias("c")).select("mesh", "c.*").distinct(), faces


def write_meshes(triangles: DataFrame, path: str, kind: str = "obj") -> None:
    """Text meshes below path, one folder a mesh: OBJ records or facets of STL.

    Every triangle becomes text by itself, so a mesh of any size is written by
    many tasks; part files of OBJ use relative indices and may be joined by cat.
    """
    if kind not in ("obj", "stl"):
        raise ValueError("meshes are written as obj or stl")
    corner = [F.concat_ws(" ", *[F.col(f"{v}{x}").cast("string") for x in "xyz"]) for v in "abc"]
    if kind == "obj":
        text = F.concat(*[F.concat(F.lit("v "), c, F.lit("\n")) for c in corner], F.lit("f -3 -2 -1"))
    else:
        text = F.concat(F.lit("facet normal 0 0 0\nouter loop\n"), *[F.concat(F.lit("vertex "), c, F.lit("\n")) for c in corner], F.lit("endloop\nendfacet"))
    triangles.select("mesh", text.alias("value")).write.partitionBy("mesh").text(path)


# ---- profiles and settings

PROFILE = StructType(
    [
        StructField("name", StringType()), StructField("scale_mm_per_pixel", DoubleType()), StructField("camera_matrix", ArrayType(ArrayType(DoubleType()))),
        StructField("dist_coeffs", ArrayType(DoubleType())), StructField("image_size", ArrayType(IntegerType())), StructField("origin_offset_px", ArrayType(DoubleType())),
        StructField("z_base", DoubleType()), StructField("notes", StringType()),
    ]
)


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    """Calibration profiles, one JSON file each."""
    return spark.read.schema(PROFILE).json(path, multiLine=True).select(PROFILE.names)


def write_profiles(profiles: DataFrame, path: str) -> None:
    """One JSON file a profile in the folder `path`, named like it; of profiles of one name any one.

    A profile is written aside and renamed into place, so that readers see the
    old or the new one, and the last save of a name wins. Others stay.
    """
    spark = profiles.sparkSession
    named = profiles.select(PROFILE.names).filter("name <> ''").dropDuplicates(["name"])
    aside = f"{path.rstrip('/')}/.saving-{uuid.uuid4().hex[:12]}"
    named.withColumn("profile", F.col("name")).repartition("profile").write.partitionBy("profile").json(aside)
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    at = hadoop.Path(aside)
    store = at.getFileSystem(conf)
    over = spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 1)
    over[0] = getattr(hadoop, "Options$Rename").OVERWRITE
    files = hadoop.FileContext.getFileContext(store.makeQualified(at).toUri(), conf)
    for folder in store.listStatus(at):
        if folder.isDirectory():
            name = folder.getPath().getName().removeprefix("profile=")  # as Spark escapes it
            for part in store.listStatus(folder.getPath()):
                if part.getPath().getName().startswith("part-"):
                    files.rename(store.makeQualified(part.getPath()), store.makeQualified(hadoop.Path(f"{path.rstrip('/')}/{name}.json")), over)
    store.delete(at, True)


def list_profiles(spark: SparkSession, path: str) -> DataFrame:
    """(name, scale_mm_per_pixel) of the profiles below path, by name."""
    return read_profiles(spark, path).select("name", "scale_mm_per_pixel").distinct().orderBy("name")


#: Settings that take part in results.
DEFAULTS = {"quality_score": {"weights": {"dimensional": 0.35, "layer": 0.25, "anomaly": 0.25, "completeness": 0.15}}, "default_tolerance_mm": 0.2, "default_layer_height_mm": 0.2}


def flat(settings: dict, above: str = "") -> dict:
    """Values by dotted name; an empty section is a value."""
    out = {}
    for k, v in settings.items():
        out |= flat(v, f"{above}{k}.") if isinstance(v, dict) and v else {f"{above}{k}": v}
    return out


def nested(values: dict) -> dict:
    """Sections of values by dotted name."""
    sections = {k.partition(".")[0]: {} for k in values}
    for k, v in values.items():
        section, _, rest = k.partition(".")
        if rest:
            sections[section][rest] = v
        else:
            sections[section] = copy.deepcopy(v)
    deep = {k.partition(".")[0] for k in values if "." in k}
    return {k: nested(v) if k in deep else v for k, v in sections.items()}


def set_values(values: dict, more: dict) -> dict:
    """values by dotted name with more's; what lies above or below a set name goes."""
    related = lambda a, b: a == b or a.startswith(f"{b}.") or b.startswith(f"{a}.")
    return {k: v for k, v in values.items() if not any(related(k, m) for m in more)} | more


def merged(base: dict, over: dict) -> dict:
    """A copy of base with over's values, nested ones by name."""
    return nested(set_values(flat(base), flat(over)))


def load_settings(path: str) -> dict:
    """Settings of a JSON file over the defaults; a missing or broken file gives the defaults."""
    try:
        with open(path, encoding="utf-8") as f:
            return merged(DEFAULTS, json.load(f))
    except (OSError, ValueError, AttributeError):  # AttributeError: JSON, but no section
        return copy.deepcopy(DEFAULTS)


def save_settings(path: str, settings: dict) -> None:
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        json.dump(settings, f, indent=2)


def setting(settings: dict, name: str, default=None):
    """A value, or a section, by its dotted name."""
    values = flat(settings)
    if name in values:
        return values[name]
    below = {k.removeprefix(f"{name}."): v for k, v in values.items() if k.startswith(f"{name}.")}
    return nested(below) if below else default


def with_setting(settings: dict, name: str, value) -> dict:
    """A copy with the value set at its dotted name; what is missing, or no section, on the way becomes one."""
    return nested(set_values(flat(settings), {name: value}))


#: A project's fields and what they are at first.
PROJECT = {"name": "", "images_dir": "", "stl_file": "", "gcode_file": "", "calibration_profile": "", "layer_height_mm": 0.2, "tolerance_mm": 0.2, "processed": False, "results": {}}


def load_project(folder: str, file: str = "project.json") -> dict:
    """A folder's project over the defaults; a missing or broken file gives these, named like the folder."""
    base = PROJECT | {"name": os.path.basename(os.path.abspath(folder))}
    try:
        with open(os.path.join(folder, file), encoding="utf-8") as f:
            return copy.deepcopy(base) | json.load(f)
    except (OSError, ValueError):
        return copy.deepcopy(base)


def save_project(folder: str, project: dict, file: str = "project.json") -> None:
    save_settings(os.path.join(folder, file), project)
