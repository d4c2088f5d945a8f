"""Layer, polygon, pixel, voxel and toolpath tables derived from the driver's tables, and the same in SQL."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from plyforge.operators import chessboard
from plyforge.operators.tables import dealt

LINES, VOLUMES = 200_000, 1_000  # rows of a partition: program lines, and embeddings, of which each becomes some 600 edges of a mesh


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A build is a user and a layer a day of their events."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("build_id"), (F.dayofmonth("ts") - 1).alias("layer_idx"), "value", F.hour("ts").alias("h"))
    return e.groupBy("build_id", "layer_idx").agg(
        (F.first("layer_idx") * F.lit(2.0) / F.lit(10.0)).alias("z"), F.round(F.sum("value"), 6).alias("area"), F.count("*").cast("double").alias("perimeter"),
        F.round(F.avg("value"), 6).alias("cx"), F.round(F.avg("h"), 6).alias("cy"), F.count("*").alias("n_points"),
    )


LAYERS = """layers AS (SELECT user_id AS build_id, CAST(day(ts) - 1 AS INTEGER) AS layer_idx, (day(ts) - 1) * CAST(2.0 AS DOUBLE) / CAST(10.0 AS DOUBLE) AS z,
    round(sum(value), 6) AS area, CAST(count(*) AS DOUBLE) AS perimeter, round(avg(value), 6) AS cx, round(avg(CAST(hour(ts) AS DOUBLE)), 6) AS cy, count(*) AS n_points
    FROM events GROUP BY user_id, day(ts))"""


def polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An embedding as the 32 corners of a polygon."""
    e = F.col("embedding")
    points = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda k: F.struct(F.get(e, k * 2).cast("double").alias("x"), F.get(e, k * 2 + 1).cast("double").alias("y")))
    return table(spark, sf_dir, "embeddings").select("vec_id", points.alias("points"))


POINTS = """points AS (SELECT vec_id, k, CAST(embedding[2 * k + 1] AS DOUBLE) AS x, CAST(embedding[2 * k + 2] AS DOUBLE) AS y FROM embeddings CROSS JOIN range(32) AS r(k))"""


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An embedding as an image of 8 x 8 grey levels."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image"), F.posexplode("embedding").alias("i", "e"))
    return e.select("image", F.expr("cast(i div 8 as int)").alias("y"), (F.col("i") % 8).alias("x"), grey_level(F.col("e")).alias("v"))


PIXELS = """pixels AS (SELECT vec_id AS image, CAST(i // 8 AS INTEGER) AS y, CAST(i % 8 AS INTEGER) AS x,
    CAST(floor((least(greatest(CAST(embedding[i + 1] AS DOUBLE), CAST(-0.55 AS DOUBLE)), CAST(0.55 AS DOUBLE)) + CAST(0.55 AS DOUBLE)) * CAST(231.0 AS DOUBLE)) AS INTEGER) AS v
    FROM embeddings CROSS JOIN range(64) AS r(i))"""


def grey_level(e: Column) -> Column:
    return F.floor((F.least(F.greatest(e.cast("double"), F.lit(-0.55)), F.lit(0.55)) + 0.55) * 231.0).cast("int")


def voxels(spark: SparkSession, sf_dir: str, level: bool = False) -> DataFrame:
    """An embedding as a volume of 4 x 4 x 4 voxels: `inside` where an entry is over 0, or its grey level as v. What follows by volume stays in the partitions dealt here."""
    e = dealt(table(spark, sf_dir, "embeddings"), VOLUMES, "vec_id").select(F.col("vec_id").alias("volume"), F.posexplode("embedding").alias("i", "e"))
    own = grey_level(F.col("e")).alias("v") if level else (F.col("e") > 0).alias("inside")
    return e.select("volume", F.expr("cast(i div 16 as int)").alias("z"), F.expr("cast(i div 4 % 4 as int)").alias("y"), (F.col("i") % 4).alias("x"), own)


GREY = """grey AS (SELECT vec_id AS volume, CAST(i // 16 AS INTEGER) AS z, CAST(i // 4 % 4 AS INTEGER) AS y, CAST(i % 4 AS INTEGER) AS x,
    CAST(floor((least(greatest(CAST(embedding[i + 1] AS DOUBLE), CAST(-0.55 AS DOUBLE)), CAST(0.55 AS DOUBLE)) + CAST(0.55 AS DOUBLE)) * CAST(231.0 AS DOUBLE)) AS INTEGER) AS v FROM embeddings CROSS JOIN range(64) AS r(i))"""
VOXELS = """voxels AS (SELECT vec_id AS volume, CAST(i // 16 AS INTEGER) AS z, CAST(i // 4 % 4 AS INTEGER) AS y, CAST(i % 4 AS INTEGER) AS x, embedding[i + 1] > 0 AS inside FROM embeddings CROSS JOIN range(64) AS r(i))"""

#: The camera of board_corners: fx fy cx cy k1 k2 p1 p2 k3.
CAMERA = (620.0, 600.0, 322.0, 235.0, -0.12, 0.05, 0.0, 0.0, 0.0)


def board_corners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, idx, x, y): where a camera sees the 7 x 5 corners of a board that the embedding's first six entries turn and shift."""
    plane = chessboard.board(7, 5, 20.0)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for k in range(0, len(whole), 1000):
                b = whole.iloc[k : k + 1000]
                e = np.clip(np.stack([np.asarray(x[:6], float) for x in b["embedding"]]), -0.55, 0.55)
                seen = chessboard.project(np.array(CAMERA), np.concatenate([e[:, :3], np.array([-60.0, -40.0, 330.0]) + 60 * e[:, 3:]], axis=1), plane)
                yield pd.DataFrame({"vec_id": b["vec_id"].repeat(len(plane)).to_numpy(), "idx": np.tile(np.arange(len(plane), dtype=np.int32), len(b)), "x": seen[..., 0].ravel(), "y": seen[..., 1].ravel()})

    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding").mapInPandas(run, "vec_id long, idx int, x double, y double")


ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate", "l_returnflag", "l_linestatus"]


def programs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toolpath program a supplier: a line for each of their order lines. What follows by file stays in the partitions dealt here."""
    li = dealt(table(spark, sf_dir, "lineitem"), LINES, "l_suppkey")
    q, n = F.col("l_quantity").cast("int").cast("string"), F.col("l_linenumber").cast("string")
    kind = F.col("l_partkey") % 8
    text = (
        F.when(kind == 0, F.lit("G90 ; absolute")).when(kind == 1, F.lit("G91")).when(kind == 2, F.concat(F.lit("G1 Z"), q, F.lit(".25 F300")))
        .when(kind == 3, F.concat(F.lit("g0 X"), n, F.lit(" Z0."), q)).when(kind == 4, F.lit("; remark")).when(kind == 5, F.concat(F.lit("M104 S"), q))
        .otherwise(F.concat(F.lit("G1 X"), q, F.lit(".5 Y-"), n, F.lit(" E.5 X"), n, F.lit(" ;x")))
    )
    w = Window.partitionBy("l_suppkey").orderBy(*ORDER)
    return li.select(F.col("l_suppkey").alias("file"), F.row_number().over(w).cast("long").alias("line_no"), text.alias("text"))


PROGRAMS = f"""programs AS (SELECT l_suppkey AS file, row_number() OVER (PARTITION BY l_suppkey ORDER BY {", ".join(ORDER)}) AS line_no,
    CASE l_partkey % 8 WHEN 0 THEN 'G90 ; absolute' WHEN 1 THEN 'G91' WHEN 2 THEN 'G1 Z' || CAST(l_quantity AS INTEGER) || '.25 F300'
    WHEN 3 THEN 'g0 X' || l_linenumber || ' Z0.' || CAST(l_quantity AS INTEGER) WHEN 4 THEN '; remark' WHEN 5 THEN 'M104 S' || CAST(l_quantity AS INTEGER)
    ELSE 'G1 X' || CAST(l_quantity AS INTEGER) || '.5 Y-' || l_linenumber || ' E.5 X' || l_linenumber || ' ;x' END AS text FROM lineitem)"""
_params = ", ".join(f"CASE WHEN is_move THEN CAST(list_last(regexp_extract_all(upper(t), '{a}\\s*([-+]?\\d*\\.?\\d+)', 1)) AS DOUBLE) END AS {a.lower()}" for a in "XYZEF")
_moves = "coalesce(TRY_CAST(nullif(regexp_extract(t, '^[Gg]\\s*(\\d+)', 1), '') AS INTEGER) IN (0, 1), false)"
COMMANDS = f"""{PROGRAMS}, cleaned AS (SELECT file, line_no, trim(split_part(text, ';', 1)) AS t FROM programs WHERE trim(split_part(text, ';', 1)) <> ''),
    moded AS (SELECT *, CASE WHEN upper(t) LIKE 'G90%' THEN 'absolute' WHEN upper(t) LIKE 'G91%' THEN 'relative' END AS mode FROM cleaned),
    told AS (SELECT *, mode IS NULL AND {_moves} AS is_move FROM moded),
    commands AS (SELECT file, line_no, t AS text, mode, is_move, {_params} FROM told)"""
_sets = ", ".join(f"count(CASE WHEN {a} IS NOT NULL AND m = 'absolute' THEN 1 END) OVER w AS g{a}" for a in "xyz")
_sums = ", ".join(f"sum(coalesce({a}, CAST(0 AS DOUBLE))) OVER (PARTITION BY file, g{a} ORDER BY line_no) AS pos_{a}" for a in "xyz")
POSITIONS = f"""{COMMANDS}, filled AS (SELECT *, coalesce(last_value(mode IGNORE NULLS) OVER (PARTITION BY file ORDER BY line_no), 'absolute') AS m FROM commands),
    grouped AS (SELECT *, {_sets} FROM filled WINDOW w AS (PARTITION BY file ORDER BY line_no)),
    placed AS (SELECT *, {_sums} FROM grouped),
    gated AS (SELECT *, is_move AND z IS NOT NULL AND abs(pos_z - coalesce(lag(pos_z) OVER (PARTITION BY file ORDER BY line_no), CAST(0 AS DOUBLE))) > 0.005 AS z_gate FROM placed)"""
TOOL_LAYERS = f"""RECURSIVE {POSITIONS}, steps AS (SELECT file, round(pos_z, 4) AS z, row_number() OVER (PARTITION BY file ORDER BY line_no) AS s FROM gated WHERE z_gate),
    fold AS (SELECT file, s, z, z AS kept, true AS fresh FROM steps WHERE s = 1 UNION ALL
             SELECT n.file, n.s, n.z, CASE WHEN abs(n.z - f.kept) > 0.005 THEN n.z ELSE f.kept END, abs(n.z - f.kept) > 0.005 FROM fold f JOIN steps n ON n.file = f.file AND n.s = f.s + 1),
    tool_layers AS (SELECT file, CAST(row_number() OVER w - 1 AS INTEGER) AS layer_idx, z, round(z - lag(z) OVER w, 4) AS height FROM fold WHERE fresh WINDOW w AS (PARTITION BY file ORDER BY s))"""
