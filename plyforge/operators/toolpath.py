"""Toolpath (G-code) programs as tables: commands, positions, layers and segments.

A program's lines are numbered, so every step is a window over (file, line).
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

AXES = ("X", "Y", "Z", "E", "F")


def clean(lines: DataFrame, text: str = "text") -> DataFrame:
    """Lines without their `;` comment and outer blanks; empty ones go."""
    return lines.withColumn(text, F.trim(F.split_part(F.coalesce(text, F.lit("")), F.lit(";"), F.lit(1)))).filter(F.col(text) != "")


def parameter(text: Column, letter: str) -> Column:
    """The value after the last such letter; null without one. Exponents are not read."""
    found = F.regexp_extract_all(F.upper(text), F.lit(rf"{letter}\s*([-+]?\d*\.?\d+)"), F.lit(1))
    return F.try_element_at(found, F.lit(-1)).cast("double")


def commands(lines: DataFrame, text: str = "text") -> DataFrame:
    """Add mode (on G90 and G91 lines), is_move (G0 and G1) and the parameters x, y, z, e, f of moves."""
    rows = clean(lines, text)
    upper = F.upper(text)
    mode = F.when(upper.startswith("G90"), "absolute").when(upper.startswith("G91"), "relative")
    number = F.regexp_extract(text, r"^[Gg]\s*(\d+)", 1).try_cast("int")
    rows = rows.withColumn("mode", mode).withColumn("is_move", F.col("mode").isNull() & F.coalesce(number.isin(0, 1), F.lit(False)))
    return rows.withColumns({a.lower(): F.when(F.col("is_move"), parameter(F.col(text), a)) for a in AXES})


def positions(moves: DataFrame, file: str = "file", line: str = "line_no") -> DataFrame:
    """Add pos_x, pos_y and pos_z after each line; all start at 0.

    An absolute value sets an axis and a relative one adds to it: each set
    begins a group, within which a running sum holds.
    """
    w = Window.partitionBy(file).orderBy(line)
    rows = moves.withColumn("_mode", F.coalesce(F.last("mode", ignorenulls=True).over(w), F.lit("absolute")))
    for a in ("x", "y", "z"):
        sets = F.col(a).isNotNull() & (F.col("_mode") == "absolute")
        rows = rows.withColumn(f"_g{a}", F.count(F.when(sets, 1)).over(w))
        within = Window.partitionBy(file, f"_g{a}").orderBy(line)
        rows = rows.withColumn(f"pos_{a}", F.sum(F.coalesce(a, F.lit(0.0))).over(within)).drop(f"_g{a}")
    return rows.drop("_mode")


def z_steps(placed: DataFrame, epsilon: float = 0.005, file: str = "file", line: str = "line_no") -> DataFrame:
    """Add z_gate: moves that name Z and change it by more than epsilon."""
    before = F.coalesce(F.lag("pos_z").over(Window.partitionBy(file).orderBy(line)), F.lit(0.0))
    return placed.withColumn("z_gate", F.col("is_move") & F.col("z").isNotNull() & (F.abs(F.col("pos_z") - before) > epsilon))


def layers(gated: DataFrame, epsilon: float = 0.005, file: str = "file", line: str = "line_no") -> DataFrame:
    """(file, layer_idx, z, height): gated heights that leave the last kept one by more than epsilon.

    What counts is the distance to the last kept height, so this is an ordered
    fold over a file's gated moves (hops included; they are not sorted). Tasks
    get whole files sorted by line, in batches, and keep the last height alone.
    """
    steps = gated.filter("z_gate and pos_z is not null").select(F.col(file).alias("_f"), F.col(line).alias("_l"), F.round("pos_z", 4).alias("z"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, kept, n = object(), None, 0
        for batch in batches:
            rows: list[list] = [[], [], [], []]
            for i, (name, z) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                if name != now:
                    now, kept, n = name, None, 0
                if kept is None or abs(z - kept) > epsilon:
                    for column, v in zip(rows, (i, n, z, kept), strict=True):
                        column.append(v)
                    kept, n = z, n + 1
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows[0], pa.int64())), pa.array(rows[1], pa.int32()), pa.array(rows[2], pa.float64()), pa.array(rows[3], pa.float64())], ["f", "layer_idx", "z", "before"])

    kind = gated.schema[file].dataType.simpleString()
    rows = steps.repartition("_f").sortWithinPartitions("_f", "_l").mapInArrow(run, f"f {kind}, layer_idx int, z double, before double")
    return rows.select(F.col("f").alias(file), "layer_idx", "z", F.round(F.col("z") - F.col("before"), 4).alias("height"))


def segments(gated: DataFrame, file: str = "file", line: str = "line_no") -> DataFrame:
    """(file, segment, n_points, points): the XY moves between gated Z moves, of two points at least.

    A move with X or Y on the Z line itself belongs to what follows. Travel
    and extrusion are not told apart.
    """
    w = Window.partitionBy(file).orderBy(line)
    rows = gated.withColumn("segment", F.sum(F.col("z_gate").cast("int")).over(w)).filter(F.col("is_move") & (F.col("x").isNotNull() | F.col("y").isNotNull()))
    point = F.struct(F.col(line).alias("l"), F.col("pos_x").alias("x"), F.col("pos_y").alias("y"))
    out = rows.groupBy(file, "segment").agg(F.array_sort(F.collect_list(point)).alias("points"))
    out = out.withColumn("n_points", F.size("points")).filter("n_points >= 2")
    return out.select(file, "segment", "n_points", F.transform("points", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("points"))


def summary(found: DataFrame, file: str = "file") -> DataFrame:
    """One row a file: layers, the greatest z, and the least and greatest layer height."""
    return found.groupBy(file).agg(F.count("*").alias("layer_count"), F.round(F.max("z"), 4).alias("total_height"), F.min("height").alias("min_height"), F.max("height").alias("max_height"))


def parse(lines: DataFrame, epsilon: float = 0.005) -> DataFrame:
    """Lines (file, line_no, text) with commands, positions and Z gates."""
    return z_steps(positions(commands(lines)), epsilon)
