"""Operators over the layers of builds: sequences, occlusion and anomalies.

All read a table with a build column, an order column and, as needed, z, area,
perimeter, cx, cy and n_points. One window, partitioned by build and ordered by
layer, serves every detector, so a build's layers are shuffled and sorted once.
`order` may be a layer index, or a contour index where a layer has several.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from plyforge.functions import names


def layer_images(files: DataFrame, layer_height: float = 0.2, build: str = "build_id", path: str = "path") -> DataFrame:
    """Image files with their layer number and z: other endings and names without a number go, one file a layer stays.

    Of several files of one layer the first by path stays. Only paths are
    looked at, so pixels need not be read for files that go.
    """
    rows = files.filter(names.is_image(F.col(path))).withColumn("layer_number", names.layer_number(F.col(path))).filter("layer_number is not null")
    return dedupe(rows, [build, "layer_number"], [path]).withColumn("z_height", F.col("layer_number") * layer_height)


def dedupe(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by the order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def respace(layers: DataFrame, totals: DataFrame, layer_height: float, build: str = "build_id", order: str = "layer_number") -> DataFrame:
    """z from the toolpath's total height over the number of layers, where it differs by over 0.001.

    z then counts positions, not numbers, so gaps in the numbers close.
    totals: (build, total_height). Builds without it, or with one layer, keep z.
    """
    w = Window.partitionBy(build)
    n, at = F.count("*").over(w), F.row_number().over(w.orderBy(order)) - 1
    rows = layers.join(totals.select(build, F.col("total_height").alias("_total")), build, "left").withColumns({"_n": n, "_at": at})
    height = F.col("_total") / F.greatest(F.col("_n") - 1, F.lit(1))
    apply = (F.col("_total") > 0) & (F.col("_n") > 1) & (F.abs(height - layer_height) > 0.001)
    return rows.withColumn("z_height", F.when(apply, F.col("_at") * height).otherwise(F.col("z_height"))).drop("_total", "_n", "_at")


def missing_layers(layers: DataFrame, build: str = "build_id", number: str = "layer_number") -> DataFrame:
    """(build, number) of the numbers between a build's first and last that it lacks.

    Gaps between neighbours are spread, so only what is missing is generated.
    """
    distinct = layers.select(build, F.col(number).cast("long").alias(number)).filter(f"{number} is not null").distinct()
    before = F.lag(number).over(Window.partitionBy(build).orderBy(number))
    gaps = distinct.withColumn("_b", before).filter(F.col(number) - F.col("_b") > 1)
    return gaps.select(build, F.explode(F.sequence(F.col("_b") + 1, F.col(number) - 1)).alias(number))


def occlusion(layers: DataFrame, build: str = "build_id", order: str = "layer_idx", area: str = "area", drop: float = 0.3, least: float = 0.7) -> DataFrame:
    """Add confidence and flagged: how far a layer's area falls below the one before.

    A ratio under 1 - drop costs twice what it lacks; the first layer, and one
    after an area of 0, have confidence 1.
    """
    before = F.lag(area).over(Window.partitionBy(build).orderBy(order))
    ratio = F.col(area) / before
    fallen = F.when((before > 0) & (ratio < 1 - drop), 1.0 - 2.0 * ((1.0 - ratio) - drop)).otherwise(1.0)
    confidence = F.greatest(F.lit(0.0), F.least(F.lit(1.0), fallen))
    return layers.withColumn("confidence", confidence).withColumn("flagged", F.col("confidence") < least)


def occlusion_report(occluded: DataFrame, build: str = "build_id", order: str = "layer_idx") -> DataFrame:
    """One row a build: how many layers, how many flagged, and the flagged ones in order."""
    return occluded.groupBy(build).agg(F.count("*").alias("n_layers"), F.count_if("flagged").alias("n_flagged"), F.sort_array(F.collect_list(F.when(F.col("flagged"), F.col(order)))).alias("flagged_layers"))


@dataclass
class AnomalySettings:
    layer_height: float = 0.2
    shift_mm: float = 0.5
    width_change: float = 0.20
    gap_factor: float = 1.5


def _severity(ratio: Column, critical: float, warning: float) -> Column:
    return F.when(ratio > critical, "critical").when(ratio > warning, "warning").otherwise("info")


def anomalies(layers: DataFrame, settings: AnomalySettings | None = None, build: str = "build_id", order: str = "layer_idx", planned: str | None = None) -> DataFrame:
    """(build, order, detector_rank, anomaly_type, severity, measured_value, threshold, description), the flat anomaly list.

    missing_layer: z rises by more than gap_factor of the expected gap, which
    is layer_height or, with a planned z column, the planned rise (a planned
    rise of 0 has no ratio: the gap then counts as one missing layer for each
    layer_height). layer_shift: the vertex mean moves by more than shift_mm; a
    contour of fewer than three points has none, and neither it nor the next is
    compared. width_variation: perimeter, and by itself area, changes by more
    than width_change; values under 1e-6 are not compared. detector_rank keeps
    the detectors' order.
    """
    s = settings or AnomalySettings()
    w = Window.partitionBy(build).orderBy(order)
    center = F.when(F.col("n_points") >= 3, F.struct("cx", "cy"))
    rows = layers.withColumns({
        "_z": F.lag("z").over(w), "_c": center, "_pc": F.lag(center).over(w), "_perimeter": F.lag("perimeter").over(w), "_area": F.lag("area").over(w),
        "_plan": (F.col(planned) - F.lag(planned).over(w)) if planned else F.lit(None).cast("double"),
    })
    gap = F.col("z") - F.col("_z")
    expected = F.coalesce(F.when(F.col("_plan") != 0, F.col("_plan")), F.lit(s.layer_height))
    n_missing = F.greatest(F.lit(0), F.bround(gap / expected, 0).cast("int") - 1)
    shift = F.sqrt((F.col("_c.cx") - F.col("_pc.cx")) * (F.col("_c.cx") - F.col("_pc.cx")) + (F.col("_c.cy") - F.col("_pc.cy")) * (F.col("_c.cy") - F.col("_pc.cy")))

    def change(metric: str) -> Column:
        able = (F.col(metric) >= 1e-6) & (F.col(f"_{metric}") >= 1e-6)
        return F.when(able, F.abs(F.col(metric) - F.col(f"_{metric}")) / F.col(f"_{metric}"))

    def row(rank: int, kind: str, when: Column, severity: Column, measured: Column, threshold: Column, description: Column) -> Column:
        return F.when(when, F.struct(F.lit(rank).alias("detector_rank"), F.lit(kind).alias("anomaly_type"), severity.alias("severity"), measured.alias("measured_value"), threshold.alias("threshold"), description.alias("description")))

    limit = expected * s.gap_factor
    found = [row(1, "missing_layer", gap > limit, F.when(n_missing >= 3, "critical").when(n_missing >= 1, "warning").otherwise("info"), F.round(gap, 4), F.round(limit, 4), F.format_string("gap of %.3f mm, %d layers missing", gap, n_missing))]
    found.append(row(2, "layer_shift", shift > s.shift_mm, _severity(shift / s.shift_mm, 3.0, 1.5), F.round(shift, 4), F.lit(s.shift_mm), F.format_string("centre moved by %.3f mm", shift)))
    for rank, metric in ((3, "perimeter"), (4, "area")):
        c = change(metric)
        found.append(row(rank, "width_variation", c > s.width_change, _severity(c / s.width_change, 3.0, 2.0), F.round(c, 4), F.lit(s.width_change), F.format_string(f"{metric} changed by %.1f %%", c * 100)))
    return rows.select(build, order, F.explode(F.array_compact(F.array(*found))).alias("a")).select(build, order, "a.*")


def anomaly_summary(found: DataFrame, *by: str) -> DataFrame:
    """Counts by type, by severity and in all, in one pass."""
    keys = [*by, "anomaly_type", "severity"]
    counted = found.groupingSets([[*by, F.col("anomaly_type")], [*by, F.col("severity")], [*by]], *keys).agg(F.count("*").alias("n"))
    return counted.select(*keys, "n")


def paired(left: DataFrame, right: DataFrame, left_order: str, right_order: str, build: str = "build_id") -> DataFrame:
    """left's and right's columns side by side, a build's rows by their places in either order (masks and heights, say).

    Builds that have not as many rows on both sides are an error when the result is computed; no further pass is made for it.
    """
    place = lambda df, order: df.withColumn("_place", F.row_number().over(Window.partitionBy(build).orderBy(order)))
    both = place(left, left_order).withColumn("_l", F.lit(1)).join(place(right, right_order).withColumn("_r", F.lit(1)), [build, "_place"], "full")
    unequal = F.when(F.col("_l").isNull() | F.col("_r").isNull(), F.raise_error(F.concat(F.lit("unequal numbers of rows to pair in build "), F.col(build).cast("string"))).cast("int")).otherwise(1)
    return both.withColumn("_l", unequal).filter("_l = 1").drop("_place", "_l", "_r")


def height_errors(planned: DataFrame, measured: DataFrame, build: str = "build_id", order: str = "layer_idx") -> DataFrame:
    """(build, order, error): measured minus planned z of the layers that both have."""
    p = planned.select(build, order, F.col("z").alias("_p"))
    return measured.select(build, order, "z").join(p, [build, order]).select(build, order, F.round(F.col("z") - F.col("_p"), 6).alias("error"))


def error_stats(errors: DataFrame, build: str = "build_id") -> DataFrame:
    """(build, n, mean_abs, max_abs) of the height errors."""
    return errors.groupBy(build).agg(F.count("*").alias("n"), F.avg(F.abs("error")).alias("mean_abs"), F.max(F.abs("error")).alias("max_abs"))


def with_overrides(rows: DataFrame, overrides: DataFrame, keys: list[str], defaults: dict[str, object]) -> DataFrame:
    """Parameters of each row: its override's, as a whole, or else the defaults. overrides has one row a key."""
    names_ = list(defaults)
    given = overrides.select(*keys, F.struct(*names_).alias("_given"))
    joined = rows.join(given, keys, "left").withColumn("_p", F.coalesce("_given", F.struct(*[F.lit(v).cast(overrides.schema[k].dataType).alias(k) for k, v in defaults.items()])))
    return joined.select(*rows.columns, *[F.col(f"_p.{n}").alias(n) for n in names_])


def mean_thickness(layers: DataFrame, build: str = "build_id", z: str = "z") -> DataFrame:
    """(build, thickness): the rise from the first to the last layer over the steps between them."""
    return layers.groupBy(build).agg(((F.max(z) - F.min(z)) / F.greatest(F.lit(1), F.count("*") - 1)).alias("thickness"))


def attach(vertices: DataFrame, distances: DataFrame, key: str = "vid") -> DataFrame:
    """Vertices with their distances, for a heat map; vertices without one keep a null."""
    return vertices.join(distances, key, "left")
