"""The inspection of one build as a lazy composition of tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from plyforge.functions import geometry
from plyforge.operators import compare, layers, meshes, pixels, register, score, segment, toolpath
from plyforge.operators.tables import written
from plyforge.sources import files


@dataclass
class BuildSettings:
    images_dir: str = ""
    mesh_file: str = ""
    toolpath_file: str = ""
    calibration_profile: str = ""
    scale_mm_per_px: float = 1.0
    layer_height_mm: float = 0.2
    tolerance_mm: float = 0.2
    weights: dict[str, float] | None = None


def of_project(project: dict, scale_mm_per_px: float = 1.0) -> BuildSettings:
    """Settings of a build from a project's fields."""
    return BuildSettings(
        images_dir=project["images_dir"], mesh_file=project["stl_file"], toolpath_file=project["gcode_file"], calibration_profile=project["calibration_profile"],
        scale_mm_per_px=scale_mm_per_px, layer_height_mm=project["layer_height_mm"], tolerance_mm=project["tolerance_mm"],
    )


@dataclass
class Inspection:
    """Named tables, the settings that were derived, and the error that ended it, if one did."""

    tables: dict[str, DataFrame] = field(default_factory=dict)
    scale: float = 1.0
    error: str | None = None


def slices(masks: DataFrame, build: str = "build_id") -> DataFrame:
    """(build, z_height, layer_number, slice): each mask's place by height; no pixel is read for it."""
    place = F.row_number().over(Window.partitionBy(build).orderBy("z_height", "layer_number")) - 1
    return masks.select(build, "z_height", "layer_number").withColumn("slice", place)


def mask_voxels(masks: DataFrame, build: str = "build_id", most: int = 500_000) -> DataFrame:
    """(volume, z, y, x, inside) of the masks' full pixels; z is the slice's place by height. Tasks emit at most `most` pixels at a time."""
    held = masks.select(F.col(build).alias("volume"), "z_height", "layer_number", "width", "mask")
    kinds = {f.name: f.dataType.simpleString() for f in held.schema}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                on = np.flatnonzero(np.frombuffer(row.mask, np.uint8))
                for k in range(0, len(on), most):
                    some = on[k : k + most]
                    yield pd.DataFrame({"volume": row.volume, "z_height": row.z_height, "layer_number": row.layer_number, "y": some // row.width, "x": some % row.width}, index=range(len(some)))

    on = held.mapInPandas(run, f"volume {kinds['volume']}, z_height {kinds['z_height']}, layer_number {kinds['layer_number']}, y int, x int")
    places = slices(masks, build).withColumnRenamed(build, "volume")
    return on.join(places, ["volume", "z_height", "layer_number"]).select("volume", F.col("slice").alias("z"), "y", "x", F.lit(True).alias("inside"))


def run(spark: SparkSession, settings: BuildSettings, progress: Callable[[float, str], None] | None = None) -> Inspection:
    """Images to contours, occlusion, surface, comparison, anomalies and score.

    Stages whose input is not named are not built. What fails is told in
    .error; the tables before it stay. "layer" in occlusion and anomalies is a
    contour's place in the order of z, as a layer may have several islands.
    """
    out, tell = Inspection(scale=settings.scale_mm_per_px), progress or (lambda percent, text: None)
    t = out.tables
    try:
        expected = 0
        if settings.toolpath_file.strip():
            tell(5, "toolpath")
            t["tool_layers"] = written(toolpath.layers(toolpath.parse(files.read_programs(spark, settings.toolpath_file))))
            expected = t["tool_layers"].count()
        tell(10, "images")
        if not settings.images_dir:
            raise ValueError("an image folder is needed")
        images = files.read_layer_images(spark, settings.images_dir, settings.layer_height_mm)
        if "tool_layers" in t:
            total = t["tool_layers"].agg(F.max("z").alias("total_height")).select(F.lit(settings.images_dir).alias("build_id"), "total_height")
            images = layers.respace(images, total, settings.layer_height_mm)
        tell(20, "calibration")
        if settings.calibration_profile:
            try:
                profile = files.read_profiles(spark, settings.calibration_profile).first()
            except PySparkException as e:  # the given scale holds without it
                profile = None
                tell(20, f"no calibration profile: {type(e).__name__}")
            out.scale = profile.scale_mm_per_pixel if profile and profile.scale_mm_per_pixel else out.scale
        tell(30, "masks")
        t["masks"] = written(segment.threshold_masks(images))
        n_images = t["masks"].count()
        if not n_images:
            raise ValueError("no image could be read")
        tell(45, "contours")
        found = segment.contours(t["masks"], out.scale)
        center = geometry.vertex_mean(F.col("outer"))
        place = (F.row_number().over(Window.partitionBy("build_id").orderBy("z_height", "layer_number", "contour_idx")) - 1).alias("layer_idx")
        t["contours"] = written(found.select("*", place, F.col("z_height").alias("z"), F.col("area_mm2").alias("area"), F.col("perimeter_mm").alias("perimeter"), center["x"].alias("cx"), center["y"].alias("cy"), F.size("outer").alias("n_points")))
        n_contours = t["contours"].count()
        if not n_contours:
            raise ValueError("no contour was found")
        tell(55, "occlusion")
        t["occlusion"] = layers.occlusion(t["contours"]).select("build_id", "layer_idx", "confidence", "flagged")
        tell(60, "surface")
        if n_images < 2:
            raise ValueError("a surface needs two images")
        heights = slices(t["masks"]).select("slice", F.col("z_height").alias("height"))
        surface = meshes.lifted(meshes.marching_cubes(mask_voxels(t["masks"])), heights)
        t["surface"] = written(surface.withColumns({f"{v}{a}": F.col(f"{v}{a}") * out.scale for v in "abc" for a in "xy"}))
        t["vertices"] = written(vertices_of(t["surface"]))
        if settings.mesh_file.strip():
            _compare(spark, settings, out, tell)
        tell(90, "anomalies")
        t["anomalies"] = written(layers.anomalies(t["contours"]))
        if "distances" in t and not t["anomalies"].isEmpty():  # without an anomaly there is no score
            tell(95, "score")
            parts = t["within_tolerance"].withColumnRenamed("within_tolerance_pct", "dimensional")
            # both sides are one row
            parts = parts.crossJoin(F.broadcast(score.anomaly_score(t["anomalies"]))).withColumns({"layer": F.lit(100.0), "n_processed": F.lit(n_contours), "n_expected": F.lit(expected or n_images)})
            t["quality"] = score.quality(parts, settings.weights)
        tell(100, "done")
    except (ValueError, OSError, PySparkException) as e:  # bad or missing input is told, as the tables so far are of use
        out.error = f"{type(e).__name__}: {e}"
        tell(100, out.error)
    return out


def _compare(spark: SparkSession, settings: BuildSettings, out: Inspection, tell: Callable[[float, str], None]) -> None:
    t = out.tables
    tell(70, "reference mesh")
    t["reference"] = written(files.read_triangles(spark, settings.mesh_file))
    corners = vertices_of(t["reference"])
    tell(75, "alignment")
    xy, z, shift = register.prealign(t["surface"], t["reference"])
    matrix = geometry.about(tuple(meshes.area_centroid(t["surface"])), [[xy, 0, 0], [0, xy, 0], [0, 0, z]])
    for i in range(3):
        matrix[i][3] += shift[i]
    placed = written(moved(t["vertices"], matrix))
    t["alignment"] = written(register.align_from_starts(placed, corners))
    best = register.best_alignment(t["alignment"]).first()
    t["aligned"] = written(moved(placed, best.matrix))
    tell(85, "comparison")
    t |= compare_models(t["aligned"], t["reference"], settings.tolerance_mm)


def compare_models(vertices: DataFrame, reference: DataFrame, tolerance_mm: float = 0.2, planned: DataFrame | None = None, detected: DataFrame | None = None, contours: DataFrame | None = None, reference_contours: DataFrame | None = None) -> dict[str, DataFrame]:
    """The comparison of a model's vertices (vid, x, y, z) with a reference's triangles: distances, stats and within_tolerance.

    With planned and detected layers (build_id, layer_idx, z) also height_errors, with contours of both
    (build_id, layer_idx, points) also contour_hausdorff; layers that one side lacks have no row there.
    """
    out = {"distances": written(compare.surface_distance(vertices, reference))}
    out["stats"] = compare.distance_stats(out["distances"], "distance")
    out["within_tolerance"] = compare.within_tolerance(out["distances"], "distance", tolerance_mm)
    if planned is not None and detected is not None:
        out["height_errors"] = layers.height_errors(planned, detected)
    if contours is not None and reference_contours is not None:
        out["contour_hausdorff"] = compare.hausdorff(contours, reference_contours, ["build_id", "layer_idx"])
    return out


def vertices_of(tris: DataFrame) -> DataFrame:
    """(vid, x, y, z): the distinct corners of triangles."""
    corner = F.explode(F.array(*[F.struct(*[F.col(f"{v}{x}").alias(x) for x in "xyz"]) for v in "abc"])).alias("p")
    return tris.select(corner).select("p.*").distinct().select(F.xxhash64("x", "y", "z").alias("vid"), "x", "y", "z")


def moved(points: DataFrame, matrix: list[list[float]]) -> DataFrame:
    x, y, z = geometry.affine(F.col("x"), F.col("y"), F.col("z"), matrix)
    return points.withColumns({"x": x, "y": y, "z": z})
