"""Column expressions over polygons: arrays of struct<x: double, y: double>."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F


def _sum_over(first: Column, last: Column, term) -> Column:
    """Sum of term(i) for i = first ... last, 0 where last is below first."""
    steps = F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, F.lit(0.0), lambda acc, i: acc + term(i))


def shoelace_area(points: Column) -> Column:
    """Area of a closed polygon; 0 for fewer than three points or a null."""
    n = F.size(points)

    def term(i: Column) -> Column:
        p, q = F.get(points, i), F.get(points, F.pmod(i + 1, n))
        return p["x"] * q["y"] - q["x"] * p["y"]

    return F.when(n >= 3, F.abs(_sum_over(F.lit(0), n - 1, term)) * 0.5).otherwise(0.0)


def polyline_length(points: Column) -> Column:
    """Length of an open polyline; 0 for fewer than two points or a null."""

    def term(i: Column) -> Column:
        p, q = F.get(points, i), F.get(points, i + 1)
        return F.sqrt((q["x"] - p["x"]) * (q["x"] - p["x"]) + (q["y"] - p["y"]) * (q["y"] - p["y"]))

    return F.when(F.size(points) >= 2, _sum_over(F.lit(0), F.size(points) - 2, term)).otherwise(0.0)


def perimeter(points: Column) -> Column:
    """Length of the closed polygon."""
    first, last = F.get(points, F.lit(0)), F.get(points, F.size(points) - 1)
    closing = F.sqrt((last["x"] - first["x"]) * (last["x"] - first["x"]) + (last["y"] - first["y"]) * (last["y"] - first["y"]))
    return polyline_length(points) + F.when(F.size(points) >= 2, closing).otherwise(0.0)


def vertex_mean(points: Column) -> Column:
    """Mean of the vertices (not the area's centroid) as struct<x, y>; null without points."""
    n = F.size(points)
    mean = lambda axis: F.aggregate(points, F.lit(0.0), lambda acc, p: acc + p[axis]) / n
    return F.when(n > 0, F.struct(mean("x").alias("x"), mean("y").alias("y")))


def circularity(area: Column, length: Column, n_points: Column) -> Column:
    """4 pi area / length squared, damped below ten points, within 0 and 1; 0 without area or length."""
    raw = 4.0 * math.pi * area / (length * length) * F.least(F.lit(1.0), n_points / 10.0)
    return F.when((area > 0) & (length > 0), F.least(F.lit(1.0), F.greatest(F.lit(0.0), raw))).otherwise(0.0)


def scaled(points: Column, factor: Column | float) -> Column:
    """Pixel to millimetre coordinates."""
    return F.transform(points, lambda p: F.struct((p["x"] * factor).alias("x"), (p["y"] * factor).alias("y")))


def scale_from_line(millimetres: Column, pixels: Column) -> Column:
    """Millimetres a pixel; an error unless both are over 0."""
    ok = F.assert_true((millimetres > 0) & (pixels > 0), "a scale needs a length and pixels over 0")
    return F.when(ok.isNull(), millimetres / pixels)


def affine(x: Column, y: Column, z: Column, matrix: list[list[float]]) -> list[Column]:
    """The three coordinates under the upper rows of a 4 x 4 matrix."""
    return [x * float(a) + y * float(b) + z * float(c) + F.lit(float(d)) for a, b, c, d in matrix[:3]]


def about(center: tuple[float, float, float], linear: list[list[float]]) -> list[list[float]]:
    """The 4 x 4 matrix that applies a 3 x 3 one about a centre."""
    rows = [[*map(float, r), c - sum(a * b for a, b in zip(r, center, strict=True))] for r, c in zip(linear, center, strict=True)]
    return [*rows, [0.0, 0.0, 0.0, 1.0]]


def rotation_z(degrees: float) -> list[list[float]]:
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    return [[c, -s, 0.0], [s, c, 0.0], [0.0, 0.0, 1.0]]
