"""Camera calibration: scale from board corners, and lens distortion taken out of pixel tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def corner_scale(corners: DataFrame, across: int, square_mm: float, image: str = "image") -> DataFrame:
    """One row: scale_mm_per_px, the square's size over the mean distance of horizontal neighbours in all images.

    corners: (image, idx, x, y), row after row with `across` corners each. Without a pair, or at a mean of 0, the scale is 1.
    """
    w = Window.partitionBy(image).orderBy("idx")
    ahead = corners.select("idx", "x", "y", *[F.lead(c).over(w).alias(f"_{c}") for c in ("idx", "x", "y")])
    pairs = ahead.filter((F.col("_idx") == F.col("idx") + 1) & (F.col("_idx") % across != 0))
    mean = F.avg(F.sqrt((F.col("_x") - F.col("x")) * (F.col("_x") - F.col("x")) + (F.col("_y") - F.col("y")) * (F.col("_y") - F.col("y"))))
    return pairs.agg(mean.alias("_m")).select(F.when(F.col("_m") > 0, square_mm / F.col("_m")).otherwise(1.0).alias("scale_mm_per_px"))


def distorted(x: Column, y: Column, camera: list[list[float]], coefficients: list[float]) -> tuple[Column, Column]:
    """Where the lens puts the ideal pixel (x, y): radial terms k1, k2, k3 and tangential p1, p2, in the order k1 k2 p1 p2 k3."""
    k1, k2, p1, p2, k3 = [*coefficients, *[0.0] * 5][:5]
    (fx, _, cx), (_, fy, cy) = camera[0], camera[1]
    u, v = (x - cx) / fx, (y - cy) / fy
    r = u * u + v * v
    radial = 1 + r * (k1 + r * (k2 + r * k3))
    du = u * radial + 2 * p1 * u * v + p2 * (r + 2 * u * u)
    dv = v * radial + p1 * (r + 2 * v * v) + 2 * p2 * u * v
    return du * fx + cx, dv * fy + cy


def undistort(pixels: DataFrame, camera: list[list[float]] | None, coefficients: list[float] | None, image: str = "image") -> DataFrame:
    """(image, y, x, v double): each pixel takes the value at its distorted place, between four pixels; outside the image is 0.

    Each place asks for its four neighbours, which one equi-join finds. Without calibration the pixels stay as they are.
    """
    if camera is None or coefficients is None:
        return pixels
    px, py = distorted(F.col("x").cast("double"), F.col("y").cast("double"), camera, coefficients)
    at = pixels.select(image, "y", "x", px.alias("_px"), py.alias("_py")).withColumns({"_x0": F.floor("_px"), "_y0": F.floor("_py")})
    fx, fy = F.col("_px") - F.col("_x0"), F.col("_py") - F.col("_y0")
    corner = [F.struct((F.col("_x0") + i).alias("x"), (F.col("_y0") + j).alias("y"), ((fx if i else 1 - fx) * (fy if j else 1 - fy)).alias("w")) for i in (0, 1) for j in (0, 1)]
    asked = at.select(image, "y", "x", F.explode(F.array(*corner)).alias("_c")).select(image, "y", "x", F.col("_c.x").cast("int").alias("_x"), F.col("_c.y").cast("int").alias("_y"), F.col("_c.w").alias("_w"))
    held = pixels.select(image, F.col("y").alias("_y"), F.col("x").alias("_x"), F.col("v").alias("_v"))
    return asked.join(held, [image, "_y", "_x"], "left").groupBy(image, "y", "x").agg(F.sum(F.col("_w") * F.coalesce("_v", F.lit(0))).alias("v"))
