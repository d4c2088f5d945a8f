"""Pixel tables (image, y, x, v) as relations: thresholds, differences, morphology, crop."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def threshold(pixels: DataFrame, level: int = 127) -> DataFrame:
    """v over the level becomes 255, the rest 0."""
    return pixels.withColumn("v", F.when(F.col("v") > level, 255).otherwise(0))


def invert(pixels: DataFrame) -> DataFrame:
    return pixels.withColumn("v", 255 - F.col("v"))


def otsu_levels(pixels: DataFrame, image: str = "image") -> DataFrame:
    """(image, level): the level with the greatest between-class variance, the first on ties.

    A histogram of 256 rows an image is all that the window sees.
    """
    histogram = pixels.groupBy(image, "v").agg(F.count("*").cast("double").alias("n"))
    w = Window.partitionBy(image)
    run = w.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    h = histogram.withColumns({"n0": F.sum("n").over(run), "s0": F.sum(F.col("n") * F.col("v")).over(run), "nt": F.sum("n").over(w), "st": F.sum(F.col("n") * F.col("v")).over(w)})
    n1, s1 = F.col("nt") - F.col("n0"), F.col("st") - F.col("s0")
    apart = F.col("s0") / F.col("n0") - s1 / F.nullif(n1, F.lit(0.0))
    between = F.coalesce(F.col("n0") * n1 * apart * apart, F.lit(0.0))
    return h.groupBy(image).agg(F.max_by("v", F.struct(F.round(between, 3), -F.col("v"))).alias("level"))


def otsu(pixels: DataFrame, image: str = "image") -> DataFrame:
    return pixels.join(otsu_levels(pixels, image), image).withColumn("v", F.when(F.col("v") > F.col("level"), 255).otherwise(0)).drop("level")


def subtract_background(pixels: DataFrame, background: DataFrame, least: int = 30) -> DataFrame:
    """255 where a pixel differs from the background's (y, x, v) by more than `least`; a pixel without one gives 0."""
    b = background.select("y", "x", F.col("v").alias("_b"))
    return pixels.join(b, ["y", "x"], "left").withColumn("v", F.when(F.abs(F.col("v") - F.col("_b")) > least, 255).otherwise(0)).drop("_b")


def bounds(pixels: DataFrame, pad: int = 10, *by: str) -> DataFrame:
    """Padded bounding box of pixels over 0 within the image size: one box over all masks, or one for each `by`."""
    inside = F.col("v") > 0
    least = lambda c: F.greatest(F.min(F.when(inside, F.col(c))) - pad, F.lit(0))
    most = lambda c: F.least(F.max(F.when(inside, F.col(c))) + pad + 1, F.max(c) + 1)
    return pixels.groupBy(*by).agg(least("x").alias("x0"), most("x").alias("x1"), least("y").alias("y0"), most("y").alias("y1"))


def crop(pixels: DataFrame, pad: int = 10) -> DataFrame:
    """Pixels inside the box of all masks, moved to its corner."""
    box = F.broadcast(bounds(pixels, pad))  # one row
    return pixels.crossJoin(box).filter("x >= x0 and x < x1 and y >= y0 and y < y1").withColumns({"x": F.col("x") - F.col("x0"), "y": F.col("y") - F.col("y0")}).drop("x0", "x1", "y0", "y1")


def ellipse(size: int) -> list[tuple[int, int]]:
    """(dy, dx) of an elliptic element of an odd size: each row as wide as the ellipse there, rounded."""
    r = size // 2
    out = []
    for dy in range(-r, r + 1):
        half = round(r * ((r * r - dy * dy) ** 0.5) / r) if r else 0
        out += [(dy, dx) for dx in range(-half, half + 1)]
    return out


def _spread(pixels: DataFrame, element: list[tuple[int, int]], image: str, pick) -> DataFrame:
    """Each pixel's least or greatest neighbour under the element; what lies outside the image does not count.

    Every pixel is sent to its neighbours' places, so this is one group-by
    whose work is the element's size a pixel.
    """
    moves = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in element])
    sent = pixels.withColumn("m", F.explode(moves)).select(image, (F.col("y") + F.col("m.dy")).alias("y"), (F.col("x") + F.col("m.dx")).alias("x"), "v", ((F.col("m.dy") == 0) & (F.col("m.dx") == 0)).alias("own"))
    return sent.groupBy(image, "y", "x").agg(pick("v").alias("v"), F.bool_or("own").alias("own")).filter("own").drop("own")


def erode(pixels: DataFrame, size: int = 5, image: str = "image") -> DataFrame:
    return _spread(pixels, ellipse(size), image, F.min)


def dilate(pixels: DataFrame, size: int = 5, image: str = "image") -> DataFrame:
    return _spread(pixels, ellipse(size), image, F.max)


def open_close(pixels: DataFrame, size: int = 5, image: str = "image") -> DataFrame:
    """Opening, then closing."""
    opened = dilate(erode(pixels, size, image), size, image)
    return erode(dilate(opened, size, image), size, image)
