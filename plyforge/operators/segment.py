"""Layer images to masks and contours; one row is one image, and one task sees one batch of them.

Images come as Spark's image source gives them: a struct with height, width,
nChannels and data (rows of BGR or grey bytes).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from plyforge.functions import geometry, images

from .pixels import ellipse

METHODS = ("adaptive", "otsu", "background_subtraction")
IMAGES = 256  # whose contours a task holds as Python's points at a time


@dataclass
class SegmentationParams:
    method: str | None = None
    block_size: int = 11
    c: float = 2
    kernel_size: int = 5
    min_area: float = 100
    invert: bool = False
    blur_size: int = 5
    background: np.ndarray | None = None
    difference: int = 30


def segment_array(image: np.ndarray, method: str = "adaptive", params: SegmentationParams | None = None) -> np.ndarray:
    """Grey, smoothing, the method, inversion, then opening, closing and small parts. params.method goes first; an unknown one is adaptive."""
    p = params or SegmentationParams()
    method, grey = p.method or method, images.blur(images.gray(image), p.blur_size)
    if method == "background_subtraction":
        if p.background is None:
            raise ValueError("background subtraction needs a background")
        mask = images.background(grey, p.background, p.difference)
    else:
        mask = images.otsu(grey) if method == "otsu" else images.adaptive(grey, p.block_size, p.c)
    if p.invert:
        mask = 255 - mask
    if p.kernel_size > 0:
        mask = images.open_close(mask, ellipse(p.kernel_size | 1))
    return images.without_small(mask, p.min_area) if p.min_area > 0 else mask


def as_array(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    a = np.frombuffer(data, np.uint8)[: height * width * channels].reshape(height, width, channels)
    return a[:, :, 0] if channels == 1 else a


def _masks(rows: DataFrame, make) -> DataFrame:
    flat = rows.select(*[c for c in rows.columns if c != "image"], F.col("image.height").alias("height"), F.col("image.width").alias("width"), F.col("image.nChannels").alias("_n"), F.col("image.data").alias("_data"))
    kept = [f for f in flat.schema if f.name not in ("_n", "_data")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            masks = [make(as_array(d, h, w, n), row).tobytes() for d, h, w, n, row in zip(b["_data"], b["height"], b["width"], b["_n"], b.to_dict("records"), strict=True)]
            yield b[[f.name for f in kept]].assign(mask=masks)

    return flat.mapInPandas(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept) + ", mask binary")


def threshold_masks(rows: DataFrame, level: int = 127) -> DataFrame:
    """image becomes height, width and mask: 255 where the grey level is over `level`."""
    return _masks(rows, lambda image, _: np.where(images.gray(image) > level, 255, 0).astype(np.uint8))


def segment(rows: DataFrame, method: str = "adaptive", params: SegmentationParams | None = None, overrides: dict[int, SegmentationParams] | None = None, order: str = "layer_idx") -> DataFrame:
    """image becomes height, width and mask. overrides: whole parameter sets by layer index, as layers.with_overrides joins tables of them."""
    given = overrides or {}
    return _masks(rows, lambda image, row: segment_array(image, method, given.get(row.get(order), params)))


def contours(masks: DataFrame, scale: float = 1.0, simplify: float = 0.002, min_area_mm2: float = 1.0) -> DataFrame:
    """One row a contour: contour_idx, outer, inners (mm), area_mm2 (less holes), perimeter_mm (outer) and confidence.

    Borders under min_area_mm2, before holes are taken off, go. outer is
    simplified by `simplify` of its length; area, perimeter and confidence's
    shape are of the traced border. masks: height, width, mask and other
    columns, which are kept. A task's points leave it every IMAGES masks.
    """
    if scale <= 0:
        raise ValueError("the scale must be over 0")
    kept = [f for f in masks.schema if f.name not in ("height", "width", "mask")]
    point = "array<struct<x: double, y: double>>"
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept) + f", contour_idx int, outer {point}, inners array<{point}>, area_mm2 double, perimeter_mm double, raw_area double"
    as_points = lambda p: [{"x": float(x), "y": float(y)} for x, y in p * scale]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in (x.iloc[k : k + IMAGES] for x in batches for k in range(0, len(x), IMAGES)):
            out = []
            for row in b.to_dict("records"):
                mask = np.frombuffer(row["mask"], np.uint8).reshape(row["height"], row["width"])
                k = 0
                for outer, holes in images.outlines(mask):
                    area = images.closed_area(outer) * scale * scale
                    if area < min_area_mm2:
                        continue
                    length = images.closed_length(outer)
                    net = area - sum(images.closed_area(h) for h in holes) * scale * scale
                    slim = images.simplified(images.corners(outer), simplify * length)
                    out.append({**{f.name: row[f.name] for f in kept}, "contour_idx": k, "outer": as_points(slim), "inners": [as_points(images.simplified(images.corners(h), simplify * images.closed_length(h))) for h in holes], "area_mm2": net, "perimeter_mm": length * scale, "raw_area": area})
                    k += 1
            if out:
                yield pd.DataFrame(out)

    rows = masks.mapInPandas(run, schema)
    return rows.withColumn("confidence", geometry.circularity(F.col("raw_area"), F.col("perimeter_mm"), F.size("outer"))).drop("raw_area")
