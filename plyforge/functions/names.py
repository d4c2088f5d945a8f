"""Layer numbers in file names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

#: What a layer image's name may look like, the first that matches counts.
LAYER_PATTERNS = (r"(?i)layer[_-]?(\d+)", r"(?i)img[_-]?(\d+)", r"(?i)capa[_-]?(\d+)", r"(?i)slice[_-]?(\d+)", r"^(\d+)$", r"(\d+)$")
#: File name endings of layer images.
IMAGE_ENDINGS = ("png", "jpg", "jpeg", "tiff", "tif", "bmp")


def stem(path: Column) -> Column:
    """The file name without folders and without its last ending."""
    name = F.element_at(F.split(path, r"[/\\]"), -1)
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def ending(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))


def is_image(path: Column) -> Column:
    return ending(path).isin(*IMAGE_ENDINGS)


def layer_number(path: Column) -> Column:
    """The number that the first matching pattern finds in the stem; null without one, or beyond an int."""
    found = [F.nullif(F.regexp_extract(stem(path), p, 1), F.lit("")) for p in LAYER_PATTERNS]
    return reduce(lambda a, b: F.coalesce(a, b), found).try_cast("int")
