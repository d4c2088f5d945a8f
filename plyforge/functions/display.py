"""How numbers and severities are shown."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Least gauge value of each state, and what each severity counts as.
GAUGES = ((80, "success"), (60, "accent"), (40, "warning"))
SEVERITIES = {"critical": "error", "high": "orange", "medium": "warning", "low": "accent", "info": "accent_secondary"}


def gauge_state(value: Column) -> Column:
    out = None
    for least, name in GAUGES:
        out = F.when(value >= least, name) if out is None else out.when(value >= least, name)
    return out.otherwise("error")


def severity_state(severity: Column) -> Column:
    """By name in any case; others, such as `warning`, are plain text."""
    out = F.lit("text")
    for name, state in SEVERITIES.items():
        out = F.when(F.lower(severity) == name, state).otherwise(out)
    return out


def scale_from_ends(x0: Column, y0: Column, x1: Column, y1: Column, millimetres: Column, least_pixels: float = 5.0) -> Column:
    """Millimetres a pixel of a drawn line; null for lines under five pixels."""
    pixels = F.sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0))
    return F.when((pixels >= least_pixels) & (millimetres > 0), millimetres / pixels)
