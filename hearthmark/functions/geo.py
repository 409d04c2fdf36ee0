"""Distances and grid cells as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance on a sphere, to the millimetre (so that equal distances compare equal)."""
    a = (F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2)
         + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2))
    return F.round(2 * EARTH_KM * F.asin(F.sqrt(F.least(a, F.lit(1.0)))), 6)


def cell(value: Column, size: float | Column) -> Column:
    return F.floor(value / size)


def block(cy: Column, cx: Column, reach: int | Column = 1) -> Column:
    """Array of (cy, cx) structs around a cell."""
    r = F.lit(reach) if isinstance(reach, int) else reach
    ys = F.sequence(cy - r, cy + r)
    return F.flatten(F.transform(ys, lambda y: F.transform(F.sequence(cx - r, cx + r), lambda x: F.struct(y.alias("cy"), x.alias("cx")))))
