"""Expressions over the pixels of a row."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from reliefspark.grid import GridMeta

EARTH_RADIUS = 6378137.0


def x_of(meta: GridMeta, row: Column, col: Column) -> Column:
    c, a, b, *_ = meta.transform
    return F.lit(c) + F.lit(a) * col + F.lit(b) * row


def y_of(meta: GridMeta, row: Column, col: Column) -> Column:
    *_, f, d, e = meta.transform
    return F.lit(f) + F.lit(d) * col + F.lit(e) * row


def orthodromic(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle distance in metres of points in degrees."""
    a, b, c, d = (F.radians(v) for v in (lat1, lat2, lon1, lon2))
    cosine = F.cos(a) * F.cos(b) * F.cos(c - d) + F.sin(a) * F.sin(b)
    return F.lit(EARTH_RADIUS) * F.acos(F.greatest(F.least(cosine, F.lit(1.0)), F.lit(-1.0)))


def angle_between(dot: Column) -> Column:
    """The acute angle of unit vectors with this product; null for null, which least and greatest would skip."""
    return F.when(dot.isNotNull(), F.acos(F.abs(F.greatest(F.least(dot, F.lit(1.0)), F.lit(-1.0)))))


def shade(d_row: Column, d_col: Column, azimuth: float = 315.0, angle_altitude: float = 45.0) -> Column:
    """Hillshade, 0 to 255, from the gradient."""
    slope = F.lit(math.pi / 2) - F.atan(F.sqrt(d_row * d_row + d_col * d_col))
    aspect = F.atan2(-d_row, d_col)
    az, alt = math.radians(azimuth), math.radians(angle_altitude)
    return (F.lit(math.sin(alt)) * F.sin(slope) + F.lit(math.cos(alt)) * F.cos(slope) * F.cos(F.lit(az) - aspect) + 1) * 255 / 2
