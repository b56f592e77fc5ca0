"""Neighbourhood operators: each pixel with those beside it, by a window along rows and one along columns.

Edges are told by row and column numbers, so that a null neighbour is never taken for an edge.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reliefspark.functions.pixel import orthodromic, shade, x_of, y_of
from reliefspark.grid import Grid, GridMeta


def line(axis: str, parts: tuple[str, ...]) -> W:
    """The window along an axis."""
    return W.partitionBy(*parts, "row").orderBy("col") if axis == "col" else W.partitionBy(*parts, "col").orderBy("row")


def edge(axis: str, step: int, n: int, parts: tuple[str, ...] = ()) -> Column:
    """Whether a pixel has no neighbour on a side; the parts of a grid have edges of their own."""
    if parts:
        return (F.lag(axis) if step < 0 else F.lead(axis)).over(line(axis, parts)).isNull()
    return F.col(axis) == (0 if step < 0 else n - 1)


def beside(c: str, axis: str, step: int, n: int, parts: tuple[str, ...] = ()) -> Column:
    """The neighbour's value along an axis; at the edge, the pixel's own."""
    return F.when(edge(axis, step, n, parts), F.col(c)).otherwise((F.lag(c) if step < 0 else F.lead(c)).over(line(axis, parts)))


def sobel(grid: Grid) -> DataFrame:
    """df with gx, gy, edges replicated; the centre itself isn't read."""
    m, parts = grid.meta, grid.parts
    df = grid.df.withColumn("__l", beside("z", "col", -1, m.ncols, parts)).withColumn("__r", beside("z", "col", 1, m.ncols, parts))
    df = df.withColumn("__hd", F.col("__l") - F.col("__r")).withColumn("__hs", F.col("__l") + 2 * F.col("z") + F.col("__r"))
    for c in ("__hd", "__hs"):
        df = df.withColumn(f"{c}_u", beside(c, "row", -1, m.nrows, parts)).withColumn(f"{c}_d", beside(c, "row", 1, m.nrows, parts))
    df = df.withColumn("gx", F.col("__hd_u") + 2 * F.col("__hd") + F.col("__hd_d")).withColumn("gy", F.col("__hs_u") - F.col("__hs_d"))
    return df.select(*grid.df.columns, "gx", "gy")


def resolution(meta: GridMeta) -> tuple[Column, Column]:
    """Width and height of each pixel in metres."""
    if meta.is_projected:
        return F.lit(abs(meta.xres)), F.lit(abs(meta.yres))
    row, col = F.col("row"), F.col("col")
    k, j = F.greatest(col, F.lit(1)), F.greatest(row, F.lit(1))
    at = lambda r, c: (x_of(meta, r, c), y_of(meta, r, c))
    return orthodromic(*at(row, k), x_of(meta, row, k - 1), y_of(meta, row, k)), orthodromic(*at(j, col), x_of(meta, j, col), y_of(meta, j - 1, col))


def per(rise: Column, width: Column) -> Column:
    """A rise over a pixel's width, which is 0 at a pole: infinite there, null without a rise."""
    return F.when(width != 0, rise / width).when(rise != 0, F.lit(math.inf))


def slope(grid: Grid, degree: bool = False, unit_change: bool = True, name: str = "slope") -> Grid:
    """The grid with its slope: 100 x the angle in radians, in degrees, or in radians without unit_change.

    By longitude and latitude, a pixel too near a pole to have a width is upright where its heights differ along the row.
    """
    dx, dy = resolution(grid.meta)
    angle = F.atan(F.sqrt(F.pow(per(F.col("gx"), dx), 2) + F.pow(per(F.col("gy"), dy), 2)) / 8)
    angle = (F.degrees(angle) if degree else angle * 100) if unit_change else angle
    return grid.with_df(sobel(grid).withColumn(name, angle).drop("gx", "gy"))


def gradient(grid: Grid, z: Column | None = None) -> DataFrame:
    """df with d_row and d_col: half the difference of both neighbours, one-sided at edges."""
    m, parts = grid.meta, grid.parts
    df = grid.df.withColumn("__z", z if z is not None else F.col("z"))
    for axis, n in (("col", m.ncols), ("row", m.nrows)):
        width = F.when(edge(axis, -1, n, parts) | edge(axis, 1, n, parts), 1.0).otherwise(2.0)
        df = df.withColumn(f"d_{axis}", (beside("__z", axis, 1, n, parts) - beside("__z", axis, -1, n, parts)) / width)
    return df.drop("__z")


def slope_aspect(grid: Grid) -> DataFrame:
    """df with the gradient's length (slope) and direction (aspect, 0 to 2 pi)."""
    df = gradient(grid)
    return df.withColumn("slope", F.sqrt(F.col("d_col") * F.col("d_col") + F.col("d_row") * F.col("d_row"))).withColumn("aspect", F.atan2(-F.col("d_col"), F.col("d_row")) + math.pi).drop("d_col", "d_row")


def normals(grid: Grid, dx: float | None = None, dy: float | None = None) -> DataFrame:
    """df with the unit normal n_x, n_y, n_z."""
    dx, dy = dx or grid.meta.xres, dy or grid.meta.yres
    df = gradient(grid).withColumn("__x", -F.col("d_col") / abs(dx)).withColumn("__y", -F.col("d_row") / abs(dy))
    norm = F.sqrt(F.col("__x") * F.col("__x") + F.col("__y") * F.col("__y") + 1)
    return df.select(*grid.df.columns, (F.col("__x") / norm).alias("n_x"), (F.col("__y") / norm).alias("n_y"), (1 / norm).alias("n_z"))


def orientation(grid: Grid, dx: float | None = None, dy: float | None = None) -> DataFrame:
    """df with the normal's direction from north, 0 to 2 pi."""
    angle = F.atan2("n_x", -F.col("n_y"))
    return normals(grid, dx, dy).withColumn("orientation", F.when(angle < 0, angle + 2 * math.pi).otherwise(angle)).drop("n_x", "n_y", "n_z")


def hillshade(grid: Grid, azimuth: float = 315.0, angle_altitude: float = 45.0) -> DataFrame:
    """row, col, z: 0 to 255, null where the grid has no data."""
    df = gradient(grid)
    return df.select("row", "col", F.when(F.col("z").isNotNull(), shade(F.col("d_row"), F.col("d_col"), azimuth, angle_altitude)).alias("z"))


def waveform(grid: Grid) -> DataFrame:
    """row, col, row_wave (height over its column's mean), col_wave (over its row's)."""
    return grid.df.select("row", "col", (F.col("z") - F.avg("z").over(W.partitionBy("col"))).alias("row_wave"), (F.col("z") - F.avg("z").over(W.partitionBy("row"))).alias("col_wave"))
