"""Grids: a DataFrame of one row a pixel, and what is known about all its pixels."""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NODATA = -32768.0
#: Metres in a unit of length.
UNITS = {"m": 1.0, "dm": 0.1, "cm": 0.01, "mm": 0.001, "km": 1000.0, "ft": 0.3048, "inch": 0.0254, "yd": 0.9144, "mi": 1609.344}
#: Codes of geographic systems; all others are taken as projected.
GEOGRAPHIC = frozenset({"EPSG:4326", "EPSG:4979", "EPSG:4258", "EPSG:4269"})


@dataclass(frozen=True)
class GridMeta:
    """Size, affine transform (x0, xres, xrot, y0, yrot, yres) and coordinate system of a grid."""

    nrows: int
    ncols: int
    transform: tuple[float, float, float, float, float, float] = (0.0, 1.0, 0.0, 0.0, 0.0, 1.0)
    crs: str = "EPSG:4326"
    nodata: float = NODATA
    zunit: str = "m"
    name: str = ""

    @property
    def is_projected(self) -> bool:
        return self.crs not in GEOGRAPHIC

    @property
    def xres(self) -> float:
        return self.transform[1]

    @property
    def yres(self) -> float:
        return self.transform[5]

    def coord(self, row: float, col: float) -> tuple[float, float]:
        """x, y of a pixel's corner; rows and columns may be fractions."""
        c, a, b, f, d, e = self.transform
        return c + a * col + b * row, f + d * col + e * row

    def pixel(self, x: float, y: float) -> tuple[float, float]:
        """Row and column of a point."""
        c, a, b, f, d, e = self.transform
        det = a * e - b * d
        return (a * (y - f) - d * (x - c)) / det, (e * (x - c) - b * (y - f)) / det

    def bounds(self) -> dict[str, float]:
        x, y = zip(self.coord(0, 0), self.coord(self.nrows, self.ncols))
        return {"left": min(x), "bottom": min(y), "right": max(x), "top": max(y)}

    def translated(self, x_off: float, y_off: float) -> GridMeta:
        """The grid moved by pixels; its pixels stay as they are."""
        c, a, b, f, d, e = self.transform
        x, y = self.coord(y_off, x_off)
        return replace(self, transform=(x, a, b, y, d, e))


@dataclass(frozen=True)
class Grid:
    """df holds row, col, z (null: no data) and label columns; every cell has a row.

    parts names columns that tell independent grids apart, such as tiles: rectangles of pixels with edges of their own.
    """

    df: DataFrame
    meta: GridMeta
    labels: tuple[str, ...] = field(default=())
    parts: tuple[str, ...] = field(default=())

    def with_df(self, df: DataFrame, **meta) -> Grid:
        return Grid(df, replace(self.meta, **meta) if meta else self.meta, self.labels, self.parts)

    def z(self) -> DataFrame:
        return self.df.select("row", "col", "z")


def create_grid(df: DataFrame, meta: GridMeta | None = None, nodata: float | None = None, zunit: str = "m", labels: tuple[str, ...] = (), **meta_values) -> Grid:
    """A grid from rows (row, col, z, labels): no-data and NaN become null, heights become metres.

    No-data is the argument, else the metadata's, else NODATA. Without metadata the size is read from the rows.
    """
    if zunit not in UNITS:
        raise ValueError(f"zunit {zunit} is not a length unit")
    if meta is None:
        size = df.agg(F.max("row").alias("r"), F.max("col").alias("c")).first()
        if size["r"] is None:
            raise ValueError("the grid has no pixels")
        meta = GridMeta(size["r"] + 1, size["c"] + 1, **meta_values)
    nodata = nodata if nodata is not None else meta.nodata
    z = F.nanvl(F.col("z").cast("double"), F.lit(None).cast("double"))
    z = F.when(z != F.lit(float(nodata)), z * F.lit(UNITS[zunit]) if UNITS[zunit] != 1 else z)
    return Grid(df.select("row", "col", z.alias("z"), *labels), replace(meta, nodata=float(nodata), zunit="m"), labels)


def check_has_data(grid: Grid) -> Grid:
    """The grid, unless all its pixels are null."""
    if not grid.df.filter("z is not null").take(1):
        raise ValueError("all pixels are no data")
    return grid


def box_intersection(a: dict, b: dict) -> dict:
    """The common part of two boxes; NameError if there is none."""
    if a["left"] > b["right"] or a["right"] < b["left"] or a["bottom"] > b["top"] or a["top"] < b["bottom"]:
        raise NameError("the bounds have no part in common")
    return {"left": max(a["left"], b["left"]), "bottom": max(a["bottom"], b["bottom"]), "right": min(a["right"], b["right"]), "top": min(a["top"], b["top"])}


def roi_bounds(meta: GridMeta, roi: dict | None) -> dict:
    """The bounds that a region of interest, in terrain or image coordinates, leaves."""
    if not roi:
        return meta.bounds()
    if set(roi) == {"left", "bottom", "right", "top"}:
        return dict(roi)
    if set(roi) == {"x", "y", "w", "h"}:
        corners = meta.coord(roi["y"], roi["x"]), meta.coord(roi["y"] + roi["h"], roi["x"] + roi["w"])
        x, y = zip(*corners)
        return {"left": min(x), "bottom": min(y), "right": max(x), "top": max(y)}
    raise TypeError("a region of interest has left, bottom, right, top or x, y, w, h")


def counted_from(df: DataFrame, row: int, col: int) -> DataFrame:
    """Rows and columns counted from a pixel. Those that stay are the same columns, so that joins by pixel know how df is dealt."""
    return df.withColumns({c: F.col(c) - first for c, first in (("row", row), ("col", col)) if first})


def crop(grid: Grid, rows: tuple[int, int], cols: tuple[int, int]) -> Grid:
    """Rows and columns of the half-open ranges, counted anew; the filter reaches the scan."""
    (r0, r1), (c0, c1) = rows, cols
    inside = grid.df.filter((F.col("row") >= r0) & (F.col("row") < r1) & (F.col("col") >= c0) & (F.col("col") < c1))
    df = counted_from(inside, r0, c0)
    return grid.with_df(df, nrows=max(0, r1 - r0), ncols=max(0, c1 - c0), transform=grid.meta.translated(c0, r0).transform)


def box_ranges(m: GridMeta, box: dict) -> tuple[tuple[int, int], tuple[int, int]]:
    """Rows and columns, as half-open ranges, of all pixels that the box touches."""
    points = [m.pixel(x, y) for x in (box["left"], box["right"]) for y in (box["bottom"], box["top"])]
    r0, c0 = (max(0, math.floor(min(p[k] for p in points) + 1e-9)) for k in (0, 1))
    r1, c1 = (min(n, math.ceil(max(p[k] for p in points) - 1e-9)) for k, n in ((0, m.nrows), (1, m.ncols)))
    if r0 >= r1 or c0 >= c1:
        raise ValueError("the region of interest lies outside the grid")
    return (r0, r1), (c0, c1)


def crop_box(grid: Grid, box: dict) -> Grid:
    """All pixels that the box touches."""
    return crop(grid, *box_ranges(grid.meta, box))


def crop_offset_ranges(nrows: int, ncols: int, x: float, y: float) -> tuple[tuple[int, int], tuple[int, int]]:
    """Rows and columns that stay after a shift: none are invented at the side that it leaves."""
    cols = (0, ncols - math.ceil(x)) if x >= 0 else (math.floor(-x), ncols)
    rows = (0, nrows - math.ceil(-y)) if -y >= 0 else (math.floor(y), nrows)
    return rows, cols


def crop_offset(grid: Grid, x: float, y: float) -> Grid:
    return crop(grid, *crop_offset_ranges(grid.meta.nrows, grid.meta.ncols, x, y))
