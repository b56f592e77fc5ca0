"""Alignment of grids: resampling by joins on pixel keys."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reliefspark.functions.projection import moved, moved_box
from reliefspark.grid import Grid, GridMeta, box_intersection, crop, crop_box


#: A squared distance beyond all others.
FAR = 2**62


def keyed(points: DataFrame) -> DataFrame:
    """points (row, col, __r, __c) with keys for those that lie nowhere, too: below 0, where no grid has pixels, and not one key for all, which one task would get."""
    return points.withColumns({"__r": F.coalesce("__r", -1 - F.col("row")), "__c": F.coalesce("__c", -1 - F.col("col"))})


def sample_at(points: DataFrame, grid: Grid, interp: str = "bilinear", values: tuple[str, ...] = ("z",)) -> DataFrame:
    """row, col and each value of the grid at points (row, col, fx, fy): fractional column fx and row fy, null for none.

    Bilinear: positions clamp to the grid; a result is null if a pixel with weight is. Nearest: null outside. One join and
    one aggregation serve all values.
    """
    m = grid.meta
    cells = grid.df.select(F.col("row").alias("__r"), F.col("col").alias("__c"), *[F.col(v).alias(f"__{v}") for v in values])
    if interp == "nearest":
        at = points.withColumn("__r", F.floor(F.col("fy") + 0.5)).withColumn("__c", F.floor(F.col("fx") + 0.5))
        return keyed(at).join(cells, ["__r", "__c"], "left").select("row", "col", *[F.col(f"__{v}").alias(v) for v in values])
    clamp = lambda c, n: F.when(F.col(c).isNotNull(), F.least(F.greatest(F.col(c), F.lit(0.0)), F.lit(float(n - 1))))
    p = points.select("row", "col", clamp("fx", m.ncols).alias("fx"), clamp("fy", m.nrows).alias("fy"))
    p = p.withColumn("c0", F.floor("fx")).withColumn("r0", F.floor("fy")).withColumn("wx", F.col("fx") - F.col("c0")).withColumn("wy", F.col("fy") - F.col("r0"))
    corner = lambda dr, dc, w: F.struct((F.col("r0") + dr).alias("__r"), (F.col("c0") + dc).alias("__c"), w.alias("w"))
    wx, wy = F.col("wx"), F.col("wy")
    corners = F.array(corner(0, 0, (1 - wx) * (1 - wy)), corner(0, 1, wx * (1 - wy)), corner(1, 0, (1 - wx) * wy), corner(1, 1, wx * wy))
    near = p.select("row", "col", F.explode_outer(F.filter(corners, lambda x: x["w"] > 0)).alias("k")).select("row", "col", "k.*")
    sums = [F.when((F.count(f"__{v}") == F.count("w")) & (F.count("w") > 0), F.sum(F.col("w") * F.col(f"__{v}"))).alias(v) for v in values]
    return keyed(near).join(cells, ["__r", "__c"], "left").groupBy("row", "col").agg(*sums)


def shifted(grid: Grid, x: float, y: float, values: tuple[str, ...] = ("z",)) -> DataFrame:
    """row, col and each value at (row - y, col + x), bilinear, clamped to the grid; null where a pixel with weight is.

    The shift is one for all pixels, so each pixel knows which it adds to: one exchange, of a few rows a pixel.
    """
    m = grid.meta
    (dr, wy), (dc, wx) = ((math.floor(v), v - math.floor(v)) for v in (-y, x))
    r, c = F.col("row"), F.col("col")

    # a target's position clamps; all targets beyond an edge read the edge, so edges send to a range of targets
    def senders(axis, n, d, w):
        """Targets of a source pixel along an axis, as an array of (target, weight)."""
        at = F.col(axis)
        inner = [F.struct((at - d - k).alias("t"), F.lit(wt).alias("w")) for k, wt in ((0, 1 - w), (1, w)) if wt > 0]
        inside = F.filter(F.array(*inner), lambda s: (s["t"] >= 0) & (s["t"] < n) & (s["t"] + F.lit(d + w) >= 0) & (s["t"] + F.lit(d + w) <= n - 1))
        # targets t with t + d + w < 0 read source 0, those with t + d + w > n - 1 read source n - 1
        low = min(n, max(0, math.ceil(-(d + w))))
        high = max(0, min(n, math.floor(n - 1 - (d + w)) + 1))
        span = lambda a, b: F.transform(F.sequence(F.lit(a).cast("long"), F.lit(b).cast("long")), lambda t: F.struct(t.alias("t"), F.lit(1.0).alias("w")))
        if low > 0:
            inside = F.when(at == 0, F.concat(inside, span(0, low - 1))).otherwise(inside)
        if high < n:
            inside = F.when(at == n - 1, F.concat(inside, span(high, n - 1))).otherwise(inside)
        return inside

    df = grid.df.select(r, c, *values)
    df = df.withColumn("kr", F.explode(senders("row", m.nrows, dr, wy))).withColumn("kc", F.explode(senders("col", m.ncols, dc, wx)))
    w = F.col("kr.w") * F.col("kc.w")
    sums = [F.when(F.count(v) == F.count("*"), F.sum(w * F.col(v))).alias(v) for v in values]
    return df.groupBy(F.col("kr.t").alias("row"), F.col("kc.t").alias("col")).agg(*sums)


def places(df: DataFrame, meta: GridMeta, grid: GridMeta) -> DataFrame:
    """df with px, py: fractional columns and rows, in another grid, of points that df's columns px, py hold in pixels of meta.

    Between coordinate systems the points are projected; where that can't be done they are null.
    """
    c, a, b, f, d, e = meta.transform
    gc, ga, gb, gf, gd, ge = grid.transform
    px, py, det = F.col("px"), F.col("py"), ga * ge - gb * gd
    df = df.withColumns({"px": F.lit(c) + F.lit(a) * px + F.lit(b) * py, "py": F.lit(f) + F.lit(d) * px + F.lit(e) * py})
    df = moved(df, "px", "py", meta.crs, grid.crs)
    df = df.withColumns({"px": F.nanvl(px, F.lit(None).cast("double")) - gc, "py": F.nanvl(py, F.lit(None).cast("double")) - gf})
    return df.withColumns({"px": (px * ge - py * gb) / det, "py": (py * ga - px * gd) / det})


def same_pixels(grid: Grid, onto: Grid) -> tuple[int, int] | None:
    """Row and column in the grid of onto's first pixel, if onto's pixels are pixels of the grid; else None."""
    m, o = grid.meta, onto.meta
    if m.crs != o.crs or any(m.transform[k] != o.transform[k] for k in (1, 2, 4, 5)):
        return None
    r, c = m.pixel(*o.coord(0, 0))
    inside = r == math.floor(r) and c == math.floor(c) and 0 <= r <= m.nrows - o.nrows and 0 <= c <= m.ncols - o.ncols
    return (int(r), int(c)) if inside else None


def reproject(grid: Grid, onto: Grid, interp: str = "bilinear") -> Grid:
    """grid resampled at the centres of onto's pixels, with its labels resampled likewise.

    Grids of different coordinate systems are warped: the centres are projected into the grid's system. Pixels whose centre
    lies outside the grid are null. An unknown interpolation counts as bilinear. Where onto's pixels are pixels of the grid,
    all weights are 1 and the grid is only cropped.
    """
    interp = interp if interp in ("bilinear", "nearest") else "bilinear"
    if first := same_pixels(grid, onto):
        own = crop(grid, (first[0], first[0] + onto.meta.nrows), (first[1], first[1] + onto.meta.ncols)).df
        values = [F.col(v) if interp == "nearest" else F.col(v).cast("double").alias(v) for v in ("z", *grid.labels)]
        return Grid(own.select("row", "col", *values), onto.meta, grid.labels)
    at = places(onto.df.select("row", "col", (F.col("col") + 0.5).alias("px"), (F.col("row") + 0.5).alias("py")), onto.meta, grid.meta)
    inside = (F.col("px") >= 0) & (F.col("py") >= 0) & (F.col("px") <= grid.meta.ncols) & (F.col("py") <= grid.meta.nrows)
    points = at.select("row", "col", F.when(inside, F.col("px") - 0.5).alias("fx"), F.when(inside, F.col("py") - 0.5).alias("fy"))
    return Grid(sample_at(points, grid, interp, ("z", *grid.labels)), onto.meta, grid.labels)


def pixel_factor(static: Grid, other: GridMeta) -> tuple[float, float]:
    """Columns and rows of `other` that one column and one row of `static` make; across coordinate systems, amid the static grid."""
    m = static.meta
    if m.crs == other.crs:
        return abs(m.xres / other.xres), abs(m.yres / other.yres)
    x, y = m.ncols / 2, m.nrows / 2
    points = static.df.sparkSession.createDataFrame([(0, x, y), (1, x + 1, y), (2, x, y + 1)], "k int, px double, py double")
    p = {r["k"]: r for r in places(points, m, other).collect()}  # three points
    return math.hypot(p[1]["px"] - p[0]["px"], p[1]["py"] - p[0]["py"]), math.hypot(p[2]["px"] - p[0]["px"], p[2]["py"] - p[0]["py"])


def reproject_grids(sec: Grid, ref: Grid, shift_x: float = 0.0, shift_y: float = 0.0, sampling_source: str = "sec", interp: str = "bilinear") -> tuple[Grid, Grid, tuple[float, float]]:
    """(sec, ref, adapting factor): both on the sampling source's pixels and system within their common bounds.

    The other grid is first moved by the initial shift; the factor scales offsets in pixels back to sec's own pixels.
    """
    static, other = (sec, ref) if sampling_source == "sec" else (ref, sec)
    bounds = moved_box(static.df.sparkSession, other.meta.bounds(), other.meta.crs, static.meta.crs)
    static = crop_box(static, box_intersection(static.meta.bounds(), bounds))
    if shift_x or shift_y:
        other = other.with_df(other.df, transform=other.meta.translated(shift_x, shift_y).transform)
    moved_ = reproject(other, static, interp)
    return (static, moved_, (1.0, 1.0)) if sampling_source == "sec" else (moved_, static, pixel_factor(static, sec.meta))


#: Pixels of the lines that a task fills together; a longer line is alone.
PIXELS = 262_144


def envelope(rows: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(cols, low, high, top) of lines whose pixels know the row of their column's nearest valid pixel (found; -1: none).

    The squared distances from a line's pixels to one column's pixel are a parabola; the lower envelope of all of them is a
    stack of columns, each at least as near as its neighbours from `low` to `high`. Parabolas that only touch it stay, for
    ties. All lines are worked on at once, and each column comes and goes once: time is in proportion to pixels.
    """
    height, width = found.shape
    cols, low, high = (np.zeros((height, width), np.int64) for _ in range(3))
    top = np.full(height, -1)
    down = np.where(found >= 0, found - rows[:, None], 0) ** 2 + np.arange(width) ** 2
    for q in range(width):
        line = np.flatnonzero(found[:, q] >= 0)
        start = np.full(len(line), -FAR)
        todo = np.flatnonzero(top[line] >= 0)
        while len(todo):
            at = line[todo]
            t = top[at]
            p = cols[at, t]
            rise, run = down[at, q] - down[at, p], 2 * (q - p)
            end = rise // run  # p is as near as q up to here, and q as p from the next whole place on
            gone = low[at, t] > end
            high[at, t] = end
            start[todo] = -(-rise // run)
            top[at[gone]] -= 1
            start[todo[gone]] = -FAR
            todo = todo[gone][top[at[gone]] >= 0]
        top[line] += 1
        t = top[line]
        cols[line, t], low[line, t], high[line, t] = q, start, FAR
    return cols, low, high, top


def filled_lines(rows: np.ndarray, found: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Values of lines (the last axis) whose pixels know the nearest valid pixel of their column: its row (-1: none) and value.

    Of equally near pixels, that of the least row, then column.
    """
    height, width = found.shape
    cols, low, high, top = envelope(rows, found)
    out, every = np.full(values.shape, np.nan), np.flatnonzero(top >= 0)
    now = np.zeros(height, np.int64)
    for c in range(width):
        todo = every[high[every, now[every]] < c]
        while len(todo):
            now[todo] += 1
            todo = todo[high[todo, now[todo]] < c]
        best, k = cols[every, now[every]], now[every] + 1
        tied = np.flatnonzero(k <= top[every])
        tied = tied[low[every[tied], k[tied]] <= c]
        while len(tied):
            at = every[tied]
            other = cols[at, k[tied]]
            nearer = found[at, other] < found[at, best[tied]]  # columns ascend in the stack
            best[tied[nearer]] = other[nearer]
            k[tied] += 1
            tied = tied[k[tied] <= top[at]]
            tied = tied[low[every[tied], k[tied]] <= c]
        out[every, c] = values[every, best]
    return out


def nearest_fill(grid: Grid) -> DataFrame:
    """row, col, z: missing pixels take the nearest valid one's value, of equally near ones that of least (row, col).

    Two passes over lines, each keyed by line: windows along columns find every pixel's nearest valid one of its column,
    and along rows the lower envelope of their distances tells which column has each pixel's nearest. A task holds a few
    rows, never the grid, and works in proportion to its pixels, however wide the holes.
    """
    m = grid.meta
    valid = F.when(F.col("z").isNotNull(), F.struct("row", "z"))
    to_here = lambda order: W.partitionBy("col").orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    d = grid.df.select("row", "col", F.last(valid, True).over(to_here(F.col("row"))).alias("above"), F.last(valid, True).over(to_here(F.col("row").desc())).alias("below"))
    near = F.when(F.col("below").isNull() | (F.col("row") - F.col("above.row") <= F.col("below.row") - F.col("row")), F.col("above")).otherwise(F.col("below"))
    d = d.withColumn("near", near).select("row", "col", F.coalesce("near.row", F.lit(-1).cast("long")).alias("found"), F.col("near.z").alias("v"))

    def lines(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["row", "col"])
        shape = (-1, m.ncols)
        z = filled_lines(pdf["row"].to_numpy(np.int64)[:: m.ncols], pdf["found"].to_numpy(np.int64).reshape(shape), pdf["v"].to_numpy(float).reshape(shape))
        return pd.DataFrame({"row": pdf["row"], "col": pdf["col"], "z": z.ravel()})

    block = F.floor(F.col("row") / max(1, PIXELS // m.ncols))
    filled = d.groupBy(block.alias("block")).applyInPandas(lines, "row long, col long, z double")
    return filled.withColumn("z", F.nanvl("z", F.lit(None).cast("double")))
