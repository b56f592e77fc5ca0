"""Tiles that overlap: which pixels they hold, the statistics of these, and the shift of each tile."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reliefspark.grid import Grid, GridMeta, crop_offset_ranges
from reliefspark.functions import metrics
from reliefspark.functions.order_stats import few
from reliefspark.operators import classify, stats
from reliefspark.operators.coregister import LEAST_SLOPE, SIGMAS, SLICES, fit, pair
from reliefspark.sources.scratch import written

TILE = ("tile_row", "tile_col")


def check(height: int, width: int, overlap: int) -> None:
    if height <= 0 or width <= 0:
        raise ValueError("height and width of a tile must be positive")
    if overlap < 0 or overlap >= min(height, width):
        raise ValueError("the overlap must be at least 0 and less than a tile")


def tile_counts(meta: GridMeta, height: int, width: int, overlap: int) -> tuple[int, int]:
    return tuple(max(1, math.ceil((n - overlap) / (t - overlap))) for n, t in ((meta.nrows, height), (meta.ncols, width)))


def assign(df: DataFrame, meta: GridMeta, height: int, width: int, overlap: int = 0) -> DataFrame:
    """df with tile_row, tile_col, a row for each tile that holds the pixel."""
    check(height, width, overlap)
    counts = tile_counts(meta, height, width, overlap)
    for axis, n, size in (("row", counts[0], height), ("col", counts[1], width)):
        step = size - overlap
        first = F.greatest(F.lit(0).cast("long"), F.ceil((F.col(axis) - size + 1) / step))
        last = F.least(F.lit(n - 1).cast("long"), F.floor(F.col(axis) / step))
        df = df.withColumn(f"tile_{axis}", F.explode(F.sequence(first, last)))
    return df


def all_tiles(grid: Grid, height: int, width: int, overlap: int = 0) -> DataFrame:
    nr, nc = tile_counts(grid.meta, height, width, overlap)
    rows = grid.df.sparkSession.range(nr).select(F.col("id").alias("tile_row"))
    return rows.withColumn("tile_col", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(nc - 1).cast("long"))))


def tile_stats(grid: Grid, height: int, width: int, overlap: int = 0) -> DataFrame:
    """tile_row, tile_col, nb_points, pct_valid, mean, median of every tile."""
    t = assign(grid.df.select("row", "col", "z"), grid.meta, height, width, overlap).groupBy("tile_row", "tile_col")
    s = t.agg(F.count("*").alias("nb_points"), (F.count("z") * 100.0 / F.count("*")).alias("pct_valid"), F.avg("z").alias("mean"), F.median("z").alias("median"))
    return all_tiles(grid, height, width, overlap).join(s, ["tile_row", "tile_col"], "left")


def stats_by_tile(grid: Grid, layer: classify.Layer, height: int, width: int, overlap: int = 0, chosen: tuple[str, ...] = metrics.DEFAULT, remove_outliers: bool | dict = False) -> DataFrame:
    """tile_row, tile_col and the statistics by mode and class of every tile."""
    tiled = Grid(assign(grid.df, grid.meta, height, width, overlap), grid.meta, grid.labels, TILE)
    return stats.part_stats(tiled, layer, all_tiles(grid, height, width, overlap), chosen, remove_outliers, height * width)


def sampled(z: np.ndarray, x: float, y: float) -> np.ndarray:
    """z at (row - y, col + x), bilinear, clamped; missing where a pixel with weight is."""
    out = np.zeros_like(z)
    at = []
    for n, shift in zip(z.shape, (-y, x)):
        v = np.clip(np.arange(n) + shift, 0, n - 1)
        at.append((np.floor(v).astype(int), v - np.floor(v)))
    (r, wr), (c, wc) = at
    for dr in (0, 1):
        for dc in (0, 1):
            w = (wr if dr else 1 - wr)[:, None] * (wc if dc else 1 - wc)[None]
            part = z[np.minimum(r + dr, z.shape[0] - 1)][:, np.minimum(c + dc, z.shape[1] - 1)]
            out += np.where(w > 0, w * part, 0.0)
    return out


def shift_of(ref: np.ndarray, sec: np.ndarray, iterations: int) -> tuple[float, float, float, float, float]:
    """dx, dy, dz and the valid shares (percent) of ref and sec of one tile, by the steps of coregister.nuth_kaab; ValueError if it has none."""
    x = y = 0.0
    a, b = ref, sec
    for k in range(iterations + 1):
        d = a - b
        if not np.isfinite(d).any():
            raise ValueError("the tile has no valid pixel in common")
        if k == iterations or min(b.shape) < 2:
            break
        d_row, d_col = np.gradient(b)
        slope, aspect = np.hypot(d_row, d_col), np.arctan2(-d_col, d_row) + math.pi
        t = (np.nanmedian(d) - d) / np.where(slope >= LEAST_SLOPE, slope, np.nan)
        cell = np.floor(aspect / (math.pi / 36))
        ok = np.isfinite(t) & (aspect > cell * (math.pi / 36)) & (cell < SLICES)
        rows = []
        for s in np.unique(cell[ok]):
            v = t[ok & (cell == s)]
            v = v[abs(v - v.mean()) <= SIGMAS * v.std()]
            if len(v):
                rows.append((int(s), float(np.median(v))))
        east, north, _ = fit(rows)
        x, y = x + east, y + north
        (r0, r1), (c0, c1) = crop_offset_ranges(*ref.shape, x, y)
        if r0 >= r1 or c0 >= c1:
            raise ValueError("the tile's shift leaves it")
        a, b = sampled(ref, x, y)[r0:r1, c0:c1], sec[r0:r1, c0:c1]
    return x, -y, float(np.nanmean(d)), 100.0 * float(np.isfinite(a).mean()), 100.0 * float(np.isfinite(b).mean())


def tile_shifts(ref: Grid, sec: Grid, height: int, width: int, overlap: int = 0, iterations: int = 6) -> DataFrame:
    """tile_row, tile_col, dx, dy, dz, pct_valid_ref, pct_valid_sec of every tile of two grids on one grid of pixels.

    A tile is one task's; its size is a setting, whatever the grid's. Tiles that can't be fitted are null.
    """
    pixels = pair(ref, sec)

    def one(key, pdf):
        pdf = pdf.sort_values(["row", "col"])
        shape = pdf["row"].nunique(), pdf["col"].nunique()
        try:
            found = shift_of(pdf["r"].to_numpy(float).reshape(shape), pdf["z"].to_numpy(float).reshape(shape), iterations)
        except ValueError:
            found = (None,) * 5
        return pd.DataFrame([(*key, *found)], columns=["tile_row", "tile_col", "dx", "dy", "dz", "pct_valid_ref", "pct_valid_sec"])

    schema = "tile_row long, tile_col long, dx double, dy double, dz double, pct_valid_ref double, pct_valid_sec double"
    found = assign(pixels, sec.meta, height, width, overlap).groupBy("tile_row", "tile_col").applyInPandas(one, schema)
    return all_tiles(sec, height, width, overlap).join(found, ["tile_row", "tile_col"], "left")


def tile_grids(ref: Grid, sec: Grid, shifts: DataFrame, height: int, width: int, overlap: int = 0) -> tuple[Grid, Grid]:
    """ref and sec of every tile after its coregistration, as grids in parts: ref moved by the tile's shift, both cropped to what it leaves.

    shifts: tile_row, tile_col, dx, dy of tile_shifts(); tiles of a null shift have no pixels. Rows and columns stay those of
    the whole grid. Labels go along, ref's resampled like its heights. A tile is one task's.
    """
    a, b = [f"__a{i}" for i in range(len(ref.labels))], [f"__b{i}" for i in range(len(sec.labels))]
    of_ref = ref.df.select("row", "col", F.col("z").alias("r"), *[F.col(c).cast("double").alias(n) for c, n in zip(ref.labels, a)])
    pixels = sec.df.select("row", "col", "z", *[F.col(c).cast("double").alias(n) for c, n in zip(sec.labels, b)]).join(of_ref, ["row", "col"])
    shift = few(written(shifts.filter("dx is not null").select(*TILE, "dx", "dy"), "shifts"))
    values = ["z", *b, "r", *a]

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["row", "col"])
        rows, cols = np.unique(pdf["row"]), np.unique(pdf["col"])
        x, y = float(pdf["dx"].iloc[0]), -float(pdf["dy"].iloc[0])
        (r0, r1), (c0, c1) = crop_offset_ranges(len(rows), len(cols), x, y)
        cut = lambda c: pdf[c].to_numpy(float).reshape(len(rows), len(cols))
        found = {c: (sampled(cut(c), x, y) if c in ("r", *a) else cut(c))[r0:r1, c0:c1].ravel() for c in values}
        place = {"row": np.repeat(rows[r0:r1], c1 - c0), "col": np.tile(cols[c0:c1], r1 - r0)}
        return pd.DataFrame({**{t: np.full(len(place["row"]), pdf[t].iloc[0]) for t in TILE}, **place, **found})

    schema = "tile_row long, tile_col long, row long, col long, " + ", ".join(f"{c} double" for c in values)
    df = assign(pixels, sec.meta, height, width, overlap).join(shift, list(TILE)).groupBy(*TILE).applyInPandas(one, schema)
    none = F.lit(None).cast("double")
    df = written(df.withColumns({c: F.nanvl(c, none) for c in values}), "tile-grids")
    moved = Grid(df.select(*TILE, "row", "col", F.col("r").alias("z"), *[F.col(n).alias(c) for c, n in zip(ref.labels, a)]), sec.meta, ref.labels, TILE)
    return moved, Grid(df.select(*TILE, "row", "col", "z", *[F.col(n).alias(c) for c, n in zip(sec.labels, b)]), sec.meta, sec.labels, TILE)
