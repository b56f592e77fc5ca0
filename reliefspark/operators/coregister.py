"""Coregistration: the shift between two grids by the method of Nuth and Kääb (2011)."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reliefspark.functions.quantiles import quantile, quantiles
from reliefspark.grid import Grid, GridMeta, crop_offset
from reliefspark.operators.resample import reproject_grids, shifted
from reliefspark.operators.stencil import slope_aspect

#: Slices of aspect, and the slope below which a pixel tells nothing.
SLICES, LEAST_SLOPE, SIGMAS = 72, 0.001, 3

_methods: dict[str, Callable] = {}


def register(name: str):
    def add(f):
        _methods[name] = f
        return f

    return add


@dataclass(frozen=True)
class Transformation:
    """Offsets in pixels of the sampling grid; total ones in sec's own pixels, with the initial shift."""

    x_offset: float
    y_offset: float
    z_offset: float
    initial_shift_x: float = 0.0
    initial_shift_y: float = 0.0
    adapting_factor: tuple[float, float] = (1.0, 1.0)

    @property
    def total_offset_x(self) -> float:
        return self.x_offset * self.adapting_factor[0] + self.initial_shift_x

    @property
    def total_offset_y(self) -> float:
        return self.y_offset * self.adapting_factor[1] + self.initial_shift_y

    def apply(self, grid: Grid) -> Grid:
        """The grid moved by the total offsets; heights stay."""
        return grid.with_df(grid.df, transform=grid.meta.translated(self.total_offset_x, self.total_offset_y).transform)


@dataclass(frozen=True)
class Coregistered:
    sec: Grid
    ref: Grid
    transformation: Transformation
    results: dict
    reproj_sec: Grid
    reproj_ref: Grid
    coreg_sec: Grid
    history: tuple = ()

    def fit_table(self) -> DataFrame:
        """iteration, slice, aspect (the slice's lower bound), n, median, fitted, east, north, c: the slices that each iteration fits, and its curve there."""
        schema = "iteration int, slice int, aspect double, n long, median double, fitted double, east double, north double, c double"
        return self.sec.df.sparkSession.createDataFrame(list(self.history), schema)


def slices(pixels: DataFrame) -> DataFrame:
    """slice, n, median: of dh / slope in each slice of aspect, without what lies beyond three deviations of its mean.

    pixels: dh, slope, aspect. Slices are open at both ends; empty ones have no row.
    """
    width = math.pi / 36
    t = pixels.filter(F.col("dh").isNotNull() & (F.col("slope") >= LEAST_SLOPE)).select(F.floor(F.col("aspect") / width).cast("int").alias("slice"), "aspect", (F.col("dh") / F.col("slope")).alias("t"))
    t = t.filter((F.col("aspect") > F.col("slice") * width) & (F.col("slice") < SLICES)).select("slice", "t").persist()
    try:
        spread = t.groupBy("slice").agg(F.avg("t").alias("m"), F.stddev_pop("t").alias("s"))  # SLICES rows
        inside = (F.col("t") >= F.col("m") - SIGMAS * F.col("s")) & (F.col("t") <= F.col("m") + SIGMAS * F.col("s"))
        kept = t.join(F.broadcast(spread), "slice").filter(inside).select("slice", "t").persist()
        counts = {r["slice"]: r["n"] for r in kept.groupBy("slice").agg(F.count("*").alias("n")).collect()}  # SLICES rows
        medians = quantiles(kept, ["slice"], [("median", F.col("t"), 0.5)])
        kept.unpersist()
    finally:
        t.unpersist()
    return pixels.sparkSession.createDataFrame([(k, n, medians[(k,)]["median"]) for k, n in sorted(counts.items())], "slice int, n long, median double")


def fit(rows: list[tuple[int, float]]) -> tuple[float, float, float]:
    """east, north, c of the least squares of north cos x + east sin x + c at the slices' lower bounds."""
    if len(rows) < 3:
        raise ValueError("fewer than three slices of aspect hold pixels")
    x = np.array([k for k, _ in rows]) * math.pi / 36
    north, east, c = np.linalg.lstsq(np.c_[np.cos(x), np.sin(x), np.ones(len(x))], np.array([v for _, v in rows]), rcond=None)[0]
    return float(east), float(north), float(c)


def pair(ref: Grid, sec: Grid) -> DataFrame:
    """row, col, z (of sec), r (of ref)."""
    return sec.z().join(ref.z().withColumnRenamed("z", "r"), ["row", "col"])


def offsets_of(pixels: DataFrame, meta: GridMeta, bias: float) -> DataFrame:
    """dh, slope, aspect of a pair's pixels: sec - (ref - bias), slope and aspect of sec."""
    return slope_aspect(Grid(pixels, meta)).select((F.col("z") - (F.col("r") - F.lit(bias))).alias("dh"), "slope", "aspect")


def bias_of(pixels: DataFrame) -> float:
    d = quantile(pixels, F.col("r") - F.col("z"), 0.5)
    if d is None:
        raise ValueError("the grids have no valid pixel in common")
    return d


@register("nuth_kaab_internal")
def nuth_kaab(sec: Grid, ref: Grid, iterations: int = 6, history: list | None = None) -> tuple[float, float, float, Grid, Grid]:
    """east, north, dz, and both grids moved together. Every iteration resamples the grids as given, so plans don't grow.

    history gets the rows of fit_table(), at most SLICES an iteration.

    The grids as given, and each iteration's pair of grids, are persisted while they are read several times.
    """
    base_ref, base_sec = Grid(ref.df.persist(), ref.meta, ref.labels), Grid(sec.df.persist(), sec.meta, sec.labels)
    x = y = 0.0
    now_ref, now_sec = base_ref, base_sec
    pixels = pair(now_ref, now_sec).persist()
    try:
        bias = bias_of(pixels)
        for k in range(iterations):
            rows = slices(offsets_of(pixels, now_sec.meta, bias)).collect()  # SLICES rows
            east, north, c = fit([(r["slice"], r["median"]) for r in rows])
            x, y = x + east, y + north
            if history is not None:
                angle = lambda r: r["slice"] * math.pi / 36
                history += [(k, r["slice"], angle(r), r["n"], r["median"], north * math.cos(angle(r)) + east * math.sin(angle(r)) + c, east, north, c) for r in rows]
            moved = Grid(shifted(base_ref, x, y, ("z", *base_ref.labels)), base_ref.meta, base_ref.labels)
            now_ref, now_sec = crop_offset(moved, x, y), crop_offset(base_sec, x, y)
            pixels.unpersist()
            pixels = pair(now_ref, now_sec).persist()
            bias = bias_of(pixels)
        dz = pixels.agg(F.avg(F.col("r") - F.col("z"))).first()[0]
    finally:
        pixels.unpersist()
        base_ref.df.unpersist()
        base_sec.df.unpersist()
    return x, y, dz, now_sec, now_ref


def counts(grid: Grid) -> dict:
    one = grid.df.agg(F.count("*").alias("n"), F.count("z").alias("v")).first()
    return {"nb_points": one["n"], "nb_valid_points": one["v"], "percentage_valid_points": round(one["v"] / one["n"], 5) if one["n"] else 0.0}


def translate_bounds(meta: GridMeta, y: float, x: float) -> dict:
    ul, lr = meta.coord(y, x), meta.coord(y + meta.nrows, x + meta.ncols)
    return {"ulx": round(ul[0], 5), "uly": round(ul[1], 5), "lrx": round(lr[0], 5), "lry": round(lr[1], 5)}


def coregister(sec: Grid, ref: Grid, method: str = "nuth_kaab_internal", iterations: int = 6, sampling_source: str = "sec", initial_shift_x: float = 0.0, initial_shift_y: float = 0.0) -> Coregistered:
    """Both grids on one grid of pixels, sec moved onto ref, and the results; KeyError for an unknown method."""
    if method not in _methods:
        raise KeyError(f"no coregistration method named {method}")
    sec_on, ref_on, factor = reproject_grids(sec, ref, initial_shift_x, initial_shift_y, sampling_source)
    history: list = []
    east, north, dz, moved_sec, moved_ref = _methods[method](sec_on, ref_on, iterations, history)
    t = Transformation(east, -north, dz, initial_shift_x, initial_shift_y, factor)
    bias = lambda v, res: {"total_bias_value": round(v * res, 5), "unit_bias_value": "m"}
    results = {
        "dx": {"nuth_offset": round(t.x_offset, 5), "total_offset": round(t.total_offset_x, 5), "unit_offset": "px", **bias(t.total_offset_x, sec.meta.xres)},
        "dy": {"nuth_offset": round(t.y_offset, 5), "total_offset": round(t.total_offset_y, 5), "unit_offset": "px", **bias(t.total_offset_y, abs(sec.meta.yres))},
        "dz": {"total_bias_value": round(dz, 5) if dz is not None else None, "unit_bias_value": "m"},
        "gdal_translate_bounds": translate_bounds(sec.meta, t.total_offset_y, t.total_offset_x),
        "reproj_coreg_ref": counts(moved_ref), "reproj_coreg_sec": counts(moved_sec),
    }
    return Coregistered(moved_sec, moved_ref, t, results, sec_on, ref_on, t.apply(sec), tuple(history))
