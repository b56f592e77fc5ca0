"""Spectral operators: curvature by a filter in the frequency domain.

The mirrored grid's Fourier transform is the grid's cosine transform, so the filter runs along rows, then along
columns; without mirroring, Fourier transforms do. A task holds a few rows or columns, never a grid.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reliefspark.functions.quantiles import quantiles as exact
from reliefspark.grid import Grid
from reliefspark.operators.resample import nearest_fill


#: Pixels of the lines that are transformed together; a longer line is alone.
PIXELS = 65_536


def cosine(x: np.ndarray) -> np.ndarray:
    """Unnormalised cosine transforms (type II) of lines (the last axis), by Fourier transforms of their mirror images."""
    n = x.shape[-1]
    return (np.fft.rfft(np.concatenate([x, x[..., ::-1]], -1))[..., :n] * np.exp(-0.5j * np.pi * np.arange(n) / n)).real


def inverse_cosine(c: np.ndarray) -> np.ndarray:
    n = c.shape[-1]
    spectrum = np.concatenate([c * np.exp(0.5j * np.pi * np.arange(n) / n), np.zeros((*c.shape[:-1], 1))], -1)
    return np.fft.irfft(spectrum, 2 * n)[..., :n]


def along(df: DataFrame, key: str, index: str, f, length: int) -> DataFrame:
    """f of each line: the values of one key in the order of the index. Lines have `length` values; short ones come to a task together."""

    def lines(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([key, index])
        return pdf.assign(z=f(pdf["z"].to_numpy().reshape(-1, length)).ravel())

    block = F.floor(F.col(key) / max(1, PIXELS // length))
    return df.select("row", "col", "z").groupBy(block.alias("block")).applyInPandas(lines, "row long, col long, z double")


def filtered(grid: Grid, filter_intensity: float = 0.9) -> DataFrame:
    """row, col, z of the grid, missing pixels filled, with each frequency times its length to the given power."""
    m = grid.meta
    spectrum = along(along(nearest_fill(grid), "row", "col", cosine, m.ncols), "col", "row", cosine, m.nrows)
    length = F.pow(F.pow(F.col("row") * np.pi / m.nrows, 2) + F.pow(F.col("col") * np.pi / m.ncols, 2), filter_intensity / 2)
    return along(along(spectrum.withColumn("z", F.col("z") * length), "col", "row", inverse_cosine, m.nrows), "row", "col", inverse_cosine, m.ncols)


def frequency(index: Column, n: int, edge: float = np.pi) -> Column:
    """The frequency at a place from 0 to n - 1 of n samples, 0 being in the middle: from -edge up to edge, which odd n reach on neither side and even ones on the left."""
    return (index - n // 2) * (2 * edge / n)


def frequencies(spark: SparkSession, nrows: int, ncols: int, edge: float = np.pi) -> DataFrame:
    """row, col, f_row, f_col: the spatial frequencies of a grid of this size, 0 in its middle."""
    cells = spark.range(nrows).select(F.col("id").alias("row"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(ncols - 1).cast("long"))).alias("col"))
    return cells.select("row", "col", frequency(F.col("row"), nrows, edge).alias("f_row"), frequency(F.col("col"), ncols, edge).alias("f_col"))


def transform_lines(df: DataFrame, key: str, index: str, f, length: int, out: int) -> DataFrame:
    """row, col, re, im: f of each line of complex values (row, col, re, im); lines of `length` values become ones of `out`."""

    def lines(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([key, index])
        y = f((pdf["re"].to_numpy() + 1j * pdf["im"].to_numpy()).reshape(-1, length))
        keys = pdf[key].to_numpy()[::length]
        return pd.DataFrame({key: np.repeat(keys, out), index: np.tile(np.arange(out), len(keys)), "re": y.real.ravel(), "im": y.imag.ravel()})[["row", "col", "re", "im"]]

    block = F.floor(F.col(key) / max(1, PIXELS // max(length, out)))
    return df.select("row", "col", "re", "im").groupBy(block.alias("block")).applyInPandas(lines, "row long, col long, re double, im double")


def fourier(df: DataFrame, nrows: int, ncols: int) -> DataFrame:
    """row, col, re, im of the two-dimensional transform of row, col, z: its left half (columns to ncols // 2), of which the rest is the mirror image."""
    half = ncols // 2 + 1
    flat = df.select("row", "col", F.col("z").alias("re"), F.lit(0.0).alias("im"))
    return transform_lines(transform_lines(flat, "row", "col", lambda x: np.fft.rfft(x.real), ncols, half), "col", "row", np.fft.fft, nrows, nrows)


def inverse_fourier(spectrum: DataFrame, nrows: int, ncols: int) -> DataFrame:
    """row, col, z of the left half of a transform."""
    half = ncols // 2 + 1
    by_rows = transform_lines(spectrum, "col", "row", np.fft.ifft, nrows, nrows)
    return transform_lines(by_rows, "row", "col", lambda x: np.fft.irfft(x, ncols) + 0j, half, ncols).select("row", "col", F.col("re").alias("z"))


def filtered_plain(grid: Grid, filter_intensity: float = 0.9) -> DataFrame:
    """As filtered(), but of the grid itself and not of its mirror images: opposite edges are neighbours."""
    m = grid.meta
    # the transform begins with frequency 0, and what lies beyond the middle is negative
    at = lambda c, n: frequency((F.col(c) + n // 2) % n, n)
    length = F.pow(F.pow(at("row", m.nrows), 2) + F.pow(at("col", m.ncols), 2), filter_intensity / 2)
    spectrum = fourier(nearest_fill(grid), m.nrows, m.ncols)
    return inverse_fourier(spectrum.withColumns({"re": F.col("re") * length, "im": F.col("im") * length}), m.nrows, m.ncols)


def curvature(grid: Grid, filter_intensity: float = 0.9, replication: bool = True) -> DataFrame:
    """row, col, z: the filtered grid, null where the grid is. With replication, of the grid and its mirror images."""
    has = grid.df.select("row", "col", F.col("z").isNotNull().alias("__has"))
    out = (filtered if replication else filtered_plain)(grid, filter_intensity)
    return out.join(has, ["row", "col"]).select("row", "col", F.when(F.col("__has"), F.col("z")).alias("z"))


def sky_view(grid: Grid, filter_intensity: float = 0.9, quantiles: tuple[float, float] = (0.09, 0.91)) -> DataFrame:
    """row, col, z: the negative part of the filtered grid, 0 to 255 between its quantiles; null where the grid is."""
    low = filtered(grid, filter_intensity).withColumn("z", F.least("z", F.lit(0.0))).persist()
    found = exact(low, [], [("a", F.col("z"), quantiles[0]), ("b", F.col("z"), quantiles[1])])[()]
    low.unpersist()
    a, b = found["a"], found["b"]
    has = grid.df.select("row", "col", F.col("z").isNotNull().alias("__has"))
    scaled = F.greatest(F.least((F.col("z") - a) / F.lit((b - a) or 1.0), F.lit(1.0)), F.lit(0.0)) * 255
    return low.join(has, ["row", "col"]).select("row", "col", F.when(F.col("__has"), scaled).alias("z"))
