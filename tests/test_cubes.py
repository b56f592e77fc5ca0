"""Cubes of bands."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from reliefspark.grid import Grid, GridMeta
from reliefspark.sources import cubes

META = GridMeta(12, 15, (100.0, 10.0, 0.0, 500.0, 0.0, -10.0), "EPSG:32631", nodata=-99.0)


def made(spark):
    rng = np.random.default_rng(3)
    planes = {n: np.round(rng.normal(size=(12, 15)) * 9) for n in ("height", "near", "red")}
    planes["red"][2, 3] = np.nan
    grids = {n: Grid(spark.createDataFrame([(r, c, None if np.isnan(v) else float(v)) for (r, c), v in np.ndenumerate(z)], "row long, col long, z double"), META) for n, z in planes.items()}
    return planes, cubes.stacked(grids, height={"unit": "m"})


def array(df, shape=(12, 15)):
    out = np.full(shape, np.nan)
    for r, c, z in df.select("row", "col", "z").collect():
        out[r, c] = np.nan if z is None else z
    return out


def test_saved_cubes_are_read_band_by_band(spark, tmp_path):
    planes, cube = made(spark)
    back = cubes.save_cube(cube, f"{tmp_path}/c")
    assert back.bands == ({"name": "height", "unit": "m"}, {"name": "near"}, {"name": "red"}) and back.meta.transform == META.transform
    for n, z in planes.items():
        one = cubes.flat(back, n)
        assert np.array_equal(array(one.df), z, equal_nan=True) and one.meta.name == n
    plan = cubes.flat(back, "near").df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(band" in plan and "(band#" in plan and "= 2)]" in plan
    assert len(cubes.flat(back, 2).df.inputFiles()) >= 1 and all("band=" in f for f in back.df.inputFiles())
    assert np.array_equal(array(cubes.flat(back).df), planes["height"])
    part = cubes.load_cube(spark, f"{tmp_path}/c", {"x": 3, "y": 2, "w": 5, "h": 4})
    assert (part.meta.nrows, part.meta.ncols, part.meta.transform) == (4, 5, (130.0, 10.0, 0.0, 480.0, 0.0, -10.0))
    assert np.array_equal(array(cubes.flat(part, "red").df, (4, 5)), planes["red"][2:6, 3:8], equal_nan=True)


def test_functions_over_bands(spark):
    planes, cube = made(spark)
    a, b = planes["near"], planes["red"]
    with np.errstate(divide="ignore", invalid="ignore"):
        want = np.where(a + b == 0, np.nan, (a - b) / (a + b))
    index = cubes.per_pixel(cube, F.try_divide(F.col("near") - F.col("red"), F.col("near") + F.col("red")), ["near", "red"])
    assert np.allclose(array(index.df), want, equal_nan=True)
    stats = {r["name"]: r for r in cubes.band_stats(cube).collect()}
    for n, z in planes.items():
        assert (stats[n]["n"], stats[n]["mean"], stats[n]["std"]) == (int((~np.isnan(z)).sum()), pytest.approx(np.nanmean(z)), pytest.approx(np.nanstd(z)))


def test_cubes_as_rasters(spark, tmp_path):
    planes, cube = made(spark)
    path = f"{tmp_path}/c.tif"
    cubes.save_raster(cube, path, block=16)
    back = cubes.load_cube(spark, path)
    assert [b["name"] for b in back.bands] == ["band1", "band2", "band3"] and back.meta.crs == META.crs
    for k, z in enumerate(planes.values(), 1):
        assert np.array_equal(array(cubes.flat(back, k).df), z, equal_nan=True)


def test_bands_that_do_not_fit_are_refused(spark):
    _, cube = made(spark)
    g = cubes.flat(cube)
    for grids in ({}, {"a": g, "b": Grid(g.df, GridMeta(12, 14))}):
        with pytest.raises(ValueError, match="one size"):
            cubes.stacked(grids)
    for band in ("blue", 0, 4):
        with pytest.raises(KeyError):
            cubes.flat(cube, band)
