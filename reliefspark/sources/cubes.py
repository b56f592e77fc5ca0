"""Cubes of bands: grids of one place that share their pixels, stored band by band."""

from __future__ import annotations

import json
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reliefspark.grid import Grid, GridMeta, box_ranges, roi_bounds
from reliefspark.sources.geotiff import header, raster_meta, read_raster, write_raster


@dataclass(frozen=True)
class Cube:
    """df has row, col, band (from 1), z; bands describes each band: a name, and what else is known of it."""

    df: DataFrame
    meta: GridMeta
    bands: tuple[dict, ...]

    def number(self, band: int | str) -> int:
        """A band's number; KeyError for a name or number that there isn't."""
        names = [b["name"] for b in self.bands]
        if band in names:
            return names.index(band) + 1
        if isinstance(band, int) and 1 <= band <= len(names):
            return band
        raise KeyError(f"no band {band!r} among {names}")


def stacked(grids: dict[str, Grid], **known: dict) -> Cube:
    """A cube of grids of one size, in their order; `known` has more about bands, by name. ValueError for grids of different sizes or places."""
    metas = [(g.meta.nrows, g.meta.ncols, g.meta.transform, g.meta.crs) for g in grids.values()]
    if not metas or len(set(metas)) > 1:
        raise ValueError("bands have one size, transform and coordinate system")
    df = None
    for k, g in enumerate(grids.values(), 1):
        band = g.df.select("row", "col", F.lit(k).alias("band"), F.col("z").cast("double").alias("z"))
        df = band if df is None else df.unionByName(band)
    return Cube(df, replace(next(iter(grids.values())).meta, name=""), tuple({"name": n, **known.get(n, {})} for n in grids))


def flat(cube: Cube, band: int | str = 1) -> Grid:
    """One band as a grid; the first, as where a cube is read as a grid. Of a saved cube, only its files are read."""
    k = cube.number(band)
    return Grid(cube.df.filter(F.col("band") == k).select("row", "col", "z"), replace(cube.meta, name=cube.bands[k - 1]["name"]))


def wide(cube: Cube, bands: list[int | str] | None = None) -> DataFrame:
    """row, col and a column for each band, by name: one aggregation, whatever the number of bands."""
    numbers = [cube.number(b) for b in bands] if bands else range(1, len(cube.bands) + 1)
    own = cube.df.filter(F.col("band").isin(*numbers)) if bands else cube.df
    return own.groupBy("row", "col").agg(*[F.max(F.when(F.col("band") == k, F.col("z"))).alias(cube.bands[k - 1]["name"]) for k in numbers])


def per_pixel(cube: Cube, f: Column, bands: list[int | str] | None = None) -> Grid:
    """The grid of an expression over bands' names."""
    return Grid(wide(cube, bands).select("row", "col", f.cast("double").alias("z")), cube.meta)


def band_stats(cube: Cube) -> DataFrame:
    """band, name, n, mean, std, min, max of every band."""
    names = F.element_at(F.array(*[F.lit(b["name"]) for b in cube.bands]), F.col("band"))
    s = cube.df.groupBy("band").agg(F.count("z").alias("n"), F.avg("z").alias("mean"), F.stddev_pop("z").alias("std"), F.min("z").alias("min"), F.max("z").alias("max"))
    return s.select("band", names.alias("name"), "n", "mean", "std", "min", "max")


def save_cube(cube: Cube, path: str, tile: int = 1024) -> Cube:
    """The cube as Parquet, a folder a band, by tile within; what is known of it beside it. The cube as reread."""
    tiles = [F.floor(F.col("row") / tile), F.floor(F.col("col") / tile)]
    cube.df.select("row", "col", "band", "z").repartition("band", *tiles).sortWithinPartitions("band", *tiles, "row", "col").write.mode("overwrite").partitionBy("band").parquet(f"{path}.cube")
    m = cube.meta
    known = {"nrows": m.nrows, "ncols": m.ncols, "transform": list(m.transform), "crs": m.crs, "nodata": m.nodata, "bands": list(cube.bands)}
    spark = cube.df.sparkSession
    spark.createDataFrame([(json.dumps(known),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}.cube.json")
    return load_cube(spark, path)


def load_cube(spark: SparkSession, path: str, roi: dict | None = None) -> Cube:
    """A cube that save_cube() wrote, or the bands of a GeoTIFF (.tif, .tiff), within a region of interest."""
    if path.lower().endswith((".tif", ".tiff")):
        meta = raster_meta(path)
        rows, cols = box_ranges(meta, roi_bounds(meta, roi)) if roi else ((0, meta.nrows), (0, meta.ncols))
        df = read_raster(spark, path, None, rows, cols)
        df = df.withColumn("z", F.when(F.nanvl("z", F.lit(meta.nodata)) != meta.nodata, F.col("z")))
        bands = tuple({"name": f"band{k}"} for k in range(1, header(path).bands + 1))
    else:
        known = json.loads("".join(r["value"] for r in spark.read.text(f"{path}.cube.json").collect()))  # one line
        meta, bands = GridMeta(known["nrows"], known["ncols"], tuple(known["transform"]), known["crs"], known["nodata"]), tuple(known["bands"])
        rows, cols = box_ranges(meta, roi_bounds(meta, roi)) if roi else ((0, meta.nrows), (0, meta.ncols))
        df = spark.read.schema("row long, col long, z double, band int").parquet(f"{path}.cube").select("row", "col", "band", "z")
        if roi:
            df = df.filter((F.col("row") >= rows[0]) & (F.col("row") < rows[1]) & (F.col("col") >= cols[0]) & (F.col("col") < cols[1]))
    df = df.withColumns({"row": F.col("row") - rows[0], "col": F.col("col") - cols[0]}) if roi else df
    meta = replace(meta, nrows=rows[1] - rows[0], ncols=cols[1] - cols[0], transform=meta.translated(cols[0], rows[0]).transform)
    return Cube(df, meta, bands)


def save_raster(cube: Cube, path: str, dtype: str = "float32", block: int = 256) -> None:
    """The cube as a GeoTIFF of as many bands."""
    write_raster(Grid(cube.df, cube.meta), path, block, dtype, len(cube.bands))
