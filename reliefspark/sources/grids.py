"""Grids from tables and files."""

from __future__ import annotations

import json
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reliefspark.grid import Grid, GridMeta, box_ranges, check_has_data, counted_from, create_grid, crop_box, roi_bounds
from reliefspark.sources.geotiff import raster_meta, read_raster


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders_size(spark: SparkSession, sf_dir: str, width: int = 100) -> tuple[int, int]:
    """Rows and columns of the grids by order key; the maximum comes from the files' statistics."""
    last = table(spark, sf_dir, "orders").agg(F.max("o_orderkey")).first()[0]
    return last // width + 1, width


def ref_grid(spark: SparkSession, sf_dir: str, width: int = 100, px: float = 1.0, crs: str = "EPSG:32631") -> Grid:
    """One pixel an order: z is its price, labels its priority (1-5) and status (1-3)."""
    nrows, ncols = orders_size(spark, sf_dir, width)
    o = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 2).otherwise(3)
    df = o.select((F.col("o_orderkey") / width).cast("long").alias("row"), (F.col("o_orderkey") % width).alias("col"), (F.col("o_totalprice") / 1000).alias("z"), F.substring("o_orderpriority", 1, 1).cast("int").alias("priority"), status.cast("int").alias("status"))
    return Grid(df, GridMeta(nrows, ncols, (0.0, px, 0.0, 0.0, 0.0, -px), crs, name="ref"), ("priority", "status"))


def sec_grid(spark: SparkSession, sf_dir: str, width: int = 100, px: float = 1.0, crs: str = "EPSG:32631") -> Grid:
    """One pixel an order: z is the sum of its items' prices, null without items; the label is the order's month mod 5."""
    nrows, ncols = orders_size(spark, sf_dir, width)
    sums = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("key")).agg((F.round(F.sum("l_extendedprice"), 2) / 1000).alias("z"))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), (F.month("o_orderdate") % 5 + 1).cast("int").alias("priority"))
    df = o.join(sums, "key", "left").select((F.col("key") / width).cast("long").alias("row"), (F.col("key") % width).alias("col"), "z", "priority")
    return Grid(df, GridMeta(nrows, ncols, (0.0, px, 0.0, 0.0, 0.0, -px), crs, name="sec"), ("priority",))


def smooth_grid(spark: SparkSession, sf_dir: str) -> Grid:
    """One row a vector, one column a component."""
    e = table(spark, sf_dir, "embeddings")
    size = e.agg(F.max("vec_id").alias("r"), F.max(F.size("embedding")).alias("c")).first()
    df = e.select(F.col("vec_id").alias("row"), F.posexplode("embedding").alias("col", "z")).select("row", F.col("col").cast("long").alias("col"), F.col("z").cast("double").alias("z"))
    return Grid(df, GridMeta(size["r"] + 1, size["c"], (0.0, 1.0, 0.0, 0.0, 0.0, -1.0), "EPSG:32631", name="smooth"))


def events_grid(spark: SparkSession, sf_dir: str) -> Grid:
    """One row a user, one column a day: the mean of the day's values; cells without events are null."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("row"), F.to_date("ts").alias("day"), "value")
    size = e.agg(F.min("day").alias("d"), F.max("day").alias("e"), F.max("row").alias("r")).first()
    cells = e.groupBy("row", F.datediff("day", F.lit(size["d"])).cast("long").alias("col")).agg(F.avg("value").alias("z"))
    ncols = (size["e"] - size["d"]).days + 1
    every = spark.range(size["r"] + 1).select(F.col("id").alias("row"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(ncols - 1).cast("long"))).alias("col"))
    return Grid(every.join(cells, ["row", "col"], "left"), GridMeta(size["r"] + 1, ncols, name="events"))


def saved_meta(spark: SparkSession, path: str) -> dict:
    """transform and crs that save_grid() wrote beside a grid file; nothing without it."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path.removesuffix(".parquet") + ".meta.json")
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return {}
    meta = json.loads("".join(r["value"] for r in spark.read.text(at.toString()).collect()))  # one line
    return {k: meta[k] for k in ("transform", "crs", "nodata")}


def is_raster(path: str) -> bool:
    return path.lower().endswith((".tif", ".tiff"))


def raster_grid(spark: SparkSession, cfg: dict) -> Grid:
    """A raster file and its label planes: only blocks that a region of interest touches are read. ValueError without heights, which are looked for in the raster alone."""
    given = {"crs": cfg.get("crs"), "transform": tuple(cfg["transform"]) if "transform" in cfg else None}
    meta = replace(raster_meta(cfg["path"]), **{k: v for k, v in given.items() if v is not None})
    rows, cols = box_ranges(meta, roi_bounds(meta, cfg["roi"])) if cfg.get("roi") else ((0, meta.nrows), (0, meta.ncols))
    df = read_raster(spark, cfg["path"], cfg.get("band", 1), rows, cols).drop("band")
    check_has_data(create_grid(df, meta, nodata=cfg.get("nodata"), zunit=cfg.get("zunit", "m")))
    labels = tuple(cfg.get("classification_layers", {}))
    for name in labels:
        path = cfg["classification_layers"][name]["map_path"]
        if is_raster(path):
            size = raster_meta(path)
            if (size.nrows, size.ncols) != (meta.nrows, meta.ncols):
                raise ValueError(f"the label plane {name} has not the size of its grid")
            plane = read_raster(spark, path, 1, rows, cols).drop("band")
        else:
            plane = pixels(spark, path, cfg.get("format", "parquet"))
        df = df.join(plane.select("row", "col", F.col("z").alias(name)), ["row", "col"], "left")
    # rows and columns count from the region's corner
    df = counted_from(df, rows[0], cols[0])
    meta = replace(meta, nrows=rows[1] - rows[0], ncols=cols[1] - cols[0], transform=meta.translated(cols[0], rows[0]).transform)
    return create_grid(df, meta, nodata=cfg.get("nodata"), zunit=cfg.get("zunit", "m"), labels=labels)


def pixels(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """row, col, z of a pixel file."""
    reader = spark.read.option("header", True).option("inferSchema", False) if kind == "csv" else spark.read
    return reader.format(kind).load(path).select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), F.col("z").cast("double").alias("z"))


def load_grid(spark: SparkSession, cfg: dict) -> Grid:
    """A grid file as a configuration names it: path, format (parquet, csv, json or orc), nodata, zunit, crs, transform, roi, labels,
    geoid (a grid file of its own, whose heights are added), band (of a raster; the first without it).

    The file is a GeoTIFF (.tif, .tiff) or has a row a pixel: row, col, z. Label planes are files of either kind,
    joined by pixel; ValueError if one has another size. A raster's tags, or what save_grid() wrote beside a pixel file (PATH without .parquet,
    and .meta.json), stand for settings that aren't given.
    """
    if cfg["path"].lower().endswith((".gtx", ".png", ".hgt")):
        raise ValueError("of rasters, only GeoTIFF files can be read")
    if is_raster(cfg["path"]):
        grid = raster_grid(spark, cfg)
        return add_geoid(grid, load_grid(spark, cfg["geoid"])) if cfg.get("geoid") else grid
    cfg = {**saved_meta(spark, cfg["path"]), **cfg}
    df = pixels(spark, cfg["path"], cfg.get("format", "parquet"))
    labels = tuple(cfg.get("classification_layers", {}))
    size = df.agg(F.max("row"), F.max("col")).first()
    check_has_data(create_grid(df, nodata=cfg.get("nodata"), zunit=cfg.get("zunit", "m")))
    for name in labels:
        path = cfg["classification_layers"][name]["map_path"]
        if is_raster(path):
            m, plane = raster_meta(path), read_raster(spark, path).drop("band")
            other = (m.nrows - 1, m.ncols - 1)
        else:
            plane = pixels(spark, path, cfg.get("format", "parquet"))
            other = plane.agg(F.max("row"), F.max("col")).first()
        if tuple(other) != tuple(size):
            raise ValueError(f"the label plane {name} has not the size of its grid")
        df = df.join(plane.select("row", "col", F.col("z").alias(name)), ["row", "col"], "left")
    more = {k: (tuple(v) if k == "transform" else v) for k, v in cfg.items() if k in ("transform", "crs")}
    grid = create_grid(df, nodata=cfg.get("nodata"), zunit=cfg.get("zunit", "m"), labels=labels, **more)
    grid = crop_box(grid, roi_bounds(grid.meta, cfg["roi"])) if cfg.get("roi") else grid
    return add_geoid(grid, load_grid(spark, cfg["geoid"])) if cfg.get("geoid") else grid


def add_geoid(grid: Grid, geoid: Grid) -> Grid:
    """Heights plus the geoid's, bilinear at the pixels' corners; ValueError where a pixel lies outside the geoid.

    The geoid has a coordinate system of its own: pixels of a projected grid are looked up by longitude and latitude.
    """
    from reliefspark.operators.resample import places, sample_at

    at = places(grid.df.withColumns({"px": F.col("col").cast("double"), "py": F.col("row").cast("double")}), grid.meta, geoid.meta)
    out = lambda v, n: F.col(v).isNull() | (F.col(v) < 0) | (F.col(v) > n - 1)
    # an aggregate, not a filter: Spark would push that through the projection and write it out twice over
    if at.agg(F.max(out("px", geoid.meta.ncols) | out("py", geoid.meta.nrows))).first()[0]:
        raise ValueError("the grid lies outside the geoid")
    height = sample_at(at.select("row", "col", F.col("px").alias("fx"), F.col("py").alias("fy")), geoid).withColumnRenamed("z", "geoid")
    return grid.with_df(grid.df.join(height, ["row", "col"]).withColumn("z", F.col("z") + F.col("geoid")).drop("geoid"))
