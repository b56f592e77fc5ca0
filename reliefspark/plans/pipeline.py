"""A whole comparison as a configuration describes it."""

from __future__ import annotations

import json
import logging
import sys
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reliefspark.functions import metrics
from reliefspark.grid import Grid
from reliefspark.operators import classify, processing, stats
from reliefspark.operators.coregister import coregister
from reliefspark.operators.resample import reproject_grids
from reliefspark.operators.stencil import slope
from reliefspark.plans import config
from reliefspark.sources.geotiff import write_raster
from reliefspark.sources.grids import load_grid

log = logging.getLogger(__name__)

#: Parameters of the vector metrics that every run gives for the whole grid.
PLOTTED = {"cdf": {"bin_step": 0.1}, "pdf": {"bin_step": 0.2}}


def layers_of(cfg: dict, grid: Grid) -> list[classify.Layer]:
    """The layers of a method, fusions last."""
    made = {n: classify.create(c["type"], n, c, grid.df.columns) for n, c in cfg.items() if c["type"] != "fusion"}
    for name, c in cfg.items():
        if c["type"] == "fusion":
            for support in ("ref", "sec"):
                if c.get(support):
                    made[name] = classify.fusion(name, [made[x] for x in c[support]], support)
    return list(made.values())


def chosen(cfg: dict, layer_cfg: dict) -> dict[str, tuple[bool, dict]]:
    """The metrics of a layer by name: whether outliers are left out, and parameters."""
    items = [*layer_cfg.get("metrics", []), *cfg.get("metrics", [])] or list(metrics.DEFAULT)
    out: dict[str, tuple[bool, dict]] = {}
    for item in items:
        name, more = (item, {}) if isinstance(item, str) else next(iter(item.items()))
        default = cfg.get("remove_outliers", False) and name not in metrics.KEEPS_OUTLIERS
        out[name] = bool(more.get("remove_outliers", default)), {k: v for k, v in more.items() if k != "remove_outliers"}
    return out


def statistics(grid: Grid, method: str, cfg: dict, output_dir: str | None = None) -> DataFrame:
    """The long table of the scalar metrics of all layers of a method; vectors, matrices and support maps are saved.

    A grid that isn't saved is made once for all layers: its heights and classes are persisted meanwhile.
    """
    layers = layers_of(cfg["classification_layers"], grid)
    if not output_dir and len(layers) > 1:
        grid, layers = classified(grid, layers)
        grid.df.persist()
        try:
            return layer_statistics(grid, layers, method, cfg)
        finally:
            grid.df.unpersist()
    return layer_statistics(grid, layers, method, cfg, output_dir)


def classified(grid: Grid, layers: list[classify.Layer]) -> tuple[Grid, list[classify.Layer]]:
    """Heights with a column of classes for each layer and support, and the layers as they are found there."""
    at = {(x.name, s): f"class_{k}_{s}" for k, x in enumerate(layers) for s in x.index}
    df = grid.df.select("z", *[x.index[s].alias(at[x.name, s]) for x in layers for s in x.index])
    return grid.with_df(df), [replace(x, index={s: F.col(at[x.name, s]) for s in x.index}) for x in layers]


def layer_statistics(grid: Grid, layers: list[classify.Layer], method: str, cfg: dict, output_dir: str | None = None) -> DataFrame:
    out = None
    for layer in layers:
        asked = chosen(cfg, cfg["classification_layers"][layer.name])
        scalars = tuple(m for m in asked if metrics.kind(m) == "scalar")
        s = stats.class_stats(grid, layer, scalars, {m: asked[m][0] for m in scalars})
        long = stats.long_form(s, method, layer.name)
        out = long if out is None else out.unionByName(long)
        if not output_dir:
            continue
        folder = f"{output_dir}/stats/{method}/{layer.name}"
        stats.save(s, folder)
        for m, (without, params) in asked.items():
            if metrics.kind(m) == "vector":
                stats.save_vectors(stats.class_vectors(grid, layer, m, params, without), m, folder)
            elif metrics.kind(m) == "matrix2D":
                for k in range(len(layer.classes)):
                    save_grid(Grid(stats.class_matrix(grid, layer, m, params, k), grid.meta), f"{folder}/{m}_{k}")
        for support in layer.supports if layer.name != "global" else ():
            save_grid(Grid(grid.df.select("row", "col", layer.index[support].cast("double").alias("z")), grid.meta), f"{folder}/{support}_rectified_support_map")
    return out


def save_plot_data(grid: Grid, folder: str) -> None:
    """What plots of a method's grid show: cdf, pdf, orientations as in a polar plot, hillshade, sky view factor, and the range of colours (mean, deviation)."""
    everything = classify.global_layer()
    for m in ("cdf", "pdf"):
        stats.save_vectors(stats.class_vectors(grid, everything, m, PLOTTED[m]), m, folder)
    for m in ("hillshade", "svf"):
        save_grid(Grid(stats.class_matrix(grid, everything, m), grid.meta), f"{folder}/{m}")
    around = metrics.polar(metrics.vector_metric("slope-orientation-histogram")(grid, grid.meta.xres, grid.meta.yres))
    around.orderBy("bin").coalesce(1).write.mode("overwrite").option("header", True).csv(f"{folder}/slope_orientation_polar.csv")
    span = grid.df.agg(F.avg("z").alias("mean"), F.stddev_pop("z").alias("std")).select("mean", "std", (F.col("mean") - F.col("std")).alias("vmin"), (F.col("mean") + F.col("std")).alias("vmax"))
    span.coalesce(1).write.mode("overwrite").json(f"{folder}/snapshot_range.json")


def run(spark: SparkSession, cfg: dict | str) -> tuple[DataFrame | None, dict]:
    """(long table of statistics, coregistration results) of a configuration or of the JSON file that holds it.

    Grids are saved as Parquet; with `raster_outputs`, those of the coregistration and of each method as GeoTIFF, too.
    """
    cfg = config.check(config.read(cfg) if isinstance(cfg, str) else cfg)
    out, raster = cfg.get("output_dir"), bool(cfg.get("raster_outputs"))
    ref = load_grid(spark, cfg["input_ref"])
    sec = load_grid(spark, cfg["input_sec"]) if "input_sec" in cfg else None
    results: dict = {}
    if "coregistration" in cfg:
        c = cfg["coregistration"]
        done = coregister(sec, ref, c["method_name"], c["number_of_iterations"], c["sampling_source"], c["estimated_initial_shift_x"], c["estimated_initial_shift_y"])
        ref, sec, results = done.ref, done.sec, done.results
        if out:
            spark.createDataFrame([(json.dumps(results),)], "value string").coalesce(1).write.mode("overwrite").text(f"{out}/coregistration/coregistration_results.json")
            ref, sec = saved(ref, f"{out}/coregistration/reproj_coreg_REF", raster), saved(sec, f"{out}/coregistration/reproj_coreg_SEC", raster)
        if c["save_optional_outputs"]:
            fits = done.fit_table().coalesce(1).sortWithinPartitions("iteration", "slice")
            fits.write.mode("overwrite").option("header", True).csv(f"{c['output_dir']}/coregistration/nuth_kaab_fit.csv")
            for grid, name in ((done.reproj_sec, "reproj_SEC"), (done.reproj_ref, "reproj_REF"), (done.coreg_sec, "coreg_SEC")):
                save_grid(grid, f"{c['output_dir']}/coregistration/{name}")
    elif sec is not None:
        sec, ref, _ = reproject_grids(sec, ref, sampling_source=cfg.get("sampling_source") or "sec")
    table = None
    ref, sec = slope(ref), slope(sec) if sec is not None else None
    for method, s in (cfg.get("statistics") or {}).items():
        log.info("method %s", method)
        grid = processing.process(method, ref, sec)
        if out:  # statistics read the saved grid
            grid = saved(grid, f"{out}/stats/{method}/dem_for_stats", raster)
            save_plot_data(grid, f"{out}/stats/{method}")
        long = statistics(grid, method, s, out)
        table = long if table is None else table.unionByName(long)
    if out:
        spark.createDataFrame([(json.dumps(cfg),)], "value string").coalesce(1).write.mode("overwrite").text(f"{out}/full_config.json")
        if table is not None:
            report(table, results).write.mode("overwrite").text(f"{out}/report.md")
    return table, results


def save_grid(grid: Grid, path: str, tile: int = 1024) -> None:
    """Parquet by tile, in order within, so that a later region of interest reads few files and row groups; meta beside it."""
    df = grid.df.withColumn("tile_row", F.floor(F.col("row") / tile)).withColumn("tile_col", F.floor(F.col("col") / tile))
    df.repartition("tile_row", "tile_col").sortWithinPartitions("tile_row", "tile_col", "row", "col").drop("tile_row", "tile_col").write.mode("overwrite").parquet(f"{path}.parquet")
    m = grid.meta
    meta = {"nrows": m.nrows, "ncols": m.ncols, "transform": list(m.transform), "crs": m.crs, "nodata": m.nodata, "zunit": m.zunit, "bounds": m.bounds()}
    grid.df.sparkSession.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}.meta.json")


def saved(grid: Grid, path: str, raster: bool = False) -> Grid:
    """The grid as saved and reread; with `raster`, its heights are a GeoTIFF beside the table, too."""
    save_grid(grid, path)
    back = grid.with_df(grid.df.sparkSession.read.schema(grid.df.schema).parquet(f"{path}.parquet"))
    if raster:
        write_raster(back, f"{path}.tif")
    return back


def report(table: DataFrame, results: dict) -> DataFrame:
    """Lines of a Markdown report, in order, in one partition: one a class and metric."""
    spark = table.sparkSession
    head = spark.createDataFrame([(0, "# Comparison"), (1, f"Coregistration: `{json.dumps(results)}`"), (2, ""), (3, "| method | layer | mode | set | metric | value |"), (4, "|---|---|---|---|---|---|")], "n int, value string")
    line = F.concat(F.lit("| "), F.concat_ws(" | ", "method", "layer", "mode", "set_name", "metric", F.coalesce(F.col("value").cast("string"), F.lit(""))), F.lit(" |"))
    body = table.select(F.lit(5).alias("n"), line.alias("value"))
    return head.unionByName(body).coalesce(1).sortWithinPartitions("n", "value").select("value")


def set_logging(args: list[str]) -> list[str]:
    """Sets the level that --loglevel names (WARNING without it); the other arguments."""
    level = args[args.index("--loglevel") + 1] if "--loglevel" in args[:-1] else "WARNING"
    logging.basicConfig(format="%(asctime)s %(levelname)s %(name)s: %(message)s", level=level.upper())
    return args if "--loglevel" not in args[:-1] else [a for k, a in enumerate(args) if k not in (args.index("--loglevel"), args.index("--loglevel") + 1)]


def main(args: list[str] | None = None) -> int:
    """CONFIG.json [--loglevel LEVEL]; the exit code is 1 after an error."""
    args = set_logging(sys.argv[1:] if args is None else args)
    if len(args) != 1:
        print("usage: python -m reliefspark.plans.pipeline CONFIG.json [--loglevel LEVEL]", file=sys.stderr)
        return 1
    table, results = run(SparkSession.builder.appName("reliefspark").getOrCreate(), args[0])
    print(json.dumps(results, indent=1))
    if table is not None:
        table.show(100, False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
