"""A comparison tile by tile, as a configuration describes it."""

from __future__ import annotations

import json
import sys

from pyspark.sql import DataFrame, SparkSession

from reliefspark.functions import metrics
from reliefspark.operators import processing, stats, tiling
from reliefspark.operators.resample import reproject_grids
from reliefspark.operators.stencil import slope
from reliefspark.plans import config
from reliefspark.plans.pipeline import chosen, layers_of, set_logging
from reliefspark.sources.grids import load_grid
from reliefspark.sources.scratch import written


def check(cfg: dict) -> dict:
    """The tiles' settings with defaults; ValueError for sizes that can't be. nb_cpu is checked only: Spark deals the tiles."""
    out = {"overlap": 0, "nb_cpu": 1, **cfg}
    for key in ("height", "width", "nb_cpu"):
        if not isinstance(out.get(key), int) or isinstance(out[key], bool) or out[key] <= 0:
            raise ValueError(f"{key} of the tiles is a positive integer")
    if not isinstance(out["overlap"], int) or isinstance(out["overlap"], bool):
        raise ValueError("the overlap is an integer")
    tiling.check(out["height"], out["width"], out["overlap"])
    return out


def run_tiles(spark: SparkSession, cfg: dict | str) -> DataFrame:
    """The shifts of compare_tiles()."""
    return compare_tiles(spark, cfg)[0]


def compare_tiles(spark: SparkSession, cfg: dict | str) -> tuple[DataFrame, DataFrame | None]:
    """(shifts and valid shares, statistics) of all tiles of a configuration with both inputs, `coregistration`, `tiling` and perhaps `statistics`.

    Both grids are aligned once, on sec's pixels or as coregistration's sampling_source says; every tile is then compared
    alone: fitted, moved, cropped, and its pixels counted by layer, mode and class. Statistics are a long table with the
    tile's columns; a tile that can't be fitted has nulls there. Methods are those of processing.LOCAL, metrics scalar ones.
    With an output_dir, `tiles.parquet` holds the shifts, `stats/<method>/tiles.parquet` the pixels of a method by tile, and
    `stats/<method>/stats_by_tile.parquet` the statistics.
    """
    cfg = config.read(cfg) if isinstance(cfg, str) else cfg
    t = check(cfg.get("tiling", {}))
    cfg = config.check({k: v for k, v in cfg.items() if k != "tiling"} | {"coregistration": cfg.get("coregistration", {})})
    c, out = cfg["coregistration"], cfg.get("output_dir")
    for method, s in (cfg.get("statistics") or {}).items():
        asked = [m for layer in s["classification_layers"].values() for m in chosen(s, layer)]
        if method not in processing.LOCAL or any(metrics.kind(m) != "scalar" for m in asked):
            raise ValueError(f"statistics by tile have scalar metrics of {processing.LOCAL}")
    ref, sec = load_grid(spark, cfg["input_ref"]), load_grid(spark, cfg["input_sec"])
    sec, ref, _ = reproject_grids(sec, ref, c["estimated_initial_shift_x"], c["estimated_initial_shift_y"], c["sampling_source"])
    size = t["height"], t["width"], t["overlap"]
    shifts = tiling.tile_shifts(ref, sec, *size, c["number_of_iterations"])
    shifts = kept(shifts, out and f"{out}/tiles.parquet")
    if out:
        spark.createDataFrame([(json.dumps(cfg | {"tiling": t}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{out}/full_config.json")
    table = None
    if cfg.get("statistics"):
        every = tiling.all_tiles(sec, *size)
        ref, sec = (slope(g) for g in tiling.tile_grids(ref, sec, shifts, *size))
        for method, s in cfg["statistics"].items():
            grid = processing.process(method, ref, sec)
            grid = grid.with_df(kept(grid.df, out and f"{out}/stats/{method}/tiles.parquet"))
            of_method = None
            for layer in layers_of(s["classification_layers"], grid):
                asked = chosen(s, s["classification_layers"][layer.name])
                found = stats.part_stats(grid, layer, every, tuple(asked), {m: a[0] for m, a in asked.items()})
                long = stats.long_form(found, method, layer.name, tiling.TILE)
                of_method = long if of_method is None else of_method.unionByName(long)
            of_method = kept(of_method, out and f"{out}/stats/{method}/stats_by_tile.parquet")
            table = of_method if table is None else table.unionByName(of_method)
    return shifts, table


def kept(df: DataFrame, path: str | None) -> DataFrame:
    """df as saved at a path, or in the shared folder without one, and reread."""
    if not path:
        return written(df, "tiles")
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def main(args: list[str] | None = None) -> int:
    """CONFIG.json [--loglevel LEVEL]; the exit code is 1 after an error."""
    args = set_logging(sys.argv[1:] if args is None else args)
    if len(args) != 1:
        print("usage: python -m reliefspark.plans.tiles CONFIG.json [--loglevel LEVEL]", file=sys.stderr)
        return 1
    run_tiles(SparkSession.builder.appName("reliefspark").getOrCreate(), args[0]).orderBy("tile_row", "tile_col").show(100, False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
