"""What keeps a whole run's passes over its pixels few."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from reliefspark.functions.quantiles import quantiles
from reliefspark.grid import Grid, GridMeta
from reliefspark.operators import processing, resample
from reliefspark.plans import pipeline
from reliefspark.sources import grids
from reliefspark.sources.geotiff import write_raster
from reliefspark.sources.grids import load_grid


def grid(spark, values, **labels):
    rows = [(r, c, v, *[labels[n][r][c] for n in labels]) for r, line in enumerate(values) for c, v in enumerate(line)]
    schema = "row long, col long, z double" + "".join(f", {n} int" for n in labels)
    return Grid(spark.createDataFrame(rows, schema), GridMeta(len(values), len(values[0]), (0.0, 1.0, 0.0, 0.0, 0.0, -1.0), "EPSG:32631"), tuple(labels))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_grids_of_the_same_pixels_are_only_cropped(spark):
    z = [[float(r * 10 + c) if (r, c) != (2, 3) else None for c in range(6)] for r in range(5)]
    g = grid(spark, z, seg=[[r + c for c in range(6)] for r in range(5)])
    corner = Grid(g.df.filter("row < 2 and col < 3"), replace(g.meta.translated(2, 1), nrows=2, ncols=3))
    got = resample.reproject(g, corner)
    assert "Join" not in plan_of(got.df) and "Exchange" not in plan_of(got.df) and got.df.dtypes[3] == ("seg", "double")
    general = resample.sample_at(corner.df.selectExpr("row", "col", "col + 2.0D as fx", "row + 1.0D as fy"), g, values=("z", "seg"))
    assert sorted(map(str, got.df.collect())) == sorted(map(str, general.collect()))
    beyond = Grid(g.df, g.meta.translated(4, 0))
    assert resample.same_pixels(g, beyond) is None and resample.reproject(g, beyond).df.filter("z is null").count() == 20
    assert resample.same_pixels(g, Grid(g.df, g.meta.translated(0, 0.5))) is None
    assert resample.same_pixels(Grid(g.df, replace(g.meta, crs="EPSG:4326")), Grid(g.df, replace(g.meta, crs="EPSG:32631"))) is None


def test_aligned_grids_meet_without_another_shuffle(spark):
    g = grid(spark, [[1.0, 2.0], [3.0, 4.0]])
    dealt = lambda: Grid(g.df.repartition(3, "row", "col"), g.meta)
    ref, sec, _ = resample.reproject_grids(dealt(), dealt())
    assert plan_of(processing.process("alti-diff", ref, sec).df).count("Exchange hashpartitioning") == 2


def test_heights_are_looked_for_before_planes_are_joined(spark, tmp_path, monkeypatch):
    g, seen = grid(spark, [[1.0, 2.0], [3.0, None]]), []
    write_raster(g, str(tmp_path / "z.tif"), block=16)
    g.z().write.parquet(str(tmp_path / "z.parquet"))
    monkeypatch.setattr(grids, "check_has_data", lambda x: seen.append(plan_of(x.df)) or x)
    for kind in ("tif", "parquet"):
        path = str(tmp_path / f"z.{kind}")
        assert load_grid(spark, {"path": path, "crs": "EPSG:32631", "classification_layers": {"seg": {"map_path": path}}}).df.count() == 4
    assert len(seen) == 2 and not any("Join" in p for p in seen)
    write_raster(g.with_df(g.df.withColumn("z", F.lit(None).cast("double"))), str(tmp_path / "none.tif"), block=16)
    monkeypatch.undo()
    with pytest.raises(ValueError):
        load_grid(spark, {"path": str(tmp_path / "none.tif"), "crs": "EPSG:32631"})


def test_a_grid_is_made_once_for_all_layers(spark):
    g, made = grid(spark, [[float(r * 7 + c) for c in range(20)] for r in range(20)], seg_ref=[[r % 3 for c in range(20)] for r in range(20)], seg_sec=[[c % 3 for c in range(20)] for r in range(20)]), spark.sparkContext.accumulator(0)

    def seen(z):
        made.add(1)
        return z

    counted = g.with_df(g.df.withColumn("z", F.udf(seen, "double")("z")))
    cfg = {"classification_layers": {"global": {"type": "global"}, "seg": {"type": "segmentation", "classes": {"a": [0], "b": [1, 2]}}}, "metrics": ["mean", "median"], "remove_outliers": True}
    once = pipeline.statistics(counted, "alti-diff", cfg).collect()
    assert made.value == 400
    apart = [r for n, c in cfg["classification_layers"].items() for r in pipeline.statistics(g, "alti-diff", {**cfg, "classification_layers": {n: c}}).collect()]
    assert sorted(map(str, once)) == sorted(map(str, apart)) and len({r["mode"] for r in once}) == 3


def test_neighbouring_ranks_share_an_interval(spark):
    df = spark.range(0, 4000, 1, 60).selectExpr("id % 2 as k", "cast((id * 7919) % 4001 as double) as v").persist()
    values = {k: np.array([r["v"] for r in df.filter(f"k = {k}").collect()]) for k in (0, 1)}
    wanted = [("a", F.col("v"), 0.5), ("b", F.col("v"), 0.123), ("c", -F.col("v"), 0.98)]
    got = quantiles(df, ["k"], wanted, cells=16, most=20)
    for k, v in values.items():
        assert got[(k,)] == pytest.approx({"a": np.quantile(v, 0.5), "b": np.quantile(v, 0.123), "c": np.quantile(-v, 0.98)})
    tasks = []
    spark.sparkContext.setJobGroup("narrowing", "")
    try:
        quantiles(df, [], [("a", F.col("v"), 0.5)], cells=16, most=1000)
        tracker = spark.sparkContext.statusTracker()
        tasks = [tracker.getStageInfo(s).numTasks for j in tracker.getJobIdsForGroup("narrowing") for s in tracker.getJobInfo(j).stageIds if tracker.getStageInfo(s)]
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        df.unpersist()
    assert 3 * spark.sparkContext.defaultParallelism in tasks  # counting in cells: few tasks, of 60 that the values have
