"""Order statistics of many groups, statistics by tile, and whole comparisons by tile."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from reliefspark.functions import order_stats
from reliefspark.grid import Grid, GridMeta
from reliefspark.operators import classify, processing, stats, stencil, tiling


def test_quantiles_of_many_groups(spark):
    rng = np.random.default_rng(2)
    groups = {("a", k): rng.normal(size=rng.integers(1, 40)) * 10.0 ** rng.integers(-3, 4) for k in range(60)}
    groups |= {("big", 1): rng.normal(size=6000), ("big", 2): np.r_[np.zeros(3000), rng.normal(size=2000), 1e12, -1e12, 1e12], ("big", 3): np.full(4000, 2.5), ("big", 4): np.r_[[1.0] * 3000, [np.nextafter(1.0, 2)] * 3001], (None, 5): np.array([3.0, 1.0]), ("n", None): np.array([7.0])}
    rows = [(a, b, float(v), 1.0) for (a, b), values in groups.items() for v in values] + [("a", 1, None, 1.0), ("empty", 0, None, None)]
    df = spark.createDataFrame(rows, "a string, b int, z double, one double").repartition(4).persist()
    got = order_stats.quantile_table(df, ["a", "b"], [("med", F.col("z"), 0.5), ("p9", F.abs("z"), 0.9), ("least", F.col("z"), 0.0), ("one", F.col("one"), 1.0)], cells=16, most=50)
    found = {(r["a"], r["b"]): r for r in got.collect()}
    assert set(found) == set(groups)
    for key, values in groups.items():
        want = np.median(values), np.percentile(abs(values), 90), values.min()
        assert (found[key]["med"], found[key]["p9"], found[key]["least"]) == pytest.approx(want, rel=1e-12, abs=1e-300) and found[key]["one"] == 1
    assert order_stats.quantile_table(df.filter("false"), ["a"], [("q", F.col("z"), 0.5)]).count() == 0


def surfaces(spark, rows=70, cols=90, seed=0):
    rng = np.random.default_rng(seed)
    r, c = np.mgrid[:rows, :cols].astype(float)
    surface = lambda r, c: np.sin(r / 9) * 20 + np.cos(c / 7) * 15 + np.sin((r + c) / 15) * 10
    ref, sec = surface(r, c), surface(r + 1, c + 2)
    sec[rng.random(sec.shape) < 0.01] = np.nan
    land = rng.integers(0, 3, ref.shape)
    meta = GridMeta(rows, cols, (0.0, 20.0, 0.0, 0.0, 0.0, -20.0), "EPSG:32631")

    def made(z):
        data = [(int(a), int(b), None if np.isnan(z[a, b]) else float(z[a, b]), int(land[a, b])) for a in range(rows) for b in range(cols)]
        return Grid(spark.createDataFrame(data, "row long, col long, z double, land int"), meta, ("land",))

    return made(ref), made(sec)


LAYER = {"classes": {"none": [0], "some": [1, 2], "never": [9]}}


@pytest.mark.parametrize("outliers", [False, True])
def test_statistics_by_tile_are_those_of_each_tile_alone(spark, outliers):
    ref, sec = surfaces(spark)
    d = processing.process("alti-diff", ref, sec)
    d = Grid(d.df.persist(), d.meta, d.labels)
    layer = classify.segmentation("land", LAYER, d.df.columns)
    got = tiling.stats_by_tile(d, layer, 40, 50, 10, remove_outliers=outliers)
    found = {}
    for r in got.collect():
        found.setdefault((r["tile_row"], r["tile_col"]), {})[r["mode"], r["class_idx"]] = r.asDict()
    assert len(found) == 4
    for (tr, tc), by in found.items():
        own = Grid(d.df.filter((F.col("row") >= 30 * tr) & (F.col("row") < 30 * tr + 40) & (F.col("col") >= 40 * tc) & (F.col("col") < 40 * tc + 50)), GridMeta(min(40, 70 - 30 * tr), min(50, 90 - 40 * tc)), d.labels)
        want = stats.class_stats(own, layer, remove_outliers=outliers).collect()
        assert len(want) == len(by) == 9
        for w in want:
            g = by[w["mode"], w["class_idx"]]
            for name, value in w.asDict().items():
                assert g[name] == value if isinstance(value, str) or value is None else g[name] == pytest.approx(value, abs=2e-5), (tr, tc, name)


@pytest.mark.parametrize("outliers", [False, True])
def test_statistics_of_small_tiles_write_no_tables(spark, monkeypatch, outliers):
    """Pixels of tiles of a known size meet once, and the result is that of narrowing tables of ranks."""
    ref, sec = surfaces(spark, 20, 30)
    d = processing.process("alti-diff", ref, sec)
    d = Grid(d.df.withColumn("z", F.when(F.col("row") > 3, F.col("z"))).persist(), d.meta, d.labels)
    layer, every = classify.segmentation("land", LAYER, d.df.columns), tiling.all_tiles(d, 4, 4, 1)
    tiled = Grid(tiling.assign(d.df, d.meta, 4, 4, 1), d.meta, d.labels, tiling.TILE)
    of = lambda got: {tuple(r[:4]): [None if v is None else v if isinstance(v, str) else pytest.approx(v, abs=2e-5) for v in r[4:]] for r in got.collect()}
    want = of(stats.part_stats(tiled, layer, every, remove_outliers=outliers))
    monkeypatch.setattr(stats, "written", None)
    got = {tuple(r[:4]): list(r[4:]) for r in tiling.stats_by_tile(d, layer, 4, 4, 1, remove_outliers=outliers).collect()}
    assert got == want and len(got) == every.count() * 9


def test_stencils_of_parts_have_edges_of_their_own(spark):
    ref, _ = surfaces(spark, 30, 20)
    tiled = Grid(tiling.assign(ref.df, ref.meta, 12, 11, 3), ref.meta, ref.labels, tiling.TILE)
    slopes = {(r["tile_row"], r["tile_col"], r["row"], r["col"]): r["slope"] for r in stencil.slope(tiled).df.collect()}
    normals = {(r["tile_row"], r["tile_col"], r["row"], r["col"]): r["n_x"] for r in stencil.normals(tiled).collect()}
    for tr, tc in {k[:2] for k in slopes}:
        rows, cols = (9 * tr, min(30, 9 * tr + 12)), (8 * tc, min(20, 8 * tc + 11))
        from reliefspark.grid import crop

        alone = crop(ref, rows, cols)
        for f, mine, name in ((lambda g: stencil.slope(g).df, slopes, "slope"), (lambda g: stencil.normals(g), normals, "n_x")):
            for r in f(alone).collect():
                assert mine[tr, tc, r["row"] + rows[0], r["col"] + cols[0]] == pytest.approx(r[name], abs=1e-12)
    with pytest.raises(ValueError, match="parts"):
        processing.process("ref-curvature", tiled)
    assert math.isfinite(slopes[0, 0, 0, 0])


def test_whole_comparison_by_tile_is_a_run_on_its_region(spark, tmp_path):
    from reliefspark.plans import pipeline, tiles

    ref, sec = surfaces(spark, 60, 80, seed=4)
    hole = F.when(F.col("col") < 60, F.col("z"))  # tiles of the last column can't be fitted
    for g, name in ((ref, "ref"), (Grid(sec.df.withColumn("z", hole), sec.meta, sec.labels), "sec")):
        pipeline.save_grid(Grid(g.df.select("row", "col", "z"), g.meta), f"{tmp_path}/{name}")
        pipeline.save_grid(Grid(g.df.select("row", "col", F.col("land").cast("double").alias("z")), g.meta), f"{tmp_path}/{name}_land")
    layers = {"land": {"type": "segmentation", "classes": LAYER["classes"]}, "Slope0": {"type": "slope", "ranges": [0, 40]}, "Fusion0": {"type": "fusion", "ref": ["land", "Slope0"]}}
    cfg = {f"input_{n}": {"path": f"{tmp_path}/{n}.parquet", "classification_layers": {"land": {"map_path": f"{tmp_path}/{n}_land.parquet"}}} for n in ("ref", "sec")}
    cfg |= {"coregistration": {"number_of_iterations": 3}, "statistics": {"alti-diff": {"classification_layers": layers, "remove_outliers": True}, "angular-diff": {"metrics": ["mean", "median"]}}}
    shifts, table = tiles.compare_tiles(spark, {**cfg, "tiling": {"height": 40, "width": 40, "overlap": 10}, "output_dir": f"{tmp_path}/out"})
    by_tile = {(r["tile_row"], r["tile_col"]): r for r in shifts.collect()}
    assert len(by_tile) == 6 and by_tile[0, 2]["dx"] is None and by_tile[0, 0]["dx"] is not None
    got = {tuple(r)[:-1]: r["value"] for r in table.collect()}
    assert all(v is None or k[-1] == "nbpts" for k, v in got.items() if k[:2] == (0, 2)) and any(k[:2] == (0, 2) for k in got)
    for tr, tc in ((0, 0), (1, 1)):
        roi = {"x": 30 * tc, "y": 30 * tr, "w": 40, "h": min(40, 60 - 30 * tr)}
        one, results = pipeline.run(spark, {**cfg, "input_ref": {**cfg["input_ref"], "roi": roi}, "input_sec": {**cfg["input_sec"], "roi": roi}})
        assert by_tile[tr, tc]["dx"] == pytest.approx(results["dx"]["nuth_offset"], abs=1e-5) and by_tile[tr, tc]["dy"] == pytest.approx(results["dy"]["nuth_offset"], abs=1e-5)
        want = {tuple(r)[:-1]: r["value"] for r in one.collect()}
        assert {k[2:] for k in got if k[:2] == (tr, tc)} == set(want)
        for k, v in want.items():
            g = got[(tr, tc, *k)]
            assert g == v if v is None or g is None else g == pytest.approx(v, rel=1e-4, abs=1e-4), k
    pixels = spark.read.parquet(f"{tmp_path}/out/stats/alti-diff/tiles.parquet")
    assert {"tile_row", "tile_col", "row", "col", "z", "land_ref", "sec_slope"} <= set(pixels.columns) and pixels.filter("tile_row = 1 and tile_col = 1").agg(F.min("row")).first()[0] >= 30
    assert spark.read.parquet(f"{tmp_path}/out/stats/alti-diff/stats_by_tile.parquet").count() == sum(k[2] == "alti-diff" for k in got)
    for bad in ({"ref-curvature": {}}, {"alti-diff": {"metrics": ["cdf"]}}):
        with pytest.raises(ValueError, match="by tile"):
            tiles.compare_tiles(spark, {**cfg, "statistics": bad, "tiling": {"height": 40, "width": 40}})
