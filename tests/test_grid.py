"""Operators on small grids, against values worked out by hand or by numpy."""

import json
import math

import numpy as np
import pytest

from reliefspark.functions import metrics
from reliefspark.grid import Grid, GridMeta, box_intersection, check_has_data, create_grid, crop_box, crop_offset_ranges, roi_bounds
from reliefspark.operators import classify, coregister, processing, resample, spectral, stats, stencil, tiling
from reliefspark.plans import config, pipeline, queries
from reliefspark.sources.grids import add_geoid, load_grid, sec_grid, smooth_grid
from reliefspark.streaming import incremental

N = None
#: Fixed values, here and in the tests' expected results: published heights and what operators make of them.
RELIEF = [[1982, 1967, 1950], [2005, 1988, 1969], [2012, 1990, 1967]]


def grid(spark, values, px=1.0, crs="EPSG:32631", **labels):
    rows = [(r, c, float(v) if v is not None else None, *[labels[n][r][c] for n in labels]) for r, line in enumerate(values) for c, v in enumerate(line)]
    schema = "row long, col long, z double" + "".join(f", {n} int" for n in labels)
    return Grid(spark.createDataFrame(rows, schema), GridMeta(len(values), len(values[0]), (0.0, px, 0.0, 0.0, 0.0, -px), crs), tuple(labels))


def array(df, value="z"):
    rows = df.select("row", "col", value).collect()
    out = np.full((max(r[0] for r in rows) + 1, max(r[1] for r in rows) + 1), np.nan)
    for r, c, v in rows:
        out[r, c] = np.nan if v is None else v
    return out


def nan(values):
    return np.array([[np.nan if v is None else v for v in line] for line in values], float)


def test_scalar_metrics(spark):
    v = np.array([-7, 3, 3, 1, 3, 1, 0], float)
    g = grid(spark, [v.tolist()])
    row = stats.class_stats(g, classify.global_layer()).first()
    want = {"mean": v.mean(), "max": 3, "min": -7, "std": v.std(), "rmse": math.sqrt((v * v).mean()), "median": 1, "nmad": 1.4826 * np.median(abs(v - 1)), "sum": 4, "squared_sum": (v * v).sum(), "percentil_90": np.percentile(abs(v - v.mean()), 90)}
    for name, value in want.items():
        assert row[name] == pytest.approx(value, abs=1e-5), name
    assert row["set_name"] == "global:1" and row["nbpts"] == 7 and row["percent_valid_points"] == 100


def test_vector_metrics(spark):
    values = [[-7, 3, 3, 1, 3, 1, 0], [-1, 3, 4, 5, 3, -6, 0]]
    got = metrics.vector_metric("cdf")(grid(spark, values).df).orderBy("bin").collect()
    hist, edges = np.histogram(abs(np.array(values)), bins=70, range=(0, 7))
    assert np.allclose([r["value"] for r in got], np.cumsum(hist) / 14) and np.allclose([r["edge"] for r in got], edges[:-1])
    one = grid(spark, values[:1])
    for p98 in (False, True):
        bound = abs(np.percentile(values[0], 98)) if p98 else 3
        hist, edges = np.histogram(values[0], bins=np.arange(-bound, bound, 0.2))
        got = metrics.vector_metric("pdf")(one.df, bin_step=0.2, filter_p98=p98).orderBy("bin").collect()
        assert np.allclose([r["edge"] for r in got], edges[:-1]) and np.allclose([r["value"] for r in got], hist / hist.sum())
    for t in ((0.5, 1, 3), (-3, 2, 90)):
        got = metrics.vector_metric("ratio_above_threshold")(one.df, elevation_threshold=t).orderBy("bin").collect()
        assert np.allclose([r["value"] for r in got], [(np.array(values[0]) > x).mean() for x in t])
    got = metrics.vector_metric("slope-orientation-histogram")(grid(spark, RELIEF), -0.000833333, -0.000833333).orderBy("bin").collect()
    assert sum(r["value"] for r in got) == 9 and got[0]["edge"] == pytest.approx(0.577902, abs=1e-5) and len(got) == 100
    assert not metrics.all_zero(one.df, 7)
    with pytest.raises(KeyError):
        metrics.kind("none")


def test_hillshade_and_sky_view(spark):
    want = [[149.34193, 142.97736, 136.03064], [125.85443, 112.33784, 99.7046], [90.020424, 73.68868, 62.433144]]
    assert np.allclose(array(metrics.matrix_metric("hillshade")(grid(spark, RELIEF))), want, atol=1e-4)
    want = [[223.102478, 72.567892, 0], [255, 255, 185.740152], [255, 255, 46.564479]]
    assert np.allclose(array(metrics.matrix_metric("svf")(grid(spark, RELIEF))), want, atol=1e-3)


def test_sobel_and_slope(spark):
    s = stencil.sobel(grid(spark, [[1, 0, 1], [1, 0, 1], [-1, 0, 1]]))
    gx, gy = np.array([[4, 0, -4], [2, -2, -4], [-2, -6, -4]]), np.array([[0, 0, 0], [6, 2, 0], [6, 2, 0]])
    assert np.allclose(array(s, "gx"), gx) and np.allclose(array(s, "gy"), gy)
    got = array(stencil.slope(grid(spark, [[1, 0, 1], [1, 0, 1], [-1, 0, 1]])).df, "slope")
    assert np.allclose(got, np.arctan(np.sqrt(gx**2 + gy**2) / 8) * 100)


def test_gradient_and_waveform(spark):
    v = np.array([[1, 1, 1], [-1, 2, 1], [4, -3, 1], [1, 1, 1], [1, 1, 1]], float)
    g = stencil.slope_aspect(grid(spark, v.tolist()))
    d_row, d_col = np.gradient(v)
    assert np.allclose(array(g, "slope"), np.hypot(d_row, d_col)) and np.allclose(np.exp(1j * array(g, "aspect")), np.exp(1j * (np.arctan2(-d_col, d_row) + np.pi)))
    w = np.array([[-7, 3, 3], [1, 3, 1], [3, 1, 0]], float)
    got = stencil.waveform(grid(spark, w.tolist()))
    assert np.allclose(array(got, "row_wave"), w - w.mean(0)) and np.allclose(array(got, "col_wave"), w - w.mean(1)[:, None])


def test_differences(spark):
    sec = [[1, 1, 1], [1, 1, 1], [-1, N, 1], [1, 2, N], [1, 1, N]]
    ref = [[3, N, 3], [N, 2, 1], [N, 0, 1], [1, 1, 0], [1, 1, N]]
    want = nan([[2, N, 2], [N, 1, 0], [N, N, 0], [0, -1, N], [0, 0, N]])
    assert np.allclose(array(processing.process("alti-diff", grid(spark, ref), grid(spark, sec)).df), want, equal_nan=True)
    other = [[1913, 1898, 1879], [1905, 1890, 1872], [1890, 1876, 1861]]
    want = [[1.480917, 1.357961, 1.192593], [1.375154, 1.154992, 0.883184], [1.126594, 0.855523, 0.545449]]
    got = array(processing.process("angular-diff", grid(spark, other, px=1.0), grid(spark, RELIEF, px=1.0)).df)
    assert np.allclose(got, want, atol=1e-4)
    ref = [[3, 3, 3], [1, 2, 1], [N, 0, 1], [1, 1, 0], [1, 1, N]]
    want = nan([[1.107149, 0.785398, 1.107149], [N, N, 0.955317], [N, N, N], [N, N, N], [0, N, N]])
    assert np.allclose(array(processing.angular_difference(grid(spark, ref), grid(spark, sec))), want, atol=1e-5, equal_nan=True)
    with pytest.raises(KeyError):
        processing.process("none", None)


def test_curvature(spark):
    values = [[3, N, 3], [N, 2, 1], [N, 0, 1], [1, 1, 0], [1, 1, N]]
    want = [[0.9398802, N, 1.7072412], [N, 0.7338672, -1.4214045], [N, -2.4205306, 0.42490682], [0.36860558, 0.6654598, -1.5057596], [-0.0843266, 0.36212376, N]]
    assert np.allclose(array(spectral.curvature(grid(spark, values))), nan(want), atol=1e-5, equal_nan=True)
    values = [[3, 3, 3], [1, 2, 1], [N, 0, 1], [1, 1, 0], [1, 1, N]]
    want = [[1.7635386, 1.500691, 1.7770832], [-1.3848146, 1.3327632, -1.3950232], [N, -2.5563521, 0.48228034], [-0.05303898, 0.64098966, -1.4813623], [-0.02683339, 0.37867376, N]]
    assert np.allclose(array(processing.process("ref-curvature", grid(spark, values)).df), nan(want), atol=1e-5, equal_nan=True)


# Heights of two pairs of grids in degrees, and their published slope-normalised differences.
STEEP_SEC = [[1914, 1895, 1880, 1857, 1872, 1890], [1901, 1885, 1869, 1855, 1871, 1888], [1892, 1875, 1858, 1857, 1878, 1900], [1371, 1351, 1320, 1761, 1764, 1759], [1355, 1342, 1317, 1760, 1760, 1758], [1343, 1321, 1294, 1760, 1757, 1754]]
STEEP_REF = [[1913, 1898, 1879, 1855, 1871, 1891], [1905, 1890, 1872, 1855, 1873, 1894], [1890, 1876, 1861, 1855, 1874, 1898], [1374, 1349, 1305, 1761, 1761, 1760], [1358, 1343, 1311, 1759, 1760, 1758], [1357, 1342, 1310, 1757, 1756, 1754]]
STEEP_WANT = [
    [-2.13889, 1.8611128, -2.1388907, -3.1388893, -2.1388905, -0.1388889], [2.861113, 3.861115, 1.8611127, -1.138889, 0.86111194, 4.8611135], [-3.1389298, -0.13889067, 1.8611313, -3.1389077, -5.138903, -3.1388984],
    [1.8611357, -3.1389303, -16.139097, -1.1389, -4.1389008, -0.1388893], [1.8611127, -0.13888901, -7.138963, -2.1389124, -1.138889, -1.138889], [12.861118, 19.861135, 14.86127, -4.1389356, -2.138889, -1.138889],
]
FLAT_SEC = [
    [19.547047, 19.55331, 19.560884, 19.568203, 19.552214, 19.561977], [19.63805, 20.045979, 20.727287, 20.874863, 20.879704, 21.060541], [21.295753, 21.389414, 21.219566, 21.058632, 21.13076, 20.918678],
    [20.903389, 20.744022, 20.70011, 20.294266, 19.87637, 19.726604], [20.337505, 20.917957, 21.017256, 21.004324, 21.197472, 21.304148], [21.458612, 21.55021, 22.57449, 22.878378, 23.041908, 23.01843],
]
FLAT_REF = [
    [19.31176, 19.22148, 19.211123, 19.293081, 19.26587, 19.203588], [19.211302, 19.3398, 19.644583, 19.965935, 20.91119, 20.868784], [20.847872, 20.863094, 20.843157, 20.69857, 20.411663, 20.092188],
    [19.784042, 19.51518, 19.33782, 19.233442, 19.191921, 19.214354], [19.346697, 19.64496, 20.012804, 20.353899, 20.642817, 20.8117], [20.90534, 20.999607, 20.481012, 20.4837, 20.482937, 20.48312],
]
FLAT_WANT = [
    [0.59798896, 0.5014447, 0.48351377, 0.55815405, 0.54693127, 0.4748869], [0.4065275, 0.127097, -0.24942902, -0.07565233, 0.8647624, 0.64151865], [0.385394, 0.30695614, 0.4568661, 0.47321403, 0.11417851, 0.00678522],
    [-0.28607106, -0.39556623, -0.5290139, -0.22754785, 0.14882739, 0.32102475], [-0.15753289, -0.4397214, -0.1711762, 0.18285076, 0.27862075, 0.34082896], [0.28000343, 0.28267184, -1.2602022, -1.5614032, -1.7256964, -1.7020358],
]


@pytest.mark.parametrize("ref,sec,want", [(STEEP_REF, STEEP_SEC, STEEP_WANT), (FLAT_REF, FLAT_SEC, FLAT_WANT)])
def test_slope_normalised_difference(spark, ref, sec, want):
    ref, sec = (Grid(grid(spark, v).df, GridMeta(6, 6)) for v in (ref, sec))
    assert np.allclose(array(processing.process("alti-diff-slope-norm", ref, sec).df), want, atol=2e-5)


def test_slope_normalised_needs_pixels(spark):
    with pytest.raises(ValueError):
        processing.slope_normalised(grid(spark, [[1, 1], [1, 1]]), grid(spark, [[1, 1], [1, 1]]))


def test_outliers(spark):
    v = [[1.0, 0, 1, 0, 1, 0, 1, 0]] * 2 + [[1.0, 0, 1, 0, 1, 0, N, 20]]
    flags = {(r["row"], r["col"]): r["inlier"] for r in stats.inliers(grid(spark, v).df).collect()}
    assert not flags[2, 6] and not flags[2, 7] and sum(flags.values()) == 22


def test_slope_classes_and_modes(spark):
    assert classify.complete_ranges([25]) == (0, 25) and classify.complete_ranges([0]) == (0,)
    with pytest.raises(TypeError):
        classify.complete_ranges([0, 2.5])
    g = grid(spark, [[1, 1, 1], [1, N, 1], [1, 1, 1]])
    sec, ref = [[0, 0, 5], [5, 10, 10], [25, 45, 45]], [[0, 5, 5], [5, 10, 10], [25, 45, 25]]
    planes = spark.createDataFrame([(r, c, float(ref[r][c]), float(sec[r][c])) for r in range(3) for c in range(3)], "row long, col long, ref_slope double, sec_slope double")
    df = g.df.join(planes, ["row", "col"])
    layer = classify.create("slope", "Slope0", {"ranges": [0, 5, 10, 25, 45]}, df.columns)
    rows = classify.in_modes(df.filter("z is not null"), layer).collect()
    assert {(r["row"], r["col"]) for r in rows if r["mode"] == "exclusion"} == {(0, 1), (2, 2)}
    assert len([r for r in rows if r["mode"] == "intersection"]) == 6 and len([r for r in rows if r["mode"] == "standard"]) == 8
    assert [r["class_idx"] for r in sorted(rows, key=lambda r: (r["row"], r["col"])) if r["mode"] == "standard"] == [0, 1, 1, 1, 2, 3, 4, 3]
    with pytest.raises(KeyError):
        classify.create("none", "x", {}, [])


def test_segmentation_and_fusion(spark):
    seg, slope = [[0, 1, 1], [1, 1, 0], [N, 1, 1], [N, 1, 0]], [[0, 0, 5], [5, 10, 10], [0, N, N], [0, 10, 5]]
    g = grid(spark, [[1] * 3] * 4, seg_ref=seg)
    planes = spark.createDataFrame([(r, c, float(slope[r][c]) if slope[r][c] is not None else None) for r in range(4) for c in range(3)], "row long, col long, ref_slope double")
    df = g.df.join(planes, ["row", "col"])
    a = classify.segmentation("seg", {"classes": {"sea": [0], "land": [1]}}, df.columns)
    b = classify.slope_layer("Slope0", {"ranges": [0, 5, 10]}, df.columns)
    f = classify.fusion("F", [a, b], "ref")
    got = array(df.withColumn("v", f.index["ref"] + 1), "v")
    assert np.allclose(got, nan([[1, 4, 5], [5, 6, 3], [N, N, N], [N, 6, 2]]), equal_nan=True)
    assert f.classes[0] == ("seg_sea_&_Slope0_[0%;5%[", "1") and len(f.classes) == 6
    with pytest.raises(classify.NotEnoughDataToClassificationLayerError):
        classify.fusion("F", [a], "ref")
    with pytest.raises(TypeError):
        classify.check_classes({"a": "b"})
    empty = stats.class_stats(g, classify.segmentation("seg", {"classes": {"none": [7]}}, df.columns)).first()
    assert empty["mean"] is None and empty["nbpts"] == 0


def test_crops_and_boxes(spark):
    assert crop_offset_ranges(5, 3, 2.3, 4.7) == ((4, 5), (0, 0))
    assert crop_offset_ranges(50, 30, 2.3, -4.7) == ((0, 45), (0, 27)) and crop_offset_ranges(50, 30, -2.3, 4.7) == ((4, 50), (2, 30))
    m = GridMeta(10, 20, (100.0, 10.0, 0.0, 200.0, 0.0, -10.0))
    assert m.bounds() == {"left": 100, "right": 300, "bottom": 100, "top": 200} and m.translated(1, 2).transform[0::3] == (110, 180)
    assert roi_bounds(m, {"x": 1, "y": 2, "w": 3, "h": 4}) == {"left": 110, "right": 140, "top": 180, "bottom": 140}
    with pytest.raises(TypeError):
        roi_bounds(m, {"x": 1})
    with pytest.raises(NameError):
        box_intersection(m.bounds(), {"left": 400, "right": 500, "bottom": 0, "top": 1})
    g = grid(spark, [[r * 4 + c for c in range(4)] for r in range(4)])
    got = crop_box(g, {"left": 0.5, "right": 2.5, "bottom": -2.0, "top": -1.0})
    assert array(got.df).tolist() == [[4, 5, 6]] and got.meta.transform[0::3] == (0, -1)
    with pytest.raises(ValueError):
        crop_box(g, {"left": 50, "right": 60, "bottom": -2, "top": -1})


def test_create_grid(spark):
    rows = spark.createDataFrame([(0, 0, -37.0), (0, 1, float("nan")), (1, 0, 100.0), (1, 1, None)], "row long, col long, z double")
    g = create_grid(rows, nodata=-37, zunit="cm")
    assert np.allclose(array(g.df), nan([[N, N], [1, N]]), equal_nan=True)
    with pytest.raises(ValueError):
        create_grid(rows, zunit="kg")
    with pytest.raises(ValueError):
        check_has_data(create_grid(rows.filter("z = -37"), nodata=-37))


def test_resampling(spark):
    v = np.arange(30, dtype=float).reshape(5, 6) ** 1.5
    g = grid(spark, v.tolist())
    for x, y in ((1.25, -2.5), (-0.5, 0.75), (0, 0), (9, -9)):
        fy, fx = np.clip(np.arange(5) - y, 0, 4), np.clip(np.arange(6) + x, 0, 5)
        r, c = np.minimum(fy.astype(int), 3), np.minimum(fx.astype(int), 4)
        a, b = (fy - r)[:, None], (fx - c)[None]
        want = v[r][:, c] * (1 - a) * (1 - b) + v[r][:, c + 1] * (1 - a) * b + v[r + 1][:, c] * a * (1 - b) + v[r + 1][:, c + 1] * a * b
        assert np.allclose(array(resample.shifted(g, x, y)), want)
    same, ref, factor = resample.reproject_grids(g, g)
    assert np.allclose(array(same.df), v) and np.allclose(array(ref.df), v) and factor == (1, 1)
    with pytest.raises(ValueError):
        resample.reproject(g, Grid(g.df, GridMeta(5, 6, crs="EPSG:2154")))  # a system that no projection is known of
    holes = [[1, N, N, N, 5]] + [[N] * 5] * 20
    assert array(resample.nearest_fill(grid(spark, holes)))[20].tolist() == [1, 1, 1, 5, 5]
    assert np.isnan(array(resample.nearest_fill(grid(spark, [[N, N]])))).all()


def test_geoid(spark):
    g = grid(spark, [[1, 2], [3, 4]], crs="EPSG:4326")
    flat = grid(spark, [[1, 1, 1]] * 3, crs="EPSG:4326")
    assert array(add_geoid(g, flat).df).tolist() == [[2, 3], [4, 5]]
    far = Grid(flat.df, GridMeta(3, 3, (182.0, 1.0, 0.0, 91.0, 0.0, -1.0)))
    with pytest.raises(ValueError):
        add_geoid(g, far)


def test_coregistration(spark):
    assert coregister.fit([(k, 2 * math.cos(k * math.pi / 36) - 3 * math.sin(k * math.pi / 36) + 1) for k in range(0, 72, 5)]) == pytest.approx((-3, 2, 1))
    with pytest.raises(ValueError):
        coregister.fit([(1, 1.0)])
    r, c = np.mgrid[0:40, 0:40].astype(float)
    surface = lambda r, c: np.sin(r / 9) * 20 + np.cos(c / 7) * 15 + np.sin((r + c) / 15) * 10
    done = coregister.coregister(grid(spark, surface(r + 1, c + 2).tolist()), grid(spark, surface(r, c).tolist()), iterations=3)
    assert done.transformation.x_offset == pytest.approx(2, abs=0.05) and done.transformation.y_offset == pytest.approx(1, abs=0.05)
    assert done.results["dx"]["unit_offset"] == "px" and done.results["reproj_coreg_sec"]["nb_points"] > 1000
    t = coregister.Transformation(30000, 64000, 0, adapting_factor=(0.4, -0.003))
    assert (t.total_offset_x, t.total_offset_y) == (12000, -192)
    with pytest.raises(KeyError):
        coregister.coregister(done.sec, done.ref, "none")


def test_tiles(spark):
    for h, w, o in ((0, 5, 0), (5, -1, 0), (5, 5, -1), (5, 5, 5)):
        with pytest.raises(ValueError):
            tiling.check(h, w, o)
    g = grid(spark, [[1] * 12] * 10)
    rows = tiling.assign(g.df, g.meta, 4, 5, 1).groupBy("tile_row", "tile_col").count().collect()
    assert {(r[0], r[1]): r[2] for r in rows}[0, 0] == 20 and len(rows) == 9
    assert tiling.tile_stats(g, 4, 5, 1).count() == 9


def test_configuration():
    with pytest.raises(ValueError):
        config.check({})
    for n in (0, -2, 16, 2.5):
        with pytest.raises(ValueError):
            config.check_coregistration({"number_of_iterations": n})
    with pytest.raises(ValueError):
        config.check_coregistration({"save_optional_outputs": True})
    with pytest.raises(TypeError):
        config.check_coregistration({"estimated_initial_shift_x": "1"})
    with pytest.raises(ValueError):
        config.check_layers({"F": {"type": "fusion", "ref": ["a", "b"]}})
    with pytest.raises(KeyError):
        config.check({"input_ref": {}, "statistics": {"none": {}}})
    with pytest.raises(ValueError):
        config.check({"input_ref": {}, "statistics": {"ref-curvature": {"classification_layers": {"Slope0": {"type": "slope"}}}}})
    with pytest.raises(ValueError):
        config.check({"input_ref": {"zunit": "kg"}})


def test_whole_run(spark, tmp_path):
    r, c = np.mgrid[0:20, 0:20].astype(float)
    ref = grid(spark, (r * c / 5).tolist(), seg=(r % 3).astype(int).tolist())
    for name, shift in (("ref", 0.0), ("sec", 2.0)):
        ref.df.selectExpr("row", "col", f"z - {shift} * (1 + row % 3) as z").write.parquet(str(tmp_path / f"{name}.parquet"))
    ref.df.selectExpr("row", "col", "cast(seg as double) as z").write.parquet(str(tmp_path / "seg.parquet"))
    cfg = {
        "output_dir": str(tmp_path / "out"), "input_ref": {"path": "ref.parquet", "crs": "EPSG:32631", "classification_layers": {"Status": {"map_path": "seg.parquet"}}}, "input_sec": {"path": "sec.parquet", "crs": "EPSG:32631"},
        "statistics": {"alti-diff": {"remove_outliers": True, "classification_layers": {
            "Status": {"type": "segmentation", "classes": {"a": [0], "b": [1, 2]}}, "Slope0": {"type": "slope", "ranges": [0, 25]}, "Fusion0": {"type": "fusion", "ref": ["Status", "Slope0"], "metrics": ["mean", "hillshade", {"ratio_above_threshold": {"elevation_threshold": [1, 3]}}, {"nmad": {"remove_outliers": False}}]}}}},
    }
    (tmp_path / "cfg.json").write_text(json.dumps(cfg))
    table, _ = pipeline.run(spark, str(tmp_path / "cfg.json"))
    results = stats.Results(table)
    assert results.layers() == ["Fusion0", "Slope0", "Status", "global"]
    assert results.metric("global", "median") == 4 and results.metric("Status", "nbpts", 0) == 140
    assert set(results.metrics("Fusion0")) == {"mean", "nmad", "nbpts", "percent_valid_points"}
    with pytest.raises(KeyError):
        results.metric("global", "none")
    folder = tmp_path / "out/stats/alti-diff"
    assert spark.read.csv(str(folder / "Fusion0/ratio_above_threshold_0.csv"), header=True).columns == ["Thresholds", "Ratio above threshold"]
    assert spark.read.csv(str(folder / "cdf_0.csv"), header=True).columns == ["Bins", "CDF values"] and spark.read.parquet(str(folder / "svf.parquet")).count() == 400
    assert spark.read.parquet(str(folder / "Status/ref_rectified_support_map.parquet")).agg({"z": "max"}).first()[0] == 1 and spark.read.parquet(str(folder / "Fusion0/hillshade_0.parquet")).count() == 400
    lines = spark.read.text(str(tmp_path / "out/report.md")).collect()
    assert lines[0][0] == "# Comparison" and len(lines) > 20
    assert spark.read.csv(str(tmp_path / "out/stats/alti-diff/Status/stats_results.csv"), header=True).columns[0] == "Set Name"
    assert load_grid(spark, {"path": str(tmp_path / "ref.parquet"), "crs": "EPSG:32631", "roi": {"x": 0, "y": 0, "w": 5, "h": 4}}).df.count() == 20


def test_incremental_statistics(spark, tmp_path):
    rows = [(k % 3, float(k)) for k in range(60)]
    for k in range(3):
        spark.createDataFrame(rows[k * 20 : k * 20 + 20], "class_idx int, z double").write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("class_idx int, z double").option("maxFilesPerTrigger", 4).parquet(str(tmp_path / "in"))
    incremental.start(stream, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
    got = {r["class_idx"]: r for r in incremental.finish(spark.read.parquet(str(tmp_path / "out"))).collect()}
    for k in range(3):
        v = np.array([z for c, z in rows if c == k])
        assert got[k]["mean"] == pytest.approx(v.mean()) and got[k]["std"] == pytest.approx(v.std()) and got[k]["nbpts"] == 20


def test_quantiles_narrow_down(spark, monkeypatch):
    from reliefspark.functions import quantiles

    rng = np.random.default_rng(4)
    groups = {0: rng.normal(size=500), 1: np.repeat(3.0, 40), 2: rng.integers(0, 3, 300).astype(float), 3: np.array([5.0]), 4: np.r_[np.zeros(200), np.ones(200)], 5: np.r_[rng.normal(size=99), 1e12]}
    groups[6] = np.r_[rng.normal(0, 1e-3, 50), 1 + rng.normal(0, 1e-3, 50)]  # two clusters with the rank between them
    groups[7] = np.nextafter(1.0, 2) + np.arange(60) % 2 * 2.0**-52  # neighbours among the doubles
    df = spark.createDataFrame([(k, float(v)) for k, g in groups.items() for v in g] + [(8, None)], "g int, v double")
    shares = (0.0, 0.3, 0.5, 0.9, 1.0)
    got = quantiles.quantiles(df, ["g"], [(f"q{s}", df["v"], s) for s in shares], cells=5, most=7)
    assert got[(8,)] == {f"q{s}": None for s in shares}
    for s in shares:
        assert {k: got[(k,)][f"q{s}"] for k in groups} == pytest.approx({k: np.quantile(g, s) for k, g in groups.items()}, abs=1e-12)
    assert quantiles.quantile(df.filter("g = 0"), df["v"], 0.98) == pytest.approx(np.quantile(groups[0], 0.98)) and quantiles.quantile(df.filter("g = 9"), df["v"], 0.5) is None


def test_registered_metrics_may_need_their_class(spark):
    rng = np.random.default_rng(5)
    v, seg = rng.normal(size=(12, 15)), rng.integers(0, 3, (12, 15))
    g = grid(spark, v.tolist(), seg_ref=seg.tolist())
    layer = classify.segmentation("seg", {"classes": {"a": [0], "b": [1, 2], "none": [9]}}, g.df.columns)
    from pyspark.sql import functions as F

    metrics.scalar("around_mean", "mean")(lambda z, mean, median: F.avg(F.abs(z - mean)))
    metrics.ranked("upper_half", 0.75, "median")(lambda z, mean, median: z - median)
    try:
        rows = {r["set_name"]: r for r in stats.class_stats(g, layer, ("around_mean", "upper_half", "nmad", "percentil_90")).collect()}
    finally:
        del metrics._scalars["around_mean"], metrics._quantiles["upper_half"]
    for name, of in (("a:[0]", seg == 0), ("b:[1, 2]", seg > 0)):
        x = v[of]
        assert rows[name]["around_mean"] == pytest.approx(abs(x - x.mean()).mean(), abs=1e-5) and rows[name]["upper_half"] == pytest.approx(np.quantile(x - np.median(x), 0.75), abs=1e-5)
        assert rows[name]["nmad"] == pytest.approx(1.4826 * np.median(abs(x - np.median(x))), abs=1e-5) and rows[name]["percentil_90"] == pytest.approx(np.quantile(abs(x - x.mean()), 0.9), abs=1e-5)
    assert rows["none:[9]"]["nmad"] is None


def test_vector_metrics_by_class(spark):
    v = np.array([[0.0, 0.5, 2.0, 4.0], [-3.0, 1.0, 6.0, 0.2], [0.0, 0.0, 0.0, 0.0]])
    g = grid(spark, v.tolist(), seg_ref=[[0, 0, 1, 1], [0, 1, 1, 0], [2, 2, 2, 2]])
    layer = classify.segmentation("seg", {"classes": {"a": [0], "b": [1], "none": [9]}}, g.df.columns)
    got = stats.class_vectors(g, layer, "ratio_above_threshold", {"elevation_threshold": (0.1, 3)}).collect()
    assert {(r["set_name"], r["edge"]): r["value"] for r in got} == {("a:[0]", 0.1): 0.5, ("a:[0]", 3.0): 0, ("b:[1]", 0.1): 1, ("b:[1]", 3.0): 0.5}
    whole = classify.global_layer()
    zero = grid(spark, [[0, 1e-9], [0, 0]])
    assert stats.class_vectors(zero, whole, "cdf").count() == 0 and stats.class_vectors(grid(spark, [[0, N]]), whole, "cdf").count() == 25
    assert stats.class_vectors(g, whole, "slope-orientation-histogram").agg({"value": "sum"}).first()[0] == 12
    shade = array(stats.class_matrix(g, whole, "hillshade"))
    assert np.allclose(shade, array(metrics.matrix_metric("hillshade")(g)))


def test_nearest_fill_by_brute_force(spark):
    rng = np.random.default_rng(11)
    for share in (0.5, 0.97):
        v = np.where(rng.random((23, 31)) < share, np.nan, rng.integers(0, 1000, (23, 31)).astype(float))
        v[:, 5:9] = np.nan
        valid = np.argwhere(~np.isnan(v)).tolist()
        want = [[v[tuple(min(valid, key=lambda q: ((q[0] - r) ** 2 + (q[1] - c) ** 2, q)))] for c in range(31)] for r in range(23)]
        got = array(resample.nearest_fill(grid(spark, [[None if np.isnan(x) else x for x in line] for line in v.tolist()])))
        assert np.array_equal(got, np.array(want))


def brute_filtered(v):
    """The whole grid's cosine transform by matrices, each frequency times its length to the power 0.9, and back."""
    def basis(n):
        return np.cos(np.pi * np.outer(np.arange(n), np.arange(n) + 0.5) / n)

    (r, c), (a, b) = v.shape, map(basis, v.shape)
    length = ((np.arange(r)[:, None] * np.pi / r) ** 2 + (np.arange(c) * np.pi / c) ** 2) ** 0.45
    weight = np.where(np.arange(r) > 0, 2, 1)[:, None] * np.where(np.arange(c) > 0, 2, 1) / (r * c)
    return a.T @ (a @ v @ b.T * length * weight) @ b


def test_curvature_queries_read_whole_tables(spark):
    sf = "/root/testdata/sf0.001"
    want = brute_filtered(array(smooth_grid(spark, sf).df))
    assert want.shape == (500, 64)
    assert np.allclose(array(queries.curvature(spark, sf)), want, atol=1e-4)
    low = np.minimum(want, 0)
    a, b = np.quantile(low, [0.09, 0.91])
    assert np.allclose(array(queries.svf(spark, sf)), np.clip((low - a) / (b - a), 0, 1) * 255, atol=1e-2)
    sec = sec_grid(spark, sf)
    v = array(sec.df)
    filled, valid = v.copy(), np.argwhere(~np.isnan(v))
    for p in np.argwhere(np.isnan(v)):
        filled[tuple(p)] = v[tuple(min(valid.tolist(), key=lambda q: ((q[0] - p[0]) ** 2 + (q[1] - p[1]) ** 2, q)))]
    got = array(queries.sec_curvature(spark, sf))
    assert got.shape == v.shape == (sec.meta.nrows, sec.meta.ncols) == (15, 100)
    assert np.allclose(got, np.where(np.isnan(v), np.nan, brute_filtered(filled)), atol=1e-4, equal_nan=True)


def test_load_grid_adds_its_geoid(spark, tmp_path):
    grid(spark, [[1, 2], [N, 4]]).df.write.parquet(str(tmp_path / "dem.parquet"))
    grid(spark, [[10, 20, 30], [10, 20, 30], [10, 20, 30]]).df.write.parquet(str(tmp_path / "geoid.parquet"))
    where = {"crs": "EPSG:32631", "transform": [0.0, 1.0, 0.0, 0.0, 0.0, -1.0]}
    got = load_grid(spark, {"path": str(tmp_path / "dem.parquet"), "geoid": {"path": str(tmp_path / "geoid.parquet"), **where}, **where})
    assert np.allclose(array(got.df), nan([[11, 22], [N, 24]]), equal_nan=True)


def test_grids_are_saved_and_loaded(spark, tmp_path):
    g = grid(spark, [[1, N], [3, 4]], px=2.0)
    pipeline.save_grid(g, str(tmp_path / "dem"))
    got = load_grid(spark, {"path": str(tmp_path / "dem.parquet")})
    assert got.meta.transform == g.meta.transform and got.meta.crs == g.meta.crs and np.allclose(array(got.df), nan([[1, N], [3, 4]]), equal_nan=True)
    grid(spark, [[1, 2, 3]]).df.write.parquet(str(tmp_path / "labels.parquet"))
    with pytest.raises(ValueError):
        load_grid(spark, {"path": str(tmp_path / "dem.parquet"), "classification_layers": {"a": {"map_path": str(tmp_path / "labels.parquet")}}})
    with pytest.raises(ValueError):
        load_grid(spark, {"path": "dem.png"})


def test_fusions_count_layers_by_support():
    layers = {"a": {"type": "slope"}, "b": {"type": "slope"}}
    config.check_layers({**layers, "F": {"type": "fusion", "sec": ["a", "b"]}})
    for fused in ({"ref": ["a"], "sec": ["b"]}, {"ref": ["a", "b"], "sec": ["a"]}, {}):
        with pytest.raises(ValueError):
            config.check_layers({**layers, "F": {"type": "fusion", **fused}})
    with pytest.raises(ValueError):
        config.check_metrics([{"ratio_above_threshold": {"original_unit": "cm"}}])


def test_tiles_are_coregistered_alone(spark, tmp_path):
    from reliefspark.plans import tiles

    r, c = np.mgrid[0:60, 0:50].astype(float)
    surface = lambda r, c: np.sin(r / 9) * 20 + np.cos(c / 7) * 15 + np.sin((r + c) / 15) * 10
    ref, sec = surface(r, c), surface(r + 1, c + 2)
    sec[:, 40:] = np.nan  # tiles of the last column have few pixels or none
    gs = [grid(spark, [[None if np.isnan(x) else x for x in line] for line in v.tolist()]) for v in (ref, sec)]
    for g, name in zip(gs, ("ref", "sec")):
        pipeline.save_grid(g, str(tmp_path / name))
    cfg = {"output_dir": str(tmp_path / "out"), "input_ref": {"path": str(tmp_path / "ref.parquet")}, "input_sec": {"path": str(tmp_path / "sec.parquet")}, "coregistration": {"number_of_iterations": 3}, "tiling": {"height": 40, "width": 30, "overlap": 10}}
    got = {(x["tile_row"], x["tile_col"]): x for x in tiles.run_tiles(spark, cfg).collect()}
    assert set(got) == {(i, j) for i in range(2) for j in range(2)}
    one = spark.createDataFrame(gs[1].df.filter("row < 40 and col < 30").collect(), gs[1].df.schema), spark.createDataFrame(gs[0].df.filter("row < 40 and col < 30").collect(), gs[0].df.schema)
    x, y, dz, moved, _ = coregister.nuth_kaab(Grid(one[0], GridMeta(40, 30, crs="EPSG:32631")), Grid(one[1], GridMeta(40, 30, crs="EPSG:32631")), 3)
    tile = got[0, 0]
    assert (tile["dx"], tile["dy"], tile["dz"]) == pytest.approx((x, -y, dz), abs=1e-6) and tile["pct_valid_sec"] == pytest.approx(coregister.counts(moved)["percentage_valid_points"] * 100, abs=1e-2)
    assert tiles.tiling.tile_shifts(gs[0], Grid(gs[1].df.selectExpr("row", "col", "cast(null as double) as z"), gs[1].meta), 60, 50).first()["dx"] is None
    for bad in ({"height": 0}, {"width": -3}, {"overlap": -1}, {"nb_cpu": 0}, {"overlap": 40}, {"height": 2.5}):
        with pytest.raises(ValueError):
            tiles.check({"height": 40, "width": 30, **bad})


@pytest.mark.parametrize("shape", [(6, 8), (7, 9), (5, 4), (1, 7), (8, 1)])
def test_curvature_without_mirroring(spark, shape):
    z = np.random.default_rng(sum(shape)).normal(size=shape) * 50
    fy, fx = (np.fft.fftfreq(n) * 2 * np.pi for n in shape)
    want = np.fft.ifft2(np.fft.fft2(z) * (fx**2 + fy[:, None] ** 2) ** 0.45).real
    assert np.allclose(array(spectral.curvature(grid(spark, z.tolist()), replication=False)), want)
    f = spectral.frequencies(spark, *shape)
    for axis, n in enumerate(shape):
        assert np.allclose(array(f, ("f_row", "f_col")[axis]).take(0, 1 - axis), np.fft.fftshift(np.fft.fftfreq(n) * 2 * np.pi) if n % 2 else np.arange(-n // 2, n // 2) * 2 * np.pi / n)


def test_curvature_without_mirroring_fills_and_restores_holes(spark):
    z = np.random.default_rng(2).normal(size=(6, 7))
    holed = z.copy()
    holed[2, 3] = np.nan
    z[2, 3] = z[1, 3]  # of its neighbours, that of least row
    fy, fx = (np.fft.fftfreq(n) * 2 * np.pi for n in z.shape)
    want = np.fft.ifft2(np.fft.fft2(z) * (fx**2 + fy[:, None] ** 2) ** 0.45).real
    want[2, 3] = np.nan
    assert np.allclose(array(spectral.curvature(grid(spark, [[None if np.isnan(v) else v for v in line] for line in holed.tolist()]), replication=False)), want, equal_nan=True)


def test_far_heights_make_no_endless_histograms(spark):
    g = grid(spark, [[1e9, 2, 3, 0.5, -4.0]])
    layer = classify.global_layer()
    for metric, params in (("cdf", {"bin_step": 0.1}), ("pdf", {"bin_step": 0.2})):
        with pytest.raises(ValueError, match="bin_step of 0"):
            stats.class_vectors(g, layer, metric, params)
        with pytest.raises(ValueError, match="choose a wider one"):
            metrics.vector_metric(metric)(g.df, **params)
        bins = stats.class_vectors(g, layer, metric, {"bin_step": 1e4})
        assert bins.count() > 50_000 and bins.agg({"value": "max"}).first()[0] == (1.0 if metric == "cdf" else 0.75)  # the greatest value ends the last bin of a pdf
