"""The queries over the driver's tables, one or more for each operator."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reliefspark.functions import metrics
from reliefspark.functions.pixel import x_of, y_of
from reliefspark.functions.projection import moved
from reliefspark.grid import Grid, GridMeta, create_grid, crop_box, crop_offset, roi_bounds
from reliefspark.operators import blocks, classify, processing, resample, spectral, stats, stencil, tiling
from reliefspark.operators.coregister import coregister, counts, offsets_of, pair, slices
from reliefspark.operators.coregister import fit as fit_shift
from reliefspark.plans import pipeline
from reliefspark.sources import cubes
from reliefspark.sources.geotiff import write_raster
from reliefspark.sources.grids import add_geoid, events_grid, load_grid, ref_grid, sec_grid, smooth_grid, table
from reliefspark.sources.scratch import fresh, written
from reliefspark.streaming import incremental

QUERIES: dict = {}
#: Pixel size at which the slope classes of the order grids are all populated.
PX = 100.0
SEGMENTS = {"urgent": [1], "high": [2], "medium": [3], "rest": [4, 5]}
SLOPES = {"ranges": [0, 5, 10, 25, 45]}


def query(f):
    QUERIES[f.__name__] = f
    return f


def rounded(df: DataFrame, *columns: str, digits: int = 5) -> DataFrame:
    """Columns rounded; a negative zero becomes zero."""
    return df.withColumns({c: F.round(F.col(c), digits) + F.lit(0.0) for c in columns or ("z",)})


def both(spark: SparkSession, sf_dir: str, px: float = PX, sloped: bool = False) -> tuple[Grid, Grid]:
    ref, sec = ref_grid(spark, sf_dir, px=px), sec_grid(spark, sf_dir, px=px)
    return (stencil.slope(ref), stencil.slope(sec)) if sloped else (ref, sec)


def diff(spark: SparkSession, sf_dir: str, sloped: bool = False) -> Grid:
    return processing.process("alti-diff", *both(spark, sf_dir, sloped=sloped))


@query
def scan_grid_ref(spark, sf_dir):
    return rounded(ref_grid(spark, sf_dir).z())


@query
def scan_grid_sec_nodata(spark, sf_dir):
    """Pixels without items come as the sentinel and leave as null."""
    raw = sec_grid(spark, sf_dir)
    return rounded(create_grid(raw.df.withColumn("z", F.coalesce("z", F.lit(-32768.0))), nodata=-32768.0).z())


@query
def unit_convert(spark, sf_dir):
    ref = ref_grid(spark, sf_dir)
    return rounded(create_grid(ref.df, ref.meta, zunit="ft", labels=ref.labels).z(), digits=9)


@query
def pix_to_coord(spark, sf_dir):
    meta = GridMeta(1, 1, (596255.0, 500.0, 0.0, 5099745.0, 0.0, -500.0), "EPSG:32630")
    df = ref_grid(spark, sf_dir).df
    return df.select("row", "col", x_of(meta, F.col("row"), F.col("col")).alias("x"), y_of(meta, F.col("row"), F.col("col")).alias("y"))


@query
def translate_grid(spark, sf_dir):
    """The bounds of the grid moved by 2.5 pixels right and 1.5 down."""
    ref = ref_grid(spark, sf_dir, px=PX)
    b = GridMeta(ref.meta.nrows, ref.meta.ncols, ref.meta.translated(2.5, 1.5).transform).bounds()
    return spark.createDataFrame([tuple(float(b[k]) for k in ("left", "bottom", "right", "top"))], "left_x double, bottom_y double, right_x double, top_y double")


@query
def roi_image(spark, sf_dir):
    ref = ref_grid(spark, sf_dir, px=PX)
    return rounded(crop_box(ref, roi_bounds(ref.meta, {"x": 10, "y": 2, "w": 30, "h": 7})).z())


@query
def roi_terrain(spark, sf_dir):
    ref = ref_grid(spark, sf_dir, px=PX)
    return rounded(crop_box(ref, {"left": 1050.0, "right": 4120.0, "bottom": -990.0, "top": -210.0}).z())


def crop_query(name, x, y):
    def f(spark, sf_dir):
        return rounded(crop_offset(ref_grid(spark, sf_dir), x, y).z())

    f.__name__ = name
    query(f)


for _name, _x, _y in (("crop_offset_pp", 2.3, 4.7), ("crop_offset_pm", 2.3, -4.7), ("crop_offset_mp", -2.3, 4.7), ("crop_offset_mm", -2.3, -4.7)):
    crop_query(_name, _x, _y)


@query
def crop_labels(spark, sf_dir):
    """A crop by an offset takes the label planes along."""
    return rounded(crop_offset(ref_grid(spark, sf_dir), 2.3, 4.7).df)


@query
def ref_labels(spark, sf_dir):
    """The method `ref`: the grid with its label planes."""
    ref, sec = both(spark, sf_dir)
    return rounded(processing.process("ref", ref, sec).df)


@query
def alti_diff(spark, sf_dir):
    return rounded(diff(spark, sf_dir).z())


@query
def sec_with_ref_labels(spark, sf_dir):
    g = processing.process("sec", *both(spark, sf_dir))
    return rounded(g.df.select("row", "col", "z", "priority_ref", "status_ref"))


@query
def label_planes(spark, sf_dir):
    """All label planes of both supports beside the difference."""
    return rounded(diff(spark, sf_dir).df.select("row", "col", "z", "priority_ref", "status_ref", "priority_sec"))


@query
def waveform_row(spark, sf_dir):
    return rounded(stencil.waveform(diff(spark, sf_dir)).select("row", "col", "row_wave"), "row_wave", digits=7)


@query
def waveform_col(spark, sf_dir):
    return rounded(stencil.waveform(diff(spark, sf_dir)).select("row", "col", "col_wave"), "col_wave", digits=7)


def summed(df: DataFrame) -> DataFrame:
    """Sums with fewer digits: they depend on the order of their terms."""
    return df.withColumns({c: F.round(c, 2) for c in ("sum", "squared_sum") if c in df.columns})


@query
def stats_global(spark, sf_dir):
    return summed(stats.class_stats(diff(spark, sf_dir), classify.global_layer()))


@query
def stats_segmentation(spark, sf_dir):
    g = diff(spark, sf_dir)
    layer = classify.segmentation("priority", {"classes": SEGMENTS}, [c for c in g.df.columns if c != "priority_sec"])
    return summed(stats.class_stats(g, layer))


@query
def stats_multilabel(spark, sf_dir):
    g = diff(spark, sf_dir)
    layer = classify.segmentation("status", {"classes": {"closed": [1], "other": [2, 3], "none": [9]}}, g.df.columns)
    return summed(stats.class_stats(g, layer))


@query
def stats_slope(spark, sf_dir):
    g = diff(spark, sf_dir, sloped=True)
    layer = classify.slope_layer("Slope0", SLOPES, [c for c in g.df.columns if c != "sec_slope"])
    return summed(stats.class_stats(g, layer, ("mean", "median", "std")))


@query
def stats_fusion(spark, sf_dir):
    g = diff(spark, sf_dir, sloped=True)
    a = classify.segmentation("status", {"classes": {"closed": [1], "other": [2, 3]}}, g.df.columns)
    b = classify.slope_layer("Slope0", {"ranges": [0, 25, 45]}, g.df.columns)
    return summed(stats.class_stats(g, classify.fusion("Fusion0", [a, b], "ref"), ("mean", "max", "min")))


def mode_stats(spark, sf_dir, mode):
    g = diff(spark, sf_dir)
    layer = classify.segmentation("priority", {"classes": SEGMENTS}, g.df.columns)
    return stats.class_stats(g, layer, ("mean", "std", "median")).filter(F.col("mode") == mode)


@query
def modes_intersection(spark, sf_dir):
    return mode_stats(spark, sf_dir, "intersection")


@query
def modes_exclusion(spark, sf_dir):
    return mode_stats(spark, sf_dir, "exclusion")


@query
def outliers_stats(spark, sf_dir):
    g = diff(spark, sf_dir)
    layer = classify.segmentation("priority", {"classes": SEGMENTS}, [c for c in g.df.columns if c != "priority_sec"])
    return stats.class_stats(g, layer, ("mean", "max", "min", "std"), remove_outliers=True)


@query
def stats_long(spark, sf_dir):
    """The long table of results, as it is appended across methods and layers."""
    s = stats.class_stats(diff(spark, sf_dir), classify.global_layer(), ("mean", "max", "min"))
    return stats.long_form(s, "alti-diff", "global")


@query
def cdf(spark, sf_dir):
    return rounded(metrics.vector_metric("cdf")(diff(spark, sf_dir).df, bin_step=10.0), "edge", "value")


@query
def pdf(spark, sf_dir):
    return rounded(metrics.vector_metric("pdf")(diff(spark, sf_dir).df, bin_step=10.0), "edge", "value")


@query
def pdf_p98(spark, sf_dir):
    return rounded(metrics.vector_metric("pdf")(diff(spark, sf_dir).df, bin_step=10.0, filter_p98=True), "edge", "value")


@query
def ratio_above_threshold(spark, sf_dir):
    return rounded(metrics.vector_metric("ratio_above_threshold")(diff(spark, sf_dir).df, elevation_threshold=(0.5, 10, 100)), "edge", "value")


def by_class(spark, sf_dir, metric, **params):
    g = diff(spark, sf_dir)
    layer = classify.segmentation("priority", {"classes": SEGMENTS}, [c for c in g.df.columns if c != "priority_sec"])
    return rounded(rounded(stats.class_vectors(g, layer, metric, params), "edge", digits=3), "value")


@query
def cdf_by_class(spark, sf_dir):
    return by_class(spark, sf_dir, "cdf", bin_step=10.0)


@query
def pdf_by_class(spark, sf_dir):
    return by_class(spark, sf_dir, "pdf", bin_step=10.0)


@query
def ratio_by_class(spark, sf_dir):
    return by_class(spark, sf_dir, "ratio_above_threshold", elevation_threshold=(0.5, 10, 100))


@query
def orientation_hist(spark, sf_dir):
    return rounded(metrics.vector_metric("slope-orientation-histogram")(ref_grid(spark, sf_dir), 100.0, 100.0), "edge")


@query
def slope_projected(spark, sf_dir):
    return rounded(stencil.slope(sec_grid(spark, sf_dir, px=PX)).df.select("row", "col", "slope"), "slope")


@query
def slope_geographic(spark, sf_dir):
    g = ref_grid(spark, sf_dir, px=0.001, crs="EPSG:4326")
    return rounded(stencil.slope(g, degree=True).df.select("row", "col", "slope"), "slope", digits=4)


@query
def gradient_aspect(spark, sf_dir):
    return rounded(stencil.slope_aspect(ref_grid(spark, sf_dir)).select("row", "col", "slope", "aspect"), "slope", "aspect")


@query
def normals(spark, sf_dir):
    return rounded(stencil.normals(ref_grid(spark, sf_dir, px=PX)).select("row", "col", "n_x", "n_y", "n_z"), "n_x", "n_y", "n_z")


@query
def angular_diff(spark, sf_dir):
    return rounded(processing.angular_difference(*both(spark, sf_dir)), digits=4)


@query
def hillshade(spark, sf_dir):
    return rounded(stencil.hillshade(sec_grid(spark, sf_dir)), digits=4)


@query
def slope_norm_diff(spark, sf_dir):
    return rounded(processing.slope_normalised(*both(spark, sf_dir)), digits=4)


@query
def bilinear_shift(spark, sf_dir):
    return rounded(resample.shifted(sec_grid(spark, sf_dir), 1.25, -2.5), digits=8)


@query
def resample_affine(spark, sf_dir):
    """SEC, on pixels half again as large, resampled onto REF's grid."""
    ref, sec = ref_grid(spark, sf_dir, px=PX), sec_grid(spark, sf_dir, px=1.5 * PX)
    return rounded(resample.reproject(Grid(sec.z(), sec.meta), ref).df, digits=7)


@query
def resample_nearest(spark, sf_dir):
    ref, sec = ref_grid(spark, sf_dir, px=PX), sec_grid(spark, sf_dir, px=1.4 * PX)
    return rounded(resample.reproject(Grid(sec.z(), sec.meta), ref, "nearest").df)


@query
def nearest_fill(spark, sf_dir):
    return rounded(resample.nearest_fill(sec_grid(spark, sf_dir)))


@query
def geoid_offset(spark, sf_dir):
    """REF plus a geoid of its own: a plane on pixels ten times as large."""
    ref = ref_grid(spark, sf_dir, px=PX)
    rows, cols = ref.meta.nrows // 10 + 2, ref.meta.ncols // 10 + 2
    plane = spark.range(rows * cols).select((F.col("id") / cols).cast("long").alias("row"), (F.col("id") % cols).alias("col")).withColumn("z", F.col("row") * 0.5 - F.col("col") * 0.25)
    return rounded(add_geoid(ref, Grid(plane, GridMeta(rows, cols, (0.0, 10 * PX, 0.0, 0.0, 0.0, -10 * PX), ref.meta.crs))).z())


@query
def raster_scan(spark, sf_dir):
    """SEC written as a GeoTIFF by tasks, block by block, and read back."""
    sec = sec_grid(spark, sf_dir, px=PX)
    path = f"{fresh(spark, 'raster')}.tif"
    write_raster(sec, path, block=64, dtype="float64")
    return rounded(load_grid(spark, {"path": path}).z())


@query
def raster_region(spark, sf_dir):
    """A region of interest of a raster of two bands (REF and its priorities): only the blocks that it touches are read."""
    ref = ref_grid(spark, sf_dir, px=PX)
    bands = F.explode(F.array(F.struct(F.lit(1).alias("band"), F.col("z").alias("v")), F.struct(F.lit(2).alias("band"), F.col("priority").cast("double").alias("v"))))
    path = f"{fresh(spark, 'raster')}.tif"
    write_raster(Grid(ref.df.select("row", "col", bands.alias("b")).select("row", "col", "b.band", F.col("b.v").alias("z")), ref.meta), path, block=32, dtype="float64", bands=2)
    z, priority = (load_grid(spark, {"path": path, "band": b, "roi": {"x": 35, "y": 2, "w": 50, "h": 130}}).z() for b in (1, 2))
    return rounded(z.join(priority.withColumnRenamed("z", "priority"), ["row", "col"]), "z", "priority")


#: Where the order grids lie in a UTM zone, and SEC by longitude and latitude around the same place.
UTM, LONLAT = ((450_000.0, 1000.0, 0.0, 5_000_000.0, 0.0, -1000.0), "EPSG:32631"), ((2.3, 0.01, 0.0, 45.2, 0.0, -0.01), "EPSG:4326")


def placed(grid: Grid, place) -> Grid:
    return Grid(grid.df, replace(grid.meta, transform=place[0], crs=place[1]), grid.labels)


@query
def to_lonlat(spark, sf_dir):
    """Longitude and latitude of the pixels' corners of a grid in a UTM zone."""
    ref = placed(ref_grid(spark, sf_dir), UTM)
    df = ref.df.select("row", "col", x_of(ref.meta, F.col("row"), F.col("col")).alias("lon"), y_of(ref.meta, F.col("row"), F.col("col")).alias("lat"))
    return rounded(moved(df, "lon", "lat", "EPSG:32631", "EPSG:4326"), "lon", "lat", digits=8)


@query
def from_lonlat(spark, sf_dir):
    """UTM coordinates of the pixels' corners of a grid by longitude and latitude."""
    sec = placed(sec_grid(spark, sf_dir), LONLAT)
    df = sec.df.select("row", "col", x_of(sec.meta, F.col("row"), F.col("col")).alias("x"), y_of(sec.meta, F.col("row"), F.col("col")).alias("y"))
    return rounded(moved(df, "x", "y", "EPSG:4326", "EPSG:32631"), "x", "y", digits=4)


@query
def warp(spark, sf_dir):
    """SEC by longitude and latitude, resampled onto REF in a UTM zone."""
    ref, sec = placed(ref_grid(spark, sf_dir), UTM), placed(sec_grid(spark, sf_dir), LONLAT)
    return rounded(resample.reproject(Grid(sec.z(), sec.meta), ref).df, digits=3)


@query
def geoid_lonlat(spark, sf_dir):
    """REF in a UTM zone plus a geoid by longitude and latitude, a plane around the earth: grids of many rows go beyond the pole."""
    ref = placed(ref_grid(spark, sf_dir), UTM)
    rows, cols = 183, 365  # from 91 degrees north and 180 west; longitudes of the zone end at 183
    plane = spark.range(rows * cols).select((F.col("id") / cols).cast("long").alias("row"), (F.col("id") % cols).alias("col")).withColumn("z", (F.col("row") - 45) * 0.5 - (F.col("col") - 180) * 0.25)
    return rounded(add_geoid(ref, Grid(plane, GridMeta(rows, cols, (-180.0, 1.0, 0.0, 91.0, 0.0, -1.0), "EPSG:4326"))).z())


def dh(spark, sf_dir):
    ref, sec = both(spark, sf_dir)
    return offsets_of(pair(ref, sec), sec.meta, 0.0)


@query
def nk_slices(spark, sf_dir):
    return rounded(slices(dh(spark, sf_dir)), "median")


@query
def nk_single_iter(spark, sf_dir):
    east, north, c = fit_shift([(r["slice"], r["median"]) for r in slices(dh(spark, sf_dir)).collect()])  # at most 72 rows
    return rounded(spark.createDataFrame([(east, north, c)], "east double, north double, c double"), "east", "north", "c", digits=3)


def two_views(spark, sf_dir):
    """REF's heights, averaged over 15 x 15 pixels, and the same surface seen 2 columns and 1 row apart and 3.5 higher, with SEC's holes; both as tables, as they are read several times."""
    ref, sec = ref_grid(spark, sf_dir), sec_grid(spark, sf_dir)
    along = lambda axis, other: W.partitionBy(other).orderBy(axis)
    df = ref.df.select("row", "col", F.avg("z").over(along("col", "row").rowsBetween(-7, 7)).alias("z"))
    df = written(df.withColumn("z", F.avg("z").over(along("row", "col").rowsBetween(-7, 7))), "view")
    aside = df.withColumn("z", F.lead("z", 2).over(along("col", "row"))).withColumn("z", F.lead("z", 1).over(along("row", "col")) + 3.5)
    aside = aside.join(sec.df.select("row", "col", F.col("z").isNotNull().alias("has")), ["row", "col"]).select("row", "col", F.when(F.col("has"), F.col("z")).alias("z"))
    return Grid(df, ref.meta), Grid(written(aside, "view"), ref.meta)


@query
def nk_coregistration(spark, sf_dir):
    """Six iterations over the whole grid."""
    ref, sec = two_views(spark, sf_dir)
    t = coregister(sec, ref).transformation
    return rounded(spark.createDataFrame([(t.x_offset, t.y_offset, t.z_offset)], "dx double, dy double, dz double"), "dx", "dy", "dz")


@query
def tile_shifts(spark, sf_dir):
    """Every tile coregistered alone."""
    return rounded(tiling.tile_shifts(*two_views(spark, sf_dir), 60, 50, 20), "dx", "dy", "dz", "pct_valid_ref", "pct_valid_sec")


@query
def tile_comparison(spark, sf_dir):
    """The differences of every tile after its own coregistration: their number, mean, spread and median."""
    ref, sec = two_views(spark, sf_dir)
    shifts = tiling.tile_shifts(ref, sec, 60, 50, 20)
    d = processing.process("alti-diff", *tiling.tile_grids(ref, sec, shifts, 60, 50, 20))
    found = stats.part_stats(d, classify.global_layer(), tiling.all_tiles(sec, 60, 50, 20), ("mean", "median", "std"), most=60 * 50)
    return rounded(found.select("tile_row", "tile_col", "mean", "median", "std", "nbpts", "percent_valid_points"), "mean", "median", "std", digits=4)


@query
def coreg_counts(spark, sf_dir):
    """Points and valid points of both grids after their alignment."""
    sec, ref, _ = resample.reproject_grids(*both(spark, sf_dir)[::-1])
    rows = [(s, c["nb_points"], c["nb_valid_points"], c["percentage_valid_points"]) for s, c in (("ref", counts(ref)), ("sec", counts(sec)))]
    return spark.createDataFrame(rows, "support string, nb_points long, nb_valid_points long, percentage_valid_points double")


@query
def curvature(spark, sf_dir):
    return rounded(spectral.curvature(smooth_grid(spark, sf_dir)), digits=4)


@query
def curvature_plain(spark, sf_dir):
    """The curvature without mirror images: opposite edges are neighbours."""
    return rounded(spectral.curvature(smooth_grid(spark, sf_dir), replication=False), digits=4)


@query
def spatial_freq(spark, sf_dir):
    """The spatial frequencies of REF's grid without its last column and row, and the length that weighs its spectrum."""
    m = ref_grid(spark, sf_dir).meta
    f = spectral.frequencies(spark, m.nrows - 1, m.ncols - 1)
    return rounded(f.withColumn("weight", F.pow(F.pow("f_row", 2) + F.pow("f_col", 2), 0.45)), "f_row", "f_col", "weight", digits=9)


@query
def svf(spark, sf_dir):
    return rounded(spectral.sky_view(smooth_grid(spark, sf_dir)), digits=3)


@query
def ref_curvature(spark, sf_dir):
    ref = ref_grid(spark, sf_dir)
    return rounded(processing.process("ref-curvature", ref).z(), digits=4)


@query
def sec_curvature(spark, sf_dir):
    """The filter over a grid with holes, filled from their nearest pixels first."""
    sec = sec_grid(spark, sf_dir)
    return rounded(processing.process("sec-curvature", sec, sec).z(), digits=4)


@query
def events_scan(spark, sf_dir):
    return rounded(events_grid(spark, sf_dir).z())


@query
def tile_assignment(spark, sf_dir):
    g = ref_grid(spark, sf_dir)
    return tiling.assign(g.df.select("row", "col"), g.meta, 40, 30, 10)


@query
def tile_stats(spark, sf_dir):
    return rounded(rounded(tiling.tile_stats(diff(spark, sf_dir), 40, 30, 10), "pct_valid", "mean"), "median", digits=6)


@query
def stats_by_tile(spark, sf_dir):
    """All default metrics of the differences, in miles, of every tile of 4 x 4 pixels, by mode and class: tens of thousands of groups."""
    g = diff(spark, sf_dir)
    g = g.with_df(g.df.withColumn("z", F.col("z") / 1.609344))
    layer = classify.segmentation("priority", {"classes": SEGMENTS}, g.df.columns)
    return summed(tiling.stats_by_tile(g, layer, 4, 4, 1))


def saved_blocks(grid: Grid, size: int = 32) -> blocks.BlockGrid:
    return blocks.save_blocks(blocks.to_blocks(grid, size), fresh(grid.df.sparkSession, "blocks"), 8)


@query
def alti_diff_blocks(spark, sf_dir):
    """REF and SEC saved in buckets by block, and joined where they lie."""
    ref, sec = (saved_blocks(g) for g in both(spark, sf_dir))
    return rounded(blocks.pixels(blocks.alti_diff(ref, sec)))


@query
def slope_blocks(spark, sf_dir):
    return rounded(blocks.slope(saved_blocks(sec_grid(spark, sf_dir, px=PX))), "slope")


@query
def normals_blocks(spark, sf_dir):
    return rounded(blocks.normals(saved_blocks(ref_grid(spark, sf_dir, px=PX))), "n_x", "n_y", "n_z")


@query
def hillshade_blocks(spark, sf_dir):
    return rounded(blocks.hillshade(saved_blocks(sec_grid(spark, sf_dir))), digits=4)


def order_cube(spark, sf_dir) -> cubes.Cube:
    """A saved cube of REF: its heights, its priorities and SEC's heights."""
    ref, sec = both(spark, sf_dir)
    plane = Grid(ref.df.select("row", "col", F.col("priority").cast("double").alias("z")), ref.meta)
    cube = cubes.stacked({"height": Grid(ref.z(), ref.meta), "priority": plane, "other": Grid(sec.z(), ref.meta)}, height={"unit": "m"})
    return cubes.save_cube(cube, fresh(spark, "cube"))


@query
def cube_band(spark, sf_dir):
    """One band of a saved cube: its folder is the only one that is read."""
    return rounded(cubes.flat(order_cube(spark, sf_dir), "other").df)


@query
def cube_index(spark, sf_dir):
    """A function over bands of a saved cube: the normalised difference of both heights."""
    a, b = F.col("height"), F.col("other")
    return rounded(cubes.per_pixel(order_cube(spark, sf_dir), F.try_divide(a - b, a + b), ["height", "other"]).df, digits=7)


@query
def cube_stats(spark, sf_dir):
    return rounded(cubes.band_stats(order_cube(spark, sf_dir)), "mean", "std", "min", "max")


@query
def order_bounds(spark, sf_dir):
    """Bounds of median and nmad by priority, from cells of differences that were counted by column first, as tiles of a stream are."""
    d = diff(spark, sf_dir).df
    parts = incremental.cells(d.select("col", F.col("priority_ref").alias("class_idx"), "z"), "col")
    return rounded(incremental.order_bounds(parts), "median_low", "median_high", "nmad_low", "nmad_high")


@query
def shifted_labels(spark, sf_dir):
    """Label planes moved with the heights, by one aggregation."""
    return rounded(resample.shifted(ref_grid(spark, sf_dir), 1.25, -2.5, ("z", "priority", "status")), "z", "priority", "status", digits=8)


@query
def whole_run(spark, sf_dir):
    """A configuration's run over raster files of REF and SEC with their label planes: scans, alignment, difference, layers, statistics."""
    cfg = {"statistics": {"alti-diff": {"classification_layers": {"priority": {"type": "segmentation", "classes": SEGMENTS}}, "metrics": ["mean", "median", "max", "min", "std"]}}}
    for name, g in zip(("ref", "sec"), both(spark, sf_dir)):
        path = fresh(spark, name)
        write_raster(g, f"{path}.tif", block=64, dtype="float64")
        write_raster(Grid(g.df.select("row", "col", F.col("priority").alias("z")), g.meta), f"{path}_priority.tif", block=64, dtype="uint8")
        cfg[f"input_{name}"] = {"path": f"{path}.tif", "classification_layers": {"priority": {"map_path": f"{path}_priority.tif"}}}
    return pipeline.run(spark, cfg)[0].withColumn("value", F.col("value") + F.lit(0.0))
