"""Projections against published and independently computed coordinates; warps and geoids between systems."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from reliefspark.functions import projection
from reliefspark.grid import Grid, GridMeta
from reliefspark.operators import coregister, resample, stencil
from reliefspark.plans import queries
from reliefspark.sources.grids import add_geoid

#: Longitude, latitude, system, easting and northing of points, as published for WGS 84.
KNOWN = [(0.0, 45.0, "EPSG:32631", 263553.9739, 4987329.5047), (-79.387139, 43.642567, "EPSG:32617", 630084.30, 4833438.59), (3.0, 0.0, "EPSG:32631", 500000.0, 0.0), (180 / math.pi, 0.0, "EPSG:3857", 6378137.0, 0.0)]


def points(spark, rows):
    return spark.createDataFrame([(float(x), float(y)) for x, y in rows], "x double, y double")


def meridian_arc(lat):
    """Metres from the equator, by the arc's integral."""
    a, f = projection.WGS84[0], 1 / projection.WGS84[1]
    e2 = f * (2 - f)
    t = np.linspace(0, math.radians(lat), 200_001)
    v = a * (1 - e2) / (1 - e2 * np.sin(t) ** 2) ** 1.5
    return float(((v[1:] + v[:-1]) / 2 * np.diff(t)).sum())


def test_known_points(spark):
    for lon, lat, crs, east, north in KNOWN:
        got = projection.moved(points(spark, [(lon, lat)]), "x", "y", "EPSG:4326", crs).first()
        assert (got["x"], got["y"]) == pytest.approx((east, north), abs=0.01)
    for lat in (-70, 10, 48.85, 84):
        got = projection.moved(points(spark, [(3.0, lat)]), "x", "y", "EPSG:4326", "EPSG:32731" if lat < 0 else "EPSG:32631").first()
        assert got["x"] == pytest.approx(500_000, abs=1e-6) and got["y"] - (1e7 if lat < 0 else 0) == pytest.approx(0.9996 * meridian_arc(lat), abs=1e-3)


def test_projection_keeps_angles(spark):
    """A small step north and one east, as long on the ground, are as long on the map and at right angles."""
    a, f = projection.WGS84[0], 1 / projection.WGS84[1]
    e2 = f * (2 - f)
    for lon, lat in ((0.5, 45.0), (6.2, 61.0), (1.0, 5.0)):
        w = math.sqrt(1 - e2 * math.sin(math.radians(lat)) ** 2)
        d_lat, d_lon = (math.degrees(10 / r) for r in (a * (1 - e2) / w**3, a * math.cos(math.radians(lat)) / w))
        p = [np.array(tuple(r)) for r in projection.moved(points(spark, [(lon, lat - d_lat), (lon, lat + d_lat), (lon - d_lon, lat), (lon + d_lon, lat)]), "x", "y", "EPSG:4326", "EPSG:32631").collect()]
        north, east = p[1] - p[0], p[3] - p[2]
        assert np.hypot(*north) == pytest.approx(np.hypot(*east), rel=1e-6) and abs(north @ east) < 1e-3 and 19.99 < np.hypot(*north) < 20.03


@pytest.mark.parametrize("crs", ["EPSG:32631", "EPSG:32731", "EPSG:25831", "EPSG:3857", "EPSG:4326"])
def test_round_trip(spark, crs):
    rows = [(lon, lat) for lon in np.linspace(-2, 8, 21) for lat in np.linspace(-80, 84, 42)]
    df = points(spark, rows).withColumns({"lon": F.col("x"), "lat": F.col("y")})
    back = projection.moved(projection.moved(df, "x", "y", "EPSG:4326", crs), "x", "y", crs, "EPSG:4326")
    worst = back.select(F.max(F.greatest(F.abs(F.col("x") - F.col("lon")), F.abs(F.col("y") - F.col("lat"))))).first()[0]
    assert worst * 111_320 < 1e-6 and set(back.columns) == {"x", "y", "lon", "lat"}


def test_zones_meet(spark):
    """A point in one zone's coordinates, moved to the next zone's, is where it is from longitude and latitude."""
    one, two = (projection.moved(points(spark, [(6.1, 47.0)]), "x", "y", "EPSG:4326", c) for c in ("EPSG:32631", "EPSG:32632"))
    got = projection.moved(one, "x", "y", "EPSG:32631", "EPSG:32632").first()
    assert tuple(got) == pytest.approx(tuple(two.first()), abs=1e-6)


def test_unknown_systems_are_refused():
    for crs in ("", "EPSG:2154", "EPSG:32661", "EPSG:32600", "local"):
        with pytest.raises(ValueError, match="isn't known"):
            projection.projection(crs)
    assert projection.projection("EPSG:32760").north == 1e7


def grid(spark, f, meta):
    r, c = np.mgrid[: meta.nrows, : meta.ncols]
    z = f(r + 0.5, c + 0.5)
    return Grid(spark.createDataFrame([(int(a), int(b), float(v)) for a, b, v in zip(r.ravel(), c.ravel(), z.ravel())], "row long, col long, z double"), meta)


UTM = GridMeta(60, 70, (400_000.0, 100.0, 0.0, 5_100_000.0, 0.0, -100.0), "EPSG:32631")


def heights(lon, lat):
    return np.sin(lon * 400) * 20 + np.cos(lat * 500) * 30 + np.sin((lon + lat) * 300) * 10


def lonlat_grid(spark, shift=0.0):
    """The surface by longitude and latitude around the UTM grid."""
    meta = GridMeta(80, 110, (1.69, 0.001, 0.0, 46.06, 0.0, -0.001), "EPSG:4326")
    return grid(spark, lambda r, c: heights(1.69 + c * 0.001 + shift, 46.06 - r * 0.001), meta)


def utm_grid(spark):
    rows = grid(spark, lambda r, c: 0 * r, UTM).df.withColumns({"x": 400_000 + (F.col("col") + 0.5) * 100, "y": 5_100_000 - (F.col("row") + 0.5) * 100})
    pts = projection.moved(rows, "x", "y", "EPSG:32631", "EPSG:4326").collect()
    return Grid(spark.createDataFrame([(r["row"], r["col"], float(heights(r["x"], r["y"]))) for r in pts], "row long, col long, z double"), UTM)


def test_warp_finds_the_same_surface(spark):
    utm, lonlat = utm_grid(spark), lonlat_grid(spark)
    got = resample.reproject(lonlat, utm).df.withColumnRenamed("z", "w").join(utm.df, ["row", "col"]).collect()
    assert len(got) == 4200 and all(r["w"] is not None and abs(r["w"] - r["z"]) < 2.5 for r in got)  # a pixel is a few metres high
    assert np.mean([abs(r["w"] - r["z"]) for r in got]) < 0.7
    near = resample.reproject(lonlat, utm, "nearest").df.filter("z is null").count()
    assert near == 0


def test_grids_of_two_systems_are_coregistered(spark):
    utm, lonlat = utm_grid(spark), lonlat_grid(spark, shift=0.002)  # two of its own pixels
    done = coregister.coregister(lonlat, utm, iterations=4, sampling_source="ref")
    fx, fy = done.transformation.adapting_factor
    assert fx == pytest.approx(100 / (111_320 * math.cos(math.radians(46)) * 0.001), rel=0.01) and fy == pytest.approx(100 / 111.2, rel=0.01)
    assert abs(done.transformation.total_offset_x) == pytest.approx(2, abs=0.15) and abs(done.transformation.total_offset_y) < 0.15
    same = coregister.coregister(lonlat, utm, iterations=4)
    assert same.reproj_sec.meta.crs == "EPSG:4326" and abs(same.transformation.total_offset_x) == pytest.approx(2, abs=0.15)


def test_disjoint_bounds_of_two_systems(spark):
    far = grid(spark, lambda r, c: r, GridMeta(5, 5, (90.0, 0.1, 0.0, 10.0, 0.0, -0.1), "EPSG:4326"))
    with pytest.raises(NameError):
        resample.reproject_grids(far, utm_grid(spark))


def test_geoid_by_longitude_and_latitude(spark):
    utm = grid(spark, lambda r, c: 0 * r + 100, UTM)
    geoid = Grid(spark.createDataFrame([(r, c, 40 + 2.0 * r - 3.0 * c) for r in range(12) for c in range(20)], "row long, col long, z double"), GridMeta(12, 20, (1.0, 0.1, 0.0, 46.5, 0.0, -0.1), "EPSG:4326"))
    got = {(r["row"], r["col"]): r["z"] for r in add_geoid(utm, geoid).df.collect()}
    corners = utm.df.withColumns({"x": 400_000 + F.col("col") * 100.0, "y": 5_100_000 - F.col("row") * 100.0})
    for r in projection.moved(corners, "x", "y", "EPSG:32631", "EPSG:4326").collect():
        assert got[r["row"], r["col"]] == pytest.approx(100 + 40 + 2 * (46.5 - r["y"]) / 0.1 - 3 * (r["x"] - 1.0) / 0.1, abs=1e-6)
    with pytest.raises(ValueError, match="outside"):
        add_geoid(utm, Grid(geoid.df, GridMeta(12, 20, (5.0, 0.1, 0.0, 46.5, 0.0, -0.1), "EPSG:4326")))


def test_poles_and_beyond(spark):
    """Both poles are points on the central meridian; latitudes beyond them are those of the same sine."""
    quarter = 0.9996 * meridian_arc(90)
    got = [tuple(r) for r in projection.moved(points(spark, [(2.3, 90), (12.0, -90), (2.3, 92), (2.3, 88)]), "x", "y", "EPSG:4326", "EPSG:32631").collect()]
    assert got[0] == pytest.approx((500_000, quarter), abs=1e-2) and got[1] == pytest.approx((500_000, -quarter), abs=1e-2) and got[2] == pytest.approx(got[3], abs=1e-2)


def orders(spark, folder, rows):
    """A table of orders whose pixels lie in some rows of the grid."""
    keys = spark.createDataFrame([(r * 100 + c, 1000.0 * (r % 7 + c * c % 5 + 1)) for r in rows for c in range(100)], "o_orderkey long, o_totalprice double")
    keys.withColumns({"o_orderpriority": F.lit("1-URGENT"), "o_orderstatus": F.lit("F")}).write.parquet(f"{folder}/orders.parquet")
    return str(folder)


def test_geoid_query_beyond_the_pole(spark, tmp_path):
    """Grids of many rows reach the pole and what lies behind it."""
    folder = orders(spark, tmp_path, (0, 14_990, 15_010, 40_000))
    pixels = queries.placed(queries.ref_grid(spark, folder), queries.UTM).df
    at = projection.moved(pixels.withColumns({"x": 450_000 + F.col("col") * 1000.0, "y": 5_000_000 - F.col("row") * 1000.0}), "x", "y", "EPSG:32631", "EPSG:4326")
    want = {(r["row"], r["col"]): r["z"] + (46 - r["y"]) * 0.5 - r["x"] * 0.25 for r in at.collect()}
    got = {(r["row"], r["col"]): r["z"] for r in queries.geoid_lonlat(spark, folder).collect()}
    assert len(got) == 400 and got == pytest.approx(want, abs=1.1e-5)


def test_slope_at_a_pole(spark, tmp_path):
    """A row of pixels without a width: upright where heights differ along the row, else without a slope."""
    meta = GridMeta(3, 4, (0.0, 0.001, 0.0, -89.998, 0.0, -0.001), "EPSG:4326")
    rough = grid(spark, lambda r, c: r + c * c, meta)
    got = {(r["row"], r["col"]): r["slope"] for r in stencil.slope(rough, degree=True).df.collect()}
    assert [got[2, c] for c in range(4)] == [90.0] * 4 and all(v is not None and 0 < v <= 90 for v in got.values())
    flat = {(r["row"], r["col"]): r["slope"] for r in stencil.slope(grid(spark, lambda r, c: 0 * r, meta), degree=True).df.collect()}
    assert [flat[2, c] for c in range(4)] == [None] * 4


def test_pixels_outside_a_grid_are_dealt_to_all_tasks(spark):
    """A warp's pixels outside the other grid have keys of their own, and stay null."""
    outside = spark.range(400).select(F.floor(F.col("id") / 20).alias("row"), (F.col("id") % 20).alias("col"), F.lit(None).cast("double").alias("fx"), F.lit(None).cast("double").alias("fy"))
    keys = resample.keyed(outside.withColumns({"__r": F.floor("fy"), "__c": F.floor("fx")}))
    assert keys.select("__r", "__c").distinct().count() == 400 and keys.filter("__r >= 0 or __c >= 0 or __r is null or __c is null").count() == 0
    small = grid(spark, lambda r, c: r + c, GridMeta(4, 4))
    for interp in ("bilinear", "nearest"):
        got = resample.sample_at(outside, small, interp)
        assert got.count() == 400 and got.filter("z is not null").count() == 0
