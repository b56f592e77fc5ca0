"""Map projections of points in columns: geographic systems, transverse Mercator (UTM) and spherical Mercator.

Transverse Mercator is the series of Krueger to the sixth power of the third flattening, whose error is far below a
micrometre within the zones' use. Every step is an expression over a row, so a warp stays within generated code.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reliefspark.grid import GEOGRAPHIC

#: The ellipsoids' semi-axis and inverse flattening (WGS 84, GRS 80), by the ranges of codes that use them.
WGS84, GRS80 = (6378137.0, 298.257223563), (6378137.0, 298.257222101)
SCALE, EAST, SOUTH = 0.9996, 500_000.0, 10_000_000.0


@dataclass(frozen=True)
class Projection:
    """kind: lonlat, utm or mercator; for UTM, the central meridian in degrees, the false northing and the ellipsoid."""

    kind: str
    meridian: float = 0.0
    north: float = 0.0
    ellipsoid: tuple[float, float] = WGS84


def projection(crs: str) -> Projection:
    """The projection of an EPSG code: geographic ones, 3857, UTM on WGS 84 (326xx, 327xx) and on ETRS 89 (258xx). ValueError for others."""
    if crs in GEOGRAPHIC:
        return Projection("lonlat")
    if crs in ("EPSG:3857", "EPSG:900913"):
        return Projection("mercator")
    m = re.fullmatch(r"EPSG:(326|327|258)(\d\d)", crs)
    if not m or not 1 <= int(m[2]) <= 60:
        raise ValueError(f"the projection of {crs} isn't known")
    return Projection("utm", 6.0 * int(m[2]) - 183, SOUTH if m[1] == "327" else 0.0, GRS80 if m[1] == "258" else WGS84)


def series(inverse_flattening: float) -> tuple[float, float, list[float], list[float], list[float]]:
    """(third flattening n, rectifying radius over the semi-axis, alpha, beta, delta): Krueger's series as Kawase (2011) gives them."""
    f = 1 / inverse_flattening
    n = f / (2 - f)
    power = lambda *c: sum(a * n ** (k + 1) for k, a in enumerate(c))
    radius = (1 + n**2 / 4 + n**4 / 64 + n**6 / 256) / (1 + n)
    # fixed values: coefficients of n, n^2, ... n^6
    alpha = [
        power(1 / 2, -2 / 3, 5 / 16, 41 / 180, -127 / 288, 7891 / 37800), power(0, 13 / 48, -3 / 5, 557 / 1440, 281 / 630, -1983433 / 1935360), power(0, 0, 61 / 240, -103 / 140, 15061 / 26880, 167603 / 181440),
        power(0, 0, 0, 49561 / 161280, -179 / 168, 6601661 / 7257600), power(0, 0, 0, 0, 34729 / 80640, -3418889 / 1995840), power(0, 0, 0, 0, 0, 212378941 / 319334400),
    ]
    beta = [
        power(1 / 2, -2 / 3, 37 / 96, -1 / 360, -81 / 512, 96199 / 604800), power(0, 1 / 48, 1 / 15, -437 / 1440, 46 / 105, -1118711 / 3870720), power(0, 0, 17 / 480, -37 / 840, -209 / 4480, 5569 / 90720),
        power(0, 0, 0, 4397 / 161280, -11 / 504, -830251 / 7257600), power(0, 0, 0, 0, 4583 / 161280, -108847 / 3991680), power(0, 0, 0, 0, 0, 20648693 / 638668800),
    ]
    delta = [
        power(2, -2 / 3, -2, 116 / 45, 26 / 45, -2854 / 675), power(0, 7 / 3, -8 / 5, -227 / 45, 2704 / 315, 2323 / 945), power(0, 0, 56 / 15, -136 / 35, -1262 / 105, 73814 / 2835),
        power(0, 0, 0, 4279 / 630, -332 / 35, -399572 / 14175), power(0, 0, 0, 0, 4174 / 315, -144838 / 6237), power(0, 0, 0, 0, 0, 601676 / 22275),
    ]
    return n, radius, alpha, beta, delta


def asinh(x: Column) -> Column:
    return F.signum(x) * F.log1p(F.abs(x) + x * x / (F.sqrt(x * x + 1) + 1))


def wrapped(degrees: Column) -> Column:
    """An angle within half a turn; one that is there already stays as it is."""
    return F.when(F.abs(degrees) <= 180, degrees).otherwise(F.pmod(degrees + 180, F.lit(360.0)) - 180)


def steps(df: DataFrame, *columns: dict[str, Column]) -> DataFrame:
    """df with columns added in steps: what a step uses several times is worked out once, in the step before."""
    for c in columns:
        df = df.withColumns(c)
    return df


def forward(df: DataFrame, p: Projection, x: str, y: str) -> DataFrame:
    """df, whose columns x and y are longitude and latitude in degrees and become the projection's."""
    lon, lat = F.col(x), F.col(y)
    if p.kind == "lonlat":
        return df
    a, inverse_flattening = p.ellipsoid
    if p.kind == "mercator":
        return df.withColumns({x: F.radians(lon) * a, y: F.log(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2)) * a})
    n, radius, alpha, _, _ = series(inverse_flattening)
    e = 2 * math.sqrt(n) / (1 + n)
    s, away, t, xi, eta = (F.col(f"__{c}") for c in ("s", "away", "t", "xi", "eta"))
    east, north = eta, xi
    for k, c in enumerate(alpha, 1):
        east = east + F.cos(xi * (2 * k)) * F.sinh(eta * (2 * k)) * c
        north = north + F.sin(xi * (2 * k)) * F.cosh(eta * (2 * k)) * c
    size = SCALE * a * radius
    return steps(
        df, {"__s": F.sin(F.radians(lat)), "__away": F.radians(wrapped(lon - p.meridian))},
        {"__t": F.sinh(F.atanh(s) - F.atanh(s * e) * e)},  # of the conformal latitude; infinite at the poles
        {"__xi": F.atan2(t, F.cos(away)), "__eta": asinh(F.sin(away) / F.sqrt(t * t + F.cos(away) * F.cos(away)))},
        {x: east * size + EAST, y: north * size + p.north},
    ).drop("__s", "__away", "__t", "__xi", "__eta")


def inverse(df: DataFrame, p: Projection, x: str, y: str) -> DataFrame:
    """df, whose columns x and y are the projection's and become longitude and latitude in degrees."""
    if p.kind == "lonlat":
        return df
    a, inverse_flattening = p.ellipsoid
    if p.kind == "mercator":
        return df.withColumns({x: F.degrees(F.col(x) / a), y: F.degrees(F.atan(F.sinh(F.col(y) / a)))})
    _, radius, _, beta, delta = series(inverse_flattening)
    size = SCALE * a * radius
    xi, eta, u, v, chi = (F.col(f"__{c}") for c in ("xi", "eta", "u", "v", "chi"))
    up, aside, lat = xi, eta, chi
    for k, c in enumerate(beta, 1):
        up = up - F.sin(xi * (2 * k)) * F.cosh(eta * (2 * k)) * c
        aside = aside - F.cos(xi * (2 * k)) * F.sinh(eta * (2 * k)) * c
    for k, c in enumerate(delta, 1):
        lat = lat + F.sin(chi * (2 * k)) * c
    return steps(
        df, {"__xi": (F.col(y) - p.north) / size, "__eta": (F.col(x) - EAST) / size}, {"__u": up, "__v": aside},
        {"__chi": F.atan2(F.sin(u), F.sqrt(F.sinh(v) * F.sinh(v) + F.cos(u) * F.cos(u)))},
        {x: F.degrees(F.atan2(F.sinh(v), F.cos(u))) + p.meridian, y: F.degrees(lat)},
    ).drop("__xi", "__eta", "__u", "__v", "__chi")


def moved(df: DataFrame, x: str, y: str, from_crs: str, to_crs: str) -> DataFrame:
    """df with the columns x, y of one system in another; equal systems need no projection.

    Datums are taken as one, as ETRS 89 and WGS 84 are to a metre.
    """
    if from_crs == to_crs:
        return df
    source, target = projection(from_crs), projection(to_crs)
    return df if source == target else forward(inverse(df, source, x, y), target, x, y)


def moved_box(spark: SparkSession, box: dict, from_crs: str, to_crs: str, points: int = 21) -> dict:
    """The least box of another system around a box, by points along its edges."""
    if from_crs == to_crs:
        return dict(box)
    t = F.col("k") / (points - 1)
    wide, high = box["right"] - box["left"], box["top"] - box["bottom"]
    edge = spark.range(points).select(F.col("id").alias("k")).select(F.explode(F.array(*[
        F.struct(F.lit(box["left"]).cast("double") + wide * a, F.lit(box["bottom"]).cast("double") + high * b) for a, b in ((t, F.lit(0.0)), (t, F.lit(1.0)), (F.lit(0.0), t), (F.lit(1.0), t))
    ])).alias("p")).select(F.col("p.col1").alias("x"), F.col("p.col2").alias("y"))
    one = moved(edge, "x", "y", from_crs, to_crs).agg(F.min("x"), F.min("y"), F.max("x"), F.max("y")).first()
    return dict(zip(("left", "bottom", "right", "top"), one))
