"""Processing methods: the grid that is compared, made from two grids or from one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reliefspark.functions.pixel import angle_between
from reliefspark.grid import Grid
from reliefspark.operators.spectral import curvature
from reliefspark.operators.stencil import normals, slope

_methods: dict[str, Callable[[Grid, Grid | None], Grid]] = {}
#: Methods that look at a pixel and those beside it only, so that they hold for grids in parts, too.
LOCAL = ("alti-diff", "angular-diff", "ref", "sec")
SLOPE_BINS = 100


def register(name: str):
    def add(f):
        _methods[name] = f
        return f

    return add


def names() -> list[str]:
    return list(_methods)


def process(name: str, ref: Grid, sec: Grid | None = None) -> Grid:
    """The method's grid, with both grids' labels and slopes; KeyError for an unknown method, ValueError for one that grids in parts haven't."""
    if name not in _methods:
        raise KeyError(f"no processing method named {name}")
    if ref.parts and name not in LOCAL:
        raise ValueError(f"{name} isn't a method of grids in parts")
    return _methods[name](ref, sec)


def planes(grid: Grid, support: str) -> list[Column]:
    """The grid's labels and slope, named by their support."""
    return [F.col(c).alias(f"{c}_{support}") for c in grid.labels] + ([F.col("slope").alias(f"{support}_slope")] if "slope" in grid.df.columns else [])


def beside(ref: Grid, sec: Grid, of_ref: tuple[str, ...] = ("z",), of_sec: tuple[str, ...] = ("z",), sec_planes: bool = True) -> DataFrame:
    """Both grids pixel by pixel, by one join: row, col, ref_<c> and sec_<c> of the columns asked for, and all planes."""
    keys = [*ref.parts, "row", "col"]
    a = ref.df.select(*keys, *[F.col(c).alias(f"ref_{c}") for c in of_ref], *planes(ref, "ref"))
    b = sec.df.select(*keys, *[F.col(c).alias(f"sec_{c}") for c in of_sec], *(planes(sec, "sec") if sec_planes else []))
    return a.join(b, keys)


def made(df: DataFrame, z: Column, ref: Grid, sec: Grid | None) -> Grid:
    """The grid of z with the planes that df has."""
    labels = tuple(f"{c}_{support}" for grid, support in ((ref, "ref"), (sec, "sec")) if grid is not None for c in grid.labels)
    slopes = [c for c in ("ref_slope", "sec_slope") if c in df.columns]
    return Grid(df.select(*ref.parts, "row", "col", z.alias("z"), *labels, *slopes), ref.meta, labels, ref.parts)


@register("alti-diff")
def alti_diff(ref: Grid, sec: Grid) -> Grid:
    """ref - sec, null where either is."""
    return made(beside(ref, sec), F.col("ref_z") - F.col("sec_z"), ref, sec)


def normalised(ref: Grid, sec: Grid, nbins: int = SLOPE_BINS) -> tuple[DataFrame, Column]:
    """Both grids' pixels, and (difference - its mean) / (1 + b/a tan(slope of sec)) of them.

    a and b are slope and intercept of the line through the differences' standard deviations in equal slope bins,
    open on the left, over the tangents of the bins' left edges; ValueError with fewer than two bins of two pixels.
    """
    sloped = slope(sec, unit_change=False, name="alpha")
    pixels = beside(ref, sloped, of_sec=("z", "alpha"))
    z, alpha = F.col("ref_z") - F.col("sec_z"), F.col("sec_alpha")
    d = pixels.select(z.alias("z"), alpha.alias("alpha")).persist()  # two scalars and a fit
    try:
        both = F.col("z").isNotNull() & F.col("alpha").isNotNull()
        low, high, mean = d.agg(F.min(F.when(both, F.col("alpha"))), F.max(F.when(both, F.col("alpha"))), F.avg("z")).first()
        if low is None or high <= low:
            raise ValueError("not enough pixels to fit")
        width = (high - low) / nbins
        # bin n holds edge n < alpha <= edge n + 1
        cell = F.least(F.ceil((F.col("alpha") - low) / width) - 1, F.lit(nbins - 1))
        bins = d.filter(both & (F.col("alpha") > low)).groupBy(cell.alias("bin")).agg(F.stddev_pop("z").alias("s"), F.count("*").alias("n")).filter("n > 1")
        edge = F.tan(F.col("bin") * width + low)
        a, b, n = bins.agg(F.regr_slope("s", edge), F.regr_intercept("s", edge), F.count("*")).first()
    finally:
        d.unpersist()
    if n < 2 or a is None:
        raise ValueError("not enough pixels to fit")
    inside = (alpha >= low) & (alpha <= high)
    return pixels, F.when(inside, (z - mean) / (1 + F.tan(alpha) * (b / a)))


def slope_normalised(ref: Grid, sec: Grid, nbins: int = SLOPE_BINS) -> DataFrame:
    """row, col, z of normalised()."""
    pixels, z = normalised(ref, sec, nbins)
    return pixels.select("row", "col", z.alias("z"))


@register("alti-diff-slope-norm")
def alti_diff_slope_norm(ref: Grid, sec: Grid) -> Grid:
    return made(*normalised(ref, sec), ref, sec)


@register("angular-diff")
def angular_diff(ref: Grid, sec: Grid) -> Grid:
    """The acute angle of both grids' normals."""
    parts = ("n_x", "n_y", "n_z")
    pixels = beside(ref.with_df(normals(ref)), sec.with_df(normals(sec)), parts, parts)
    dot = F.col("ref_n_x") * F.col("sec_n_x") + F.col("ref_n_y") * F.col("sec_n_y") + F.col("ref_n_z") * F.col("sec_n_z")
    return made(pixels, angle_between(dot), ref, sec)


def angular_difference(ref: Grid, sec: Grid) -> DataFrame:
    """row, col, z of angular_diff()."""
    return angular_diff(Grid(ref.z(), ref.meta), Grid(sec.z(), sec.meta)).z()


@register("ref")
def ref_only(ref: Grid, sec: Grid | None = None) -> Grid:
    return made(ref.df.select(*ref.parts, "row", "col", "z", *planes(ref, "ref")), F.col("z"), ref, None)


@register("sec")
def sec_only(ref: Grid, sec: Grid) -> Grid:
    """sec's heights with ref's labels."""
    return made(beside(ref, sec, of_ref=(), sec_planes=False), F.col("sec_z"), ref, None)


@register("ref-curvature")
def ref_curvature(ref: Grid, sec: Grid | None = None) -> Grid:
    return sec_only(ref, Grid(curvature(ref), ref.meta))


@register("sec-curvature")
def sec_curvature(ref: Grid, sec: Grid) -> Grid:
    return sec_only(ref, Grid(curvature(sec), sec.meta))
