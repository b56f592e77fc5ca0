"""Metrics of a set of heights, by name.

A scalar metric is an aggregate over a column z, or the exact quantile of an expression of z, given its group's mean or
median where it asks for it; a vector metric makes a table of bins from a table of values; a matrix metric makes a grid.
"""

from __future__ import annotations

import math
from collections import namedtuple
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reliefspark.functions.quantiles import quantile
from reliefspark.grid import UNITS, Grid

LEAST_BINS = 25

_scalars: dict[str, tuple[Callable[[Column, Column, Column], Column], str]] = {}
_quantiles: dict[str, tuple[Callable[[Column, Column, Column], Column], str, float, float]] = {}
_vectors: dict[str, Callable] = {}
_matrices: dict[str, Callable] = {}


def scalar(name: str, needs: str = ""):
    """Registers f(z, mean, median) -> aggregate; needs: "", "mean" or "median" of the group."""

    def add(f):
        _scalars[name] = (f, needs)
        return f

    return add


def ranked(name: str, share: float, needs: str = "", scale: float = 1.0):
    """Registers f(z, mean, median) -> value: the metric is scale times the value's quantile at this share."""

    def add(f):
        _quantiles[name] = (f, needs, share, scale)
        return f

    return add


def vector(name: str):
    def add(f):
        _vectors[name] = f
        return f

    return add


def matrix(name: str):
    def add(f):
        _matrices[name] = f
        return f

    return add


def names() -> list[str]:
    return sorted([*_scalars, *_quantiles, *_vectors, *_matrices])


def kind(name: str) -> str:
    """scalar, vector or matrix2D; KeyError for an unknown metric."""
    for kinds, of in (("scalar", _scalars), ("scalar", _quantiles), ("vector", _vectors), ("matrix2D", _matrices)):
        if name in of:
            return kinds
    raise KeyError(f"no metric named {name}")


def scalar_metric(name: str) -> tuple[Callable[[Column, Column, Column], Column], str]:
    """(aggregate, what it needs of its group) of a metric that Spark aggregates."""
    kind(name)
    return _scalars[name]


def ranked_metric(name: str) -> tuple[Callable[[Column, Column, Column], Column], str, float, float] | None:
    """(value, what it needs of its group, share, scale) of a metric that is a quantile; None for others."""
    kind(name)
    return _quantiles.get(name)


def vector_metric(name: str) -> Callable:
    kind(name)
    return _vectors[name]


def matrix_metric(name: str) -> Callable:
    kind(name)
    return _matrices[name]


scalar("mean")(lambda z, mean, median: F.avg(z))
scalar("max")(lambda z, mean, median: F.max(z))
scalar("min")(lambda z, mean, median: F.min(z))
scalar("std")(lambda z, mean, median: F.stddev_pop(z))
scalar("rmse")(lambda z, mean, median: F.sqrt(F.avg(z * z)))
ranked("median", 0.5)(lambda z, mean, median: z)
ranked("nmad", 0.5, "median", 1.4826)(lambda z, mean, median: F.abs(z - median))
scalar("sum")(lambda z, mean, median: F.sum(z))
scalar("squared_sum")(lambda z, mean, median: F.sum(z * z))
ranked("percentil_90", 0.9, "mean")(lambda z, mean, median: F.abs(z - mean))

#: Vector metrics that read a grid and not its values.
GRID_VECTORS = frozenset({"slope-orientation-histogram"})
#: What is computed where nothing is chosen.
DEFAULT = ("mean", "median", "max", "min", "sum", "percentil_90", "squared_sum", "nmad", "rmse", "std")
#: Of these, what keeps outliers although they are to be removed.
KEEPS_OUTLIERS = frozenset({"percentil_90"})


#: Bins that a histogram may have: the windows over them, and what is saved of them, stay small.
MOST_BINS = 1_000_000
#: A histogram's bins: their number, the left edge of the first, their width, the values that count, and whether edges decide over quotients.
Bins = namedtuple("Bins", "n low step high exact")


def bounded(n: float, step: float) -> int:
    """n; ValueError if so many bins are too many."""
    if n > MOST_BINS:
        raise ValueError(f"a bin_step of {step} makes {n:.0f} bins, more than {MOST_BINS}: choose a wider one, or leave outliers out")
    return int(n)


def cdf_bins(top: float, bin_step: float = 0.1) -> Bins:
    """Equal bins from 0 to the greatest size of a value."""
    n = max(bounded(top / bin_step, bin_step), LEAST_BINS)
    return Bins(n, 0.0, top / n, top, False)


def pdf_bins(found: float, bin_step: float | None = None, filter_p98: bool | None = None) -> Bins:
    """Bins between -bound and bound, which is the greatest value or the size of the 98th percentile; less than LEAST_BINS edges give LEAST_BINS equal bins."""
    step = bin_step or 1.0
    bound = abs(found) if filter_p98 else found
    edges = bounded(max(0, math.ceil(2 * bound / step)), step)
    if edges >= LEAST_BINS:
        n, low, step = edges - 1, -bound, (step - bound) + bound  # the step as edges added up have it
        return Bins(n, low, step, low + n * step, True)
    high = abs(bound)
    return Bins(LEAST_BINS, -high, 2 * high / LEAST_BINS or 1.0, high, True)


def cell_of(v: Column, bins) -> Column:
    """The bin of a value, from columns n, low, step, high, exact (or numbers of these names)."""
    of = lambda c: c if isinstance(c, Column) else F.lit(c)
    n, low, step, high, exact = (of(c) for c in bins)
    by_share = F.when(high > 0, F.floor(v / high * n)).otherwise(0)
    cell = F.floor((v - low) / step)
    by_edge = cell + F.when(v >= (cell + 1) * step + low, 1).when(v < cell * step + low, -1).otherwise(0)
    return F.least(F.when(exact, by_edge).otherwise(by_share), n - 1).cast("long")


def histograms(values: DataFrame, keys: list[str], value: Column, bins: dict[tuple, Bins], cumulative: bool) -> DataFrame:
    """keys, bin, edge, value of all groups by one aggregation: the share of the group's values in each bin, or up to its end; empty bins too.

    bins: those of each group; groups are few, and each has at most MOST_BINS.
    """
    kinds = dict(values.dtypes)
    schema = "".join(f"`{k}` {kinds[k]}, " for k in keys) + "n long, low double, step double, high double, exact boolean"
    table = F.broadcast(values.sparkSession.createDataFrame([(*k, *b) for k, b in bins.items()], schema))
    columns = [F.col(c) for c in Bins._fields]
    v = values.select(*keys, value.alias("v")).filter("v is not null")
    v = v.join(table, keys) if keys else v.withColumns({c: F.lit(b) for c, b in zip(Bins._fields, bins[()])})
    counts = v.filter((F.col("v") >= F.col("low")) & (F.col("v") <= F.col("high"))).groupBy(*keys, cell_of(F.col("v"), columns).alias("bin")).agg(F.count("*").alias("c"))
    every = table.select(*keys, "low", "step", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("bin")).join(counts, [*keys, "bin"], "left")
    own = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))  # MOST_BINS rows at most
    c = F.coalesce("c", F.lit(0))
    return every.select(*keys, "bin", (F.col("bin") * F.col("step") + F.col("low")).alias("edge"), ((F.sum(c).over(own.orderBy("bin")) if cumulative else c) / F.sum(c).over(own)).alias("value"))


@vector("cdf")
def cdf(values: DataFrame, bin_step: float = 0.1) -> DataFrame:
    """bin, edge, value: the cumulative share of |z| in equal bins from 0 to its maximum, by left edges; empty bins too."""
    top = values.agg(F.max(F.abs("z"))).first()[0]
    if top is None:
        return values.sparkSession.createDataFrame([], "bin long, edge double, value double")
    return histograms(values, [], F.abs("z"), {(): cdf_bins(top, bin_step)}, True)


@vector("pdf")
def pdf(values: DataFrame, bin_step: float | None = None, filter_p98: bool | None = None) -> DataFrame:
    """bin, edge, value: the share of the values between -bound and bound in bins of bin_step (None: 1), by left edges, as pdf_bins() has them."""
    v = values.select("z").filter("z is not null")
    found = quantile(v, F.col("z"), 0.98) if filter_p98 else v.agg(F.max("z")).first()[0]
    if found is None:
        return values.sparkSession.createDataFrame([], "bin long, edge double, value double")
    return histograms(v, [], F.col("z"), {(): pdf_bins(found, bin_step, filter_p98)}, False)


def ratios(values: DataFrame, keys: list[str], elevation_threshold: tuple[float, ...] = (0.5, 1, 3), original_unit: str = "m") -> DataFrame:
    """keys, bin, edge (the threshold in metres), value (the share of values above it) of all groups by one aggregation."""
    t = [float(x) * UNITS[original_unit] for x in elevation_threshold]
    shares = values.select(*keys, "z").filter("z is not null").groupBy(*keys).agg(*[F.avg((F.col("z") > x).cast("double")).alias(f"t{k}") for k, x in enumerate(t)])
    rows = F.array(*[F.struct(F.lit(k).cast("long").alias("bin"), F.lit(x).alias("edge"), F.col(f"t{k}").alias("value")) for k, x in enumerate(t)])
    return shares.select(*keys, F.explode(rows).alias("x")).select(*keys, "x.*")


@vector("ratio_above_threshold")
def ratio_above_threshold(values: DataFrame, elevation_threshold: tuple[float, ...] = (0.5, 1, 3), original_unit: str = "m") -> DataFrame:
    """bin, edge, value of all values as one group."""
    return ratios(values, [], elevation_threshold, original_unit)


@vector("slope-orientation-histogram")
def slope_orientation_histogram(grid: Grid, dx: float, dy: float, nb_bins: int = 100) -> DataFrame:
    """bin, edge, value: counts of the normals' directions in bins between the least and the greatest."""
    from reliefspark.operators.stencil import orientation

    a = orientation(grid, dx, dy).filter("orientation is not null").select("orientation")
    low, high = a.agg(F.min("orientation"), F.max("orientation")).first()
    if low is None:
        return a.sparkSession.createDataFrame([], "bin long, edge double, value long")
    step = (high - low) / nb_bins or 1.0
    cell = F.least(F.floor((F.col("orientation") - low) / step), F.lit(nb_bins - 1)).cast("long")
    counts = a.groupBy(cell.alias("bin")).agg(F.count("*").alias("n"))
    bins = a.sparkSession.range(nb_bins).withColumnRenamed("id", "bin").join(counts, "bin", "left")
    return bins.select("bin", (F.col("bin") * step + low).alias("edge"), F.coalesce("n", F.lit(0)).alias("value"))


def polar(bins: DataFrame) -> DataFrame:
    """bin, theta, degrees, value of an orientation histogram: where a polar plot draws each bin, counter-clockwise from the east, and its direction clockwise from the north."""
    return bins.select("bin", (F.lit(math.pi / 2) - F.col("edge")).alias("theta"), F.degrees("edge").alias("degrees"), "value")


@matrix("hillshade")
def hillshade(grid: Grid, azimuth: float = 315.0, angle_altitude: float = 45.0) -> DataFrame:
    from reliefspark.operators.stencil import hillshade as shaded

    return shaded(grid, azimuth, angle_altitude)


@matrix("svf")
def svf(grid: Grid, filter_intensity: float = 0.9, quantiles: tuple[float, float] = (0.09, 0.91)) -> DataFrame:
    from reliefspark.operators.spectral import sky_view

    return sky_view(grid, filter_intensity, quantiles)


def all_zero(values: DataFrame, total: int) -> bool:
    """Whether values cover all of the grid's pixels and all are zero to 6 decimals: their vector metrics are then left out."""
    got = values.agg(F.count("z").alias("n"), F.max(F.abs(F.round("z", 6))).alias("m")).first()
    return got["n"] == total and got["m"] == 0
