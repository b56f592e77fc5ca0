"""Exact quantiles of many groups, of any size each, as a table: no group and no list of groups passes through the driver.

Each wanted rank has an interval of values that holds it. A pass joins values with the intervals, counts them in equal
cells by partial sums, and keeps the rank's cell, until an interval holds few values; those are then sorted together.
Intervals are a written table between passes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reliefspark.sources.scratch import written

#: Cells of a pass, values of an interval that are sorted together, and intervals up to which their table is broadcast.
CELLS, SORTED, BROADCAST = 256, 2000, 200_000


def few(df: DataFrame, rows: int = BROADCAST) -> DataFrame:
    """df (a written table of narrow rows), marked for broadcast if it has at most so many rows; else Spark shuffles both sides."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def same(left: list[str], right: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(x).eqNullSafe(F.col(y)) for x, y in zip(left, right)], F.lit(True))


def quantile_table(df: DataFrame, keys: list[str], wanted: list[tuple[str, Column, float]], cells: int = CELLS, most: int = SORTED) -> DataFrame:
    """keys and a column for each wanted (name, value, share): the quantile of the group's values that aren't null, interpolated.

    Groups without any value have no row; null keys are a group. df is read once a pass and twice besides: pass a written or
    persisted table. What comes to the driver is one number a pass: whether an interval is still wide.
    """
    k = [f"__k{i}" for i in range(len(keys))]
    pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("q"), v.cast("double").alias("v")) for i, (_, v, _) in enumerate(wanted)])).alias("p")
    rows = df.select(*[F.col(a).alias(b) for a, b in zip(keys, k)], pairs).select(*k, F.col("p.q").alias("__q"), F.col("p.v").alias("__v")).filter("__v is not null")
    share = F.element_at(F.array(*[F.lit(float(s)) for _, _, s in wanted]), F.col("__q") + 1)
    place = (share * (F.col("n") - 1)).alias("place")
    sizes = rows.groupBy(*k, "__q").agg(F.count("*").alias("n"), F.min("__v").alias("low"), F.max("__v").alias("high")).select("*", place)
    below, above = F.floor("place"), F.least(F.floor("place") + 1, F.col("n") - 1)
    ranks = F.explode(F.array_distinct(F.array(below, above))).alias("rank")
    state = written(sizes.select(*k, F.col("__q").alias("q"), "place", "n", ranks, "low", "high", F.lit(0).cast("long").alias("before"), F.col("n").alias("inside")), "ranks")
    names = [f"__r{i}" for i in range(len(k))]

    def inside(of: DataFrame) -> DataFrame:
        """Values within the intervals of some ranks, beside them."""
        of = few(of.select(*[F.col(a).alias(b) for a, b in zip(k, names)], *[c for c in of.columns if c not in k]))
        return rows.join(of, same(k, names) & (F.col("__q") == F.col("q"))).filter((F.col("__v") >= F.col("low")) & (F.col("__v") <= F.col("high")))

    is_wide = (F.col("inside") > most) & (F.col("high") > F.col("low"))
    while state.filter(is_wide).limit(1).count():
        step = F.col("high") / cells - F.col("low") / cells
        by_step = F.least(F.floor((F.col("__v") - F.col("low")) / step), F.lit(cells - 1))
        # the least and the greatest value are in different cells, so every pass narrows; with neighbours among the doubles, the step may be 0
        cell = F.when(F.col("__v") == F.col("low"), 0).when(F.col("__v") == F.col("high"), cells - 1).when(step > 0, by_step).otherwise(cells // 2)
        counts = inside(state.filter(is_wide)).groupBy(*names, "q", "place", "n", "rank", "before", cell.alias("cell")).agg(F.count("*").alias("own"), F.min("__v").alias("lo"), F.max("__v").alias("hi"))
        upto = F.col("before") + F.sum("own").over(W.partitionBy(*names, "q", "rank").orderBy("cell"))  # cells rows
        found = counts.withColumn("upto", upto).filter((F.col("upto") > F.col("rank")) & (F.col("upto") - F.col("own") <= F.col("rank")))
        found = found.select(*[F.col(a).alias(b) for a, b in zip(names, k)], "q", "place", "n", "rank", F.col("lo").alias("low"), F.col("hi").alias("high"), (F.col("upto") - F.col("own")).alias("before"), F.col("own").alias("inside"))
        state = written(state.filter(~is_wide).unionByName(found), "ranks")
    done = state.filter("high = low").select(*k, "q", "place", "n", "rank", F.col("low").alias("x"))
    at = F.element_at(F.sort_array(F.collect_list("__v")), (F.col("rank") - F.col("before") + 1).cast("int")).alias("x")  # `most` values
    rest = inside(state.filter("high > low")).groupBy(*names, "q", "place", "n", "rank", "before").agg(at)
    every = done.unionByName(rest.select(*[F.col(a).alias(b) for a, b in zip(names, k)], "q", "place", "n", "rank", "x"))

    def value(i: int) -> Column:
        own = lambda rank: F.max(F.when((F.col("q") == i) & (F.col("rank") == rank), F.col("x")))
        part = F.max(F.when(F.col("q") == i, F.col("place") - F.floor("place")))
        return (own(below) + (own(above) - own(below)) * part).alias(wanted[i][0])

    return every.groupBy(*[F.col(a).alias(b) for a, b in zip(k, keys)]).agg(*[value(i) for i in range(len(wanted))])
