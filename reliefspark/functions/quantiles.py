"""Exact quantiles of groups that no task could hold.

Spark's own exact percentile keeps all distinct values of a group in one task. Here each pass counts values in equal
cells of the interval that holds a wanted rank, with partial sums in every task, and narrows the interval to the least
and greatest value of that rank's cell, until few enough values are left to be sorted together in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Cells of a pass, and values of an interval that are sorted together (a few megabytes).
CELLS, SORTED = 4096, 200_000
#: Tasks for each core that count values in cells.
TASKS = 3


def quantiles(df: DataFrame, keys: list[str], wanted: list[tuple[str, Column, float]], cells: int = CELLS, most: int = SORTED) -> dict[tuple, dict[str, float | None]]:
    """name -> quantile by key, for each wanted (name, value, share): interpolated between order statistics of values that aren't null.

    Groups are classes, so they are few; what comes to the driver is a few numbers a group in each pass, and at last a
    value a rank. Groups without values are None. df is read twice, and once more a pass for groups of more than `most`
    values: persist it if it is dear.
    """
    names = [n for n, _, _ in wanted]
    shares = {n: s for n, _, s in wanted}
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), v.cast("double").alias("v")) for n, v, _ in wanted])).alias("x")
    rows = df.select(*keys, pairs).select(*keys, "x.*")
    v = rows.filter("v is not null")
    spark = df.sparkSession
    of = lambda r: (tuple(r[k] for k in keys), r["name"])
    sizes = {of(r): r.asDict() for r in rows.groupBy(*keys, "name").agg(F.count("v").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).collect()}
    ranks = {}  # (group, name, order statistic) -> its interval
    for (group, name), g in sizes.items():
        if g["n"]:
            below = int(shares[name] * (g["n"] - 1))
            for rank in {below, min(below + 1, g["n"] - 1)}:
                ranks[group, name, rank] = {"low": g["low"], "high": g["high"], "before": 0, "inside": g["n"]}
    schema = "".join(f"{k} {dict(df.dtypes)[k]}, " for k in keys) + "name string, id int, low double, high double, step double, places array<int>"

    def intervals(of_ranks: list) -> list[tuple[tuple, dict, list]]:
        """((group, name), interval, its ranks): neighbouring ranks mostly have one interval, whose values are read once for both."""
        found: dict[tuple, tuple] = {}
        for (group, name, rank), i in of_ranks:
            found.setdefault((group, name, *i.values()), ((group, name), i, []))[2].append(rank)
        return list(found.values())

    def inside(of: list) -> DataFrame:
        rows_ = [(*g, name, k, i["low"], i["high"], i["high"] / cells - i["low"] / cells, [r - i["before"] for r in own]) for k, ((g, name), i, own) in enumerate(of)]
        table = spark.createDataFrame(rows_, schema)
        return v.join(F.broadcast(table), [*keys, "name"]).filter((F.col("v") >= F.col("low")) & (F.col("v") <= F.col("high")))

    while wide := intervals([(k, i) for k, i in ranks.items() if i["inside"] > most and i["high"] > i["low"]]):
        by_step = F.least(F.floor((F.col("v") - F.col("low")) / F.col("step")), F.lit(cells - 1))
        # with neighbours among the doubles, the step may be 0
        cell = F.when(F.col("v") == F.col("low"), 0).when(F.col("v") == F.col("high"), cells - 1).when(F.col("step") > 0, by_step).otherwise(cells // 2)
        found: dict[int, list] = {}
        # each task's partial sums may have all cells, so few tasks make them
        for r in inside(wide).coalesce(TASKS * spark.sparkContext.defaultParallelism).groupBy("id", cell.alias("cell")).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect():  # at most `cells` rows an interval
            found.setdefault(r["id"], []).append((r["cell"], r["n"], r["lo"], r["hi"]))
        for k, ((group, name), i, own) in enumerate(wide):
            for rank in own:
                before = i["before"]
                for _, n, lo, hi in sorted(found[k]):
                    if before + n > rank:
                        ranks[group, name, rank] = {"low": lo, "high": hi, "before": before, "inside": n}
                        break
                    before += n
    at: dict[tuple, float] = {k: i["low"] for k, i in ranks.items() if i["high"] == i["low"]}
    if few := intervals([(k, i) for k, i in ranks.items() if k not in at]):
        sorted_ = inside(few).groupBy("id", "places").agg(F.sort_array(F.collect_list("v")).alias("a"))  # `most` values an interval
        for r in sorted_.select("id", F.transform("places", lambda p: F.get("a", p)).alias("x")).collect():  # a value a rank
            (group, name), _, own = few[r["id"]]
            at |= {(group, name, rank): x for rank, x in zip(own, r["x"])}
    out: dict[tuple, dict[str, float | None]] = {}
    for (group, name), g in sizes.items():
        if g["n"]:
            place = shares[name] * (g["n"] - 1)
            below, above = at[group, name, int(place)], at[group, name, min(int(place) + 1, g["n"] - 1)]
            out.setdefault(group, dict.fromkeys(names))[name] = below + (above - below) * (place - int(place))
        else:
            out.setdefault(group, dict.fromkeys(names))
    return out


def quantile(df: DataFrame, value: Column, share: float) -> float | None:
    """The quantile of all values of df; None without any."""
    return quantiles(df, [], [("q", value, share)]).get((), {}).get("q")
