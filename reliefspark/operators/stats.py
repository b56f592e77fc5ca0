"""Statistics by class and mode: one pass for plain metrics, a few for quantiles and for metrics about a class's mean or median."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reliefspark.functions import metrics, quantiles
from reliefspark.functions.order_stats import few, quantile_table, same
from reliefspark.grid import Grid
from reliefspark.operators.classify import Layer, classes_table, in_modes
from reliefspark.sources.scratch import written

DIGITS = 5
#: Pixels of a part that are sorted together in a task (a megabyte).
TOGETHER = 100_000


def inliers(df: DataFrame) -> DataFrame:
    """df with the flag inlier: z within three deviations of the mean, both of all valid pixels."""
    one = df.agg(F.avg("z").alias("mu"), F.stddev_pop("z").alias("sigma")).first()
    if one["mu"] is None:
        return df.withColumn("inlier", F.lit(False))
    low, high = one["mu"] - 3 * one["sigma"], one["mu"] + 3 * one["sigma"]
    return df.withColumn("inlier", F.coalesce((F.col("z") > low) & (F.col("z") < high), F.lit(False)))


def class_stats(grid: Grid, layer: Layer, chosen: tuple[str, ...] = metrics.DEFAULT, remove_outliers: bool | dict = False, total: int | None = None) -> DataFrame:
    """mode, class_idx, set_name, the chosen scalar metrics, nbpts, percent_valid_points; empty classes are null.

    remove_outliers holds for all metrics, or by name. One aggregation, with conditions, gives all classes of all modes;
    quantiles narrow down in a few more, and what needs its class's mean or median follows. The heights and classes are
    persisted meanwhile; what comes to the driver is a few numbers a class, of which the result is made.
    """
    without = remove_outliers if isinstance(remove_outliers, dict) else {m: remove_outliers and m not in metrics.KEEPS_OUTLIERS for m in chosen}
    flagged = any(without.get(m) for m in chosen)
    df = in_modes(inliers(grid.df) if flagged else grid.df, layer).filter("class_idx is not null")
    df = df.select("mode", "class_idx", "z", *(["inlier"] if flagged else [])).persist()
    z = lambda m: F.when(F.col("inlier"), F.col("z")) if without.get(m) else F.col("z")
    keys, none = ["mode", "class_idx"], F.lit(None).cast("double")
    of = {m: metrics.ranked_metric(m) for m in chosen}
    needs = {m: of[m][1] if of[m] else metrics.scalar_metric(m)[1] for m in chosen}
    total = total or grid.meta.nrows * grid.meta.ncols
    values: dict[tuple, dict] = {}
    try:
        plain = [metrics.scalar_metric(m)[0](z(m), none, none).alias(m) for m in chosen if not of[m] and not needs[m]]
        plain += [F.avg(z(m)).alias(f"centre {m}") for m in chosen if needs[m] == "mean"]
        for r in df.groupBy(*keys).agg(F.count("z").alias("nbpts"), *plain).collect():
            values[r["mode"], r["class_idx"]] = r.asDict()
        ranks = [(m, of[m][0](z(m), none, none), of[m][2]) for m in chosen if of[m] and not needs[m]]
        ranks += [(f"centre {m}", z(m), 0.5) for m in chosen if needs[m] == "median"]
        for key, q in (quantiles.quantiles(df, keys, ranks) if ranks else {}).items():
            values[key] |= {m: v if m not in of or v is None else v * of[m][3] for m, v in q.items()}
        about = [m for m in chosen if needs[m]]
        if about and values:
            centres = df.sparkSession.createDataFrame([(*k, *[v[f"centre {m}"] for m in about]) for k, v in values.items()], "mode string, class_idx int, " + ", ".join(f"c{i} double" for i in range(len(about))))
            centred = df.join(F.broadcast(centres), keys)
            c = {m: F.col(f"c{i}") for i, m in enumerate(about)}
            ranks = [(m, of[m][0](z(m), c[m], c[m]), of[m][2]) for m in about if of[m]]
            for key, q in (quantiles.quantiles(centred, keys, ranks) if ranks else {}).items():
                values[key] |= {m: None if v is None else v * of[m][3] for m, v in q.items()}
            plain = [metrics.scalar_metric(m)[0](z(m), c[m], c[m]).alias(m) for m in about if not of[m]]
            for r in centred.groupBy(*keys).agg(*plain).collect() if plain else []:
                values[r["mode"], r["class_idx"]] |= r.asDict()
    finally:
        df.unpersist()
    rows = [(*k, v["nbpts"], *[float(v[m]) if v[m] is not None else None for m in chosen]) for k, v in values.items()]
    found = df.sparkSession.createDataFrame(rows, "mode string, class_idx int, nbpts long" + "".join(f", `{m}` double" for m in chosen))
    out = classes_table(df, layer).join(F.broadcast(found), keys, "left")
    return out.select(
        "mode", "class_idx", F.concat_ws(":", "class_name", "class_value").alias("set_name"), *[F.round(m, DIGITS).alias(m) for m in chosen],
        F.coalesce("nbpts", F.lit(0)).alias("nbpts"), F.round(F.coalesce("nbpts", F.lit(0)) * 100.0 / total, DIGITS).alias("percent_valid_points"),
    )


def grouped_stats(df: DataFrame, keys: list[str], chosen: tuple[str, ...], without: dict[str, bool] | None = None) -> DataFrame:
    """keys, the chosen scalar metrics and nbpts of each group of df (a written table: keys, z, and inner for metrics of `without`).

    Groups may be many and large: all are found by partial sums and by narrowing tables of ranks, and none comes to the driver.
    """
    of = {m: metrics.ranked_metric(m) for m in chosen}
    needs = {m: of[m][1] if of[m] else metrics.scalar_metric(m)[1] for m in chosen}
    z, none = (lambda m: F.col("inner") if (without or {}).get(m) else F.col("z")), F.lit(None).cast("double")
    about = [m for m in chosen if needs[m]]
    plain = [metrics.scalar_metric(m)[0](z(m), none, none).cast("double").alias(m) for m in chosen if not of[m] and not needs[m]]
    plain += [F.avg(z(m)).alias(f"centre {m}") for m in about if needs[m] == "mean"]
    out = df.groupBy(*keys).agg(F.count("z").alias("nbpts"), *plain)
    scaled = lambda m: of[m][0](z(m), none, none)
    ranks = [(m, scaled(m), of[m][2]) for m in chosen if of[m] and not needs[m]] + [(f"centre {m}", z(m), 0.5) for m in about if needs[m] == "median"]
    out = joined(out, quantile_table(df, keys, ranks), keys) if ranks else out
    if about:
        out = written(out, "group-stats")
        k = [f"__c{i}" for i in range(len(keys))]
        centres = out.select(*[F.col(a).alias(b) for a, b in zip(keys, k)], *[F.col(f"centre {m}").alias(f"__m{i}") for i, m in enumerate(about)])
        centred = df.join(few(centres), same(keys, k)).drop(*k)
        c = {m: F.col(f"__m{i}") for i, m in enumerate(about)}
        sums = [metrics.scalar_metric(m)[0](z(m), c[m], c[m]).cast("double").alias(m) for m in about if not of[m]]
        out = joined(out, centred.groupBy(*keys).agg(*sums), keys) if sums else out
        ranks = [(m, of[m][0](z(m), c[m], c[m]), of[m][2]) for m in about if of[m]]
        out = joined(out, quantile_table(centred, keys, ranks), keys) if ranks else out
    return out.select(*keys, *[(F.col(m) * of[m][3] if of[m] else F.col(m)).alias(m) for m in chosen], "nbpts")


def joined(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """left with right's columns by keys, nulls being keys as well."""
    k = [f"__j{i}" for i in range(len(keys))]
    return left.join(right.select(*[F.col(a).alias(b) for a, b in zip(keys, k)], *[F.col(f"`{c}`") for c in right.columns if c not in keys]), same(keys, k), "left").drop(*k)


def of_sorted(values: Column, share: float) -> Column:
    """The quantile of a sorted array, interpolated; null of an empty one."""
    place = F.lit(float(share)) * (F.size(values) - 1)
    below = F.floor(place).cast("int")
    low = F.get(values, below)
    return low + (F.get(values, F.least(below + 1, F.size(values) - 1)) - low) * (place - below)


def whole_part_stats(df: DataFrame, parts: list[str], layer: Layer, chosen: tuple[str, ...], without: dict[str, bool]) -> DataFrame:
    """parts, total and found (an array of mode, class_idx, the chosen metrics as m0, m1, ... and nbpts) of each part of df.

    Pixels are dealt by part once, and all else is done where they lie: modes, classes and quantiles, from sorted arrays.
    """
    of = {m: metrics.ranked_metric(m) for m in chosen}
    df = df.repartition(*parts)
    flagged = any(without.get(m) for m in chosen)
    if flagged:
        own = W.partitionBy(*parts)
        mu, sigma = F.avg("z").over(own), F.stddev_pop("z").over(own)
        df = df.withColumns({"__mu": mu, "__sigma": sigma})
        df = df.withColumn("inner", F.when((F.col("z") > F.col("__mu") - 3 * F.col("__sigma")) & (F.col("z") < F.col("__mu") + 3 * F.col("__sigma")), F.col("z")))
    keys, none = [*parts, "mode", "class_idx"], F.lit(None).cast("double")
    z = lambda m: F.col("inner") if without.get(m) else F.col("z")
    array = lambda m: F.col("__inner") if without.get(m) else F.col("__z")
    sums = [F.count("*").alias("__rows"), F.count("z").alias("nbpts"), F.sort_array(F.collect_list("z")).alias("__z")]
    sums += [F.sort_array(F.collect_list("inner")).alias("__inner")] if flagged else []
    sums += [metrics.scalar_metric(m)[0](z(m), none, none).cast("double").alias(f"m{i}") for i, m in enumerate(chosen) if not of[m]]
    sums += [F.avg(z(m)).alias(f"c{i}") for i, m in enumerate(chosen) if of[m] and of[m][1] == "mean"]
    t = in_modes(df, layer).select(*keys, "z", *(["inner"] if flagged else [])).groupBy(*keys).agg(*sums)
    t = t.withColumns({f"c{i}": of_sorted(array(m), 0.5) for i, m in enumerate(chosen) if of[m] and of[m][1] == "median"})
    for i, m in enumerate(chosen):
        if of[m]:
            c = F.col(f"c{i}") if of[m][1] else none
            t = t.withColumn(f"a{i}", F.sort_array(F.transform(array(m), lambda x: of[m][0](x, c, c)))).withColumn(f"m{i}", of_sorted(F.col(f"a{i}"), of[m][2]) * of[m][3]).drop(f"a{i}")
    found = F.when(F.col("class_idx").isNotNull(), F.struct("mode", "class_idx", *[f"m{i}" for i in range(len(chosen))], "nbpts"))
    return t.groupBy(*parts).agg(F.sum(F.when(F.col("mode") == "standard", F.col("__rows"))).alias("total"), F.collect_list(found).alias("found"))


def part_stats(grid: Grid, layer: Layer, every: DataFrame, chosen: tuple[str, ...] = metrics.DEFAULT, remove_outliers: bool | dict = False, most: int | None = None) -> DataFrame:
    """Statistics of each part of a grid by mode and class: the parts' columns and those of class_stats().

    every: the parts that have rows in the result (parts' columns); classes without pixels are null there. Outliers are those
    of their part; shares count the part's pixels. most: pixels that a part has at most, if that is known: parts of up to
    TOGETHER are done where their pixels meet, larger ones by partial sums and narrowing tables of ranks.
    """
    without = remove_outliers if isinstance(remove_outliers, dict) else {m: bool(remove_outliers) and m not in metrics.KEEPS_OUTLIERS for m in chosen}
    parts, df = list(grid.parts), grid.df
    classes = F.array(*[F.struct(F.lit(r["mode"]).alias("mode"), F.lit(r["class_idx"]).alias("class_idx"), F.lit(f"{r['class_name']}:{r['class_value']}").alias("set_name")) for r in classes_table(df, layer).collect()])  # a few classes
    if most and most <= TOGETHER and not any(metrics.scalar_metric(m)[1] for m in chosen if not metrics.ranked_metric(m)):
        out = every.select(*parts).join(whole_part_stats(df, parts, layer, chosen, without), parts, "left").withColumn("c", F.explode(classes))
        own = F.get(F.filter("found", lambda x: (x["mode"] == F.col("c.mode")) & (x["class_idx"] == F.col("c.class_idx"))), 0)
        out, n = out.select(*parts, "c.*", "total", own.alias("own")), F.coalesce("own.nbpts", F.lit(0))
        return out.select(*parts, "mode", "class_idx", "set_name", *[F.round(f"own.m{i}", DIGITS).alias(m) for i, m in enumerate(chosen)], n.cast("long").alias("nbpts"), F.round(n * 100.0 / F.col("total"), DIGITS).alias("percent_valid_points"))
    sizes = written(df.groupBy(*parts).agg(F.count("*").alias("total"), F.avg("z").alias("mu"), F.stddev_pop("z").alias("sigma")), "part-sizes")
    inner = F.lit(None).cast("double")
    if any(without.get(m) for m in chosen):
        df = df.join(few(sizes.select(*parts, "mu", "sigma")), parts)
        inner = F.when((F.col("z") > F.col("mu") - 3 * F.col("sigma")) & (F.col("z") < F.col("mu") + 3 * F.col("sigma")), F.col("z"))
    keys = [*parts, "mode", "class_idx"]
    values = written(in_modes(df, layer).filter("class_idx is not null").select(*keys, "z", inner.alias("inner")), "part-values")
    found = grouped_stats(values, keys, chosen, without)
    out = every.select(*parts, F.explode(classes).alias("c")).select(*parts, "c.*").join(sizes.select(*parts, "total"), parts, "left").join(found, keys, "left")
    n = F.coalesce("nbpts", F.lit(0))
    return out.select(*keys, "set_name", *[F.round(m, DIGITS).alias(m) for m in chosen], n.cast("long").alias("nbpts"), F.round(n * 100.0 / F.col("total"), DIGITS).alias("percent_valid_points"))


def class_vectors(grid: Grid, layer: Layer, metric: str, params: dict | None = None, remove_outliers: bool = False) -> DataFrame:
    """mode, class_idx, set_name, bin, edge, value: a vector metric of every class of every mode, rounded.

    Metrics of values read the class's heights, all classes in one aggregation; metrics of grids read the grid, null
    outside the class. Classes that cover all pixels with zeros, and empty ones, have no rows. A few numbers a class come
    to the driver, bins never do.
    """
    keys, params, total = ["mode", "class_idx"], params or {}, grid.meta.nrows * grid.meta.ncols
    df = in_modes(inliers(grid.df) if remove_outliers else grid.df, layer)
    z = F.when(F.col("inlier"), F.col("z")) if remove_outliers else F.col("z")
    df = df.filter("class_idx is not null").select("row", "col", *keys, z.alias("z")).persist()
    try:
        size = df.groupBy(*keys).agg(F.count("z").alias("n"), F.max(F.abs(F.round("z", 6))).alias("all_zero"), F.max("z").alias("top"), F.max(F.abs("z")).alias("far")).collect()  # a few classes
        found = {(r["mode"], r["class_idx"]): r for r in size if r["n"] and not (r["n"] == total and r["all_zero"] == 0)}
        values = df.select(*keys, "z")
        if not found:
            bins = df.sparkSession.createDataFrame([], "mode string, class_idx int, bin long, edge double, value double")
        elif metric == "cdf":
            bins = metrics.histograms(values, keys, F.abs("z"), {k: metrics.cdf_bins(r["far"], **params) for k, r in found.items()}, True)
        elif metric == "pdf":
            p98 = quantiles.quantiles(values, keys, [("q", F.col("z"), 0.98)]) if params.get("filter_p98") else {}
            bins = metrics.histograms(values, keys, F.col("z"), {k: metrics.pdf_bins(p98[k]["q"] if p98 else r["top"], **params) for k, r in found.items()}, False)
        elif metric == "ratio_above_threshold":
            bins = metrics.ratios(values, keys, **params)
        else:
            made = []
            for (mode, k), _ in sorted(found.items()):
                own = df.filter((F.col("mode") == mode) & (F.col("class_idx") == k)).select("row", "col", "z")
                own = grid.df.select("row", "col").join(own, ["row", "col"], "left") if metric in metrics.GRID_VECTORS else own
                args = {"dx": grid.meta.xres, "dy": grid.meta.yres, **params} if metric in metrics.GRID_VECTORS else params
                of = Grid(own, grid.meta) if metric in metrics.GRID_VECTORS else own
                one = metrics.vector_metric(metric)(of, **args)
                made.append(one.select(F.lit(mode).alias("mode"), F.lit(k).cast("int").alias("class_idx"), "bin", "edge", F.col("value").cast("double").alias("value")))
            bins = reduce(DataFrame.unionByName, made)
        bins = written(bins, "vectors")
    finally:
        df.unpersist()
    wanted = df.sparkSession.createDataFrame([*found], "mode string, class_idx int") if found else bins.select(*keys)
    names = classes_table(df, layer).join(F.broadcast(wanted), keys, "left_semi")
    named = bins.join(F.broadcast(names), keys)
    return named.select(*keys, F.concat_ws(":", "class_name", "class_value").alias("set_name"), "bin", F.round("edge", DIGITS).alias("edge"), F.round("value", DIGITS).alias("value"))


def class_matrix(grid: Grid, layer: Layer, metric: str, params: dict | None = None, class_idx: int = 0, mode: str = "standard") -> DataFrame:
    """row, col, z: a matrix metric of the grid with the pixels of one class only, the others being missing."""
    own = in_modes(grid.df, layer).filter((F.col("mode") == mode) & (F.col("class_idx") == class_idx)).select("row", "col", "z")
    own = grid.df.select("row", "col").join(own, ["row", "col"], "left")
    return metrics.matrix_metric(metric)(Grid(own, grid.meta), **(params or {}))


def long_form(stats: DataFrame, method: str, layer: str, parts: tuple[str, ...] = ()) -> DataFrame:
    """method, layer, mode, class_idx, set_name, metric, value; columns of the parts first."""
    values = [c for c in stats.columns if c not in ("mode", "class_idx", "set_name", *parts)]
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in values]))
    return stats.select(*parts, F.lit(method).alias("method"), F.lit(layer).alias("layer"), "mode", "class_idx", "set_name", pairs.alias("m")).select(*parts, "method", "layer", "mode", "class_idx", "set_name", "m.*")


def save(stats: DataFrame, folder: str) -> None:
    """CSV and JSON of each mode, in folders stats_results[_mode].csv and .json, rows in order of class."""
    for (mode,) in sorted(stats.select("mode").distinct().collect()):  # three at most
        rows = stats.filter(F.col("mode") == mode).orderBy("class_idx").withColumnRenamed("set_name", "Set Name").drop("mode", "class_idx").coalesce(1)
        name = f"{folder}/stats_results" + ("" if mode == "standard" else f"_{mode}")
        rows.write.mode("overwrite").option("header", True).option("quoteAll", True).csv(f"{name}.csv")
        rows.write.mode("overwrite").json(f"{name}.json")


#: Column names of the vector metrics' CSV files; other vector metrics have Bins and Values.
VECTOR_HEADS = {"cdf": ("Bins", "CDF values"), "pdf": ("Bins", "Normalized PDF values"), "ratio_above_threshold": ("Thresholds", "Ratio above threshold")}


def save_vectors(vectors: DataFrame, metric: str, folder: str) -> None:
    """CSV of each class of each mode: bins by their left edges, in order."""
    head = VECTOR_HEADS.get(metric, ("Bins", "Values"))
    for mode, k in sorted(map(tuple, vectors.select("mode", "class_idx").distinct().collect())):  # a few classes
        rows = vectors.filter((F.col("mode") == mode) & (F.col("class_idx") == k)).orderBy("bin").select(F.col("edge").alias(head[0]), F.col("value").alias(head[1]))
        name = f"{folder}/{metric}_{k}" + ("" if mode == "standard" else f"_{mode}")
        rows.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{name}.csv")


class Results:
    """Access to a long table of results by layer, mode, class and metric."""

    def __init__(self, table: DataFrame):
        self.table = table

    def layers(self) -> list[str]:
        return [r[0] for r in self.table.select("layer").distinct().orderBy("layer").collect()]

    def stats(self, layer: str, mode: str = "standard") -> DataFrame:
        return self.table.filter((F.col("layer") == layer) & (F.col("mode") == mode))

    def metrics(self, layer: str, class_idx: int = 0, mode: str = "standard") -> list[str]:
        return [r[0] for r in self.stats(layer, mode).filter(F.col("class_idx") == class_idx).select("metric").orderBy("metric").collect()]

    def metric(self, layer: str, metric: str, class_idx: int = 0, mode: str = "standard") -> float | None:
        """One value; KeyError if there is none of this name."""
        got = self.stats(layer, mode).filter((F.col("class_idx") == class_idx) & (F.col("metric") == metric)).select("value").head()
        if got is None:
            raise KeyError(metric)
        return got[0]
