"""An extension: statistics by class of pixels that arrive as a stream of tiles: moments, and bounds of order statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def moments(pixels: DataFrame) -> DataFrame:
    """class_idx, n, s, ss, lo, hi of pixels (class_idx, z); what two tables of them hold can be added up."""
    z = F.col("z")
    return pixels.groupBy("class_idx").agg(F.count(z).alias("n"), F.sum(z).alias("s"), F.sum(z * z).alias("ss"), F.min(z).alias("lo"), F.max(z).alias("hi"))


def finish(parts: DataFrame) -> DataFrame:
    """class_idx, nbpts, mean, std, rmse, min, max from tables of moments."""
    t = parts.groupBy("class_idx").agg(*[f(c).alias(c) for f, c in ((F.sum, "n"), (F.sum, "s"), (F.sum, "ss"), (F.min, "lo"), (F.max, "hi"))])
    mean = F.col("s") / F.col("n")
    return t.select("class_idx", F.col("n").alias("nbpts"), mean.alias("mean"), F.sqrt(F.greatest(F.col("ss") / F.col("n") - mean * mean, F.lit(0.0))).alias("std"), F.sqrt(F.col("ss") / F.col("n")).alias("rmse"), F.col("lo").alias("min"), F.col("hi").alias("max"))


def start(pixels: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Writes the moments of each batch of streamed pixels to a folder of its own, so that a repeated batch replaces itself."""

    def add(batch: DataFrame, number: int) -> None:
        moments(batch).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return pixels.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: Cells of the order statistics: so many to each doubling of a value.
PER_DOUBLING = 16


def cell_of(z: Column) -> Column:
    """The cell of a value: cells are in the order of their values, and a cell's values differ by a factor of 2 ** (1 / PER_DOUBLING) at most."""
    size = F.floor(F.log2(F.abs(z)) * PER_DOUBLING).cast("int") + F.lit(1100 * PER_DOUBLING)  # above 0, whatever the double
    return F.when(z == 0, 0).otherwise(F.signum(z).cast("int") * size)


def cells(pixels: DataFrame, *keys: str) -> DataFrame:
    """keys, class_idx, cell, n, lo, hi of pixels (keys, class_idx, z): the values in each cell, their least and greatest; tables of them can be added up."""
    z = F.nanvl(F.col("z"), F.lit(None).cast("double"))
    v = pixels.select(*keys, "class_idx", z.alias("z")).filter("z is not null")
    return v.groupBy(*keys, "class_idx", cell_of(F.col("z")).alias("cell")).agg(F.count("*").alias("n"), F.min("z").alias("lo"), F.max("z").alias("hi"))


def at_share(points: DataFrame, share: float, value: str, name: str) -> DataFrame:
    """class_idx, name: the interpolated quantile of weighted points (class_idx, value, n). A class has a row a cell at most."""
    order = W.partitionBy("class_idx").orderBy(value).rowsBetween(W.unboundedPreceding, W.currentRow)
    p = points.filter(F.col(value).isNotNull()).withColumn("upto", F.sum("n").over(order)).withColumn("all", F.sum("n").over(W.partitionBy("class_idx")))
    place = (F.col("all") - 1) * share
    own = lambda rank: F.min(F.when(F.col("upto") > rank, F.col(value)))
    below = F.floor(place)
    x, y = own(below), own(F.least(below + 1, F.col("all") - 1))
    return p.groupBy("class_idx").agg((x + (y - x) * F.max(place - below)).alias(name))


def order_bounds(parts: DataFrame) -> DataFrame:
    """class_idx, nbpts, median_low, median_high, nmad_low, nmad_high from tables of cells: between them lie the exact median and nmad.

    Every value lies between its cell's least and greatest, and so do order statistics; a value's distance from a median
    within bounds is bounded likewise. A cell of one value only, or the ends of a class, are exact.
    """
    t = parts.groupBy("class_idx", "cell").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    low, high = at_share(t, 0.5, "lo", "median_low"), at_share(t, 0.5, "hi", "median_high")
    out = t.groupBy("class_idx").agg(F.sum("n").alias("nbpts")).join(low, "class_idx").join(high, "class_idx")
    d = t.join(out, "class_idx")
    near = F.greatest(F.lit(0.0), F.col("lo") - F.col("median_high"), F.col("median_low") - F.col("hi"))
    far = F.greatest(F.col("hi") - F.col("median_low"), F.col("median_high") - F.col("lo"))
    d = d.select("class_idx", "n", (near * 1.4826).alias("near"), (far * 1.4826).alias("far"))
    return out.join(at_share(d, 0.5, "near", "nmad_low"), "class_idx").join(at_share(d, 0.5, "far", "nmad_high"), "class_idx")


def start_cells(pixels: DataFrame, folder: str, checkpoint: str, tile: str = "tile", version: str = "version") -> StreamingQuery:
    """Writes the cells of streamed tiles of pixels (tile, version, class_idx, z), a folder for each tile.

    A tile that comes again, late or corrected, replaces its former pixels, if its version is higher; of one batch, the
    highest version counts. A repeated batch replaces itself. The folder is what order_bounds() reads.
    """

    def add(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        newest = batch.groupBy(tile).agg(F.max(version).alias("newest"))
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            known = spark.read.parquet(folder).groupBy(F.col(tile).alias("known")).agg(F.max(version).alias("has"))
            newest = newest.join(known, F.col(tile) == F.col("known"), "left").filter(F.col("has").isNull() | (F.col("newest") >= F.col("has"))).select(tile, "newest")
        kept = batch.join(newest, tile).filter(F.col(version) == F.col("newest"))
        made = cells(kept, tile, version).repartition(tile).persist()
        made.count()  # before files that it was chosen by are replaced
        made.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(tile).parquet(folder)
        made.unpersist()

    return pixels.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
