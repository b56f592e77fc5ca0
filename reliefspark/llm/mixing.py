"""Mixing sources to target weights by Pareto order sampling (DataFrame operations only)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reliefspark.llm.common import WORD, read_table, small, written

#: Weights by the sources' order; a target stops at so many times its source's size.
WEIGHTS, MOST = (1, 2, 3), 3
#: Buckets of the order statistic, in which the cut of each source is first bracketed.
BUCKETS = 4096


#: What tells rows apart for the draw: equal rows are numbered.
KEYS = ("doc_id", "digest", "copy")


def uniform(seed: int) -> Column:
    """A number in (0, 1) that depends on a row's id, text, number among equal rows and the seed alone."""
    text = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "digest", F.col("copy").cast("string")))
    return (F.conv(F.substring(text, 1, 12), 16, 10).cast("double") + 0.5) / F.lit(float(2**48))


#: What equal rows agree in.
SAME = ["doc_id", "source", "digest"]


def equal(left: list[str], right: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [F.col(a).eqNullSafe(F.col(b)) for a, b in zip(left, right)])


def named(columns: list[str]) -> list[str]:
    return [f"__{c}" for c in columns]


def repeated(rows: DataFrame) -> DataFrame:
    """__doc_id, __source, __digest of rows that have equals."""
    several = rows.groupBy(*[F.col(c).alias(n) for c, n in zip(SAME, named(SAME))]).agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    return small(written(several, "repeated"))


def copies(rows: DataFrame, several: DataFrame) -> DataFrame:
    """rows (SAME, place, others) with copy: the number from 0 among equal rows; place goes.

    place: where a row stands, its task in the high bits (monotonically_increasing_id). Only rows that have equals are numbered: within
    each task first, and by sums over tasks, so that a row repeated millions of times fills no task.
    """
    own = written(rows.join(several, equal(SAME, named(SAME))).drop(*named(SAME)).withColumn("__task", F.shiftright("place", 33)), "equals")
    tasks = own.groupBy(*[F.col(c).alias(n) for c, n in zip(SAME, named(SAME))], F.col("__task").alias("__t")).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy(*named(SAME)).orderBy("__t").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # a row a task
    starts = small(written(tasks.withColumn("__before", before).drop("n"), "copies"))
    inside = F.row_number().over(W.partitionBy(*SAME, "__task").orderBy("place")) - 1
    numbered = own.withColumn("__inside", inside).join(starts, equal([*SAME, "__task"], [*named(SAME), "__t"])).withColumn("copy", F.col("__before") + F.col("__inside"))
    return rows.join(several, equal(SAME, named(SAME)), "left_anti").withColumn("copy", F.lit(0).cast("long")).unionByName(numbered.select(*rows.columns, "copy")).drop("place")


def targets(sizes: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """source, source_size -> with target: shares by weight of all sizes, stopped at most x size, the excess reshared.

    The resharing ends where target = min(most x size, level x weight) with one level for all, found from running sums
    over the sources ordered by size a weight. The windows run over one row a source.
    """
    every = W.orderBy(F.col("source").asc_nulls_last())
    n = len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(every) - 1) % n + 1).cast("int"))
    t = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    by_fill = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_fill.rowsBetween(W.unboundedPreceding, -1)
    whole = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    t = t.withColumn("total", F.sum("source_size").over(whole).cast("double")).withColumn("capped", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    t = t.withColumn("free", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    t = t.withColumn("level_here", (F.col("total") - F.col("capped")) / F.col("free"))
    # the level is that of the first source (in this order) which does not reach its cap
    t = t.withColumn("level", F.min(F.when(F.col("level_here") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), (-F.col("level_here")).alias("l")))).over(whole)["l"] * -1)
    return t.select("source", "source_size", F.coalesce(F.least("cap", F.col("level") * F.col("weight")), F.col("cap")).alias("target"))


def measure(size: Column) -> Column:
    """What a document's inclusion grows with: the whole root of its words, plus 1."""
    return F.floor(F.sqrt(size)) + 1


def levels(sized: DataFrame, t: DataFrame) -> DataFrame:
    """source, level: documents of a source are included with min(1, level x measure), which sums to rest words.

    The largest measures reach 1 first. Words are summed by (source, measure), so the windows run over as many rows a
    source as texts have different roots of sizes, whatever the number of documents.
    """
    h = sized.filter("size > 0").groupBy("source", measure(F.col("size")).alias("x")).agg(F.sum("size").alias("words"))
    h = h.withColumnRenamed("source", "s").join(small(t.filter("rest > 0").select("source", "rest")), F.col("s").eqNullSafe(F.col("source")))
    down = W.partitionBy("s").orderBy(F.col("x").desc())
    larger = F.coalesce(F.sum("words").over(down.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    below = F.sum(F.col("words") * F.col("x")).over(down.rowsBetween(W.currentRow, W.unboundedFollowing))
    h = h.withColumn("level", (F.col("rest") - larger) / below)
    # of those whose measure stays below 1, the one of the largest measure
    return h.filter(F.col("level") * F.col("x") < 1).groupBy(F.col("s").alias("source")).agg(F.max(F.struct("x", "level"))["level"].alias("level"))


def plan(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = 7) -> DataFrame:
    """For each source of sized (doc_id, source, digest, copy, size): target, whole copies, level of inclusion, and the cut.

    Documents of level x measure >= 1 are certain. Of the others, one is drawn when (q, KEYS) <= cut, with q
    its random odds divided by its inclusion odds. Every task reads part of a source only: words are summed by (source,
    bucket of q), the bucket in which a source fills its remainder is found from these sums, and only its documents are
    put in order.
    """
    t = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    t = written(t.withColumn("copies", F.floor(ratio)).withColumn("rest", F.col("target") - F.floor(ratio) * F.col("source_size")), "targets")
    level = written(levels(sized, t).withColumnRenamed("source", "s"), "levels")
    t = written(t.join(small(level), t["source"].eqNullSafe(level["s"]), "left").drop("s"), "levelled")
    asked = sized.filter("size > 0").join(small(t.filter("level is not null")).withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
    pi = F.col("level") * measure(F.col("size"))
    asked = asked.select(*KEYS, "source", "size", "rest", pi.alias("pi"), odds(pi, seed).alias("q"))
    drawn = asked.filter("pi < 1").withColumn("bucket", F.floor(F.col("q") / (F.col("q") + 1) * BUCKETS))
    certain = asked.filter("pi >= 1").groupBy("source").agg(F.sum("size").alias("certain")).withColumnRenamed("source", "s")
    sums = drawn.groupBy("source", "bucket").agg(F.sum("size").alias("words"), F.max("rest").alias("rest"))
    sums = sums.join(small(written(certain, "certain")), F.col("source").eqNullSafe(F.col("s")), "left").withColumn("rest", F.col("rest") - F.coalesce("certain", F.lit(0))).drop("s")
    sums = sums.withColumn("done", F.sum("words").over(W.partitionBy("source").orderBy("bucket")) - F.col("words"))
    last = written(sums.filter("done < rest").groupBy(F.col("source").alias("s")).agg(F.max("bucket").alias("b"), F.max("done").alias("done"), F.max("rest").alias("room")), "brackets")
    inner = W.partitionBy("source").orderBy("q", *KEYS)
    near = drawn.join(small(last), F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    near = near.withColumn("before", F.col("done") + F.sum("size").over(inner.rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("size"))
    # the document that crosses the remainder is taken if at least half of it fits; an earlier bracket is taken whole
    taken = near.filter(F.col("before") + F.col("size") / 2 <= F.col("room"))
    cut = taken.groupBy("source").agg(F.max(F.struct("q", *KEYS)).alias("cut"))
    cut = last.join(cut.withColumnRenamed("source", "c"), F.col("s").eqNullSafe(F.col("c")), "left")
    # with none taken in its bracket, a source's cut lies at the bracket's start
    cut = cut.select("s", "cut", "b")
    return written(t.join(cut, t["source"].eqNullSafe(cut["s"]), "left").drop("s"), "mix-plan")


def odds(pi: Column, seed: int) -> Column:
    u = uniform(seed)
    return (u / (1 - u)) / (pi / (1 - pi))


def with_draws(rows: DataFrame, p: DataFrame, seed: int) -> DataFrame:
    """rows (source, size, KEYS and others) with mix_plan, their source's plan, and mix_draws, how often each is taken."""
    right = p.select(F.col("source").alias("mix_source"), F.struct(*[c for c in p.columns if c != "source"]).alias("mix_plan"))
    joined = rows.join(small(right), F.col("source").eqNullSafe(F.col("mix_source")))
    of = lambda c: F.col(f"mix_plan.{c}")
    pi = of("level") * measure(F.col("size"))
    q = odds(pi, seed)
    bucket = F.floor(q / (q + 1) * BUCKETS)
    # null ids come first, as structs are ordered
    below = F.when(of("cut").isNull(), bucket < of("b")).otherwise(F.struct(q.alias("q"), *KEYS) <= of("cut"))
    more = F.when((pi >= 1) | ((pi < 1) & below), 1).otherwise(0)
    return joined.withColumn("mix_draws", F.when(F.col("size") > 0, of("copies") + more).otherwise(0)).drop("mix_source")


def keyed(docs: DataFrame, id_col: str, text_col: str, source_col: str, *more: Column) -> DataFrame:
    """doc_id, source, digest (of the text), size, place and more of each row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).alias("source"), F.md5(text).alias("digest"), words(F.col(text_col)).alias("size"), F.monotonically_increasing_id().alias("place"), *more)


def words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """(sized, plan): doc_id, source, digest, copy, size of each row of docs, and the plan of each source.

    Size is the number of words of a text (null: 0). Null is a source of its own, last in order. Sources of no words
    get and give none, nor do documents of none. A source whose target is r times its size is taken floor(r) times
    whole. For the rest, a document's inclusion probability grows with the root of its size, so that longer documents
    are likelier, but short ones stay: those that would reach 1 are certain copies, and the others are drawn by Pareto
    order sampling of a fixed number of words: in the order of random odds over inclusion odds, until the remainder is
    filled (to within half of the document at the cut). The random odds come from the id and the seed, so reruns
    agree; rows repeated with one id (null ids, too) share their random number, and are counted in turn. Other columns
    are never read. An empty table gives no rows.
    """
    sized, _ = numbered_sizes(docs, id_col, text_col, source_col)
    return sized, plan(sized, weights, most, seed)


def numbered_sizes(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> tuple[DataFrame, DataFrame]:
    """(doc_id, source, digest, size, copy of each row; what rows have equals)."""
    sized = written(keyed(docs, id_col, text_col, source_col), "sized")
    several = repeated(sized)
    return written(copies(sized, several), "numbered"), several


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of docs, with all their columns, each as often as the mix takes it."""
    whole = F.struct(*[F.col(c).alias(f"c{k}") for k, c in enumerate(docs.columns)]).alias("row")  # so that no column can clash with those of the plan
    sized, several = numbered_sizes(docs, id_col, text_col, source_col)
    # equal rows are numbered anew: which of them has which number makes no difference
    rows = copies(keyed(docs, id_col, text_col, source_col, whole), several)
    taken = with_draws(rows, plan(sized, weights, most, seed), seed).filter("mix_draws > 0")
    taken = taken.withColumn("mix_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("mix_draws").cast("long"))))
    return taken.select(*[F.col(f"row.c{k}").alias(c) for k, c in enumerate(docs.columns)])


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized, p = mix(read_table(spark, sf_dir, "documents"))
    taken = (F.col("size") * F.col("mix_draws")).cast("long").alias("taken")
    return with_draws(sized, p, 7).select("doc_id", "size", "mix_plan.source_size", "mix_plan.target", taken)


SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5(coalesce(text, '')) AS digest,
         row_number() OVER (PARTITION BY doc_id, source, coalesce(text, '')) - 1 AS copy FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, ((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight, source_size * 3.0::DOUBLE AS cap FROM s
), l AS (
  SELECT *, (sum(source_size) OVER ())::DOUBLE AS total,
         coalesce(sum(cap) OVER o, 0) AS capped, sum(weight) OVER () - coalesce(sum(weight) OVER o, 0) AS free
  FROM w WINDOW o AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), v AS (
  SELECT first((total - capped) / free ORDER BY cap / weight, (total - capped) / free DESC) AS level FROM l WHERE (total - capped) / free * weight <= cap
), t AS (
  SELECT source, source_size, least(cap, coalesce(level * weight, cap)) AS target,
         CASE WHEN source_size > 0 THEN least(cap, coalesce(level * weight, cap)) / source_size ELSE 0 END AS r FROM w CROSS JOIN v
), p AS (
  SELECT *, floor(r) AS copies, target - floor(r) * source_size AS rest FROM t
), x AS (
  SELECT *, (floor(sqrt(size)) + 1)::BIGINT AS x FROM d
), h AS (
  SELECT source, x, sum(size)::BIGINT AS words FROM x WHERE size > 0 GROUP BY 1, 2
), g AS (
  SELECT h.source, x, (rest - coalesce(sum(words) OVER (PARTITION BY h.source ORDER BY x DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(words * x) OVER (PARTITION BY h.source ORDER BY x DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM h JOIN p ON h.source IS NOT DISTINCT FROM p.source WHERE rest > 0
), k AS (
  SELECT source, max_by(level, x) AS level FROM g WHERE level * x < 1 GROUP BY 1
), u AS (
  SELECT x.doc_id, x.digest, x.copy, x.size, p.*, k.level * x.x AS pi, (('0x' || substr(md5('7:' || coalesce(x.doc_id::VARCHAR, '') || ':' || x.digest || ':' || x.copy), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0::DOUBLE AS u
  FROM x JOIN p ON x.source IS NOT DISTINCT FROM p.source LEFT JOIN k ON x.source IS NOT DISTINCT FROM k.source
), q AS (
  SELECT *, CASE WHEN pi < 1 THEN (u / (1 - u)) / (pi / (1 - pi)) END AS q,
         rest - coalesce(sum(size) FILTER (pi >= 1) OVER (PARTITION BY source), 0) AS room FROM u
), c AS (
  SELECT *, sum(CASE WHEN size > 0 AND pi < 1 THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY q NULLS LAST, doc_id NULLS FIRST, digest, copy ROWS UNBOUNDED PRECEDING) - size AS before FROM q
)
SELECT doc_id, size, source_size, target,
       (size * (copies + CASE WHEN pi >= 1 OR (pi < 1 AND before + size / 2.0 <= room) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM c
"""
