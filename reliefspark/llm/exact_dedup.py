"""Exact dedup by an extendible-hash index on shared files (DataFrame operations only)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reliefspark.llm.common import folded, read_table, small, written

#: Index entries that a bucket holds before it is split, and the directory's greatest depth (65,536 slots).
CAPACITY, MAX_DEPTH = 8192, 16
#: Bytes of head texts up to which they may be broadcast.
BROADCAST_BYTES = 32_000_000


def directory(slots: dict[int, int], depth: int, capacity: int) -> list[tuple[int, int, int]]:
    """(slot, bucket, pages) of every slot of a directory of 2**depth slots.

    It starts as one bucket; whenever a bucket holds more than `capacity` entries, the directory doubles if need be
    and the bucket is split by the next bit of the key. A bucket that is still overfull at the last depth gets a chain of
    pages of its own, so many that each holds about `capacity` entries.
    """
    out, todo = [], [(0, 0)]
    sums = [0] * (2**depth + 1)
    for s in range(2**depth):
        sums[s + 1] = sums[s] + slots.get(s, 0)
    while todo:
        prefix, local = todo.pop()
        low, high = prefix << (depth - local), (prefix + 1) << (depth - local)
        if local < depth and sums[high] - sums[low] > capacity:
            todo += [(prefix * 2 + 1, local + 1), (prefix * 2, local + 1)]
        else:
            out += [(s, low, max(1, -(-(sums[high] - sums[low]) // capacity))) for s in range(low, high)]
    return out


def normal(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), folded(F.col(text_col)).alias("norm")).withColumn("key", F.xxhash64("norm"))


def indexed(text: DataFrame, capacity: int) -> DataFrame:
    """key, head, n, sha, written: one index entry a key (hash of the folded text), with its largest id and its rows.

    The directory tells each row's bucket and page. Rows are shuffled once, by ranges of (bucket, page); the owner task of a
    range sorts and groups what it holds and writes its files. Only entries of chained buckets are put together again.
    """
    entries = written(text.select("doc_id", "key", F.unhex(F.sha2("norm", 256)).alias("sha")), "entries")
    depth = min(MAX_DEPTH, max(2, math.ceil(math.log2(max(entries.count(), 1) / capacity + 1)) + 3))
    slot = F.shiftrightunsigned(F.col("key"), 64 - depth)
    counts = {r["slot"]: r["n"] for r in entries.groupBy(slot.alias("slot")).agg(F.count("*").alias("n")).collect()}  # at most 65,536 rows
    slots = text.sparkSession.createDataFrame(directory(counts, depth, capacity), "slot long, bucket long, pages long")
    paged = entries.withColumn("slot", slot).join(F.broadcast(slots), "slot")
    # rows of a chained bucket are dealt by their place in the table, which even repeated rows don't share
    paged = paged.withColumn("page", F.when(F.col("pages") > 1, F.pmod(F.xxhash64(F.monotonically_increasing_id()), "pages")).otherwise(0))
    owned = paged.repartitionByRange("bucket", "page").groupBy("bucket", "page", "pages", "key").agg(F.max("doc_id").alias("head"), F.count("*").alias("n"), F.max("sha").alias("sha"))
    index = written(owned, "index")
    chained = index.filter("pages > 1").groupBy("key").agg(F.max("head").alias("head"), F.sum("n").alias("n"), F.max("sha").alias("sha"))
    return written(index.filter("pages = 1").select("key", "head", "n", "sha").unionByName(chained), "heads")


def short(heads: DataFrame, column: str) -> DataFrame:
    """heads (a written table with a text column), marked for broadcast if it is small in rows and in bytes."""
    return F.broadcast(heads) if (heads.agg(F.sum(F.octet_length(column) + 64).alias("b")).first()["b"] or 0) <= BROADCAST_BYTES else heads


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are, after folding A-Z; of equal texts the row with the largest id stays. Null
    text counts as empty, so null and empty texts form one group. Rows repeated with one id share their fate and
    each counts in group_size (kept_rows() keeps one of them). Null ids are less than all others; where all ids of a group
    are null, keep_id and kept are null. Texts may be of any length: a task holds two at a time. Columns other than the
    two named are never read. An empty table gives no rows.

    The index lies on shared files (indexed()); its directory has at most 65,536 slots. Texts of keys with several rows
    are compared with their head's bytes. Rows that differ (a collision) go along the chain: they get a head of their own,
    until none is left. A key with a third of all rows has many pages in the index; comparing it is a join with few
    heads, which are broadcast if they are at most BROADCAST_BYTES long, and else a skewed join that Spark splits.
    """
    text = normal(docs, id_col, text_col)
    heads = indexed(text, capacity)
    result = heads.filter("n = 1").select(F.col("head").alias("doc_id"), F.col("head").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lower(F.hex("sha")).alias("text_sha256"))
    shared = written(heads.filter("n > 1").select("key", F.col("head").alias("keep_id")), "shared-keys")
    left = written(text.join(small(shared), "key"), "members")
    while left.limit(1).count():
        # several rows may hold the head's id: the least text among them is the head
        head_text = written(left.filter(F.col("doc_id").eqNullSafe(F.col("keep_id"))).groupBy("key").agg(F.min("norm").alias("head_norm")), "head-texts")
        same = F.col("norm") == F.col("head_norm")
        compared = written(left.join(short(head_text, "head_norm"), "key").select("doc_id", "key", "keep_id", same.alias("same"), F.when(~same, F.col("norm")).alias("norm"), F.when(same, F.sha2("norm", 256)).alias("text_sha256")), "compared")
        equal = compared.filter("same")
        sizes = written(equal.groupBy("key").agg(F.count("*").alias("group_size")), "sizes")
        result = result.unionByName(equal.join(small(sizes), "key").select("doc_id", "keep_id", "group_size", "text_sha256"))
        rest = compared.filter("not same").select("doc_id", "norm", "key")
        again = written(rest.groupBy("key").agg(F.max("doc_id").alias("keep_id")), "chained-heads")
        left = rest.join(small(again), "key")
    return result.select("doc_id", "keep_id", "group_size", (F.col("doc_id") == F.col("keep_id")).alias("kept"), "text_sha256")


def kept_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """The rows of docs, with all their columns, one for each group of equal texts: one of the largest id.

    Rows go by their id and text together, so that a row which shares its id with a dropped one stays. Of rows
    repeated with the kept id, one stays.
    """
    d = written(exact_dedup(docs, id_col, text_col, capacity).select("doc_id", "text_sha256", "group_size", F.coalesce("kept", F.lit(True)).alias("kept")), "decisions")
    gone = written(d.filter("not kept").select(F.col("doc_id").alias("gone_id"), F.col("text_sha256").alias("gone_sha")).distinct(), "exact-copies")
    several = d.filter("kept and group_size > 1").groupBy("doc_id", "text_sha256").agg(F.count("*").alias("rows")).filter("rows > 1")
    several = written(several.select(F.col("doc_id").alias("gone_id"), F.col("text_sha256").alias("gone_sha")), "repeated")
    names = [f"c{k}" for k in range(len(docs.columns))]
    of = {c: names[docs.columns.index(c)] for c in (id_col, text_col)}
    plain = docs.toDF(*names).withColumn("row_sha", F.sha2(folded(F.col(of[text_col])), 256))
    on = lambda t: F.col(of[id_col]).cast("long").eqNullSafe(t["gone_id"]) & (F.col("row_sha") == t["gone_sha"])
    out = plain.join(small(gone), on(gone), "left_anti")
    if several.limit(1).count():
        # the first of its columns' values, for a defined choice
        twice = out.join(small(several), on(several), "left_semi").groupBy(of[id_col], "row_sha").agg(F.min(F.struct(*names)).alias("one"))
        out = out.join(small(several), on(several), "left_anti").select(*names).unionByName(twice.select("one.*"))
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns)])


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read_table(spark, sf_dir, "documents"))


SQL = """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
FROM t
"""
