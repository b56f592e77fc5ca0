"""Exact top-k search by tiled integer matrix products."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reliefspark.llm.common import read_table, written

#: Rows of a query block and of a shard; lists merged at a node of the tree.
QUERIES, SHARD, FAN_IN = 8192, 8192, 8
SCHEMA = "block long, shard long, query_id long, vec_id long, score long"


def quantised(vectors: DataFrame, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, dim, v: floor(scale * x) of each component; vectors null or with null or non-finite components are left out."""
    x = F.col(vector_col)
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    good = vectors.filter(F.col(id_col).isNotNull() & x.isNotNull() & F.coalesce(finite, F.lit(False)))
    return good.select(F.col(id_col).cast("long").alias("vec_id"), F.size(x).alias("dim"), F.transform(x, lambda c: F.floor(c.cast("double") * scale)).alias("v"))


def select(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest of a row, ties to the smaller id; ids ascend."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        above = np.flatnonzero(scores > least)
        return np.concatenate([above, np.flatnonzero(scores == least)[: k - len(above)]])
    return np.arange(len(scores))


def products(q: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Exact integer inner products; floats serve while all sums are exact in them."""
    most = int(np.abs(q).max(initial=0)) * int(np.abs(s).max(initial=0)) * max(1, q.shape[1])
    if most < 2**24:
        return q.astype(np.float32) @ s.astype(np.float32).T
    if most < 2**53:
        return q.astype(np.float64) @ s.astype(np.float64).T
    return q @ s.T


def top_k(vectors: DataFrame, k: int = 20, every: int = 20, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k highest integer inner products of each query with every other row.

    Queries are the rows whose id is divisible by `every`; ties go to the smaller id. Vectors null or holding null or
    non-finite components take no part; vectors meet those of their own length only. A row is no candidate for a query
    of its own id, so rows repeated with one id don't find each other; each takes part otherwise, and a query id
    that is repeated is answered once, for the least of its shortest vectors. Null ids take no part. Other columns are never read.
    An empty table gives no rows.

    Rows are dealt by their place in the table to shards, so that an id or vector with a third of all rows fills no
    shard; queries are dealt by a hash of their id to blocks; a task multiplies one block with one shard and
    keeps k for each query. The lists are merged in a tree, FAN_IN lists of a block at a node. Nothing is broadcast.
    """
    v = written(quantised(vectors, scale, id_col, vector_col), "vectors")
    n = v.count()
    queries = v.filter(F.col("vec_id") % every == 0)
    shards, blocks = max(1, -(-n // SHARD)), max(1, -(-queries.count() // QUERIES))
    asked = queries.groupBy("vec_id").agg(F.min(F.struct("dim", "v")).alias("q")).select("vec_id", "q.dim", "q.v")
    left = asked.select(F.lit(True).alias("is_query"), F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1)).cast("array<long>")).alias("shard"), "dim", "vec_id", "v")
    right = v.select(F.lit(False).alias("is_query"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<long>")).alias("block"), F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)).alias("shard"), "dim", "vec_id", "v")

    def tile(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id", kind="stable")
        q, s = pdf[pdf["is_query"]], pdf[~pdf["is_query"]]
        if not len(q) or not len(s):
            return pd.DataFrame({"block": [], "shard": [], "query_id": [], "vec_id": [], "score": []}).astype("int64")
        dim = int(pdf["dim"].iloc[0])
        qid, sid = q["vec_id"].to_numpy(np.int64), s["vec_id"].to_numpy(np.int64)
        qm = np.array(q["v"].tolist(), dtype=np.int64).reshape(len(q), dim)
        sm = np.array(s["v"].tolist(), dtype=np.int64).reshape(len(s), dim)
        out = []
        for a in range(0, len(q), 256):
            scores = products(qm[a : a + 256], sm)
            for row, query in zip(scores, qid[a : a + 256]):
                own = slice(*np.searchsorted(sid, [query, query + 1]))
                if own.start < own.stop:
                    kept = np.r_[0 : own.start, own.stop : len(sid)]
                    row, ids = row[kept], sid[kept]
                else:
                    ids = sid
                at = select(row, ids, k)
                out.append((np.full(len(at), query), ids[at], row[at].astype(np.int64)))
        a, b, c = (np.concatenate(x) for x in zip(*out))
        return pd.DataFrame({"block": pdf["block"].iloc[0], "shard": pdf["shard"].iloc[0], "query_id": a, "vec_id": b, "score": c})

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True], kind="stable")
        return pdf[pdf.groupby("query_id").cumcount() < k]

    lists = left.unionByName(right).groupBy("block", "shard", "dim").applyInPandas(tile, SCHEMA)
    width = shards
    while width > 1:
        width = -(-width // FAN_IN)
        lists = lists.withColumn("shard", F.floor(F.col("shard") / FAN_IN)).groupBy("block", "shard").applyInPandas(merge, SCHEMA)

    def ranked(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = merge(pdf)
        return pdf.assign(rank=pdf.groupby("query_id").cumcount() + 1)[["query_id", "rank", "vec_id", "score"]]

    return lists.groupBy("block").applyInPandas(ranked, "query_id long, rank int, vec_id long, score long")


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(read_table(spark, sf_dir, "embeddings"))


SQL = """
WITH v AS (
  SELECT vec_id, [floor(64 * x::DOUBLE)::BIGINT FOR x IN embedding] AS q, len(embedding) AS dim
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id,
         list_sum([a.q[i] * b.q[i] FOR i IN range(1, a.dim + 1)])::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id AND a.dim = b.dim
), r AS (
  SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score FROM s
)
SELECT * FROM r WHERE rank <= 20
"""
