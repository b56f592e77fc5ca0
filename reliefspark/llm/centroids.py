"""Exact centroid clustering of integer vectors: float32 screening within rigorous error bounds, integers where it can't decide."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reliefspark.llm.common import read_table, written

#: Components up to this size have sums of squared differences that fit a long, for vectors of up to 64 components.
LARGEST = 2**27
#: Rows of a screening product, and partial sums that one task adds up.
ROWS, PARTS = 8192, 64
#: Bounds of the relative error of one float32 and one float64 operation.
U32, U64 = 2.0**-24, 2.0**-53


def whole_vectors(vectors: DataFrame, dim: int = 64, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, v: floor(scale * x) of each component, an integer held by a double; only vectors of `dim` components, all finite."""
    x = F.col(vector_col)
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    good = vectors.filter(x.isNotNull() & (F.size(x) == dim) & F.coalesce(finite, F.lit(False)))
    # Spark's floor is a long; of a double beyond 2 ** 53, which is whole, nothing is cut off
    floor = lambda c: F.when(F.abs(c) < 2.0**53, F.floor(c).cast("double")).otherwise(c)
    return good.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(x, lambda c: floor(c.cast("double") * scale)).alias("v"))


def seeds(whole: DataFrame, k: int, salt: str) -> list[list[int]]:
    """The k vectors of the least SHA-256 of salt and id; of equal ids, the least vectors. Null ids come last."""
    first = whole.select(F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256).alias("order"), "v").orderBy(F.asc_nulls_last("order"), "v").limit(k)
    return [[int(c) for c in r["v"]] for r in first.collect()]  # k rows


def shortlist(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nearest, open): each row's nearest centroid by float32 products, and which centroids may be as near (one: it is decided).

    |c|^2 - 2 x.c orders the centroids. The float32 product of n terms is wrong by at most (n + 3) u' |x| |c|, which covers
    the rounding of both operands, u' = u / (1 - (n + 3) u); norms and the rest are rounded in float64, and allowed for.
    """
    n = x.shape[1]
    gamma = (n + 3) * U32 / (1 - (n + 3) * U32) * (1 + 1e-6)
    norms = (centroids.astype(np.float64) ** 2).sum(1)
    lengths = np.sqrt((x.astype(np.float64) ** 2).sum(1))
    products = (x.astype(np.float32) @ centroids.astype(np.float32).T).astype(np.float64)
    score = norms - 2 * products
    slack = 2 * gamma * lengths[:, None] * np.sqrt(norms) + 4 * (n + 2) * U64 * (norms + 2 * np.abs(products)) + 1e-6
    slack = slack * (1 + 1e-6)
    return score.argmin(1), score - slack <= (score + slack).min(1, keepdims=True)


def nearest(x: np.ndarray, centroids: list[list[int]]) -> np.ndarray:
    """The number of each row's nearest centroid, ties to the smaller one; x holds whole numbers."""
    of = np.array(centroids, dtype=object)
    if not len(x):
        return np.zeros(0, np.int32)
    if max(float(np.abs(x).max()), float(np.abs(of).max())) > LARGEST:
        return np.array([min(range(len(of)), key=lambda j: (sum((int(a) - b) ** 2 for a, b in zip(row, of[j])), j)) for row in x], np.int32)
    whole, c = x.astype(np.int64), of.astype(np.int64)
    best, open_ = shortlist(whole, c)
    unsure = np.flatnonzero(open_.sum(1) > 1)
    if len(unsure):
        least = np.full(len(unsure), np.iinfo(np.int64).max)
        for j in range(len(c)):  # in order, so an equal distance doesn't replace
            at = np.flatnonzero(open_[unsure, j])
            d = ((whole[unsure[at]] - c[j]) ** 2).sum(1)
            closer = d < least[at]
            least[at[closer]], best[unsure[at[closer]]] = d[closer], j
    return best.astype(np.int32)


def distances(x: np.ndarray, of: np.ndarray, centroids: list[list[int]]) -> list[int | None]:
    """The squared distance of each row from its centroid; None beyond a long."""
    if not len(x):
        return []
    c = np.array(centroids, dtype=object)
    if max(float(np.abs(x).max()), float(np.abs(c).max())) > LARGEST:
        found = (sum((int(a) - b) ** 2 for a, b in zip(row, c[j])) for row, j in zip(x, of))
        return [d if d < 2**63 else None for d in found]
    return ((x.astype(np.int64) - c.astype(np.int64)[of]) ** 2).sum(1).tolist()


def blocks(batch: pa.RecordBatch, dim: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """(ids, vectors) of parts of a batch of vec_id, v."""
    for at in range(0, batch.num_rows, ROWS):
        part = batch.slice(at, ROWS)
        yield part.column(0), part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def sums(whole: DataFrame, centroids: list[list[int]], dim: int) -> dict[int, tuple[int, list[int]]]:
    """(vectors, sum) of each cluster that has vectors. Each task adds up its own, as exact integers; those are added in two steps."""

    def partial(batches):
        counts, totals = [0] * len(centroids), [[0] * dim for _ in centroids]
        for batch in batches:
            for _, x in blocks(batch, dim):
                if not len(x):
                    continue
                of = nearest(x, centroids)
                exact = np.abs(x).max() <= LARGEST  # and ROWS of them fit a long
                for j in np.unique(of):
                    own = x[of == j]
                    added = own.astype(np.int64).sum(0).tolist() if exact else [sum(int(a) for a in col) for col in own.T]
                    counts[j] += len(own)
                    totals[j] = [a + b for a, b in zip(totals[j], added)]
        rows = [j for j, n in enumerate(counts) if n]
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), pa.array([counts[j] for j in rows], pa.int64()), pa.array([[str(v) for v in totals[j]] for j in rows], pa.list_(pa.string()))], ["cluster", "n", "total"])

    def add(pdf):
        totals = [sum(map(int, column)) for column in zip(*pdf["total"])]
        return pdf.head(1).assign(n=pdf["n"].sum(), total=[[str(v) for v in totals]])

    schema = "cluster int, n long, total array<string>"
    parts = whole.select("vec_id", "v").mapInArrow(partial, schema)
    few = parts.groupBy("cluster", F.pmod(F.xxhash64("total"), F.lit(PARTS))).applyInPandas(lambda key, pdf: add(pdf), schema)
    total = few.groupBy("cluster").applyInPandas(add, schema).collect()  # a row a cluster
    return {r["cluster"]: (r["n"], [int(v) for v in r["total"]]) for r in total}


def cluster(
    vectors: DataFrame, k: int = 8, rounds: int = 10, salt: str = "3:", dim: int = 64, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding"
) -> tuple[DataFrame, list[list[int]]]:
    """(vec_id, cluster, distance of every vector kept; final centroids).

    Vectors are floor(scale * x) of those with `dim` components, none of them null or non-finite; others are left out.
    Centroids start as the k vectors of the least SHA-256 of salt and id (all, if there are fewer: clusters then are fewer,
    too). A round assigns every vector to its nearest centroid by squared distance, ties to the smaller number, then
    replaces each non-empty cluster's centroid by the exact floor of its vectors' mean; empty ones stay. At last all
    vectors are assigned once more.

    Everything is exact: float32 products only shortlist centroids, and where error intervals overlap, integers decide.
    Repeated rows and ids are vectors of their own; null ids take part but start no centroid while others are left. A
    squared distance beyond a long is null. Other columns are never read. An empty table gives no rows.
    Each round reads the written vectors once; a row a task and cluster is shuffled, k rows come to the driver.
    """
    whole = written(whole_vectors(vectors, dim, scale, id_col, vector_col), "whole-vectors")
    centroids = seeds(whole, k, salt)
    for _ in range(rounds if centroids else 0):
        for j, (n, total) in sums(whole, centroids, dim).items():
            centroids[j] = [t // n for t in total]

    def assigned(batches):
        for batch in batches:
            for ids, x in blocks(batch, dim):
                of = nearest(x, centroids)
                yield pa.RecordBatch.from_arrays([ids, pa.array(of, pa.int32()), pa.array(distances(x, of, centroids), pa.int64())], ["vec_id", "cluster", "distance"])

    return written(whole.mapInArrow(assigned, "vec_id long, cluster int, distance long"), "clusters"), centroids


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector with its cluster, the inertia of its cluster and of all, and its centroid's digest."""
    found, centroids = cluster(read_table(spark, sf_dir, "embeddings"))
    inertia = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s"), F.count("distance").alias("c"), F.count("*").alias("n")).collect()  # a row a cluster
    within = {r["cluster"]: int(r["s"]) if r["c"] == r["n"] and r["s"] < 2**63 else None for r in inertia}
    total = sum(within.values()) if None not in within.values() else None
    rows = [(j, within.get(j), total if total is not None and total < 2**63 else None, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for j, c in enumerate(centroids)]
    table = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql(k: int = 8, rounds: int = 10) -> str:
    """The same in long integers, a step a round."""
    out = [f"""WITH v AS MATERIALIZED (
      SELECT row_number() OVER () AS r, vec_id, [floor(1024 * x::DOUBLE)::BIGINT FOR x IN embedding] AS q FROM embeddings
      WHERE len(embedding) = 64 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
    c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY o NULLS LAST, q) - 1 AS j, q AS c FROM (SELECT sha256('3:' || vec_id) AS o, q FROM v ORDER BY o NULLS LAST, q LIMIT {k}))"""]
    near = "SELECT r, arg_min(j, (d, j)) AS j, min(d) AS d FROM (SELECT r, j, list_sum([(q[i] - c[i]) * (q[i] - c[i]) FOR i IN range(1, 65)])::BIGINT AS d FROM v, c{0}) GROUP BY r"
    for k_ in range(rounds):
        out.append(f"a{k_} AS MATERIALIZED ({near.format(k_)})")
        out.append(f"m{k_} AS MATERIALIZED (SELECT j, list((s - ((s % n + n) % n)) // n ORDER BY i) AS c FROM (SELECT j, i, sum(q[i])::BIGINT AS s, count(*) AS n FROM v JOIN a{k_} USING (r), range(1, 65) t(i) GROUP BY j, i) GROUP BY j)")
        out.append(f"c{k_ + 1} AS MATERIALIZED (SELECT j, coalesce(m.c, b.c) AS c FROM c{k_} b LEFT JOIN m{k_} m USING (j))")
    out.append(f"a AS MATERIALIZED ({near.format(rounds)})")
    return ", ".join(out) + f""" SELECT vec_id, j::INT AS cluster, d AS distance, sum(d) OVER (PARTITION BY j)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia,
      sha256(array_to_string(c, ',')) AS centroid_sha256 FROM v JOIN a USING (r) JOIN c{rounds} USING (j)"""


SQL = _sql()
