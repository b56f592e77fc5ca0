"""Token counts: an exact histogram of encoded lengths, and what its suffix sums answer."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reliefspark.llm.common import read_table, small_batches, written
from reliefspark.llm.tokens import VOCABULARY, encoder

#: Lengths that one block of the histogram spans.
BLOCK = 1024


def lengths(docs: DataFrame, path: str = VOCABULARY, text_col: str = "text") -> DataFrame:
    """length, n: partial histograms of the encoded lengths of all rows' whole texts (null: 0), one for each task."""

    def count(batches):
        encode = encoder(path)
        found: dict[int, int] = {}
        for pdf in batches:
            texts = [t or "" for t in pdf["text"].tolist()]
            for k in range(0, len(texts), 64):
                for data in encode.encode(texts[k : k + 64]):
                    found[len(data) // 4] = found.get(len(data) // 4, 0) + 1
        yield pd.DataFrame({"length": list(found.keys()), "n": list(found.values())}).astype("int64")

    return small_batches(docs).select(F.col(text_col).alias("text")).mapInPandas(count, "length long, n long")


def histogram(docs: DataFrame, path: str = VOCABULARY, text_col: str = "text") -> DataFrame:
    """One row for each encoded length that occurs: what holds for a context limit of that length.

    context_limit, docs_at (documents of that length), docs_over (longer ones), docs_within, tokens_within (tokens of
    documents that fit), tokens_truncated (tokens left when each document is cut at the limit), tokens_total, share_within
    (share of documents that fit: the limit is the quantile of lengths at that share). For a limit between two of the
    rows, take the next lower row's counts and add docs_over x (limit - context_limit) to its tokens_truncated.

    Null and empty texts have length 0. Rows repeated with one id count each. Other columns are never read. An empty
    table gives no rows. Suffix sums run within blocks of BLOCK lengths, and over the blocks' own sums; the
    histogram has at most as many rows as the longest text has tokens, whatever the number of documents.
    """
    h = written(lengths(docs, path, text_col).groupBy("length").agg(F.sum("n").alias("n")).withColumn("block", F.floor(F.col("length") / BLOCK)), "lengths")
    blocks = h.groupBy("block").agg(F.sum("n").alias("bn"), F.sum(F.col("n") * F.col("length")).alias("bt"))
    after = W.orderBy(F.col("block").desc()).rowsBetween(W.unboundedPreceding, -1)
    every = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    blocks = blocks.select("block", *[F.coalesce(F.sum(c).over(after), F.lit(0)).alias(f"{c}_after") for c in ("bn", "bt")], F.sum("bn").over(every).alias("docs"), F.sum("bt").over(every).alias("tokens_total"))
    inner = W.partitionBy("block").orderBy(F.col("length").desc()).rowsBetween(W.unboundedPreceding, -1)
    t = h.join(blocks, "block")
    over = F.coalesce(F.sum("n").over(inner), F.lit(0)) + F.col("bn_after")
    tokens_over = F.coalesce(F.sum(F.col("n") * F.col("length")).over(inner), F.lit(0)) + F.col("bt_after")
    t = t.select("length", "n", "docs", "tokens_total", over.alias("docs_over"), tokens_over.alias("tokens_over"))
    return t.select(
        F.col("length").alias("context_limit"), F.col("n").alias("docs_at"), "docs_over", (F.col("docs") - F.col("docs_over")).alias("docs_within"), (F.col("tokens_total") - F.col("tokens_over")).alias("tokens_within"),
        (F.col("tokens_total") - F.col("tokens_over") + F.col("docs_over") * F.col("length")).alias("tokens_truncated"), "tokens_total", ((F.col("docs") - F.col("docs_over")) / F.col("docs")).alias("share_within"),
    )


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram(read_table(spark, sf_dir, "documents"))
