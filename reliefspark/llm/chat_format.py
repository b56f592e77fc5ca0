"""Chat formatting of reply trees (DataFrame operations only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reliefspark.llm.common import read_table, written

#: A turn is OPEN role MIDDLE text CLOSE; texts under LOSS_ROLE bear the loss.
OPEN, MIDDLE, CLOSE, LOSS_ROLE = "<turn ", ">", "</turn>\n", "assistant"
#: The template's control strings all hold one of these, so escaped texts hold none.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"))


def escape(text: Column) -> Column:
    for plain, coded in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def unescape(text: Column) -> Column:
    for plain, coded in reversed(ESCAPES):
        text = F.replace(text, F.lit(coded), F.lit(plain))
    return text


def same(tree: str, node: str) -> Column:
    """Whether a row's (tree, node) is (t, key), the names that the other side of a join has; null is a tree of its own."""
    return F.col(tree).eqNullSafe(F.col("t")) & (F.col(node) == F.col("key"))


def best_paths(nodes: DataFrame, branches: int = 1) -> DataFrame:
    """tree, leaf, rank, node, distance: the nodes of the best root-to-leaf paths of each tree.

    nodes: tree, node, parent (null, or not in the tree: a root), score (null: 0). Null is a tree like others. A branch's
    score is the mean over its path; ties go to the smaller leaf. Each self-join doubles the stretch that a node's pointer
    spans, so paths of n turns take log2(n) joins; sums of scores ride along, so only the chosen branches are ever spelt
    out. Nodes on a cycle have no root and no path: no path is longer than its tree has nodes, so the doubling ends there.
    Keys of the joins are single nodes: a tree with a third of all rows is dealt to all tasks, until its branches are ranked.
    """
    n = nodes.select("tree", "node", "parent", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    ids = n.select(F.col("tree").alias("t"), F.col("node").alias("key"))
    hop = written(n.join(ids, same("tree", "parent"), "left").select("tree", "node", F.col("key").alias("up"), F.col("score").alias("total"), F.lit(1).cast("long").alias("turns")), "hop")
    largest = hop.groupBy("tree").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    parents = hop.filter("up is not null").select(F.col("tree").alias("t"), F.col("up").alias("key")).distinct()
    leaves = hop.select("tree", "node").join(parents, same("tree", "node"), "left_anti")
    hops = []
    while 2 ** len(hops) < largest and hop.filter("up is not null").limit(1).count():
        hops.append(hop.filter("up is not null").select(F.col("tree").alias("t"), F.col("node").alias("key"), "up"))
        further = hop.select(F.col("tree").alias("t"), F.col("node").alias("key"), F.col("up").alias("up2"), F.col("total").alias("total2"), F.col("turns").alias("turns2"))
        hop = hop.join(further, same("tree", "up"), "left")
        hop = written(hop.select("tree", "node", F.col("up2").alias("up"), (F.col("total") + F.coalesce("total2", F.lit(0.0))).alias("total"), (F.col("turns") + F.coalesce("turns2", F.lit(0))).alias("turns")), "hop")
    rooted = hop.filter("up is null").select(F.col("tree").alias("t"), F.col("node").alias("key"), "total", "turns")
    ranked = leaves.join(rooted, same("tree", "node")).withColumn("rank", F.row_number().over(W.partitionBy("tree").orderBy((F.col("total") / F.col("turns")).desc(), "node")))
    paths = ranked.filter(F.col("rank") <= branches).select("tree", F.col("node").alias("leaf"), "rank", "node", F.lit(0).cast("long").alias("distance"))
    for k, h in reversed(list(enumerate(hops))):  # widest first: few rows pass the early joins
        paths = paths.join(h, same("tree", "node"), "left")
        here, above = F.struct("node", "distance"), F.struct(F.col("up").alias("node"), (F.col("distance") + 2**k).alias("distance"))
        paths = paths.select("tree", "leaf", "rank", F.explode(F.when(F.col("up").isNull(), F.array(here)).otherwise(F.array(here, above))).alias("x")).select("tree", "leaf", "rank", "x.*")
    return paths


def format_trees(messages: DataFrame, branches: int = 1) -> DataFrame:
    """tree, leaf, rank, formatted, loss: one conversation for each of the best branches of each reply tree.

    messages: tree, node, parent, role, text, score. loss is an array of (start, end), code points in formatted, of the
    texts under the loss mask. Null roles and texts count as empty; a null tree is a tree like others. Nodes repeated in a
    tree aren't allowed: number them first. An empty table gives no rows; columns of other names are never read. A
    formatted conversation is one value, so one task puts it together: its texts may have 2 GB at most.
    """
    turn = messages.select(F.col("tree").alias("t"), F.col("node").alias("key"), F.coalesce("role", F.lit("")).alias("role"), escape(F.coalesce("text", F.lit(""))).alias("body"))
    p = best_paths(messages, branches).join(turn, same("tree", "node"))
    head = F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(MIDDLE))
    p = p.select("tree", "leaf", "rank", "distance", "role", F.length(head).alias("lead"), F.length("body").alias("size"), F.concat(head, F.col("body"), F.lit(CLOSE)).alias("segment"))
    before = W.partitionBy("tree", "leaf").orderBy(F.col("distance").desc()).rowsBetween(W.unboundedPreceding, -1)
    p = p.withColumn("at", F.coalesce(F.sum(F.length("segment")).over(before), F.lit(0)) + F.col("lead"))
    p = p.groupBy("tree", "leaf", "rank").agg(F.sort_array(F.collect_list(F.struct(F.col("at").alias("start"), (F.col("at") + F.col("size")).alias("end"), (F.col("role") == LOSS_ROLE).alias("loss"), "segment"))).alias("turns"))
    return p.select(
        "tree", "leaf", "rank", F.concat_ws("", F.transform("turns", lambda t: t["segment"])).alias("formatted"),
        F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: F.struct(t["start"], t["end"])).alias("loss"),
    )


def read_back(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation."""
    segments = F.slice(F.split(formatted, CLOSE, -1), 1, F.size(F.split(formatted, CLOSE, -1)) - 1)
    role_end = lambda s: F.instr(s, MIDDLE)
    return F.transform(
        segments,
        lambda s: F.struct(unescape(F.substring(s, F.lit(len(OPEN) + 1), role_end(s) - len(OPEN) - 1)).alias("role"), unescape(F.substring(s, role_end(s) + 1, F.length(s))).alias("text")),
    )


def conversations_as_trees(conversations: DataFrame) -> DataFrame:
    """Rows by turn as reply trees without branches; turns that several rows share follow by role and text. Rows of a null id are one tree."""
    order = W.partitionBy("tree").orderBy("turn", "role", "text")
    rows = conversations.select(F.col("conv_id").cast("long").alias("tree"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("node", F.row_number().over(order).cast("long"))
    return rows.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def digests(formatted: DataFrame) -> DataFrame:
    """What the contract asks of formatted conversations, read back from them."""
    # written first: the digests come from the stored text
    f = written(formatted, "formatted").withColumn("turns", read_back(F.col("formatted")))
    spoken = F.concat_ws("", F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))))
    return f.select(
        F.col("tree").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))), 256).alias("turns_sha256"),
        F.length(spoken).cast("long").alias("loss_chars"), F.sha2(spoken, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return digests(format_trees(written(conversations_as_trees(rows), "trees")))


SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok'))
), e AS (
  SELECT *, '<turn ' || replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '>'
         || replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</turn>' || chr(10) AS segment,
         CASE WHEN role = 'assistant' THEN text ELSE '' END AS spoken
  FROM c
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       sum(length(spoken))::BIGINT AS loss_chars, sha256(string_agg(spoken, '' ORDER BY turn, role, text)) AS loss_sha256,
       sum(length(segment))::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
