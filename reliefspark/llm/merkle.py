"""Merkle manifest of a dataset: levels of hashes built bottom-up, proofs pushed top-down (DataFrame operations only)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reliefspark.llm.common import LOWER, UPPER, read_table, small, written

#: Children of a node, bytes of a digest, and the columns that a leaf hashes, in order.
FAN, BYTES, FIELDS = 8, 32, ("doc_id", "source", "lang", "n_chars", "text")


def encoded(c: Column) -> Column:
    """`-` for null, else the number of UTF-8 bytes, `:` and the value: no two rows encode alike."""
    text = c.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_of(*values: Column) -> Column:
    """The digest of a row's values, as 32 bytes."""
    return F.unhex(F.sha2(F.concat(*[encoded(v) for v in values]), 256))


def hexed(digests: Column) -> Column:
    return F.lower(F.hex(digests))


def node_of(digests: Column) -> Column:
    """The digest of digests, which go in as lowercase hex text one after the other."""
    return F.unhex(F.sha2(hexed(digests), 256))


def placed(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """rows (a written table) with idx, the place from 0 in its group by `order`, and n, the rows of its group.

    Rows are ranged over tasks by group, order and their place in the table, so neither a large group nor a row that is
    repeated fills a task; a second look adds up the rows of a group in the tasks before.
    """
    ranged = rows.withColumn("__tie", F.monotonically_increasing_id()).repartitionByRange(group, *order, "__tie").sortWithinPartitions(group, *order, "__tie")
    ranged = written(ranged.withColumn("__at", F.monotonically_increasing_id()).withColumn("__part", F.shiftright("__at", 33)).drop("__tie"), "merkle-ranged")
    pieces = ranged.groupBy(F.col(group).alias("__group"), F.col("__part").alias("__in")).agg(F.min("__at").alias("first"), F.count("*").alias("rows"))
    every, before = W.partitionBy("__group"), W.partitionBy("__group").orderBy("__in").rowsBetween(W.unboundedPreceding, -1)  # a row for each task with rows of the group
    starts = written(pieces.select("__group", "__in", (F.coalesce(F.sum("rows").over(before), F.lit(0)) - F.col("first")).alias("__start"), F.sum("rows").over(every).alias("n")), "merkle-starts")
    at = (F.col(group) == F.col("__group")) & (F.col("__part") == F.col("__in"))
    return ranged.join(small(starts), at).withColumn("idx", F.col("__at") + F.col("__start")).drop("__at", "__part", "__group", "__in", "__start")


def levels_of(nodes: DataFrame, most: int, carried: list[str]) -> tuple[list[DataFrame], DataFrame]:
    """(levels, tops) of trees from nodes (key, idx, n, h, carried), n being the nodes of a tree and `most` the largest n.

    A row of level k is a node of level k + 1 with its children: key, idx, n, h, kids (h and, at level 0, what is carried),
    in order. tops: key, h, height of each tree's last node; the only node of a tree is its top.
    """
    levels, tops, height = [], [nodes.filter("n = 1").select("key", "h", F.lit(0).alias("height"))], 0
    while most > 1:
        kid = F.struct((F.col("idx") % FAN).cast("int").alias("pos"), "h", *(carried if not levels else []))
        run = nodes.filter("n > 1").groupBy("key", F.floor(F.col("idx") / FAN).alias("parent")).agg(F.sort_array(F.collect_list(kid)).alias("kids"), F.max("n").alias("n"))  # FAN rows
        whole = F.aggregate("kids", F.lit(b""), lambda a, k: F.concat(a, k["h"]))
        levels.append(written(run.select("key", F.col("parent").alias("idx"), F.ceil(F.col("n") / FAN).alias("n"), node_of(whole).alias("h"), "kids"), f"merkle-level-{len(levels)}"))
        nodes, most, height = levels[-1], -(-most // FAN), height + 1
        tops.append(nodes.filter("n = 1").select("key", "h", F.lit(height).alias("height")))
    return levels, reduce(DataFrame.unionByName, tops)


def pushed(levels: list[DataFrame], tops: DataFrame, more: list[str]) -> DataFrame:
    """key, idx, kid, proof, steps and the columns `more` for each node of level 0, from tops (key, height, proof, steps, more).

    Top-down, each level's rows meet the proofs that their parents got; a child's is its siblings' digests before its
    parent's proof. steps has a number for each level: the child's position times FAN, plus how many siblings it has.
    """
    given = None
    for k in reversed(range(len(levels))):
        roots = tops.filter(F.col("height") == k + 1).select("key", F.lit(0).cast("long").alias("idx"), "proof", "steps", *more)
        given = roots if given is None else given.select("key", "idx", "proof", "steps", *more).unionByName(roots)
        kids = levels[k].select("key", "idx", "kids").join(given, ["key", "idx"])
        kids = kids.select("key", (F.col("idx") * FAN).alias("first"), "kids", F.col("proof").alias("up"), F.col("steps").alias("way"), *more, F.explode("kids").alias("kid"))
        beside = F.aggregate(F.filter("kids", lambda s: s["pos"] != F.col("kid.pos")), F.lit(b""), lambda a, s: F.concat(a, s["h"]))
        given = kids.select("key", (F.col("first") + F.col("kid.pos")).alias("idx"), "kid", F.concat(beside, F.col("up")).alias("proof"), F.concat(F.array(F.col("kid.pos") * FAN + F.size("kids") - 1), F.col("way")).alias("steps"), *more)
        if k:
            given = written(given.drop("kid"), f"merkle-proofs-{k}")
    return given


def folded(leaf: Column, proof: Column, steps: Column) -> Column:
    """The root that a leaf's digest and its proof lead to."""

    def up(a: Column, s: Column) -> Column:
        left, all_ = F.floor(s / FAN).cast("int") * BYTES, (s % FAN).cast("int") * BYTES
        h = node_of(F.concat(F.substring(proof, a["at"], left), a["h"], F.substring(proof, a["at"] + left, all_ - left)))
        return F.struct(h.alias("h"), (a["at"] + all_).alias("at"))

    return F.aggregate(steps, F.struct(leaf.alias("h"), F.lit(1).alias("at")), up, lambda a: a["h"])


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id", group_col: str = "lang", beside: dict[str, Column] | None = None) -> DataFrame:
    """id, leaf, subroot, root, proof, steps of every row, digests as bytes, and the columns of `beside`, by name.

    A leaf is the digest of the row's fields. The leaves of a group, by id, are the first level of its tree: while several
    nodes remain, every FAN consecutive ones become their digest. The groups' last nodes, by group, are the first level of
    the tree that ends in the root. `proof` holds the siblings' digests from the leaf's level to the root's; folded() leads
    from leaf, proof and steps to the root.

    Null ids and the null group come first; a null field is a value of its own, unlike the empty string. Rows of one id
    are in order of their leaves; equal rows are leaves of their own, side by side. Columns that aren't fields are never read. An empty table has no rows. The tree of
    a single row is its leaf. Texts are hashed whole.

    Every level is a written table, FAN times smaller than the one below, grouped by parent; no group is a task's, and a
    proof grows with the logarithm of the rows.
    """
    beside = beside or {}
    key = F.when(F.col(group_col).isNull(), F.lit("")).otherwise(F.concat(F.lit("+"), F.col(group_col).cast("string")))
    kept = [F.col(id_col).alias("id"), key.alias("key"), leaf_of(*[F.col(f) for f in fields]).alias("h"), *[c.alias(f"beside {n}") for n, c in beside.items()]]
    carried = ["id", *[f"beside {n}" for n in beside]]
    nodes = written(placed(written(docs.select(*kept), "merkle-leaves"), "key", ["id", "h"]), "merkle-placed")
    levels, tops = levels_of(nodes, nodes.agg(F.max("n")).first()[0] or 0, carried)
    groups = placed(written(tops.select(F.lit("").alias("all"), "key", "h", "height"), "merkle-tops"), "all", ["key"])
    groups = written(groups.select(F.col("all").alias("key"), F.col("key").alias("group"), "idx", "n", "h", "height"), "merkle-groups")
    upper, root = levels_of(groups, groups.count(), ["group", "height"])
    root = written(root, "merkle-root")
    all_ = root.first()
    start = root.select("key", "height", F.lit(b"").alias("proof"), F.array().cast("array<int>").alias("steps"))
    if upper:
        top = pushed(upper, start, []).select(F.col("kid.group").alias("key"), F.col("kid.height").alias("height"), F.col("kid.h").alias("subroot"), "proof", "steps")
    else:  # one group at most
        top = groups.select(F.col("group").alias("key"), "height", F.col("h").alias("subroot"), F.lit(b"").alias("proof"), F.array().cast("array<int>").alias("steps"))
    top = written(top, "merkle-top-proofs")
    alone = nodes.filter("n = 1").join(top.filter("height = 0").drop("height"), "key")
    out = alone.select(*carried, "h", "subroot", "proof", "steps")
    if levels:
        out = pushed(levels, top, ["subroot"]).select(*[F.col("kid")[c].alias(c) for c in [*carried, "h"]], "subroot", "proof", "steps").unionByName(out)
    return out.select("id", F.col("h").alias("leaf"), "subroot", F.lit(bytes(all_["h"]) if all_ else None).cast("binary").alias("root"), "proof", "steps", *[F.col(f"beside {n}").alias(n) for n in beside])


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of documents, checked against rows of which a third have had their text's A-Z lower-cased."""
    docs = read_table(spark, sf_dir, "documents")
    changed = [F.translate("text", UPPER, LOWER) if f == "text" else F.col(f) for f in FIELDS]
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, leaf_of(*changed))
    m = manifest(docs, beside={"tampered": tampered})
    m = m.withColumn("to", folded(F.coalesce("tampered", "leaf"), F.col("proof"), F.col("steps")))
    return m.select(
        F.col("id").alias("doc_id"), hexed(F.col("leaf")).alias("leaf"), hexed(F.col("subroot")).alias("subroot"), hexed(F.col("root")).alias("root"),
        F.sha2(hexed(F.col("proof")), 256).alias("proof_sha256"), hexed(F.col("to")).alias("folded_root"), (F.col("to") == F.col("root")).alias("verified"),
    )


def _sql(levels: int = 9, upper: int = 3) -> str:
    """The same by window functions, with as many levels as FAN ** levels rows of a group and FAN ** upper groups need."""
    part = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c} END"
    leaf = lambda text: "sha256(" + " || ".join(part(text if f == "text" else f) for f in FIELDS) + ")"
    low = f"translate(text, '{UPPER}', '{LOWER}')"
    crc = "xor(list_reduce(list_prepend(4294967295::BIGINT, [ascii(c)::BIGINT FOR c IN string_split(doc_id::VARCHAR, '')]), lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)), 4294967295)"
    out = [f"WITH d AS MATERIALIZED (SELECT doc_id, coalesce('+' || lang, '') AS k, {leaf('text')} AS leaf, CASE WHEN doc_id IS NOT NULL AND ({crc}) % 3 = 0 THEN {leaf(low)} END AS tampered FROM documents)"]
    out.append("t0 AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, leaf AS h, coalesce(tampered, leaf) AS f, '' AS proof FROM d)")

    def climb(k: int, tree: str, rows: str) -> str:
        """Each row's node, fold and proof one level up: runs of nodes of a tree, rows repeated below a node counted once."""
        return (
            f"n{k} AS MATERIALIZED (SELECT DISTINCT {tree} AS tree, i, h FROM {rows}), r{k} AS MATERIALIZED (SELECT tree, i // {FAN} AS j, string_agg(h, '' ORDER BY i) AS run, min(i) AS low, sum(count(*)) OVER (PARTITION BY tree) AS n FROM n{k} GROUP BY tree, i // {FAN}), "
            f"u{k} AS MATERIALIZED (SELECT t.* REPLACE (t.i // {FAN} AS i, CASE WHEN r.n > 1 THEN sha256(r.run) ELSE t.h END AS h, CASE WHEN r.n > 1 THEN sha256(run[:64 * (t.i - low)] || f || run[64 * (t.i - low) + 65:]) ELSE f END AS f, "
            f"CASE WHEN r.n > 1 THEN proof || run[:64 * (t.i - low)] || run[64 * (t.i - low) + 65:] ELSE proof END AS proof) FROM {rows} t JOIN r{k} r ON r.tree = t.{tree} AND r.j = t.i // {FAN})"
        )

    rows = "t0"
    for k in range(levels):
        out.append(climb(k, "k", rows))
        rows = f"u{k}"
    out.append(f"s AS MATERIALIZED (SELECT * REPLACE (dense_rank() OVER (ORDER BY k) - 1 AS i), h AS subroot, 'all' AS every FROM {rows})")
    rows = "s"
    for k in range(levels, levels + upper):
        out.append(climb(k, "every", rows))
        rows = f"u{k}"
    return ", ".join(out) + f" SELECT doc_id, leaf, subroot, h AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = h AS verified FROM {rows}"


SQL = _sql()
