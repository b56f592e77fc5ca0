"""N-gram Jaccard join: exact links between documents' shingle sets by prefixes and a token-group matrix."""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reliefspark.llm.common import free, held, read_table, small, small_batches, written

#: Times that a task must meet a shingle for it to be counted, and counted documents from which it comes last in order.
SEEN, FREQUENT = 2, 20
#: Frequent shingles that are sent to all tasks (16 MB); with more, only the most frequent are. Results don't depend on it.
MOST_FREQUENT = 2_000_000
#: Sets of a group of the token-group matrix, and shingles of a group or of a task's part of the matrix.
GROUP, TOKENS = 2048, 500_000
#: Queries that a group meets together, and parts into which a frequent shingle's sets are dealt.
ASKING, SALTS = 2048, 32
#: Pairs of a set and a group that a task makes at a time.
PAIRS = 1_000_000
#: Words whose hashes a worker keeps, and shingles that a task counts at a time.
WORDS, COUNTED = 200_000, 1_000_000
#: Odd factors and shifts of the shingle hash (splitmix64's finaliser).
FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)
MIX = ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1))

class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingles(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's k-word shingles; of the whole sequence, if it is shorter.

    Words are runs of anything but ASCII white space, A-Z lower-cased: what bytes.lower and bytes.split do. Two
    different shingles of a corpus have the same hash with a chance of 2**-64 a pair.
    """
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.empty(0, np.int64)
    if len(words) < k:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=1)], np.uint64).view(np.int64)
    known = held("word hashes", _Words)
    if len(known) > WORDS:
        known.clear()
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    n = len(words) - k + 1
    s = np.zeros(n, np.uint64)
    for i in range(k):
        s = s * np.uint64(FACTORS[0]) + h[i : i + n] * np.uint64(FACTORS[1 + i % 4])
    for shift, factor in MIX:
        s = (s ^ (s >> np.uint64(shift))) * np.uint64(factor)
    return np.unique(s.view(np.int64))


def set_id(tokens: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(tokens.tobytes())).astype(np.int64))


def sets_and_frequent(docs: DataFrame, k: int) -> DataFrame:
    """Rows (0, doc_id, set id, size, key) of all documents, kind 2 for null ids, and (1, shingle, count) of shingles met SEEN times by a task.

    A task counts the shingles of all its distinct sets, COUNTED at a time.
    """

    def scan(batches):
        pending, waiting, seen = [], 0, set()

        def flush():
            tokens, counts = np.unique(np.concatenate(pending), return_counts=True)
            often = counts >= SEEN
            return pd.DataFrame({"kind": np.int32(1), "a": tokens[often], "b": counts[often].astype(np.int64), "n": np.int64(0), "key": np.int64(0)})

        for pdf in batches:
            for at in range(0, len(pdf), 2000):
                part = pdf.iloc[at : at + 2000]
                ids, sizes = [], []
                for text in part["text"].tolist():
                    tokens = shingles(text, k)
                    ids.append(sid := set_id(tokens))
                    sizes.append(len(tokens))
                    if len(tokens) and sid not in seen:
                        if len(seen) < 1_000_000:
                            seen.add(sid)
                        pending.append(tokens)
                        waiting += len(tokens)
                yield pd.DataFrame({"kind": np.where(part["no_id"], 2, 0).astype(np.int32), "a": part["doc_id"].to_numpy(np.int64), "b": np.array(ids, np.int64), "n": np.array(sizes, np.int64), "key": part["key"].to_numpy(np.int64)})
                if waiting > COUNTED:
                    yield flush()
                    pending, waiting = [], 0
        if pending:
            yield flush()

    return docs.mapInPandas(scan, "kind int, a long, b long, n long, key long")


def frequent(found: DataFrame) -> np.ndarray:
    """The frequent shingles, sorted: those counted FREQUENT times, or with too many of them, those counted more often."""
    sums = written(found.filter("kind = 1").groupBy(F.col("a").alias("token")).agg(F.sum("b").alias("c")).filter(F.col("c") >= FREQUENT), "frequent")
    levels = sorted(sums.groupBy(F.floor(F.log2("c")).alias("level")).agg(F.count("*").alias("n"), F.min("c").alias("c")).collect(), reverse=True)  # at most 64 rows
    total, least = 0, None
    for x in levels:
        total += x["n"]
        if total > MOST_FREQUENT:
            break
        least = x["c"]
    if least is None:
        return np.empty(0, np.int64)
    return np.sort(sums.filter(F.col("c") >= least).select("token").toPandas()["token"].to_numpy(np.int64))


def prefixes(docs: DataFrame, k: int, num: int, den: int, last: np.ndarray) -> DataFrame:
    """token, sid, n, mark, head, hot: the first shingles of each set, so many that two linked sets share one; frequent (hot) ones come last in order.

    mark is the same for sets that are likely to be similar: a set's least shingle. Where its first shingles hold hot ones,
    so that most of its shingles are, it is the least hot one: a word changed in a near copy often makes the least
    shingle one that no other copy has, and near copies of one text would make the more groups the more they are. head
    tells the first of a set's rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(last)

    def scan(batches):
        last, seen = shared.value, set()
        for pdf in batches:
            for at in range(0, len(pdf), 500):
                out = []
                for text in pdf["text"].iloc[at : at + 500].tolist():
                    tokens = shingles(text, k)
                    n = len(tokens)
                    if not n or (sid := set_id(tokens)) in seen:
                        continue
                    if len(seen) < 1_000_000:
                        seen.add(sid)
                    mark, first, hot = tokens[0], n + (-num * n) // den + 1, np.zeros(n, bool)
                    if len(last):
                        hot = last[np.minimum(np.searchsorted(last, tokens), len(last) - 1)] == tokens
                        order = np.argsort(hot, kind="stable")[:first]
                        if hot[order[-1]]:
                            mark = tokens[np.argmax(hot)]
                        tokens, hot = tokens[order], hot[order]
                    out.append((tokens[:first], sid, n, mark, hot[:first]))
                if out:
                    sizes = [len(x[0]) for x in out]
                    yield pd.DataFrame({
                        "token": np.concatenate([x[0] for x in out]), "sid": np.repeat(np.array([x[1] for x in out], np.int64), sizes), "n": np.repeat(np.array([x[2] for x in out], np.int32), sizes),
                        "mark": np.repeat(np.array([x[3] for x in out], np.int64), sizes), "head": np.isin(np.arange(sum(sizes)), np.cumsum([0, *sizes[:-1]])), "hot": np.concatenate([x[4] for x in out]),
                    })

    return docs.select("text").mapInPandas(scan, "token long, sid long, n int, mark long, head boolean, hot boolean")


def components(edges: DataFrame) -> DataFrame:
    """node, label: the least node that edges (a, b) reach from each node, by minimum labels and pointer jumping."""
    e = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = written(e.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("label")), "labels")
    while True:
        up = labels.select(F.col("node").alias("up"), F.col("label").alias("up_label"))
        jumped = written(labels.join(up, F.col("label") == F.col("up")).select("node", F.col("label").alias("old"), F.least("label", "up_label").alias("label")), "jumped")
        near = e.join(jumped.select(F.col("node").alias("b"), F.col("label").alias("l")), "b").groupBy(F.col("a").alias("x")).agg(F.min("l").alias("l"))
        after = written(jumped.join(near, F.col("node") == F.col("x")).select("node", "old", F.least("label", "l").alias("label")), "labels")
        labels = after.select("node", "label")
        if not after.filter("label < old").limit(1).count():
            return labels


def band(num: int, den: int):
    """Sets of one band have sizes within a fifth of what a link allows."""
    return F.floor(F.log(F.col("n").cast("double")) / F.lit(0.2 * np.log(den / num) + 0.01)).cast("long")


def grouped(sets: DataFrame, large: DataFrame, num: int, den: int) -> DataFrame:
    """sets (sid, n, mark, ...) with g, their group: similar sets share their mark and their band of sizes.

    large: mark, band, parts of such groups that are over GROUP sets or TOKENS shingles; a hash of the set deals them.
    """
    x = sets.withColumn("band", band(num, den)).join(small(large), ["mark", "band"], "left")
    return x.withColumn("g", F.xxhash64("mark", "band", F.pmod(F.xxhash64("sid"), F.coalesce("parts", F.lit(1))))).drop("mark", "band", "parts")


def large_groups(heads: DataFrame, num: int, den: int) -> DataFrame:
    sizes = heads.withColumn("band", band(num, den)).groupBy("mark", "band").agg(F.count("*").alias("c"), F.sum("n").alias("t"))
    return sizes.withColumn("parts", F.ceil(F.greatest(F.col("c") / GROUP, F.col("t") / TOKENS))).filter("parts > 1").select("mark", "band", "parts")


def gap(n, m, num: int, den: int):
    """Prefix shingles that sets of n and m shingles have in common if they are linked are more than this.

    A link has num (n + m) / (num + den) common shingles; of these, at most num max(n, m) / den lie beyond the prefix that
    ends first.
    """
    return (n + m) * F.lit(num / (num + den)) - F.greatest(n, m) * F.lit(num / den) - 1e-6


def asks(p: DataFrame, num: int, den: int) -> DataFrame:
    """sid, g: the groups of the matrix in which a set may have links; of two groups, the one of lesser number asks.

    p: token, sid, n, hot, g of the prefixes. The matrix has a row for each group and each shingle in the prefixes of
    its sets: how many sets have it, and their least and greatest sizes. A set asks a group if they share so many
    shingles as a link with sizes like these needs. A shingle that isn't frequent has few sets, so its rows of the matrix
    are made where its sets come together (cold_pairs()). Frequent shingles have many sets in few groups: their groups
    meet first, and a group's sets then meet the rows of each group that it has shingles in common with (hot_pairs()).
    """
    cold = p.filter("not hot").select("token", "sid", "n", "g").repartition("token").sortWithinPartitions("token", "g", "sid").mapInPandas(cold_pairs(num, den), "sid long, n int, group long, least int, most int")
    cold = cold.groupBy("sid", "n", "group").agg(F.count("*").alias("c"), F.min("least").alias("least"), F.max("most").alias("most"))
    shared = written(p.filter("hot").select("token", "sid", "n", "g").dropDuplicates(["token", "sid"]), "shared")
    matrix = written(shared.groupBy("token", "g").agg(F.count("*").alias("sets"), F.min("n").alias("least"), F.max("n").alias("most")), "matrix")
    own = matrix.select("token", "g", F.col("sets").alias("own"), F.col("least").alias("low"), F.col("most").alias("high"), F.pmod(F.xxhash64("g"), F.lit(SALTS)).cast("int").alias("salt"))
    other = matrix.select("token", F.col("g").alias("group"), "sets", "least", "most", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    near = ((F.col("group") > F.col("g")) | ((F.col("group") == F.col("g")) & (F.col("sets") > 1))) & (F.col("most") * den >= F.col("low") * num) & (F.col("least") * num <= F.col("high") * den)
    cells = written(own.join(other, ["token", "salt"]).filter(near).select("g", "group", "token", "own", "least", "most"), "cells")
    dealt = written(cells.groupBy("g").agg(F.sum("own").alias("c")).withColumn("parts", F.ceil(F.col("c") / PAIRS)), "dealt-cells")
    buckets = max(8, -(-(dealt.agg(F.sum("c")).first()[0] or 0) // PAIRS))
    bucket = F.pmod(F.xxhash64("g", "part"), F.lit(buckets)).alias("bucket")
    asking = shared.join(small(dealt), "g").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).select(bucket, "g", "part", "token", "sid", "n")
    asked = cells.join(small(dealt), "g").withColumn("part", F.pmod(F.xxhash64("group"), "parts")).select(bucket, "g", "part", "group", "token", "least", "most")
    hot = asking.groupBy("bucket").cogroup(asked.groupBy("bucket")).applyInPandas(hot_pairs(num, den), "sid long, n int, group long, c long, least int, most int")
    pairs = cold.unionByName(hot).groupBy("sid", "n", "group").agg(F.sum("c").alias("c"), F.min("least").alias("least"), F.max("most").alias("most"))
    n = F.col("n")
    least, most = F.greatest(F.col("least"), n * F.lit(num / den)), F.least(F.col("most"), n * F.lit(den / num))
    out = written(pairs.filter(F.col("c") > F.least(gap(n, least, num, den), gap(n, most, num, den))).select("sid", F.col("group").alias("g")), "asks")
    for table in (shared, matrix, cells, dealt):
        free(table)
    return out


def cold_pairs(num: int, den: int):
    """Of rows (token, sid, n, g) sorted by token, group and set, the pairs (sid, n, group, least, most) of sets and groups that share a token."""

    def of(token, sid, n, g):
        """The pairs of whole tokens' rows."""
        first = np.r_[True, (token[1:] != token[:-1]) | (sid[1:] != sid[:-1]) | (g[1:] != g[:-1])]  # a set met by two tasks is there twice
        token, sid, n, g = token[first], sid[first], n[first], g[first]
        new = np.r_[True, token[1:] != token[:-1]]
        run = np.cumsum(new) - 1
        several = np.bincount(run)[run] > 1
        token, sid, n, g = token[several], sid[several], n[several], g[several]
        if not len(token):
            return
        cell = np.r_[True, (token[1:] != token[:-1]) | (g[1:] != g[:-1])]  # a row of the matrix
        starts = np.flatnonzero(cell)
        group, sets, least, most = g[starts], np.diff(np.r_[starts, len(g)]), np.minimum.reduceat(n, starts), np.maximum.reduceat(n, starts)
        new = np.r_[True, token[1:] != token[:-1]]
        run, run_of_cell = np.cumsum(new) - 1, np.cumsum(new)[starts] - 1
        width = np.bincount(run_of_cell)
        begin = np.r_[0, np.cumsum(width)[:-1]]
        ends = np.cumsum(width[run])
        at = 0
        while at < len(run):  # so many rows at a time as make PAIRS pairs
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
            w = width[run[at:stop]]
            row = np.repeat(np.arange(at, stop), w)
            c = begin[run[row]] + np.arange(len(row)) - np.repeat(np.cumsum(w) - w, w)
            near = ((group[c] > g[row]) | ((group[c] == g[row]) & (sets[c] > 1))) & (most[c].astype(np.int64) * den >= n[row].astype(np.int64) * num) & (least[c].astype(np.int64) * num <= n[row].astype(np.int64) * den)
            row, c = row[near], c[near]
            if len(row):
                yield pd.DataFrame({"sid": sid[row], "n": n[row], "group": group[c], "least": least[c], "most": most[c]})
            at = stop

    def scan(batches):
        held_ = None
        for pdf in batches:
            columns = [pdf[c].to_numpy(t) for c, t in (("token", np.int64), ("sid", np.int64), ("n", np.int32), ("g", np.int64))]
            if held_ is not None:
                columns = [np.concatenate(x) for x in zip(held_, columns)]
            if not len(columns[0]):
                continue
            last = int(np.searchsorted(columns[0], columns[0][-1]))  # the last token may go on
            held_ = [x[last:] for x in columns]
            if last:
                yield from of(*[x[:last] for x in columns])
        if held_ is not None and len(held_[0]):
            yield from of(*held_)

    return scan


def hot_pairs(num: int, den: int):
    """Of a bucket's rows (g, part, token, sid, n) and rows of the matrix (g, part, group, token, least, most) that its groups meet, the pairs (sid, n, group, c, least, most).

    A pair is counted whole, so one row of it leaves the task, however many shingles it has in common.
    """

    def count(sets: pd.DataFrame, cells: pd.DataFrame) -> pd.DataFrame:
        on = ["g", "part", "token"]
        sets = sets.sort_values(on)
        runs = sets.groupby(on).size().rename("width").reset_index()
        runs["begin"] = runs["width"].cumsum() - runs["width"]
        cells = cells.merge(runs, on=on).sort_values(["g", "part", "group"])
        sid, n = sets["sid"].to_numpy(np.int64), sets["n"].to_numpy(np.int64)
        g, part, group, least, most, width, begin = (cells[c].to_numpy(np.int64) for c in ("g", "part", "group", "least", "most", "width", "begin"))
        change = (g[1:] != g[:-1]) | (part[1:] != part[:-1]) | (group[1:] != group[:-1])
        bounds = np.r_[np.flatnonzero(change) + 1, len(g)]  # ends of the rows of one pair of groups
        ends, out, at = np.cumsum(width), [], 0
        while at < len(g):  # so many pairs of groups at a time as make PAIRS rows
            full = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right"))
            k = max(int(np.searchsorted(bounds, full, "right")) - 1, int(np.searchsorted(bounds, at, "right")))
            stop = int(bounds[k])
            w = width[at:stop]
            c = np.repeat(np.arange(at, stop), w)
            row = begin[c] + np.arange(len(c)) - np.repeat(np.cumsum(w) - w, w)
            near = (most[c] * den >= n[row] * num) & (least[c] * num <= n[row] * den)
            row, c = row[near], c[near]
            order = np.lexsort((group[c], sid[row]))
            row, c = row[order], c[order]
            if len(row):
                first = np.flatnonzero(np.r_[True, (sid[row][1:] != sid[row][:-1]) | (group[c][1:] != group[c][:-1])])
                out.append(pd.DataFrame({"sid": sid[row[first]], "n": n[row[first]], "group": group[c[first]], "c": np.diff(np.r_[first, len(row)]), "least": np.minimum.reduceat(least[c], first), "most": np.maximum.reduceat(most[c], first)}))
            at = stop
        return pd.concat(out) if out else pd.DataFrame(columns=["sid", "n", "group", "c", "least", "most"], dtype="int64")

    return count


def stored(members: DataFrame) -> DataFrame:
    """g, sids, weights, sizes, tokens, starts, sets: one row for each group of members (g, sid, rows, tokens).

    tokens is the group's token union; the sets that have its i-th token are sets[starts[i] : starts[i + 1]].
    """

    def build(pdf):
        out = []
        for g, part in pdf.drop_duplicates(["g", "sid"]).groupby("g", sort=False):  # equal rows of several tasks bring a set again
            parts = part["tokens"].tolist()
            union, column = np.unique(np.concatenate(parts), return_inverse=True)
            order = np.argsort(column, kind="stable")
            sets = np.repeat(np.arange(len(parts)), [len(x) for x in parts])[order]
            out.append((g, part["sid"].to_numpy(np.int64), part["rows"].to_numpy(np.int64), np.array([len(x) for x in parts], np.int32), union, np.r_[0, np.cumsum(np.bincount(column, minlength=len(union)))].astype(np.int32), sets.astype(np.int32)))
        return pd.DataFrame(out, columns=["g", "sids", "weights", "sizes", "tokens", "starts", "sets"])

    schema = "g long, sids array<long>, weights array<long>, sizes array<int>, tokens array<long>, starts array<int>, sets array<int>"
    return members.groupBy("bucket").applyInPandas(build, schema)


def open_groups(groups: DataFrame, queries: DataFrame, salts: DataFrame, num: int, den: int, parts: int) -> DataFrame:
    """a, b, n: rows of n = 0 join what is linked, others have a = b and n rows that a links with in one group.

    queries: g, sid, rows, tokens; salts: g and into how many parts its queries are dealt. A group is opened for a query only if its token union holds as many of the query's
    tokens as a link needs; the overlaps with its sets then come from the union's lists. ASKING queries meet a group at
    a time, and a task has many groups, or one of many queries' parts.
    """
    none = lambda t: F.lit(None).cast(t)
    g = groups.join(small(salts), "g").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1))).drop("salts")
    g = g.select("g", "salt", F.lit(False).alias("asks"), F.lit(0).cast("long").alias("sid"), F.lit(0).cast("long").alias("rows"), "tokens", "sids", "weights", "sizes", "starts", "sets")
    q = queries.join(small(salts), "g").withColumn("salt", F.pmod(F.xxhash64("sid"), "salts")).select("g", "salt", F.lit(True).alias("asks"), "sid", "rows", "tokens", *[none(f"array<{t}>").alias(c) for c, t in (("sids", "long"), ("weights", "long"), ("sizes", "int"), ("starts", "int"), ("sets", "int"))])
    bucket = F.pmod(F.xxhash64("g", "salt"), F.lit(parts))

    def opened(pdf):
        out = []
        for (_, _), tile in pdf.groupby(["g", "salt"], sort=False):
            head = tile[~tile["asks"]].iloc[0]
            union, starts, sets, sids, weights, sizes = (np.asarray(head[c]) for c in ("tokens", "starts", "sets", "sids", "weights", "sizes"))
            back, part, touched = np.zeros(len(sids), np.int64), np.arange(len(sids)), np.zeros(len(sids), bool)
            asking, own = tile[tile["asks"]].drop_duplicates("sid"), set(sids.tolist())
            for sid, weight, tokens in zip(asking["sid"].tolist(), asking["rows"].tolist(), asking["tokens"].tolist()):
                at = np.minimum(np.searchsorted(union, tokens), len(union) - 1)
                at = at[union[at] == tokens]
                if len(at) * den < num * len(tokens):
                    continue  # the group's union holds too few of the query's tokens
                hits = np.bincount(np.concatenate([sets[starts[c] : starts[c + 1]] for c in at]), minlength=len(sids))
                ok = (hits * den >= (sizes + len(tokens) - hits) * num) & (sids != sid)
                if not ok.any():
                    continue
                out.append((sid, sid, int(weights[ok].sum())))
                if sid not in own:  # in their own group, both sets of a link ask
                    back[ok] += weight
                touched |= ok
                roots = np.unique(part[ok])  # part: for each set a place that it is joined with
                out.append((sid, int(sids[roots[0]]), 0))
                if len(roots) > 1:
                    part[np.isin(part, roots)] = roots[0]
            out += [(s, s, n) for s, n in zip(sids[back > 0].tolist(), back[back > 0].tolist())]
            out += [(s, r, 0) for s, r in zip(sids[touched].tolist(), sids[part[touched]].tolist()) if s != r]
        return pd.DataFrame(out, columns=["a", "b", "n"]).astype("int64")

    return g.unionByName(q).withColumn("bucket", bucket).groupBy("bucket").applyInPandas(opened, "a long, b long, n long")


def join(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, n_links, key, kept of every row: components of the links den x intersection >= num x union.

    component_id is the smallest id reachable by links, a row's own included (null ids are never it, unless a
    component has no other); n_links is the number of other rows whose sets link with the row's, equal sets included. key
    is the xxhash64 of the text, and kept tells the rows of least (id, key) of each component, null ids first. Texts
    without words (null, empty, white space) have size 0, link with nothing and are their own component. Rows repeated with one id are judged
    each by their text. A text may be long: one at a time is cut into shingles, 8 bytes each. Other columns are never
    read. An empty table gives no rows. No link is lost, and each is verified on whole sets:

    1. Rows with equal sets form a class (by a 64-bit hash and the size); from here on, classes stand for them.
    2. Sets are dealt to groups of similar ones (grouped()).
    3. All shingles have one order, frequent ones last. Linked sets share shingles within their first
       n - ceil(num/den n) + 1: the token-group matrix over these tells which groups a set asks (asks()).
    4. Groups that are asked are stored with their token unions (stored()). A query opens a group if the union holds
       enough of its tokens, and then counts its overlap with each of the group's sets (open_groups()).
    """
    rows = small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("key"))
    found = written(sets_and_frequent(rows.withColumn("no_id", F.col("doc_id").isNull()).fillna(0, ["doc_id"]), k), "sets")
    classes = found.filter("kind <> 1").select(F.when(F.col("kind") == 0, F.col("a")).alias("doc_id"), F.col("b").alias("sid"), F.col("n").cast("int").alias("n"), "key")
    least_row, least_id = F.min(F.struct("doc_id", "key")), F.min("doc_id")
    heads = written(classes.filter("n > 0").groupBy("sid", "n").agg(least_row.alias("head"), least_id.alias("least"), F.count("*").alias("rows")), "heads")

    first = written(prefixes(rows, k, num, den, frequent(found)), "prefixes")
    marks = written(first.filter("head").groupBy("sid", "n").agg(F.max("mark").alias("mark")), "marks")
    large = written(large_groups(marks, num, den), "large-groups")
    pairs = asks(grouped(first.drop("head"), large, num, den), num, den)
    free(first)
    asked = written(pairs.select("g").distinct(), "asked")
    members = written(grouped(heads.select("sid", "n", "rows").join(marks, ["sid", "n"]), large, num, den).join(small(asked), "g", "left_semi"), "members")
    # what a set is to do: to be a member of its group, to ask groups, or both
    tasks = pairs.select("sid", "g", F.lit(True).alias("asks")).unionByName(members.select("sid", "g", F.lit(False).alias("asks")))
    tasks = tasks.groupBy("sid").agg(F.collect_list(F.when(F.col("asks"), F.col("g"))).alias("asked"), F.max(F.when(~F.col("asks"), F.col("g"))).alias("own"))
    tasks = written(tasks.join(heads, "sid").select(F.col("head.doc_id").alias("task_id"), F.col("head.key").alias("task_key"), "rows", "asked", "own"), "tasks")

    def again(batches):
        seen = set()
        for pdf in batches:
            out, waiting = [], 0
            for at in range(0, len(pdf), 50):
                for text, rows_, asked_, own, member in pdf[["text", "rows", "asked", "own", "member"]].iloc[at : at + 50].itertuples(index=False):
                    tokens = shingles(text, k)
                    if (sid := set_id(tokens)) in seen:
                        continue
                    if len(seen) < 1_000_000:
                        seen.add(sid)
                    out += [(g, True, sid, rows_, tokens) for g in asked_]
                    if member:
                        out.append((own, False, sid, rows_, tokens))
                    waiting += len(tokens) * (len(asked_) + member)
                    if waiting > TOKENS // 4:
                        yield pd.DataFrame(out, columns=["g", "asks", "sid", "rows", "tokens"])
                        out, waiting = [], 0
            if out:
                yield pd.DataFrame(out, columns=["g", "asks", "sid", "rows", "tokens"])

    free(members)
    told = rows.join(small(tasks, width=32 + 8 * F.size("asked")), F.col("doc_id").eqNullSafe(F.col("task_id")) & (F.col("key") == F.col("task_key")))
    told = told.select("text", "rows", "asked", F.coalesce("own", F.lit(0)).alias("own"), F.col("own").isNotNull().alias("member"))
    dealt = written(told.mapInPandas(again, "g long, asks boolean, sid long, rows long, tokens array<long>"), "dealt")
    queries, members = dealt.filter("asks").drop("asks"), dealt.filter("not asks").drop("asks")
    size = dealt.groupBy("g").agg(*[F.sum(F.when(w, x)).alias(c) for c, w, x in (("c", F.col("asks"), F.lit(1)), ("t", F.col("asks"), F.size("tokens")), ("m", ~F.col("asks"), F.size("tokens")))])
    salts = written(size.withColumn("salts", F.ceil(F.greatest(F.col("c") / ASKING, F.col("t") / TOKENS))), "salts")
    whole = salts.agg(F.sum("m").alias("m"), F.sum("t").alias("t")).first()
    parts = lambda t: max(8, -(-(t or 0) // TOKENS))
    groups = written(stored(members.withColumn("bucket", F.pmod(F.xxhash64("g"), F.lit(parts(whole["m"]))))), "groups")
    links = written(open_groups(groups, queries, salts.select("g", "salts"), num, den, parts(whole["t"])), "links")
    for t in (pairs, asked, tasks, dealt, groups):
        free(t)

    labels = components(links.filter("n = 0"))
    counted = links.filter("n > 0").groupBy(F.col("a").alias("sid")).agg(F.sum("n").alias("links"))
    linked = labels.select(F.col("node").alias("sid"), "label").join(heads, "sid")
    of_label = small(written(linked.groupBy("label").agg(F.min("head").alias("top"), F.min("least").alias("component_id")), "least"))
    linked = linked.drop("least").join(of_label, "label").join(counted, "sid", "left")
    several = heads.filter("rows > 1").join(labels.select(F.col("node").alias("sid")), "sid", "left_anti")
    named = linked.select("sid", "n", "rows", "top", "component_id", "links").unionByName(several.select("sid", "n", "rows", F.col("head").alias("top"), F.col("least").alias("component_id"), F.lit(0).cast("long").alias("links")))
    named = written(named.select("sid", "n", "top", "component_id", (F.coalesce("links", F.lit(0)) + F.col("rows") - 1).alias("n_links")), "named")
    result = classes.filter("n > 0").join(small(named), ["sid", "n"], "left")
    kept = F.col("top").isNull() | (F.col("doc_id").eqNullSafe(F.col("top.doc_id")) & (F.col("key") == F.col("top.key")))
    result = result.select("doc_id", "n", F.when(F.col("top").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), "key", kept.alias("kept"))
    empty = classes.filter("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links"), "key", F.lit(True).alias("kept"))
    return result.unionByName(empty).select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id", "n_links", "key", "kept")


def kept_rows(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that join() keeps: of each component the row of least id.

    Rows go by their id and text together: a row that shares its id with a dropped one stays. Rows equal in both stay or
    go together.
    """
    gone = join(docs, k, num, den, id_col, text_col).filter("not kept").select(F.col("doc_id").alias("gone_id"), F.col("key").alias("gone_key"))
    gone = written(gone.distinct(), "near-copies")
    on = docs[id_col].cast("long").eqNullSafe(gone["gone_id"]) & (F.xxhash64(docs[text_col]) == gone["gone_key"])
    return docs.join(small(gone), on, "left_anti")


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(read_table(spark, sf_dir, "documents"), k=4, num=85, den=100).select("doc_id", "n_shingles", "component_id", "n_links")
