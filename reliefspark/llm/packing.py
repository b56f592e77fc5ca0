"""Packing documents into sequences: bin completion over the histogram of lengths."""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reliefspark.llm.common import read_table, small, small_batches, written
from reliefspark.llm.tokens import VOCABULARY, encoder

#: Tokens of a sequence, and the id that ends a document.
SEQUENCE, END = 4096, 1
#: Steps of the search before its best incumbent stands, and states of it that are remembered (which only saves time).
STEPS, SEEN = 300_000, 200_000
#: Rows of one length that are put in order together.
RANKED = 500_000


def pieces(docs: DataFrame, size: int = SEQUENCE, path: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of the pieces of at most `size` tokens of every row's whole text."""

    def cut(batches):
        encode = encoder(path)
        end = END.to_bytes(4, "little")
        for pdf in batches:
            out = []
            ids, texts = pdf["doc_id"].tolist(), [t or "" for t in pdf["text"].tolist()]
            for k in range(0, len(texts), 64):
                for doc_id, data in zip(ids[k : k + 64], encode.encode(texts[k : k + 64])):
                    data += end
                    for piece, at in enumerate(range(0, len(data), 4 * size)):
                        part = data[at : at + 4 * size]
                        out.append((doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part)))
            yield pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32"])

    return small_batches(docs).select(F.col(id_col).cast("long").cast("string").alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(cut, "doc_id string, piece int, start long, length long, ids_crc32 long").withColumn("doc_id", F.col("doc_id").cast("long"))


def best_fit(left: dict[int, int], size: int) -> list[tuple[list[int], int]]:
    """Bins as (lengths, how many such bins): the largest length left, then the largest that fits, again and again."""
    count, order, plan = dict(left), sorted(k for k, v in left.items() if v), []
    while order:
        full, room = [], size
        k = len(order) - 1
        while k >= 0:
            fits = min(room // order[k], count[order[k]])
            full += [order[k]] * fits
            room -= order[k] * fits
            k = min(k - 1, bisect_right(order, room) - 1)
        uses = Counter(full)
        n = min(count[x] // u for x, u in uses.items())
        for x, u in uses.items():
            count[x] -= n * u
            if not count[x]:
                order.pop(bisect_right(order, x) - 1)
        plan.append((full, n))
    return plan


def bound(counts: dict[int, int], size: int) -> int:
    """No packing has fewer bins: by volume, and for each k by what must lie apart from lengths over size - k."""
    x = np.array(sorted(k for k, v in counts.items() if v), np.int64)
    if not len(x):
        return 0
    n = np.array([counts[int(k)] for k in x], np.int64)
    items, volume = np.r_[0, np.cumsum(n)], np.r_[0, np.cumsum(n * x)]
    least = -(-int(volume[-1]) // size)
    half = int(np.searchsorted(x, size // 2, side="right"))  # from here on, no two lie in one bin
    for at in range(half + 1):
        k = int(x[at]) if at < half else size // 2 + 1
        apart = int(np.searchsorted(x, size - k, side="right"))
        alone, shared = int(items[-1] - items[apart]), int(items[apart] - items[half]) if apart > half else 0
        free = shared * size - int(volume[apart] - volume[half]) if apart > half else 0
        least = max(least, alone + shared + max(0, -(-(int(volume[half] - volume[at]) - free) // size)))
    return least


def fillings(left: dict[int, int], room: int, waste: int, spend):
    """The undominated fillings of a bin's room beside its largest document, those of least waste first, none over `waste`.

    left: lengths and counts, without that document. A filling is dominated, and left out, if a length still there could
    be added, or could take the place of one or two smaller ones within the room: what another solution has there could
    be swapped. spend() is called once a step and ends the search when it returns False.
    """
    order = sorted((k for k, v in left.items() if v and k <= room), reverse=True)
    spend(2 * len(order))
    # what lengths from each place on add up to at most, and every sum that they reach
    most, reach = [0] * (len(order) + 1), [1] * (len(order) + 1)
    full = (1 << (room + 1)) - 1
    for i in range(len(order) - 1, -1, -1):
        x, n = order[i], min(left[order[i]], room // order[i])
        most[i], bits, part = most[i + 1] + x * n, reach[i + 1], 1
        while n > 0:  # n copies by powers of two
            take = min(part, n)
            bits |= bits << (x * take) & full
            n, part = n - take, part * 2
        reach[i] = bits

    def dominated(filling: list[int], rest: int) -> bool:
        used = Counter(filling)
        spare = sorted(x for x in order if left[x] > used[x])
        if spare and spare[0] <= rest:
            return True
        kinds = sorted(used)
        sums = [(x, False) for x in kinds] + [(x + y, True) for i, x in enumerate(kinds) for y in kinds[i:] if x != y or used[x] > 1]
        for total, two in sums:
            k = bisect_right(spare, total + rest) - 1
            if k >= 0 and (spare[k] > total or (two and spare[k] == total)):
                return True
        return False

    for over in range(min(waste, room) + 1):
        if not reach[0] >> (room - over) & 1:
            continue
        stack = [(0, room - over, ())]
        while stack:
            i, want, chosen = stack.pop()
            if not spend(1):
                return
            if not want:
                filling = [x for x, n in chosen for _ in range(n)]
                if not dominated(filling, over):
                    yield filling
                continue
            while i < len(order) and order[i] > want:
                i += 1
            if i == len(order) or most[i] < want or not reach[i] >> want & 1:
                continue
            for n in range(0, min(left[order[i]], want // order[i]) + 1):  # the most copies come off the stack first
                stack.append((i + 1, want - n * order[i], (*chosen, (order[i], n)) if n else chosen))


def complete(counts: dict[int, int], size: int = SEQUENCE, steps: int | None = STEPS) -> list[tuple[list[int], int]]:
    """Bins as (lengths, how many such bins), as few bins as the search finds.

    Bin completion: bins are filled around the largest document left, in turn by each undominated filling, by as many
    bins of it at once as the counts allow, then by fewer, so a plan has a few entries a length and doesn't grow with the
    documents. Best fit gives the first incumbent, and at each node what best fit makes of the rest gives another. A
    branch ends when its waste exceeds what beating the incumbent leaves; the search ends when an incumbent meets the lower
    bound, when all branches have ended (the incumbent is then optimal), or after `steps` steps. None sets no limit: the
    result is optimal, whatever that takes.
    """
    counts = {k: v for k, v in counts.items() if v}
    total, least = sum(k * v for k, v in counts.items()), bound(counts, size)
    best = best_fit(counts, size)
    bins = sum(n for _, n in best)
    taken = 0

    def spend(work: int) -> bool:
        nonlocal taken
        taken += work
        return steps is None or taken <= steps

    def options(left: dict[int, int], waste: int):
        """(filling with the largest, bins of it) for a node, the most bins first."""
        top = max(left)
        beside = {**left, top: left[top] - 1}
        for filling in fillings(beside, size - top, waste, spend):
            full = [top, *filling]
            uses, lost = Counter(full), size - sum(full)
            n = min(left[x] // u for x, u in uses.items())
            for k in range(min(n, waste // lost) if lost else n, 0, -1):
                yield full, k

    seen: dict[tuple, int] = {}
    # a node: its options still to try, what is left, its waste, its bins, its plan
    stack = [(options(counts, (bins - 1) * size - total), counts, 0, 0, None)] if bins > least and counts else []
    while stack and bins > least and (steps is None or taken <= steps):
        todo, left, lost, used, plan = stack[-1]
        got = next(todo, None)
        if got is None:
            stack.pop()
            continue
        spend(2 * len(left))
        full, n = got
        lost, used, plan = lost + n * (size - sum(full)), used + n, (plan, got)
        allowed = (bins - 1) * size - total - lost
        if allowed < 0:
            continue
        uses = Counter(full)
        left = {k: rest for k, v in left.items() if (rest := v - n * uses[k])}
        state = tuple(sorted(left.items()))
        if seen.get(state, used + 1) <= used:
            continue
        if len(seen) < SEEN:
            seen[state] = used
        tail = best_fit(left, size)
        if (found := used + sum(k for _, k in tail)) < bins:
            head = []
            while plan:
                plan, entry = plan
                head.append(entry)
            best, bins = head[::-1] + tail, found
            allowed -= size
            plan = None
            for entry in head[::-1]:
                plan = (plan, entry)
        if left and allowed >= 0:
            stack.append((options(left, allowed), left, lost, used, plan))
    return best


def places(plan: list[tuple[list[int], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length: first rank, uses a bin, first sequence and offset of each run of the plan."""
    runs: dict[int, list[tuple[int, int, int, int]]] = {}
    ranks: dict[int, int] = {}
    sequence = 0
    for full, n in plan:
        at, uses = 0, {}
        for x in full:
            if x in uses:
                uses[x][1] += 1
            else:
                uses[x] = [at, 1]
            at += x
        offset = 0
        for x, (_, u) in uses.items():
            runs.setdefault(x, []).append((ranks.get(x, 0), u, sequence, offset))
            ranks[x] = ranks.get(x, 0) + n * u
            offset += x * u
        sequence += n
    return {x: tuple(np.array(c, dtype=np.int64) for c in zip(*r)) for x, r in runs.items()}


def pack(docs: DataFrame, size: int = SEQUENCE, path: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text", steps: int | None = STEPS) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: every row's pieces, placed in as few sequences as found.

    Null and empty texts have one piece, the end id. Rows repeated with one id are packed each; null
    ids stay null. Only texts of over
    `size` tokens are cut, into full pieces but for the last. Other columns are never read. An empty table gives no rows. `steps` limits the
    search for fewer sequences (complete()); None finds the fewest.

    Only the histogram of lengths (at most `size` rows) comes to the driver, and only the plan made from it (at most a
    few runs for each length) goes out. Pieces of a length get ranks within salted groups, so that a length shared by a
    third of all rows is dealt to many tasks; a rank gives the sequence and the offset.
    """
    p = written(pieces(docs, size, path, id_col, text_col), "pieces")
    counts = {r["length"]: r["n"] for r in p.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `size` rows
    salts = max(16, -(-sum(counts.values()) // RANKED))
    runs = p.sparkSession.sparkContext.broadcast(places(complete(counts, size, steps)))
    salted = p.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    groups = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    groups = groups.select("length", "salt", (F.sum("n").over(W.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"))
    ranked = salted.withColumn("in_group", F.row_number().over(W.partitionBy("length", "salt").orderBy("doc_id", "piece")) - 1)
    ranked = ranked.join(small(written(groups, "ranks")), ["length", "salt"]).withColumn("rank", F.col("before") + F.col("in_group"))

    def place(batches):
        for pdf in batches:
            length, rank = pdf["length"].to_numpy(), pdf["rank"].to_numpy()
            sequence, offset = np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64)
            for x in np.unique(length):
                rows = np.flatnonzero(length == x)
                first, uses, seq, off = runs.value[int(x)]
                k = np.searchsorted(first, rank[rows], side="right") - 1
                inside = rank[rows] - first[k]
                sequence[rows] = seq[k] + inside // uses[k]
                offset[rows] = off[k] + inside % uses[k] * x
            yield pdf[["doc_id", "piece", "start", "length", "ids_crc32"]].assign(sequence_id=sequence, offset=offset)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInPandas(place, schema)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"))
