"""Quality classifier: heuristic labellers, their accuracies by expectation-maximisation, and a hashed linear scorer."""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reliefspark.llm.common import held, read_table, small_batches, written
from reliefspark.llm.tokens import Memory

#: Words that a worker keeps in each of two generations, and buckets of hashed features (the last ones tell of the whole text).
WORDS, BUCKETS, OF_TEXT = 250_000, 4096, 64
#: Documents, of the least hashes, on which the scorer is fitted, and steps of its fit.
TRAIN_ROWS, STEPS, L2 = 3000, 300, 1e-4
SYMBOLS = frozenset("#$%&*@^~{}<>\\=+_")
#: Labellers vote 1 (good), -1 (bad) or 0 (abstain), in this order.
LABELLERS = ("symbols", "bars", "capitals", "exclamations", "repeats", "variety", "lines", "punctuation", "short words", "plain words")
ALARMS = 7
#: Chances (labeller; good, bad) that a labeller that judges votes bad, towards which the estimates are pulled by as many
#: documents as PULL of all; the share of good documents likewise, and the shares at which the estimation starts.
ANCHORS = np.array([[0.005, 0.3]] * ALARMS + [[0.2, 0.5]] * (len(LABELLERS) - ALARMS))
PULL, GOOD, STARTS = 0.1, 0.8, (0.5, 0.8, 0.95)
SYMBOL, BAR, CAPITAL, EXCLAIMED, STOP, SHORT, PLAIN = (1 << k for k in range(7))


def shape_of(word: str) -> str:
    """Runs of capitals, small letters and digits by one sign each; other characters as they are, runs once."""
    if word.isalpha():
        if word.islower():
            return "a"
        if word.isupper():
            return "A"
        if word[0].isupper() and word[1:].islower():
            return "Aa"
    shape, before = [], ""
    for c in word:
        kind = "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c
        if kind != before:
            shape.append(kind)
        before = kind
    return "".join(shape)


def look(word: str) -> int:
    """What a word shows: flags, bucket of the word << 8, bucket of its shape << 24."""
    core = word.rstrip(".,;:?!")
    flags = 0
    if core.isalpha():
        flags = PLAIN
        letters = len(core)
    else:
        letters = sum(map(str.isalpha, word))
        if not SYMBOLS.isdisjoint(word):
            flags = SYMBOL
        if "|" in word:
            flags |= BAR
    if letters:
        if letters > 1 and word.isupper():
            flags |= CAPITAL
        if letters <= 3:
            flags |= SHORT
    if word.endswith("!!"):
        flags |= EXCLAIMED
    elif word[-1] in ".,":
        flags |= STOP
    buckets = BUCKETS - OF_TEXT
    shape = shape_of(core) + word[len(core) :] if core else word
    return flags | zlib.crc32(word.lower().encode("utf-8", "replace")) % buckets << 8 | zlib.crc32(shape.encode("utf-8", "replace"), 1) % buckets << 24


class Reader:
    """Votes and features of whole texts; what a word shows is kept."""

    def __init__(self):
        self.memory = Memory(WORDS)

    def read(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """Votes, codes of the words, and buckets of the whole text; None without words."""
        words = text.split()
        n = len(words)
        if not n:
            return None
        memory = self.memory
        memory.age()
        for w in set(words):
            if w not in memory.young and not memory.known(w):
                memory.young[w] = look(w)
        codes = np.fromiter(map(memory.young.__getitem__, words), np.int64, n)
        flags = codes & 255
        share = {f: np.count_nonzero(flags & f) / n for f in (SYMBOL, BAR, CAPITAL, EXCLAIMED, STOP, SHORT, PLAIN)}
        repeats = np.count_nonzero(codes[1:] == codes[:-1]) / n
        variety = len(np.unique(codes[1:] * 31 ^ codes[:-1])) / (n - 1) if n >= 20 else 1.0  # of pairs of words
        lines = [x for x in text.split("\n") if x.strip()]
        doubled = 1 - len(set(lines)) / len(lines) if len(lines) > 1 else 0.0
        bad = lambda x, most: -1 if x > most else 0
        votes = np.array([
            bad(share[SYMBOL], 0.1), bad(share[BAR], 0.1), bad(share[CAPITAL], 0.25), bad(share[EXCLAIMED], 0.1), bad(repeats, 0.15), bad(0.4, variety), bad(doubled, 0.4) if len(lines) > 3 else 0,
            0 if n < 20 else 1 if 0.02 < share[STOP] < 0.4 else -1, 0 if n < 20 else 1 if 0.1 < share[SHORT] < 0.75 else -1, 1 if share[PLAIN] > 0.8 else -1 if share[PLAIN] < 0.6 else 0,
        ], np.int8)
        # shares of the text fall into four cells each
        whole = [share[SYMBOL], share[BAR], share[CAPITAL], share[EXCLAIMED], repeats, doubled, share[STOP], share[SHORT], share[PLAIN]]
        return votes, codes, BUCKETS - OF_TEXT + np.arange(len(whole)) * 4 + np.searchsorted([0.02, 0.1, 0.4], whole)


def features(codes: np.ndarray, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and their values: shares of words and shapes, and 1 for the cells of the whole text."""
    found, count = np.unique(np.concatenate([codes >> 8 & 0xFFFF, codes >> 24]), return_counts=True)
    return np.r_[found, cells], np.r_[count / len(codes), np.ones(len(cells))]


def pattern(votes: np.ndarray) -> int:
    return int(((votes.astype(np.int64) + 1) * 3 ** np.arange(len(votes))).sum())


def votes_of(pattern: np.ndarray) -> np.ndarray:
    return pattern[:, None] // 3 ** np.arange(len(LABELLERS)) % 3 - 1


def rates(votes: np.ndarray, weights: np.ndarray, pseudo: float) -> np.ndarray:
    """(labeller, class) chances that a labeller that judges votes bad; class 0 is good, class 1 bad.

    weights: (pattern, class) counts. `pseudo` counts of each class's ANCHORS pull the estimates. A labeller that would
    be less of an alarm among bad documents than among good ones is no better than chance: its two chances become one.
    """
    judges = np.where(np.arange(len(LABELLERS)) < ALARMS, True, votes != 0)  # a silent alarm judges, too
    bad, all_ = (votes == -1).T.astype(float) @ weights, judges.T.astype(float) @ weights
    chance = (bad + pseudo * ANCHORS) / (all_ + pseudo)
    pooled = ((bad + pseudo * ANCHORS).sum(1) / (all_ + pseudo).sum(1))[:, None]
    return np.where(chance[:, :1] > chance[:, 1:], pooled, chance)


def log_joint(votes: np.ndarray, chance: np.ndarray, good: float) -> np.ndarray:
    """Log joint chances (pattern, class) of votes with the class, labellers being independent given the class."""
    judges = np.where(np.arange(len(LABELLERS)) < ALARMS, True, votes != 0).astype(float)
    bad = (votes == -1).astype(float)
    return bad @ np.log(chance) + (judges - bad) @ np.log1p(-chance) + np.log([good, 1 - good])


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> np.ndarray:
    """P(good) of each pattern of votes. Labellers are independent given the class.

    Each labeller votes bad with a chance of its own in either class: its accuracies. That the first ALARMS labellers are
    silent tells for a text; the others abstain on what they can't judge, which tells nothing. The chances and the share of
    good documents are estimated from the posteriors in turn, as the most likely ones a posteriori: a share PULL of all
    documents counts as if it were as ANCHORS and GOOD have it, and no labeller may be worse than chance (rates()). So
    the classes can't swap, and documents that agree on everything, whatever it is, don't split into two classes. Of
    several starts, the one with the best posterior stands.
    """
    votes = votes_of(patterns)
    total = counts.sum()
    if not total:
        return np.full(len(patterns), GOOD)
    pseudo = PULL * total
    best = None
    for good in STARTS:
        chance = ANCHORS
        for _ in range(rounds):
            log = log_joint(votes, chance, good)
            top = np.logaddexp(log[:, 0], log[:, 1])
            posterior = np.exp(log - top[:, None])
            prior = (pseudo * (ANCHORS * np.log(chance) + (1 - ANCHORS) * np.log1p(-chance))).sum() + pseudo * (GOOD * np.log(good) + (1 - GOOD) * np.log1p(-good))
            fit_ = float((counts * top).sum() + prior)
            weights = counts[:, None] * posterior
            chance, good = rates(votes, weights, pseudo), float((weights[:, 0].sum() + pseudo * GOOD) / (total + pseudo))
        if best is None or fit_ > best[0]:
            best = (fit_, posterior[:, 0])
    return best[1]


def fit_scorer(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic scorer for soft labels, by Adam over the whole sample."""
    row = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    column, value = np.concatenate([r[0] for r in rows]).astype(np.int64), np.concatenate([r[1] for r in rows]).astype(float)
    w, m, v = (np.zeros(BUCKETS + 1) for _ in range(3))
    for step in range(1, STEPS + 1):
        z = np.bincount(row, value * w[column], minlength=len(rows)) + w[-1]
        error = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - labels) / len(rows)
        g = np.r_[np.bincount(column, value * error[row], minlength=BUCKETS), error.sum()] + L2 * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w[:-1], float(w[-1])


@dataclass
class Model:
    """Posteriors by pattern of votes, and the scorer."""

    posterior: dict[int, float]
    weights: np.ndarray
    bias: float

    def score(self, codes: np.ndarray, cells: np.ndarray) -> float:
        w = self.weights
        z = (w[codes >> 8 & 0xFFFF].sum() + w[codes >> 24].sum()) / len(codes) + w[cells].sum() + self.bias
        return float(1 / (1 + np.exp(-np.clip(z, -50, 50))))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS) -> Model:
    """The labellers vote on every row's whole text; the counts of their patterns (at most 3**10) give the accuracies.

    The scorer learns the posteriors of `train_rows` different texts, those of least xxhash64 among all that have a word:
    each task keeps its own least ones, so copies of one text, however many, are one example.
    """
    rows = small_batches(docs).select(F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h"))

    def vote(batches):
        reader = held("quality", Reader)
        found: dict[int, int] = {}
        least = np.empty(0, np.int64)
        for pdf in batches:
            worded = []
            for t in pdf["text"].tolist():
                seen = reader.read(t or "")
                worded.append(seen is not None)
                if seen is not None:
                    p = pattern(seen[0])
                    found[p] = found.get(p, 0) + 1
            least = np.unique(np.concatenate([least, pdf["h"].to_numpy(np.int64)[worded]]))[:train_rows]
        yield pd.DataFrame({"kind": 0, "value": list(found.keys()), "n": list(found.values())}).astype("int64")
        yield pd.DataFrame({"kind": 1, "value": least, "n": 1}).astype("int64")

    seen = written(rows.mapInPandas(vote, "kind long, value long, n long").groupBy("kind", "value").agg(F.sum("n").alias("n")), "votes")
    table = seen.filter("kind = 0").toPandas()  # at most 3**10 rows
    patterns, counts = table["value"].to_numpy(np.int64), table["n"].to_numpy(float)
    posterior = dict(zip(patterns.tolist(), expectation_maximisation(patterns, counts).tolist())) if len(table) else {}
    sample = written(seen.filter("kind = 1").select(F.col("value").alias("h")).orderBy("h").limit(train_rows), "sample")

    def describe(batches):
        reader = held("quality", Reader)
        known: set[int] = set()
        for pdf in batches:
            out = []
            for h, t in zip(pdf["h"].tolist(), pdf["text"].tolist()):
                if h not in known and (seen := reader.read(t or "")) is not None:
                    known.add(h)
                    buckets, values = features(*seen[1:])
                    out.append((h, pattern(seen[0]), buckets.astype("<u2").tobytes(), values.astype("<f4").tobytes()))
            yield pd.DataFrame(out, columns=["h", "pattern", "buckets", "feature_values"])

    # at most train_rows rows of at most BUCKETS features
    described = rows.join(F.broadcast(sample), "h", "left_semi").mapInPandas(describe, "h long, pattern long, buckets binary, feature_values binary")
    got = described.groupBy("h").agg(F.max(F.struct("pattern", "buckets", "feature_values")).alias("x")).select("h", "x.*").toPandas().sort_values("h")
    if not len(got):
        return Model(posterior, np.zeros(BUCKETS), 0.0)
    vectors = [(np.frombuffer(b, "<u2"), np.frombuffer(v, "<f4")) for b, v in zip(got["buckets"], got["feature_values"])]
    weights, bias = fit_scorer(vectors, np.array([posterior[p] for p in got["pattern"].tolist()]))
    return Model(posterior, weights, bias)


def classify(docs: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, weak_label (the labellers' posterior), score (the scorer's), keep (score >= threshold) of every row.

    Each row is judged by its whole text, however long: a task holds the words of one text at a time. Null texts and those without words have no votes and score 0: they aren't
    kept. Rows repeated with one id are judged each, and
    null ids stay null. Other columns are never read. An empty table gives no rows.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, id_col, text_col, train_rows))

    def judge(batches):
        reader, m = held("quality", Reader), model.value
        for pdf in batches:
            weak, score = [], []
            for t in pdf["text"].tolist():
                seen = reader.read(t or "")
                weak.append(m.posterior.get(pattern(seen[0]), 0.5) if seen else None)
                score.append(m.score(*seen[1:]) if seen else 0.0)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "weak_label": pd.Series(weak, dtype=float), "score": pd.Series(score, dtype=float), "keep": [s >= threshold for s in score]})

    rows = docs.select(F.col(id_col).cast("long").cast("string").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(judge, "doc_id string, weak_label double, score double, keep boolean").withColumn("doc_id", F.col("doc_id").cast("long"))


def kept(docs: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """The rows of docs, with all their columns, that classify() keeps; no join is needed."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, id_col, text_col, train_rows))

    def judge(batches):
        reader, m = held("quality", Reader), model.value
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text_col))
            seen = map(reader.read, (t or "" for t in column.to_pylist()))
            keep = [x is not None and m.score(*x[1:]) >= threshold for x in seen]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(judge, docs.schema)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(read_table(spark, sf_dir, "documents"))
