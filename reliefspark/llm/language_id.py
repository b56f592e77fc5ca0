"""Language identification by unigram models of pieces, summed over all segmentations of a text."""

from __future__ import annotations

from collections import Counter
from functools import cached_property, reduce

import numpy as np
import pandas as pd
import public_tokenizers
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reliefspark.llm.common import held, read_table, small_batches, written
from reliefspark.llm.tokens import MARKS, Memory

VOCABULARY = public_tokenizers.path("piece_bpe_32k.model")
#: Added to each piece's count; documents of which one fold in FOLDS is held out.
SMOOTHING, FOLDS = 0.1, 5
#: Words whose pieces a worker keeps in each of two generations; twice as many log-probabilities are kept.
WORDS = 300_000
#: Bytes of log-probabilities that a worker keeps: with many languages, of fewer words; and languages whose table is held at a time.
KEPT_BYTES, LANGUAGES = 100_000_000, 64
SPACE = "▁"
#: Characters with a column each in the table of the pieces' tree; others are searched for.
COLUMNS = 96


class Pieces:
    """The vocabulary: ids by piece, all their beginnings, and the ids of single bytes."""

    def __init__(self, path: str):
        self.processor = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.processor.get_piece_size()
        self.size = n
        self.ids = {self.processor.id_to_piece(k): k for k in range(n) if not (self.processor.is_control(k) or self.processor.is_byte(k) or self.processor.is_unknown(k))}
        # where a piece has a letter before a closing mark, the two may not be summed apart
        self.joined = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1) if p[k].isalpha() and p[k + 1] in MARKS}
        self.starts = {p[:k] for p in self.ids for k in range(1, len(p) + 1)}
        self.bytes = [self.processor.piece_to_id(f"<0x{b:02X}>") for b in range(256)]

    @cached_property
    def tree(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The tree of all beginnings: each node's piece (or -1), the columns of characters, next nodes by node and column, and node and character of the other steps, sorted, with the nodes they lead to."""
        node = {s: k for k, s in enumerate(["", *sorted(self.starts)])}
        piece = np.array([self.ids.get(s, -1) for s in node], np.int64)
        common = Counter(s[-1] for s in self.starts).most_common(COLUMNS)
        column = np.full(0x110000, COLUMNS, np.int16)
        column[[ord(c) for c, _ in common]] = np.arange(len(common))
        steps = np.array([(node[s[:-1]], ord(s[-1]), k) for s, k in node.items() if s], np.int64).reshape(-1, 3)
        by = column[steps[:, 1]]
        following = np.full((len(node), COLUMNS + 1), -1, np.int32)
        following[steps[by < COLUMNS, 0], by[by < COLUMNS]] = steps[by < COLUMNS, 2]
        rare = steps[by == COLUMNS]
        keys = rare[:, 0] << 21 | rare[:, 1]
        order = np.argsort(keys)
        return piece, column, following, np.r_[keys[order], np.iinfo(np.int64).max], np.r_[rare[order, 2], -1]

    def spans(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[tuple[int, int]]]:
        """word, from, to, piece of all places of pieces in words, and word and place of characters that are no piece; all places go down the tree together."""
        piece, column, following, keys, leads = self.tree
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        word, stops = np.repeat(np.arange(len(words)), sizes), np.cumsum(sizes)
        place, stop, by = np.arange(len(codes)) - (stops - sizes)[word], stops[word], column[codes]
        at, node, depth = np.arange(len(codes)), np.zeros(len(codes), np.int64), 0
        found, lone = [], np.ones(len(codes), bool)
        while len(at):
            to = following[node, by[at + depth]].astype(np.int64)
            rare = np.flatnonzero(by[at + depth] == COLUMNS)
            key = node[rare] << 21 | codes[at[rare] + depth]
            k = np.searchsorted(keys, key)
            to[rare] = np.where(keys[k] == key, leads[k], -1)
            at, node, depth = at[to >= 0], to[to >= 0], depth + 1
            here = piece[node]
            own, here = at[here >= 0], here[here >= 0]
            found.append((word[own], place[own], place[own] + depth, here))
            if depth == 1:
                lone[own] = False
            goes = at + depth < stop[at]
            at, node = at[goes], node[goes]
        parts = [np.concatenate(x) for x in zip(*found)] if found else [np.empty(0, np.int64)] * 4
        return *parts, list(zip(word[lone].tolist(), place[lone].tolist()))


def pieces(path: str) -> Pieces:
    return held(f"pieces {path}", lambda: Pieces(path))


def piece_counts(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """lang, piece, n over docs (lang, text): how often the vocabulary's own segmentation of the whole texts has each piece."""

    def count(batches):
        vocabulary, memory = pieces(path), Memory(WORDS)
        sums: dict[str, np.ndarray] = {}
        for pdf in batches:
            for lang, texts in pdf.groupby("lang")["text"]:
                for k in range(0, len(texts), 1024):
                    words: Counter[str] = Counter()
                    for t in texts.iloc[k : k + 1024]:
                        words.update(t.split())
                    memory.age()
                    new = [w for w in words if not memory.known(w)]
                    for w, ids in zip(new, vocabulary.processor.encode(new, num_threads=1)):
                        memory.young[w] = np.array(ids, np.int32).tobytes()
                    n = np.fromiter(words.values(), np.int64, len(words))
                    ids = [memory.young[w] for w in words]
                    if not ids:
                        continue
                    flat = np.frombuffer(b"".join(ids), np.int32)
                    at = np.repeat(n, np.fromiter(map(len, ids), np.int64, len(ids)) // 4)
                    total = np.bincount(flat, weights=at, minlength=vocabulary.size)
                    sums[lang] = sums[lang] + total if lang in sums else total
        for lang, total in sums.items():
            used = np.flatnonzero(total)
            yield pd.DataFrame({"lang": lang, "piece": used.astype(np.int32), "n": total[used].astype(np.int64)})

    return docs.select("lang", "text").mapInPandas(count, "lang string, piece int, n long").groupBy("lang", "piece").agg(F.sum("n").alias("n"))


class Scorer:
    """Log-probabilities of words in each language, by the forward algorithm over all segmentations."""

    def __init__(self, path: str, table: np.ndarray):
        self.pieces, self.table = pieces(path), table
        self.rows: dict[str, int] = {}
        self.kept = max(1, min(2 * WORDS, KEPT_BYTES // (8 * table.shape[1])))
        self.logs = np.zeros((self.kept, table.shape[1]))

    def forward(self, words: list[str]) -> np.ndarray:
        """log P of each word (those that begin with white space: of what follows) in each language.

        A character that is no piece is spelt by its bytes.
        """
        spelled = [w[1:] if w[0] == " " else SPACE + w for w in words]
        longest = max(map(len, spelled), default=0)
        w_at, j_at, i_at, p_at, alone = self.pieces.spans(spelled)
        lone = [(w, j, [self.pieces.bytes[b] for b in spelled[w][j].encode("utf-8", "replace")]) for w, j in alone]
        langs = self.table.shape[1]
        weight = np.exp(self.table[p_at])
        if lone:
            w_at, j_at = np.r_[w_at, [x[0] for x in lone]], np.r_[j_at, [x[1] for x in lone]]
            i_at = np.r_[i_at, [x[1] + 1 for x in lone]]
            weight = np.vstack([weight, [np.exp(self.table[x[2]].sum(0)) for x in lone]])
        order = np.argsort((i_at * len(words) + w_at) * (longest + 1) + j_at)
        w_at, j_at, i_at, weight = w_at[order], j_at[order], i_at[order], weight[order]
        bounds = np.searchsorted(i_at, np.arange(1, longest + 2))
        alpha = np.zeros((longest + 1, len(words), langs))
        alpha[0] = 1
        scale = np.zeros((longest + 1, len(words)))  # log of what alpha at a position was divided by
        for i in range(1, longest + 1):
            a, b = bounds[i - 1], bounds[i]
            if a == b:
                continue
            w, j = w_at[a:b], j_at[a:b]
            first = np.flatnonzero(np.diff(w, prepend=-1))
            top = np.maximum.reduceat(scale[j, w], first)
            terms = alpha[j, w] * weight[a:b] * np.exp(scale[j, w] - np.repeat(top, np.diff(np.r_[first, b - a])))[:, None]
            sums = np.add.reduceat(terms, first)
            peak = np.maximum(sums.max(1), 1e-300)
            alpha[i, w[first]] = np.maximum(sums / peak[:, None], 1e-300)
            scale[i, w[first]] = top + np.log(peak)
        ends = np.array([len(x) for x in spelled])
        at = np.arange(len(words))
        return np.log(alpha[ends, at]) + scale[ends, at][:, None]

    def learn(self, new: list[str]) -> None:
        k = 0
        while k < len(new):
            n = max(1, min(4096, 1_600_000 // self.table.shape[1] // (len(new[min(k + 4095, len(new) - 1)]) + 2)))
            part, at = new[k : k + n], len(self.rows)
            self.logs[at : at + len(part)] = self.forward(part)
            self.rows.update(zip(part, range(at, at + len(part))))
            k += n

    def texts(self, texts: list[str]) -> np.ndarray:
        """Sum of the words' log-probabilities of each text; closing marks are summed apart where no piece spans the place."""
        split = [t.split() for t in texts]
        words = set().union(*split)
        if len(self.rows) + 2 * len(words) > len(self.logs):
            self.rows.clear()
            if 2 * len(words) > len(self.logs) or len(self.logs) > self.kept:  # room for these texts' words at least
                self.logs = np.zeros((max(self.kept, 2 * len(words)), self.table.shape[1]))
        new = {w for w in words if w not in self.rows}
        parts: dict[str, tuple[str, str]] = {}
        for w in new:
            core = w.rstrip(MARKS)
            if core and len(core) < len(w) and core[-1].isalpha() and core[-1] + w[len(core)] not in self.pieces.joined:
                parts[w] = (core, " " + w[len(core) :])
        whole = {w for w in (new - parts.keys()).union(*parts.values()) if w not in self.rows}
        self.learn(sorted(whole, key=len))  # words of like length share their arrays
        at = len(self.rows)
        self.logs[at : at + len(parts)] = self.logs[[self.rows[c] for c, _ in parts.values()]] + self.logs[[self.rows[m] for _, m in parts.values()]]
        self.rows.update(zip(parts, range(at, at + len(parts))))
        row = self.rows.__getitem__
        return np.array([self.logs[np.fromiter(map(row, w), np.int64, len(w))].sum(0) for w in split])


def train(counts: DataFrame, langs: list[str], path: str = VOCABULARY) -> np.ndarray:
    """Log-probabilities (piece x language) of some languages, from counts (lang, piece, n) of all.

    What comes to the driver is one count a language and piece: at most LANGUAGES x 32,000 small rows.
    """
    rows = counts.filter(F.col("lang").isin(langs)).toPandas()
    table = np.full((pieces(path).size, max(1, len(langs))), SMOOTHING)
    np.add.at(table, (rows["piece"].to_numpy(np.int64), rows["lang"].map({x: k for k, x in enumerate(langs)}).to_numpy(np.int64)), rows["n"].to_numpy(float))
    return np.log(table / table.sum(0))


def scored(rows: DataFrame, langs: list[str], table: np.ndarray, path: str) -> DataFrame:
    """rows (doc_id, held_out, row, text) without their texts, and with lang, top and total: the likeliest of some languages, its log-likelihood and the logarithm of all their likelihoods' sum; lang is null for texts without a letter."""
    model = rows.sparkSession.sparkContext.broadcast((langs, table))

    def predict(batches):
        langs, table = model.value
        scorer = Scorer(path, table)
        for pdf in batches:
            texts = [t or "" for t in pdf["text"].tolist()]
            letters = [any(c.isalpha() for c in t) for t in texts]
            best, top, total = [None] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
            for k in range(0, len(texts) if langs else 0, 256):
                logs = scorer.texts(texts[k : k + 256])
                high = logs.max(1)
                first, total[k : k + 256], top[k : k + 256] = logs.argmax(1), high + np.log(np.exp(logs - high[:, None]).sum(1)), high
                for i in range(len(logs)):
                    if letters[k + i]:
                        best[k + i] = langs[first[i]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "held_out": pdf["held_out"], "row": pdf["row"], "lang": best, "top": top, "total": total})

    return rows.select("doc_id", "held_out", "row", "text").mapInPandas(predict, "doc_id string, held_out boolean, row long, lang string, top double, total double")


def identify(docs: DataFrame, path: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = FOLDS) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row, by its whole text alone.

    Models are learned from the rows whose crc32(id as text) mod `folds` isn't 0 and whose text and language aren't
    null. Language by language, pieces of a fixed public vocabulary have smoothed relative frequencies; a text's
    likelihood is the sum over all its segmentations into pieces (words are summed apart, as pieces never cross white
    space). score is the posterior of the predicted language under equal priors; ties go to the first in order. Null
    texts, texts without a letter, and all texts if nothing was learned, get `und` and score 0. Rows repeated with one
    id are judged each. Null ids are never held out. Other columns are never read. An empty table gives no rows. Texts
    are summed by distinct word, so a very long one takes memory for its different words only.

    Languages come in blocks of LANGUAGES, whose table is what the driver and a task hold; with several blocks, texts are
    scored once a block, and a row's likeliest languages and sums are put together by row.
    """
    fold = F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds, F.lit(1))
    rows = small_batches(docs).select(F.col(id_col).cast("long").cast("string").alias("doc_id"), (fold == 0).alias("held_out"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    counts = written(piece_counts(rows.filter("not held_out and text is not null and lang is not null"), path), "piece-counts")
    langs = sorted(r["lang"] for r in counts.select("lang").distinct().collect())  # names only
    if len(langs) <= LANGUAGES:
        best = scored(rows.withColumn("row", F.lit(0).cast("long")), langs, train(counts, langs, path), path)
    else:
        placed = written(rows.drop("lang").withColumn("row", F.monotonically_increasing_id()), "placed-texts")
        parts = [langs[k : k + LANGUAGES] for k in range(0, len(langs), LANGUAGES)]
        every = reduce(DataFrame.unionByName, [written(scored(placed, part, train(counts, part, path), path), "scored") for part in parts])
        # the greatest likelihood, of equal ones the first language; sums of likelihoods about the greatest
        high = every.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("held_out").alias("held_out"), F.max("top").alias("top"), F.min(F.struct(-F.col("top"), "lang"))["lang"].alias("lang"), F.collect_list("total").alias("totals"))
        best = high.withColumn("total", F.col("top") + F.log(F.aggregate("totals", F.lit(0.0), lambda a, t: a + F.exp(t - F.col("top")))))
    known = F.col("lang").isNotNull()
    return best.select(F.col("doc_id").cast("long").alias("doc_id"), "held_out", F.coalesce("lang", F.lit("und")).alias("lang_pred"), F.when(known, F.exp(F.col("top") - F.col("total"))).otherwise(F.lit(0.0)).alias("score"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(read_table(spark, sf_dir, "documents"))
