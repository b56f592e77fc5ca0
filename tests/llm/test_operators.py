"""Each corpus operator against a brute-force version, on fixtures with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pandas as pd
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from reliefspark.llm import chat_format, exact_dedup, language_id, mixing, ngram_join, packing, quality, token_counts, topk, url_filter
from reliefspark.llm.common import CLEANED, written

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, key long, length int, token long"
WORDS = [a + b for a in "thand er on ti ha the of re".split() for b in "ing ed ly s er, and.".split()]


def documents(spark, rows):
    """rows (doc_id, text, lang, source), with columns whose names the operators use themselves."""
    return spark.createDataFrame([(*r, None, -1, -2, -3, -4) for r in rows], SCHEMA)


def fixture(n=60, seed=1):
    rng = random.Random(seed)
    say = lambda k: " ".join(rng.choice(WORDS) + rng.choice(["", "", rng.choice("abcdef")]) for _ in range(k))
    rows = [(k, say(rng.choice([1, 2, 5, 30, 80, 200])), rng.choice(["en", "fr", None]), rng.choice(["a", "b", "b", "é", None])) for k in range(n)]
    base = say(120).split()
    for k in range(n, n + 25):  # near copies of one text
        words = list(base)
        for _ in range(rng.randrange(0, 8)):
            words[rng.randrange(len(words))] = rng.choice(WORDS) + "x"
        rows.append((k, " ".join(words), "en", "a"))
    rows += [(n + 30, None, "en", None), (n + 31, "", None, "a"), (n + 32, " \n\t ", "en", "a"), (n + 33, say(9000), "en", "a"), (n + 34, rows[3][1].upper(), "en", "b"), (n + 35, "ÉÀ É É", "fr", "é"), (n + 36, "éà é é", "fr", "é"), (n + 37, "a\x1cb <|endoftext|> Σσ Σ.", "en", "b")]
    return [*rows, rows[5], rows[5], rows[n + 31]]


EMPTY: list = []


def folded(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# op1


def test_quality_finds_junk_and_keeps_clean_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = quality.classify(docs).join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").collect()
    clean, junk = [r["keep"] for r in got if r["quality"] == 1], [r["keep"] for r in got if r["quality"] == 0]
    assert sum(clean) >= 0.99 * len(clean) and sum(junk) <= 0.1 * len(junk)
    kept = quality.kept(docs)
    assert kept.columns == docs.columns and kept.count() == quality.classify(docs).filter("keep").count()


def test_quality_edge_cases(spark):
    docs = documents(spark, fixture())
    got = quality.classify(docs).collect()
    assert len(got) == docs.count() and all(not r["keep"] and r["score"] == 0 for r in got if r["doc_id"] in (90, 91, 92))
    assert quality.kept(docs).columns == docs.columns
    for f in (quality.classify, quality.kept):
        assert f(documents(spark, EMPTY)).count() == 0


def test_expectation_maximisation_trusts_overlapping_alarms():
    votes = np.array([[0] * 7 + [1, 1, 1], [-1] + [0] * 6 + [1, -1, -1], [0] * 3 + [-1, -1] + [0] * 2 + [1, 1, 1]])
    p = quality.expectation_maximisation(np.array([quality.pattern(v) for v in votes]), np.array([900.0, 60, 40]))
    assert p[0] > 0.95 and p[1] < 0.05 and p[2] < 0.05
    assert (quality.votes_of(np.array([quality.pattern(v) for v in votes])) == votes).all()


def test_labellers_that_agree_do_not_split_clean_documents():
    for votes in ([0] * 7 + [1, -1, 1], [0] * 7 + [1, -1, -1], [0] * 7 + [-1, -1, 1]):
        p = quality.expectation_maximisation(np.array([quality.pattern(np.array(v)) for v in ([0] * 7 + [1, 1, 1], votes)]), np.array([60.0, 40]))
        assert min(p) > 0.9
    assert len(quality.expectation_maximisation(np.array([], np.int64), np.array([]))) == 0


def brute_maximisation(rows, rounds=200):
    """P(good) of each row of votes, row by row and by plain loops, from the best of the starts."""
    q, n, k = quality, len(rows), len(quality.LABELLERS)
    best = None
    for good in q.STARTS:
        chance = [list(x) for x in q.ANCHORS]
        for _ in range(rounds):
            posterior, value = [], 0.0
            for row in rows:
                p = [good, 1 - good]
                for j, v in enumerate(row):
                    if v or j < q.ALARMS:
                        p = [p[c] * (chance[j][c] if v == -1 else 1 - chance[j][c]) for c in (0, 1)]
                posterior.append(p[0] / sum(p))
                value += math.log(sum(p))
            for j in range(k):
                value += sum(q.PULL * n * (a * math.log(c) + (1 - a) * math.log(1 - c)) for a, c in zip(q.ANCHORS[j], chance[j]))
            value += q.PULL * n * (q.GOOD * math.log(good) + (1 - q.GOOD) * math.log(1 - good))
            for j in range(k):
                weight = [[p, 1 - p] for p, row in zip(posterior, rows) if row[j] or j < q.ALARMS]
                bad = [[p, 1 - p] for p, row in zip(posterior, rows) if row[j] == -1]
                top = [sum(w[c] for w in bad) + q.PULL * n * q.ANCHORS[j][c] for c in (0, 1)]
                all_ = [sum(w[c] for w in weight) + q.PULL * n for c in (0, 1)]
                chance[j] = [top[c] / all_[c] for c in (0, 1)]
                if chance[j][0] > chance[j][1]:
                    chance[j] = [sum(top) / sum(all_)] * 2
            good = (sum(posterior) + q.PULL * n * q.GOOD) / (n + q.PULL * n)
        if best is None or value > best[0]:
            best = (value, posterior)
    return best[1]


def test_expectation_maximisation_by_brute_force():
    rng = random.Random(6)
    rows = []
    for _ in range(60):
        junk = rng.random() < 0.3
        rows.append([-1 if rng.random() < (0.4 if junk else 0.02) else 0 for _ in range(7)] + [rng.choice([-1, -1, 0]) if junk else rng.choice([1, 1, 1, 0, -1]) for _ in range(3)])
    found = Counter(quality.pattern(np.array(r)) for r in rows)
    p = quality.expectation_maximisation(np.array(list(found)), np.array(list(found.values()), float))
    of, want = dict(zip(found, p)), brute_maximisation(rows)
    assert max(abs(of[quality.pattern(np.array(r))] - w) for r, w in zip(rows, want)) < 1e-6


LONG_WORDS = "Donaudampfschifffahrt Gesellschaft Kapitaen wartet immer wieder lange draussen Freunde kommen morgen Wandern".split()


@pytest.mark.parametrize("vocabulary", [LONG_WORDS, "the cat sat on a mat with its warm blanket and never left".split(), ["Haus", "Baum", "morgen", "liegt"]])
def test_quality_keeps_corpora_of_clean_documents(spark, vocabulary):
    rng = random.Random(8)
    texts = [" ".join(rng.choice(vocabulary) + rng.choice(["", "", "", ",", "."]) for _ in range(rng.randrange(8, 70))) + "." for _ in range(60)]
    texts += [" ".join(vocabulary * 3) + "."] * 60  # one pattern
    got = quality.classify(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert sum(r["keep"] for r in got) >= 0.95 * len(got)


def test_quality_of_ids_repeated_and_null(spark):
    big = 2**60 + 1
    rows = [(big, "the cat sat on the mat, and it was warm."), (None, "the cat sat on the mat, and it was warm."), (big, "$$$ ### | | @@@ ~~~ ^^^ &&& *** ((( )))"), (big, None)]
    got = quality.classify(spark.createDataFrame(rows, "doc_id long, text string"), train_rows=2).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in rows)


# op2


def brute_pieces(rows, size):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.encode_special_tokens = True
    out = Counter()
    for doc_id, text, *_ in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        for p in range(0, len(ids), size):
            part = np.array(ids[p : p + size], "<u4")
            out[doc_id, p // size, p, len(part), zlib.crc32(part.tobytes())] += 1
    return out


@pytest.mark.parametrize("size", [4096, 64])
def test_packing(spark, size):
    rows = fixture()
    got = packing.pack(documents(spark, rows), size).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == brute_pieces(rows, size)
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= size
    assert len(sequences) <= -(-sum(r["length"] for r in got) // size) + 1
    assert packing.pack(documents(spark, EMPTY)).count() == 0


def test_encoder_is_the_tokenizer_on_odd_strings():
    from reliefspark.llm.tokens import encoder

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.encode_special_tokens = True
    rng = random.Random(12)
    signs = [*"aAbBzZiİIıÉéßẞΣσςŒœĳǅ0179 .,!?;:%$&*#|'-_()\n\t日本語กั\u0301\u0307\u200d\u00ad\x1c\x85\u00a0\u2028😀", "İ.", "<|endoftext|>", "don't", "ﬁ"]
    texts = ["İ.", "İ!?", "aİ, b", *("".join(rng.choice(signs) for _ in range(rng.randrange(1, 12))) for _ in range(6000))]
    for text, ids in zip(texts, encoder().encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == t.encode(text, add_special_tokens=False).ids, text


def test_perfect_packings_are_found():
    rng = random.Random(7)
    for _ in range(60):
        items, bins = [], rng.randrange(3, 25)
        for _ in range(bins):
            cuts = sorted(rng.sample(range(1, 100), rng.randrange(1, 5)))
            items += [b - a for a, b in zip([0, *cuts], [*cuts, 100])]
        plan = packing.complete(dict(Counter(items)), 100)
        assert Counter(x for full, n in plan for x in full for _ in range(n)) == Counter(items) and sum(n for _, n in plan) == bins
    many = {k: rng.randrange(1, 10**6) for k in range(1, 400)}  # the search ends, the plan stays short
    plan = packing.complete(many, 1000)
    assert sum((Counter({x: n * c for x, c in Counter(full).items()}) for full, n in plan), Counter()) == Counter(many) and len(plan) < 2000


def test_fillings_are_all_that_are_undominated():
    from itertools import combinations

    rng = random.Random(4)
    for _ in range(150):
        items, room, waste = sorted(rng.randrange(1, 13) for _ in range(rng.randrange(1, 8))), rng.randrange(1, 25), rng.randrange(0, 8)
        want = set()
        for n in range(len(items) + 1):
            for filling in combinations(items, n):
                over = room - sum(filling)
                spare = Counter(items) - Counter(filling)
                better = any(x <= over for x in spare) or any(k <= x <= k + over and (x > k or m == 2) for m in (1, 2) for k in map(sum, combinations(filling, m)) for x in spare)
                if 0 <= over <= waste and not better:
                    want.add(tuple(sorted(filling, reverse=True)))
        got = [tuple(f) for f in packing.fillings(dict(Counter(items)), room, waste, lambda work: True)]
        assert len(got) == len(set(got)) and set(got) == want, (items, room, waste)
        assert [sum(f) for f in got] == sorted((sum(f) for f in got), reverse=True)


def test_bin_completion_is_optimal_on_small_cases():
    def least(items, size):
        best = [len(items)]

        def put(k, bins):
            if len(bins) >= best[0]:
                return
            if k == len(items):
                best[0] = len(bins)
                return
            for i in {b: i for i, b in enumerate(bins)}.values():
                if bins[i] >= items[k]:
                    put(k + 1, [*bins[:i], bins[i] - items[k], *bins[i + 1 :]])
            put(k + 1, [*bins, size - items[k]])

        put(0, [])
        return best[0]

    rng = random.Random(3)
    for _ in range(60):
        items = sorted((rng.randrange(1, 20) for _ in range(rng.randrange(1, 10))), reverse=True)
        plan = packing.complete(dict(Counter(items)), 20, None)
        assert Counter(x for full, n in plan for x in full for _ in range(n)) == Counter(items) and all(sum(full) <= 20 for full, _ in plan)
        assert sum(n for _, n in plan) == least(items, 20)


# op3


def test_chat_format_of_conversations(spark):
    rows = [(1, 0, "user", "a<b>&amp;</turn>\n<turn x>"), (1, 1, "assistant", "é\U0001f600\\n"), (1, 1, "assistant", "b"), (2, 5, None, None), (3, 0, "assistant", ""), *[(4, k, ["user", "assistant"][k % 2], f"t{k}") for k in range(70)], (1, 0, "user", "a<b>&amp;</turn>\n<turn x>")]
    c = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("tree", F.lit(9)).withColumn("node", F.lit(1))
    formatted = chat_format.format_trees(chat_format.conversations_as_trees(c))
    got = {r["conv_id"]: r for r in chat_format.digests(formatted).collect()}
    rows += [(None, 1, "assistant", "second"), (None, 0, "user", "first")]
    more = spark.createDataFrame(rows[-2:], "conv_id long, turn long, role string, text string")
    got[None] = chat_format.digests(chat_format.format_trees(chat_format.conversations_as_trees(more))).first()
    for conv in (1, 2, 3, 4, None):
        turns = sorted((t, r or "", x or "") for i, t, r, x in rows if i == conv)
        spoken = "".join(x for _, r, x in turns if r == "assistant")
        g = got[conv]
        assert g["n_turns"] == len(turns) and g["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
        assert g["loss_chars"] == len(spoken) and g["loss_sha256"] == hashlib.sha256(spoken.encode()).hexdigest()
    assert chat_format.format_trees(chat_format.conversations_as_trees(c.limit(0))).count() == 0


def test_reply_trees_rank_branches(spark):
    # 1 - 2 - 4 and 1 - 3 - 5 - 6; 7 and 8 are a cycle; 9's parent is missing
    rows = [(1, 1, None, 0.0), (1, 2, 1, 5.0), (1, 4, 2, 1.0), (1, 3, 1, 1.0), (1, 5, 3, 1.0), (1, 6, 5, 1.0), (1, 7, 8, 9.0), (1, 8, 7, 9.0), (2, 9, 99, None)]
    m = spark.createDataFrame([(*r[:3], "user", f"n{r[1]}", r[3]) for r in rows], "tree long, node long, parent long, role string, text string, score double")
    got = {(r["tree"], r["rank"]): (r["leaf"], re.findall(r"n\d", r["formatted"])) for r in chat_format.format_trees(m, branches=5).collect()}
    assert got == {(1, 1): (4, ["n1", "n2", "n4"]), (1, 2): (6, ["n1", "n3", "n5", "n6"]), (2, 1): (9, ["n9"])}
    assert {r["leaf"] for r in chat_format.format_trees(m).collect()} == {4, 9}


# op4


def test_exact_dedup(spark):
    rows = fixture()
    groups = defaultdict(list)
    for doc_id, text, *_ in rows:
        groups[folded(text)].append(doc_id)
    want = Counter((d, max(g), len(g), d == max(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for d in g)
    for capacity in (exact_dedup.CAPACITY, 4):
        assert Counter(map(tuple, exact_dedup.exact_dedup(documents(spark, rows), capacity=capacity).collect())) == want
    assert exact_dedup.exact_dedup(documents(spark, EMPTY)).count() == 0


def test_exact_dedup_follows_chains_of_collisions(spark, monkeypatch):
    rows = fixture()
    groups = defaultdict(list)
    for doc_id, text, *_ in rows:
        groups[folded(text)].append(doc_id)
    monkeypatch.setattr(exact_dedup.F, "xxhash64", lambda c: F.length(c).cast("long") % 3)
    got = exact_dedup.exact_dedup(documents(spark, rows)).collect()
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"]) for r in got) == Counter((d, max(g), len(g)) for g in groups.values() for d in g)


def test_directory_doubles_until_buckets_fit():
    d = exact_dedup.directory({0: 5, 1: 5, 2: 1, 12: 100}, 4, 6)
    assert sorted(s for s, _, _ in d) == list(range(16))
    of = {s: (b, pages) for s, b, pages in d}
    assert of[0][0] != of[1][0] and of[12] == (12, 17) and of[4] == of[7] and of[4][1] == 1


def test_exact_dedup_chains_pages_of_a_hot_key(spark):
    rows = [(k, "same") for k in range(300)] + [(1000 + k, f"text {k}") for k in range(60)] + [(None, "Same")]
    got = exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string"), capacity=4).collect()
    assert Counter((r["keep_id"], r["group_size"]) for r in got) == Counter([(299, 301)] * 301 + [(1000 + k, 1) for k in range(60)])


def test_exact_dedup_keeps_one_row_a_group(spark):
    rows = [(5, "same text here", 1), (9, "same text here", 2), (5, "a wholly different text", 3), (7, "z", 4), (7, "Z", 5), (7, "z", 4), (None, "n", 6), (None, "N", 7), (None, None, 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, gone_id int")
    got = exact_dedup.kept_rows(docs)
    assert got.columns == docs.columns and Counter((r["doc_id"], folded(r["text"])) for r in got.collect()) == Counter([(9, "same text here"), (5, "a wholly different text"), (7, "z"), (None, "n"), (None, "")])


# op5


def test_token_counts(spark):
    rows = fixture()
    lengths = Counter()
    for (_, _, start, n, _), k in brute_pieces(rows, 10**9).items():
        lengths[n - 1] += k
    got = {r["context_limit"]: r for r in token_counts.histogram(documents(spark, rows)).collect()}
    assert set(got) == set(lengths)
    for limit, r in got.items():
        within = sum(n for x, n in lengths.items() if x <= limit)
        assert (r["docs_at"], r["docs_within"], r["docs_over"]) == (lengths[limit], within, len(rows) - within)
        assert r["tokens_within"] == sum(x * n for x, n in lengths.items() if x <= limit) and r["tokens_truncated"] == sum(min(x, limit) * n for x, n in lengths.items())
        assert r["tokens_total"] == sum(x * n for x, n in lengths.items()) and r["share_within"] == pytest.approx(within / len(rows))
    assert token_counts.histogram(documents(spark, EMPTY)).count() == 0


# op6


def brute_ratio(urls, order=url_filter.ORDER):
    """urls: (url, accepted, rejected, learns); the mean log ratio of each."""
    counts = [[Counter() for _ in range(order + 1)] for _ in range(2)]
    for url, a, r, learns in urls:
        padded = url_filter.PAD * order + url
        for i in range(order, len(padded)):
            for k in range(order + 1):
                for c, n in enumerate((a, r)):
                    if n and learns:
                        counts[c][k][padded[i - k : i + 1]] += n
    chars = {c for url, *_ in urls for c in url}

    def p(c, context, ch):
        value = 1 / (len(chars) + 1)
        for k in range(order + 1):
            ctx = context[len(context) - k :]
            following = [counts[c][k][ctx + x] for x in chars if counts[c][k][ctx + x]]
            n, t = sum(following), len(following)
            if n + t:
                value = (counts[c][k][ctx + ch] + t * value) / (n + t)
        return value

    out = {}
    for url, *_ in urls:
        padded = url_filter.PAD * order + url
        logs = [math.log(p(1, padded[i - order : i], padded[i])) - math.log(p(0, padded[i - order : i], padded[i])) for i in range(order, len(padded))]
        out[url] = sum(logs) / len(logs) if logs else 0.0
    return out


def test_url_filter_rules(spark):
    urls = ["http://a.NET/x?q", "http://x.example.net/en/1", "https://example.com/de/", "http://example.com/den", "http://fr.org/fr/#a", "http://a.net", "notnet/", None, "", "x://", "http://anet/", "ftp://net/", "http://Example.Net/EN/"]
    p = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("clash")).withColumn("gram", F.lit(1))
    got = {r["page_id"]: r for r in url_filter.filter_urls(p).collect()}
    assert [got[k]["rule"] for k in range(len(urls))] == ["net/", "example.net/en/", "example.com/de/", None, "org/fr/", None, None, None, None, None, None, "net/", "net/"]
    assert got[0]["host"] == "a.net" and got[0]["path"] == "/x" and (got[7]["host"], got[7]["path"], got[7]["verdict"]) == ("", "", "allow") and got[5]["path"] == ""
    assert url_filter.filter_urls(p.limit(0)).count() == 0


def test_url_filter_models(spark):
    rng = random.Random(5)
    urls = [f"https://{rng.choice(['spam', 'ham', 'www.eggs'])}{rng.randrange(9)}.example.{rng.choice(['net', 'com', 'org'])}/{rng.choice(['en', 'fr', 'de'])}/{rng.randrange(99)}.html" for _ in range(150)]
    p = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = url_filter.filter_urls(p).collect()
    text = lambda u: u.split("://", 1)[1]
    seen = defaultdict(lambda: [0, 0])
    for r in got:
        seen[text(urls[r["page_id"]])][0] += r["rule"] is not None and r["verdict"] == "allow"
        seen[text(urls[r["page_id"]])][1] += r["rule"] is not None and r["verdict"] == "block"
    learns = {u: zlib.crc32(u.encode()) % url_filter.FOLDS != 0 for u in seen}
    want = brute_ratio([(u, a, b, learns[u]) for u, (a, b) in seen.items()])
    accepted = sorted((round(want[u] / url_filter.STEP) for u, (a, _) in seen.items() for _ in range(a) if not learns[u]), reverse=True)
    over = [c for c in accepted if c >= 0][: int(url_filter.FALSE_BLOCKS * len(accepted)) + 1]
    cut = max(0, over[-1] + 1) * url_filter.STEP if over else 0
    for r in got:
        assert r["ratio"] == pytest.approx(want[text(urls[r["page_id"]])], abs=1e-9)
        if r["rule"] is None:
            assert r["verdict"] == ("block" if r["ratio"] > cut else "allow")
    assert url_filter.threshold([(-10, 50, 1), (20, 50, 5), (300, 1, 90)]) == pytest.approx(0.21)
    assert url_filter.threshold([(0, 5, 0)]) == math.inf


def test_url_filter_scores_whole_urls(spark):
    urls = [f"https://cheap-pills{k}.shop.net/x/buy-pills{k}.html" for k in range(60)] + [f"https://library{k}.town.org/fr/livres{k}.html" for k in range(60)]
    urls += ["https://cheap-pills.biz/buy", "https://library.biz/livres"]
    p = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r["page_id"]: r for r in url_filter.filter_urls(p).collect()}
    bad, good = got[120], got[121]
    assert len(got) == 122 and bad["rule"] is None and good["rule"] is None
    assert bad["ratio"] > 0 > good["ratio"] and (bad["verdict"], good["verdict"]) == ("block", "allow")


def test_long_urls_take_time_in_proportion(spark):
    rng = random.Random(3)
    long = "http://long.example/" + "".join(rng.choice("abcdefgh/-") for _ in range(1_000_000))
    rows = [(k, f"http://{w}.example.net/{p}/{k}") for k in range(40) for w, p in (("good", "en"), ("casino", "de"))] + [(9000, long), (9001, long[:300_000]), (9002, "http://" + "a" * 255), (9003, "http://" + "b" * 16_385)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    began = time.time()
    got = {r["page_id"]: r["ratio"] for r in url_filter.filter_urls(pages).collect() if r["page_id"] >= 9000}
    assert time.time() - began < 60 and len(got) == 4
    # pieces have the context that the whole has
    few = url_filter.grams(pages.filter("page_id in (9001, 9002, 9003)").select("page_id", F.substring("url", 8, 2**30).alias("url")), 4, ["page_id"]).groupBy("page_id").agg(F.count("*").alias("n"), F.sum(F.crc32("gram")).alias("s")).collect()
    for r in few:
        padded = url_filter.PAD * 4 + dict(rows)[r["page_id"]][7:]
        assert (r["n"], r["s"]) == (len(padded) - 4, sum(zlib.crc32(padded[k : k + 5].encode()) for k in range(len(padded) - 4)))


# op7


def test_mixing(spark):
    rows = fixture(200)
    docs = documents(spark, rows)
    sized, plan = mixing.mix(docs)
    out = mixing.with_draws(sized, plan, 7).select("doc_id", "source", "digest", "copy", "size", "mix_plan.target", F.col("mix_draws").alias("draws"), (F.col("size") * F.col("mix_draws")).alias("taken")).collect()
    size = Counter()
    for _, text, _, source in rows:
        size[source] += len(words_of(text))
    order = sorted((s for s in size if s is not None), key=lambda s: [ord(c) for c in s]) + [None]
    weight, total, target = {s: k % 3 + 1 for k, s in enumerate(order)}, sum(size.values()), dict.fromkeys(size, 0.0)
    capped: set = set()
    while True:
        rest = total - sum(3 * size[s] for s in capped)
        free = [s for s in size if s not in capped]
        target = {s: 3.0 * size[s] if s in capped else rest * weight[s] / sum(weight[x] for x in free) for s in size}
        over = {s for s in free if target[s] > 3 * size[s]}
        if not over:
            break
        capped |= over
    taken, largest = Counter(), Counter()
    for r in out:
        assert r["target"] == pytest.approx(target[r["source"]]) and r["taken"] in (0, r["size"], 2 * r["size"], 3 * r["size"])
        taken[r["source"]] += r["taken"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    assert all(abs(taken[s] - target[s]) <= largest[s] / 2 + 1e-6 for s in size)
    # by brute force: whole copies, certain ones, and others in the order of random odds over inclusion odds
    for source in size:
        own = [r for r in out if r["source"] == source and r["size"]]
        if not own:
            continue
        copies = math.floor(target[source] / size[source])
        rest = target[source] - copies * size[source]
        x = lambda r: math.isqrt(r["size"]) + 1
        low, high = 0.0, 1.0
        for _ in range(200):
            level = (low + high) / 2
            low, high = (level, high) if sum(min(1, level * x(r)) * r["size"] for r in own) < rest else (low, level)
        u = lambda r: (int(hashlib.md5(f"7:{r['doc_id']}:{r['digest']}:{r['copy']}".encode()).hexdigest()[:12], 16) + 0.5) / 2**48
        want, done = Counter(), 0
        for r in own:
            if level * x(r) >= 1 - 1e-9:
                want[r["doc_id"], r["size"]] += 1
                done += r["size"]
        for r in sorted((r for r in own if level * x(r) < 1 - 1e-9), key=lambda r: (u(r) / (1 - u(r)) / (level * x(r) / (1 - level * x(r))), r["doc_id"], r["digest"], r["copy"])) if rest > 0 else []:
            if done + r["size"] / 2 <= rest:
                want[r["doc_id"], r["size"]] += 1
            done += r["size"]
        assert Counter({k: n for r in own for k, n in [((r["doc_id"], r["size"]), 0)]}) | want == Counter({(r["doc_id"], r["size"]): sum(y["draws"] - copies for y in own if (y["doc_id"], y["size"]) == (r["doc_id"], r["size"])) for r in own}) | Counter(), source
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns
    assert Counter(r["doc_id"] for r in mixed.collect() if r["text"] and r["text"].strip()) == Counter({d: n for d, n in Counter(k for r in out if r["size"] for k in [r["doc_id"]] * (r["taken"] // r["size"])).items()})
    assert mixing.mixed(documents(spark, EMPTY)).count() == 0


@pytest.mark.parametrize("ids", [[None] * 400, [5] * 400, list(range(400))])
def test_mixing_meets_targets_whatever_the_ids(spark, ids):
    """Rows that share an id, or are equal altogether, are drawn each for itself."""
    rows = [(i, "one two three four five six seven eight nine ten", "en", "a") for i in ids] + [(1000 + k, "x " * 3000, "en", "b") for k in range(4)] + [(None, f"t{k % 3} " * 7, None, None) for k in range(90)]
    docs = documents(spark, rows).repartition(7)
    sized, plan = mixing.mix(docs)
    got = mixing.with_draws(sized, plan, 7).groupBy("source").agg(F.sum(F.col("size") * F.col("mix_draws")).alias("taken"), F.first("mix_plan.target").alias("target"), F.max("size").alias("largest")).collect()
    assert len(got) == 3 and all(abs(r["taken"] - r["target"]) <= r["largest"] / 2 + 1e-6 for r in got)
    again = Counter((r["doc_id"], r["source"], r["n"]) for r in mixing.mixed(docs.repartition(3)).groupBy("doc_id", "source").agg(F.count("*").alias("n")).collect())
    assert again == Counter((r["doc_id"], r["source"], r["n"]) for r in mixing.mixed(docs).groupBy("doc_id", "source").agg(F.count("*").alias("n")).collect())


# op8


def test_forward_sums_all_segmentations():
    p = language_id.pieces(language_id.VOCABULARY)
    table = np.log(np.random.default_rng(0).dirichlet(np.ones(p.size) * 0.3, 3).T + 1e-9)
    scorer = language_id.Scorer(language_id.VOCABULARY, table)

    def brute(word):
        word = language_id.SPACE + word
        a = [np.ones(3), *[np.zeros(3) for _ in word]]
        for i in range(1, len(word) + 1):
            for j in range(i):
                if word[j:i] in p.ids:
                    a[i] = a[i] + a[j] * np.exp(table[p.ids[word[j:i]]])
            if word[i - 1] not in p.ids:
                a[i] = a[i] + a[i - 1] * np.exp(sum(table[p.bytes[b]] for b in word[i - 1].encode()))
        return np.log(a[-1])

    words = ["thon,", "Mr.", "ção!!", "日本語", "กx", "a", "x" * 60, "e.g.", "|", "###"]
    for w in words:
        assert np.allclose(scorer.texts([w])[0], brute(w))
    assert np.allclose(scorer.texts([" ".join(words), ""]), [sum(map(brute, words)), np.zeros(3)])


def test_language_id_finds_all_pieces_of_words_together():
    """Places of pieces, and characters that are none, of words with common, rare and unknown characters."""
    p = language_id.pieces(language_id.VOCABULARY)
    rng = random.Random(4)
    letters = sorted({c for x in p.ids for c in x})
    words = ["", "▁the", "▁house,", "▁l'été", "▁東京", "▁\U0001f9ff☃\U0010ffff", "▁", "x", "▁" + "ab" * 40]
    words += ["▁" + "".join(rng.choice(letters + ["\U0001f9ff"]) for _ in range(rng.randrange(9))) for _ in range(300)]
    want = sorted((w, j, i, p.ids[x[j:i]]) for w, x in enumerate(words) for j in range(len(x)) for i in range(j + 1, len(x) + 1) if x[j:i] in p.ids)
    *found, lone = p.spans(words)
    assert sorted(zip(*(x.tolist() for x in found))) == want and len(want) > 1000
    assert lone == [(w, j) for w, x in enumerate(words) for j, c in enumerate(x) if c not in p.ids] and lone
    assert p.spans([])[4] == [] and not len(p.spans([""])[0])


def test_language_id_by_brute_force(spark):
    import sentencepiece

    rng = random.Random(9)
    say = lambda w, k: " ".join(rng.choice(w) for _ in range(k))
    words = {"en": ["the", "house,", "stands", "here", "Mr."], "de": ["das", "haus", "steht,", "hier", "straße"], "fr": ["la", "maison", "reste", "là,", "l'été"]}
    rows = [(k, say(words[lang], rng.randrange(1, 9)) if k % 11 else None, lang if k % 7 else None, "s") for k, lang in enumerate(rng.choice(list(words)) for _ in range(60))]
    p = language_id.pieces(language_id.VOCABULARY)
    processor = sentencepiece.SentencePieceProcessor(model_file=language_id.VOCABULARY)
    held_out = lambda d: zlib.crc32(str(d).encode()) % 5 == 0
    counts = {x: Counter() for x in words}
    for d, text, lang, _ in rows:
        if text is not None and lang and not held_out(d):
            for w in text.split():
                counts[lang].update(processor.encode(w))
    langs = sorted(counts)
    table = {x: {i: math.log((counts[x][i] + language_id.SMOOTHING) / (sum(counts[x].values()) + language_id.SMOOTHING * p.size)) for i in range(p.size)} for x in langs}

    def forward(word, lang):
        word, a = language_id.SPACE + word, [1.0]
        for i in range(1, len(word) + 1):
            a.append(sum(a[j] * math.exp(table[lang][p.ids[word[j:i]]]) for j in range(i) if word[j:i] in p.ids))
        return math.log(a[-1])

    got = {r["doc_id"]: r for r in language_id.identify(documents(spark, rows)).collect()}
    for d, text, _, _ in rows:
        r = got[d]
        assert r["held_out"] == held_out(d)
        if text is None:
            assert (r["lang_pred"], r["score"]) == ("und", 0)
            continue
        logs = [sum(forward(w, x) for w in text.split()) for x in langs]
        assert r["lang_pred"] == langs[logs.index(max(logs))] and r["score"] == pytest.approx(1 / sum(math.exp(v - max(logs)) for v in logs))


def test_language_id_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language_id.identify(docs).join(docs.select("doc_id", "lang", "text"), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    held = [r["lang"] == r["lang_pred"] for r in got if r["held_out"] and len(r["text"]) > 20]
    assert len(held) > 100 and sum(held) >= 0.98 * len(held)


def test_language_id_edge_cases(spark):
    got = {r["doc_id"]: r for r in language_id.identify(documents(spark, fixture())).collect()}
    assert all((got[k]["lang_pred"], got[k]["score"]) == ("und", 0) for k in (90, 91, 92)) and got[0]["lang_pred"] in ("en", "fr") and 0 < got[0]["score"] <= 1
    assert {r["lang_pred"] for r in language_id.identify(documents(spark, [(1, "a b", None, "x"), (2, "123", None, "x")])).collect()} == {"und"}
    assert language_id.identify(documents(spark, EMPTY)).count() == 0


def test_languages_in_blocks_are_those_of_one_table(spark, monkeypatch):
    rng = random.Random(8)
    words = {f"l{k}": ["".join(rng.choice("abcdefghijklmnop") for _ in range(5)) for _ in range(12)] for k in range(7)}
    rows = [(k, " ".join(rng.choice(words[lang]) for _ in range(15)), lang, "a") for k, lang in enumerate(rng.choice(sorted(words)) for _ in range(150))]
    rows += [(500, None, "l1", "a"), (501, "123", None, "a"), (502, rows[0][1], None, "a"), (502, rows[1][1], None, "a"), (None, rows[2][1], None, "a")]
    docs = documents(spark, rows)
    one = sorted(map(repr, ((r["doc_id"], r["held_out"], r["lang_pred"], round(r["score"], 9)) for r in language_id.identify(docs).collect())))
    monkeypatch.setattr(language_id, "LANGUAGES", 3)
    several = sorted(map(repr, ((r["doc_id"], r["held_out"], r["lang_pred"], round(r["score"], 9)) for r in language_id.identify(docs).collect())))
    assert one == several and len(one) == len(rows)


# op9


def test_top_k_answers_a_query_of_several_lengths_once(spark):
    rows = [(0, [1.0, 2.0, 3.0]), (0, [1.0, 1.0]), (0, [0.5, 9.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [5.0, 5.0, 5.0])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("rank").collect()
    assert [tuple(r) for r in got] == [(0, 1, 2, 9 * 64 * 64), (0, 2, 1, 32 * 64)]


def test_top_k(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD", 16)
    monkeypatch.setattr(topk, "QUERIES", 3)
    rng = random.Random(2)
    rows = [(k, [rng.choice([-0.5, 0.25, 0.1, 1e9 if k == 7 else 0.3]) for _ in range(4)]) for k in range(160)]
    rows += [(200, None), (220, [1.0, None, 2.0, 3.0]), (240, [float("nan")] * 4), (260, [float("inf"), 0.0, 0.0, 0.0]), (280, [1.0, 2.0]), (281, [3.0, 4.0]), (20, rows[20][1]), (300, [])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("block", F.lit(1)).withColumn("score", F.lit("x"))
    got = topk.top_k(v, k=5).collect()
    ok = [(i, [math.floor(64 * x) for x in e]) for i, e in rows if e is not None and all(x is not None and math.isfinite(x) for x in e)]
    want = set()
    for q, e in dict(ok).items():
        if q % 20 == 0:
            scores = sorted((-sum(a * b for a, b in zip(e, f)), i) for i, f in ok if i != q and len(e) == len(f))[:5]
            want |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(scores)}
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert topk.top_k(v.limit(0)).count() == 0


# op10


def brute_components(rows, k, num, den):
    sets = {}
    for d, text, *_ in rows:
        w = words_of(folded(text))
        sets[d] = frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and den * both >= num * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in sets}


def small_groups(monkeypatch):
    for name, value in (("GROUP", 3), ("TOKENS", 900), ("ASKING", 4), ("FREQUENT", 10), ("SALTS", 3)):
        monkeypatch.setattr(ngram_join, name, value)


def test_ngram_join_of_nothing(spark):
    assert ngram_join.join(documents(spark, EMPTY)).count() == 0
    got = ngram_join.join(documents(spark, [(1, None, None, None), (2, "", None, None), (3, "a b", None, None), (4, "A b", None, None)])).collect()
    assert {tuple(r)[:4] for r in got} == {(1, 0, 1, 0), (2, 0, 2, 0), (3, 1, 3, 1), (4, 1, 3, 1)}


@pytest.mark.parametrize("dealt,num", [(False, 85), (True, 85), (True, 70)])
def test_ngram_join(spark, monkeypatch, dealt, num):
    if dealt:
        small_groups(monkeypatch)
    rows = fixture()
    sets = []
    for _, text, *_ in rows:
        w = words_of(folded(text))
        sets.append(frozenset(tuple(w[i : i + 4]) for i in range(len(w) - 3)) if len(w) >= 4 else frozenset([tuple(w)] if w else []))
    want = Counter()
    for i, a in enumerate(sets):
        links = sum(bool(a & b) and 100 * len(a & b) >= num * len(a | b) for j, b in enumerate(sets) if j != i)
        want[rows[i][0], links] += 1
    got = ngram_join.join(documents(spark, rows), 4, num, 100).collect()
    assert len(got) == len(rows)
    assert Counter((r["doc_id"], r["n_links"]) for r in got) == want and max(n for _, n in want) > 5
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_components(rows, 4, num, 100)


def test_ngram_join_of_near_copies_of_one_text_makes_few_rows(spark):
    """Groups of near copies meet group by group: not each copy with each group for each shingle."""
    sets = pd.DataFrame([(7, 0, t, s, 100) for s in range(300) for t in range(15)], columns=["g", "part", "token", "sid", "n"])
    cells = pd.DataFrame([(7, 0, h, t, 90 + h, 100 + h) for h in range(20) for t in range(15)], columns=["g", "part", "group", "token", "least", "most"])
    got = ngram_join.hot_pairs(85, 100)(sets, cells)
    assert len(got) == 6000 and set(got["c"]) == {15} and (got["least"] == 90 + got["group"]).all() and (got["most"] == 100 + got["group"]).all()
    far = ngram_join.hot_pairs(85, 100)(sets, cells.assign(least=10, most=20))
    assert len(far) == 0


def test_ngram_join_puts_near_copies_of_one_text_into_few_groups(spark, monkeypatch):
    """Four times the near copies don't make sixteen times the pairs of groups, and every link is found."""
    kept, rows_of = ngram_join.written, {}

    def counted(df, name):
        out = kept(df, name)
        rows_of[name] = out.count()
        return out

    monkeypatch.setattr(ngram_join, "written", counted)
    made = []
    for n in (100, 400):
        rng = random.Random(7)
        rows = []
        for i in range(n):
            words = [f"w{j}" for j in range(150)]
            for at in rng.sample(range(150), 3):
                words[at] = f"x{i} y{at}"
            rows.append((i, " ".join(words), "en", "a"))
        docs = documents(spark, rows).repartition(4)
        got = ngram_join.join(docs, 4, 85, 100).collect()
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_components(rows, 4, 85, 100)
        made.append(rows_of["cells"])
    assert made[1] < 6 * made[0]


def test_written_tables_leave_no_shuffles_behind(spark):
    def shuffled():
        return sum("shuffle_" in x for x in str(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()).split(","))

    docs = spark.range(20_000).repartition(7, "id")
    before = shuffled()
    assert written(docs.groupBy((F.col("id") % 10).alias("k")).count(), "counts").count() == 10
    for _ in range(50):
        if shuffled() <= before + 4:  # of the count: one of the tasks that read the table
            break
        time.sleep(0.1)
    assert shuffled() <= before + 4 and spark.conf.get(CLEANED) == "false"


def test_exact_dedup_of_null_ids(spark):
    rows = [(None, "a"), (None, "A"), (None, "b"), (3, "b"), (None, "c")]
    got = exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in got) == Counter([(None, None, 2, None)] * 2 + [(None, 3, 2, None), (3, 3, 2, True), (None, None, 1, None)])


def test_ngram_join_of_null_and_repeated_ids(spark):
    rows = [(None, "a b"), (2**60 + 1, "A b"), (None, "x y z w q"), (None, "x y z w q"), (5, None), (None, "")]
    got = ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string")).drop("key").collect()
    big = 2**60 + 1
    assert Counter(map(tuple, got)) == Counter([(None, 1, big, 1, True), (big, 1, big, 1, False), (None, 1, None, 1, True), (None, 1, None, 1, True), (5, 0, 5, 0, True), (None, 0, None, 0, True)])


def test_ngram_join_keeps_rows_that_share_an_id_with_a_dropped_one(spark):
    say = lambda k: " ".join(f"w{(k * 7919 + i) % 10007}" for i in range(40))
    rows = [(5, say(1)), (9, say(1) + " more"), (9, say(2)), (3, say(2) + " words"), (9, say(3))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("gone_id", F.lit(9))
    got = ngram_join.kept_rows(docs)
    assert got.columns == docs.columns and Counter((r["doc_id"], r["text"]) for r in got.collect()) == Counter([rows[0], rows[3], rows[4]])
