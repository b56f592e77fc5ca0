"""URL filters: rules, and the ratio of two character language models where no rule fits (DataFrame operations only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reliefspark.llm.common import LOWER, UPPER, read_table, small, written

#: (host, path, verdict). A rule fits its host and all subdomains, if the path starts with the rule's.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: Characters of context; one fold in FOLDS of the URLs that rules decide calibrates the ratio.
ORDER, FOLDS = 4, 5
#: Share of calibrating accepted URLs that may be rejected, and the step of the ratios' histogram.
FALSE_BLOCKS, STEP = 0.01, 0.01
#: Rows of ratios, by gram or by URL, that may be broadcast.
RATIOS = 300_000
PAD = "\x02"
#: Characters of the pieces into which URLs are cut, first and then.
PIECES = (16_384, 256)


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL; both empty for null and for a text without ://."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"(?s)^[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return host, path


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """(rule, verdict) of the longest rule that fits, else null."""
    out = None
    for h, p, verdict in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r)):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        value = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out if out is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def grams(urls: DataFrame, order: int, columns: list[str]) -> DataFrame:
    """gram and columns of urls (url, columns), a row for each character: it after `order` characters of context.

    A URL is cut into pieces and these into smaller ones, each beginning with its context: finding a character's place
    reads its string from the start, so time is in proportion to a URL's length only while strings are short.
    """
    cut = urls.filter(F.length("url") > 0).select(*columns, F.concat(F.lit(PAD * order), F.col("url")).alias("s"))
    for size in PIECES:
        at = F.explode(F.sequence(F.lit(0), F.floor((F.length("s") - order - 1) / size).cast("int"))).alias("at")
        cut = cut.select(*columns, "s", at).select(*columns, F.substring(F.col("s"), F.col("at") * size + 1, F.lit(size + order)).alias("s"))
    cut = cut.select(*columns, "s", F.explode(F.sequence(F.lit(1), F.length("s") - order)).alias("at"))
    return cut.select(*columns, F.substring(F.col("s"), F.col("at"), F.lit(order + 1)).alias("gram"))


def model(counts: DataFrame, order: int) -> DataFrame:
    """gram, ratio: log P(rejected) - log P(accepted) of its last character, from counts (gram, accepted, rejected).

    Each class has a Markov model of variable order, smoothed by Witten and Bell: a context of n characters seen before
    t different characters trusts itself by n / (n + t), and else the context shorter by one.
    """
    last, below = None, None
    for k in range(order + 1):
        g = F.substring("gram", order + 1 - k, k + 1)
        t = counts.groupBy(g.alias("g")).agg(F.sum("accepted").alias("a"), F.sum("rejected").alias("r"))
        context = W.partitionBy(F.substring("g", 1, k)) if k else W.partitionBy(F.lit(0))
        t = t.select("g", "a", "r", *[F.sum(c).over(context).alias(f"{c}_n") for c in "ar"], *[F.sum((F.col(c) > 0).cast("long")).over(context).alias(f"{c}_t") for c in "ar"])
        if below is None:
            # each character that occurs, and one for all others
            every = W.partitionBy(F.lit(0))
            t = t.withColumn("a_below", 1 / (F.count("g").over(every) + 1)).withColumn("r_below", F.col("a_below"))
        else:
            t = t.join(below, F.substring(F.col("g"), 2, k) == F.col("shorter"))
        p = lambda c: F.when(F.col(f"{c}_n") + F.col(f"{c}_t") > 0, (F.col(c) + F.col(f"{c}_t") * F.col(f"{c}_below")) / (F.col(f"{c}_n") + F.col(f"{c}_t"))).otherwise(F.col(f"{c}_below"))
        last = written(t.select(F.col("g"), p("a").alias("pa"), p("r").alias("pr")), "order")
        below = last.select(F.col("g").alias("shorter"), F.col("pa").alias("a_below"), F.col("pr").alias("r_below"))
    return last.select(F.col("g").alias("gram"), (F.log("pr") - F.log("pa")).alias("ratio"))


def threshold(hist: list[tuple[int, int, int]]) -> float:
    """The least ratio, not below 0, beyond which at most FALSE_BLOCKS of the accepted URLs lie; infinite without either class.

    hist: (cell of STEP, accepted, rejected). A ratio is a mean of differences of logarithms of at most order + 1 products
    of shares of counts, so cells lie within some thousands of 0.
    """
    accepted, rejected = sum(a for _, a, _ in hist), sum(r for _, _, r in hist)
    if not accepted or not rejected:
        return float("inf")
    over, cut = 0, 0
    for cell, a, _ in sorted(hist, reverse=True):
        if over + a > FALSE_BLOCKS * accepted:
            cut = max(0, cell + 1)
            break
        over += a
    return cut * STEP


def scores(urls: DataFrame, order: int) -> DataFrame:
    """urls (key, url, accepted, rejected, learns) with the ratio of each by models of those that learn."""
    counts = grams(urls, order, ["accepted", "rejected", "learns"]).groupBy("gram").agg(*[F.sum(F.col(c) * F.col("learns")).alias(c) for c in ("accepted", "rejected")])
    ratios = written(model(written(counts, "grams"), order), "ratios")
    scored = grams(urls, order, ["key"]).join(small(ratios, RATIOS), "gram").groupBy("key").agg(F.avg("ratio").alias("ratio"))
    return written(urls.join(scored, "key"), "scored")


def filter_urls(pages: DataFrame, rules=RULES, order: int = ORDER, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, ratio of every row.

    URLs that a rule decides are the models' examples, accepted or rejected; one in FOLDS, by the URL's crc32,
    calibrates instead. Where no rule fits, a URL is blocked if its length-normalised log-likelihood difference (ratio)
    exceeds the calibrated threshold; without examples of both classes all such URLs are allowed. URLs are learned and
    scored whole: all that follows ://, A-Z lower-cased. Null URLs, those without :// and empty ones have empty host and
    path, ratio 0, and are allowed unless a rule fits. Rows repeated with one id are judged each; null ids stay null.
    Other columns are never read. An empty table gives no rows.

    Equal URLs are scored once, in time in proportion to their length, and empty ones take no part in any join. Counts
    are summed by task before they are shuffled; no key keeps its rows together. URLs are broadcast up to RATIOS rows
    and common.BROADCAST_BYTES.
    """
    host, path = parts(F.col(url_col))
    said = F.when(F.instr(F.col(url_col), "://") > 0, F.translate(F.substring(F.col(url_col), F.instr(F.col(url_col), "://") + 3, F.length(url_col)), UPPER, LOWER)).otherwise("")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), host.alias("host"), path.alias("path"), F.coalesce(said, F.lit("")).alias("url"))
    rows = written(rows.withColumn("decided", rule_of(F.col("host"), F.col("path"), rules)), "urls")
    verdict = F.col("decided.verdict")
    urls = rows.filter("url <> ''").groupBy("url").agg(*[F.coalesce(F.sum((verdict == v).cast("long")), F.lit(0)).alias(c) for c, v in (("accepted", "allow"), ("rejected", "block"))])
    urls = urls.withColumn("learns", (F.crc32(F.col("url").cast("binary")) % FOLDS != 0).cast("long"))
    judged = scores(written(urls.withColumn("key", F.monotonically_increasing_id()), "distinct-urls"), order)
    hist = judged.filter("learns = 0 and accepted + rejected > 0").groupBy(F.round(F.col("ratio") / STEP).cast("int").alias("cell")).agg(F.sum("accepted").alias("a"), F.sum("rejected").alias("r")).collect()
    cut = threshold([(x["cell"], x["a"], x["r"]) for x in hist])
    out = rows.filter("url <> ''").join(small(judged.select("url", "ratio"), RATIOS, F.octet_length("url")), "url").unionByName(rows.filter("url = ''").withColumn("ratio", F.lit(0.0)))
    return out.select("page_id", "host", "path", F.col("decided.rule").alias("rule"), F.coalesce(verdict, F.when(F.col("ratio") > F.lit(cut), "block").otherwise("allow")).alias("verdict"), "ratio")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(read_table(spark, sf_dir, "pages"))
