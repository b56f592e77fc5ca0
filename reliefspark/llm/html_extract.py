"""Main text of web pages by wrapper induction: pages of a host are aligned, constant parts are template, varying slots content."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reliefspark.llm import dom
from reliefspark.llm.common import LOWER, UPPER, read_table, small, small_batches, written

#: Pages from which a host's constant text counts as its template, and the share of its pages that have it.
LEAST, SHARE = 5, 0.8
#: Distinct slots of a page or wrapper; pages with more are judged alone, wrappers lose their rarest slots.
SLOTS = 1000
#: Hosts, aligned shapes and texts that a task holds before it passes them on.
HOSTS, SHAPES, TEXTS = 1000, 200, 50_000
#: Tasks that share a host's wrappers, or its pages where wrappers aren't broadcast, and the bytes up to which they are.
SPREAD, BROADCAST = 16, 16_000_000
SEEN = "host string, wrapper string, place long, pages long, letters long"


def host_of(url: Column) -> Column:
    """What follows the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null and without ://."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))
    return F.translate(F.regexp_extract(F.coalesce(rest, F.lit("")), r"(?s)^[^/?#]*", 0), UPPER, LOWER)


class Inducer:
    """A host's wrapper while pages are added; a shape that was aligned before isn't aligned again."""

    def __init__(self):
        self.wrapper, self.shapes = dom.Slot("body"), {}

    def add(self, page: dom.Skeleton) -> None:
        parts = dom.slots(page)
        known = self.shapes.get(page.shape)
        if known is None:
            pairs = dom.merge(self.wrapper, page)
            if len(self.shapes) >= SHAPES:
                self.shapes.clear()
            self.shapes[page.shape] = [pairs[id(p)] for p in parts]
            trimmed(self)
            return
        for p, w in zip(parts, known):
            w.text = w.text if w.text == p.text else None
            w.pages, w.chars, w.links = w.pages + 1, w.chars + p.chars, w.links + p.links


def trimmed(inducer: Inducer) -> None:
    """The rarest slots go while a wrapper has more than SLOTS."""
    every = dom.slots(inducer.wrapper)
    if len(every) > SLOTS:
        bar = sorted((s.pages for s in every), reverse=True)[SLOTS // 2]
        for s in every:
            s.kids = [k for k in s.kids if k.pages > bar]
        inducer.shapes.clear()


def seen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (host, wrapper, pages) of the hosts of a task's pages, and (host, place, pages, letters) of texts by where they stand."""
    hosts: dict[str, Inducer] = {}
    texts: dict[tuple[str, int], list[int]] = {}

    def rows() -> pd.DataFrame:
        found = [(h, json.dumps(i.wrapper.packed()), None, i.wrapper.pages, None) for h, i in hosts.items()]
        found += [(h, None, place, n, letters) for (h, place), (n, letters) in texts.items()]
        hosts.clear()
        texts.clear()
        columns = zip(*found) if found else [()] * 5
        kinds = zip(["host", "wrapper", "place", "pages", "letters"], [object, object, "Int64", "Int64", "Int64"])
        return pd.DataFrame({name: pd.array(list(c), dtype=kind) for (name, kind), c in zip(kinds, columns)})

    for pdf in batches:
        for host, html in zip(pdf["host"], pdf["html"]):
            root = dom.parse(html)
            page = dom.skeleton(root)
            if len(dom.slots(page)) <= SLOTS:
                hosts.setdefault(host, Inducer()).add(page)
            for place, letters in {p: n for _, p, n in dom.paths(root)}.items():
                texts.setdefault((host, place), [0, letters])[0] += 1
            if len(hosts) > HOSTS or len(texts) > TEXTS:
                yield rows()
    yield rows()


def merged(pdf: pd.DataFrame) -> pd.DataFrame:
    """One wrapper of several of a host, in an order of their own."""
    inducer = Inducer()
    for w in sorted(pdf["wrapper"], key=lambda w: (-json.loads(w)[1], w)):
        dom.merge(inducer.wrapper, dom.Slot.unpacked(json.loads(w)))
        trimmed(inducer)
    return pd.DataFrame({"host": [pdf["host"].iloc[0]], "wrapper": [json.dumps(inducer.wrapper.packed())], "pages": [pdf["pages"].sum()]})


def wrappers(pages: DataFrame) -> DataFrame:
    """host, wrapper, constants of each host of pages (host, html): the slots of its aligned pages, and the texts that are template.

    A text is template if it stands in one place in SHARE of the host's pages, LEAST of them or more. Where such texts make more
    than half of all text, the pages are copies of each other and not one template, and none counts.
    Tasks align their own pages first; a host's wrappers are merged in two steps, its texts counted by partial sums.
    """
    found = written(small_batches(pages).mapInPandas(seen, SEEN), "html-seen")
    parts = found.filter("wrapper is not null").select("host", "wrapper", "pages")
    schema = "host string, wrapper string, pages long"
    few = parts.groupBy("host", F.pmod(F.xxhash64("wrapper"), F.lit(SPREAD))).applyInPandas(lambda key, pdf: merged(pdf), schema)
    one = written(few.groupBy("host").applyInPandas(merged, schema), "html-wrappers")
    texts = written(found.filter("place is not null").groupBy("host", "place").agg(F.sum("pages").alias("n"), F.max("letters").alias("letters")).filter(f"n >= {LEAST}"), "html-texts")
    every = found.filter("place is not null").groupBy("host").agg(F.sum(F.col("pages") * F.col("letters")).alias("all"))
    sizes = written(one.select("host", "pages").join(every, "host"), "html-sizes")
    often = texts.join(small(sizes), "host").filter(F.col("n") >= SHARE * F.col("pages"))
    constant = often.groupBy("host").agg(F.collect_list("place").alias("constants"), F.sum(F.col("n") * F.col("letters")).alias("same"), F.max("all").alias("all"))
    constant = constant.filter("2 * same <= all").select("host", "constants")
    return written(one.select("host", "wrapper").join(constant, "host", "left"), "html-hosts")


def extractor(cache: dict):
    """f(host's wrapper, constants, html) -> text; wrappers that were read are kept in `cache`."""

    def text_of(packed: str | None, constants, page: str) -> str:
        root = dom.parse(page)
        skeleton = dom.skeleton(root)
        parts = dom.slots(skeleton)
        nodes = []
        if packed and len(parts) <= SLOTS:
            if packed not in cache:
                if len(cache) >= HOSTS:
                    cache.clear()
                wrapper = dom.Slot.unpacked(json.loads(packed))
                cache[packed] = wrapper, {id(s) for s in dom.content(wrapper, LEAST)}, {}
            wrapper, chosen, shapes = cache[packed]
            if skeleton.shape not in shapes:
                if len(shapes) >= SHAPES:
                    shapes.clear()
                pairs = {id(p): id(w) for w, p in dom.aligned(wrapper, skeleton)}
                shapes[skeleton.shape] = [k for k, p in enumerate(parts) if pairs.get(id(p)) in chosen]
            nodes = [n for k in shapes[skeleton.shape] for n in parts[k].nodes]
        blocks = {b[0]: b[1] for n in nodes for b in dom.blocks_in(n)}
        if not blocks:  # no wrapper, or a page unlike its host's others
            alone = dom.Slot("body")
            pairs = dom.merge(alone, skeleton)
            back = {id(pairs[id(p)]): p for p in parts}
            blocks = {b[0]: b[1] for s in dom.content(alone, LEAST) for n in back[id(s)].nodes for b in dom.blocks_in(n)}
        if constants is not None and len(constants):
            same = set(constants)
            for place, digest, _ in dom.paths(root):
                if digest in same:
                    blocks.pop(place, None)
        return "\n".join(blocks[k] for k in sorted(blocks))

    return text_of


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars: the main text of each row's whole page, blocks in page order, joined by line feeds.

    Character references are decoded, white space within a block is one space, and br is white space. Elements that are
    never the article (menus, asides, forms and so on, by name, class, id or role) lie apart. The rest is aligned with the
    wrapper of the page's host by simple tree matching: the slots of the article are those of its article or main element,
    or else of the innermost container of most varying text; constant texts within them go as template. A page that its
    host's wrapper doesn't fit, a page of more than SLOTS distinct slots and a page without host is judged alone.

    Null and empty pages have an empty text. Rows repeated are pages of their own; null ids and URLs stay. Other columns are never
    read. An empty table has no rows. Pages are read twice; wrappers, a few kilobytes a host, are broadcast up to
    BROADCAST bytes, else joined by host, each host's pages dealt to SPREAD keys.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), host_of(F.col(url_col)).alias("host"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    hosts = wrappers(rows.filter("host <> '' and html <> ''").select("host", "html"))
    size = hosts.agg(F.sum(F.octet_length("host") + F.octet_length("wrapper") + 8 * F.greatest(F.size("constants"), F.lit(0)))).first()[0] or 0
    if size <= BROADCAST:
        met = rows.join(F.broadcast(hosts), "host", "left")
    else:
        spread = hosts.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SPREAD - 1).cast("long"))))
        met = rows.withColumn("salt", F.pmod(F.xxhash64("html"), F.lit(SPREAD).cast("long"))).join(spread, ["host", "salt"], "left")

    def texts(batches):
        text_of = extractor({})
        for pdf in batches:
            text = [text_of(w, c, h) if h else "" for w, c, h in zip(pdf["wrapper"], pdf["constants"], pdf["html"])]
            yield pd.DataFrame({"page_id": pdf["page_id"], "url": pdf["url"], "text": text, "n_chars": pd.Series([len(t) for t in text], dtype="int64")})

    id_type = dict(rows.dtypes)["page_id"]
    # ids go as text, which keeps long ones beside nulls
    met = small_batches(met).select(F.col("page_id").cast("string").alias("page_id"), "url", "html", "wrapper", "constants")
    out = met.mapInPandas(texts, "page_id string, url string, text string, n_chars long")
    return out.withColumn("page_id", F.col("page_id").cast(id_type))


def op13_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read_table(spark, sf_dir, "pages"))
