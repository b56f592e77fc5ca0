"""Merkle manifest, exact clustering and HTML extraction against brute-force versions."""

import hashlib
import html as entities
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from reliefspark.llm import centroids, dom, html_extract, merkle

SF = "/root/testdata/sf0.001"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def encoded(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def climb(nodes):
    """(top, for each node its siblings by level) of a tree given its first level."""
    siblings, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[k : k + 8] for k in range(0, len(nodes), 8)]
        for leaf, i in enumerate(at):
            run = runs[i // 8]
            siblings[leaf].append((run[: i % 8], run[i % 8 + 1 :]))
        at, nodes = [i // 8 for i in at], [H(*run) for run in runs]
    return nodes[0], siblings


def manifest(rows):
    """rows (doc_id, source, lang, n_chars, text) -> what op11 returns, sorted."""
    groups = defaultdict(list)
    for r in rows:
        text = r[4] and re.sub("[A-Z]", lambda m: m[0].lower(), r[4])
        changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
        leaf = H(*map(encoded, r))
        groups[r[2]].append((r[0] is not None, r[0], leaf, H(*map(encoded, (*r[:4], text))) if changed else leaf))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    tops = {g: climb([x[2] for x in sorted(groups[g])]) for g in order}
    root, upper = climb([tops[g][0] for g in order]) if order else (None, [])
    out = []
    for g, above in zip(order, upper):
        for leaf, below in zip(sorted(groups[g]), tops[g][1]):
            fold = leaf[3]
            for left, right in below + above:
                fold = H(*left, fold, *right)
            proof = "".join(h for left, right in below + above for h in left + right)
            out.append((leaf[1], leaf[2], tops[g][0], root, H(proof), fold, fold == root))
    return sorted(map(repr, out))


def documents(spark, rows):
    """Columns whose names the operator uses itself lie beside the table's."""
    return spark.createDataFrame([(*r, 1, "x", 2, None) for r in rows], "doc_id long, source string, lang string, n_chars long, text string, idx long, key string, n long, h string")


@pytest.fixture
def op11(spark, tmp_path):
    def run(rows):
        documents(spark, rows).repartition(3).write.parquet(f"{tmp_path}/{len(rows)}/documents.parquet")
        return sorted(repr(tuple(r)) for r in merkle.op11_merkle(spark, f"{tmp_path}/{len(rows)}").collect())

    return run


def test_manifest_is_the_brute_force_one(op11):
    rng = random.Random(3)
    say = lambda: rng.choice([None, "", "Ab " * rng.randrange(9), "ÄÖ A", "x" * 3000])
    rows = [(k, rng.choice(["a", None]), rng.choice(["en", "en", "en", "en", "de", "fr", None, ""]), rng.choice([None, k]), say()) for k in range(650)]
    rows += [(None, None, None, None, None), (None, "a", "en", 1, "B"), (7, "a", "en", 1, "B"), *[(9, "a", "en", 3, "Same")] * 30, (-5, "a", "only", 3, "Alone")]
    rows += [(1000 + k, None, f"l{k}", None, "A") for k in range(70)]  # more groups than one node has children
    assert op11(rows) == manifest(rows)


@pytest.mark.parametrize("n", [0, 1, 8, 9, 65])
def test_manifest_of_small_groups(op11, n):
    rows = [(k, "s", "en", k, f"T{k}") for k in range(n)]
    assert op11(rows) == manifest(rows)


def test_proof_leads_to_the_root_and_no_other_does(spark):
    docs = documents(spark, [(k, "s", "en" if k % 3 else None, k, f"T{k}") for k in range(100)])
    m = merkle.manifest(docs)
    fold = lambda leaf: merkle.folded(leaf, F.col("proof"), F.col("steps")) == F.col("root")
    assert m.filter(fold(F.col("leaf"))).count() == 100 and m.filter(fold(F.unhex(F.sha2(F.col("id").cast("string"), 256)))).count() == 0


# op12


def clusters(rows, k=8, rounds=10):
    """(id, cluster, distance) and the final centroids, in Python's integers."""
    kept = [(i, [int(np.floor(1024 * np.float64(c))) for c in v]) for i, v in rows if v is not None and len(v) == 64 and all(c is not None and np.isfinite(c) for c in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    cents = [v for _, v in order[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(cents))
    for _ in range(rounds):
        of = [near(v)[1] for _, v in kept]
        for j in range(len(cents)):
            own = [v for (_, v), o in zip(kept, of) if o == j]
            if own:
                cents[j] = [sum(column) // len(own) for column in zip(*own)]
    return [(i, near(v)[1], near(v)[0]) for i, v in kept], cents


def vectors(spark, rows, kind="float"):
    return spark.createDataFrame([(i, v, 1, 2) for i, v in rows], f"vec_id long, embedding array<{kind}>, cluster int, n int")


def test_clusters_are_exact(spark, tmp_path):
    rng = np.random.default_rng(5)
    f32 = lambda v: [float(np.float32(c)) for c in v]
    rows = [(k, f32(rng.normal(size=64) + 3 * (k % 5))) for k in range(150)]
    rows += [(None, f32(rng.normal(size=64))), (3, f32(rng.normal(size=64))), *[(400 + k, [0.5] * 64) for k in range(60)], (500, [0.0] * 64), (501, [-0.0] * 64)]
    rows += [(600, None), (601, []), (602, [1.0] * 63), (603, [float("nan")] * 64), (604, [float("inf")] * 64), (605, [None] * 64), (606, [1.0] * 65)]
    vectors(spark, rows).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = centroids.op12_centroids(spark, str(tmp_path)).collect()
    want, cents = clusters(rows)
    assert sorted(map(repr, want)) == sorted(repr((r["vec_id"], r["cluster"], r["distance"])) for r in got)
    within = defaultdict(int)
    for _, j, d in want:
        within[j] += d
    for r in got:
        assert (r["cluster_inertia"], r["inertia"]) == (within[r["cluster"]], sum(within.values()))
        assert r["centroid_sha256"] == H(",".join(map(str, cents[r["cluster"]])))


@pytest.mark.parametrize("rows", [[], [(1, [1.0] * 64)], [(k, [2.0] * 64) for k in range(20)], [(1, None), (2, [1.0])]])
def test_clusters_of_few_vectors(spark, rows):
    found, cents = centroids.cluster(vectors(spark, rows))
    want, want_cents = clusters(rows)
    assert sorted(map(tuple, found.collect())) == sorted(want) and cents == want_cents


def test_clusters_of_huge_components(spark):
    rows = [(k, [float(10 ** (k % 30))] * 63 + [-1e12]) for k in range(40)]
    found, cents = centroids.cluster(vectors(spark, rows, "double"), rounds=3)
    want, want_cents = clusters(rows, rounds=3)
    assert sorted(map(repr, (tuple(r) for r in found.collect()))) == sorted(repr((i, j, d if d < 2**63 else None)) for i, j, d in want) and cents == want_cents


def test_screening_never_loses_the_nearest():
    rng = np.random.default_rng(1)
    for size in (3, 1000, 2**27 - 1):
        base = rng.integers(-size, size, 64)
        cents = base + rng.integers(-2, 3, (8, 64))  # so near each other that float32 can't tell
        x = np.clip(np.r_[base + rng.integers(-3, 4, (200, 64)), rng.integers(-size, size, (200, 64)), cents], -(2**27), 2**27).astype(float)
        cents[5] = cents[2]  # a tie
        best, open_ = centroids.shortlist(x.astype(np.int64), cents)
        d = ((x[:, None].astype(object) - cents[None].astype(object)) ** 2).sum(2)
        exact = np.array([min(range(8), key=lambda j: (row[j], j)) for row in d])
        assert all(open_[i, j] for i, j in enumerate(exact)) and (centroids.nearest(x, cents.tolist()) == exact).all()
    assert (open_[:200].sum(1) == 1).mean() < 0.5  # the intervals overlap here, so integers decided


# op13


def article_of(page):
    """The article of the given tables' pages, by patterns."""
    inner = re.sub("<b>|<br>", "", re.search("<article>(.*?)</article>", page, re.S)[1])
    blocks = [" ".join(entities.unescape(b).split()) for b in re.split("</?(?:p|h1)>", inner)]
    return "\n".join(b for b in blocks if b)


def test_html_of_the_tables(spark):
    want = {r["page_id"]: article_of(r["html"]) for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()}
    got = html_extract.op13_html(spark, "/root/testdata/sf0.01").collect()
    assert {r["page_id"]: r["text"] for r in got} == want and len(got) == len(want) and all(r["n_chars"] == len(r["text"]) for r in got)


def pages(spark, rows):
    return spark.createDataFrame([(*r, "w", "h", 1) for r in rows], "page_id long, url string, html string, wrapper string, host string, pages long")


def prose(rng, n=40):
    return " ".join(rng.choice("lorem ipsum dolor sit amet consectetur elit sed do eiusmod".split()) + rng.choice(["", "", ",", "."]) for _ in range(n)).strip()


def blind(rng, k):
    """A page whose elements have no telling names: what is template shows only beside the host's other pages."""
    blocks = [prose(rng) for _ in range(rng.randrange(2, 6))]
    body = "".join(f"<div class=x{k % 7}9>{b}</div>" if rng.random() < 0.2 else f"<p>{b}</p>" for b in blocks)
    title = prose(rng, 6)
    page = (
        f"<html><body><div class=a><div>Our site, the best of all sites there are, with news and views from all over</div><div>{prose(rng, 3)}</div></div>"
        f"<div class=b><div class=c><h1>{title}</h1>{body}<p>Read more of this in our printed edition, every Sunday.</p></div><div class=d><p>{prose(rng, 8)}</p><p>Always the same long text beside the page, for the readers of all pages.</p></div></div>"
        f"<div class=e>All rights reserved by the owners of this site, wherever they are</div></body></html>"
    )
    return page, "\n".join(" ".join(b.split()) for b in [title, *blocks])


def test_html_wrapper_tells_template_from_content(spark):
    rng = random.Random(4)
    made = [blind(rng, k) for k in range(40)]
    rows = [(k, f"http://One.example/{k}", page) for k, (page, _) in enumerate(made)]
    got = {r["page_id"]: r["text"] for r in html_extract.extract(pages(spark, rows).repartition(5)).collect()}
    assert got == {k: text for k, (_, text) in enumerate(made)}


def test_html_copies_on_a_host_are_no_template(spark):
    rng = random.Random(5)
    same = "".join(f"<p>{prose(rng)}</p>" for _ in range(4))
    rows = [(k, "http://copies.example/", f"<html><body><article><h1>Copy</h1>{same}<p>{k}</p></article></body></html>") for k in range(30)]
    got = {r["page_id"]: r["text"] for r in html_extract.extract(pages(spark, rows)).collect()}
    assert got == {k: "\n".join(["Copy", *re.findall("<p>(.*?)</p>", same), str(k)]) for k in range(30)}


MESSY = """<html><body class="has-comments"><header><h1>Site</h1><p>motto</p></header><div id="nav-menu"><a href=x>Home</a></div>
<div class="layout with-sidebar"><div class=c1><h1>Title &amp; more</h1><p>First <b>bold</b>&nbsp;and <a href="/x>y">link</a>.</p><p>Second<br>line &lt;x&gt; a<p>Third unclosed<ul><li>one<li>two</ul>
<div class="newsletterBox newsletter">Subscribe</div><ul><li><a href=1>Menu one</a><li><a href=2>Menu two</a></ul><blockquote>Quote</blockquote><table><tr><td>a<td>b<tr><td>c</table></div><div class="sidebar">beside</div></div>
<form action=x><label>Name</label><input><p>Form text</p></form><section id="comments"><p>A very long comment of a reader. {}</p></section><div class=cookie-notice>We use cookies</div><footer>c</footer><script>var x="<div>"</script><style>p</style></body></html>""".format("words and " * 60)


def test_html_edge_cases(spark):
    hosts = ["http://a.example/", None, "no scheme", "http://b.example"]
    odd = {
        None: "", "": "", " \n": "", "plain &amp text": "plain & text", "a<b>c": "ac", "<p": "", "x <": "x <", "<!-- x": "", "<script>p": "", "<title>t</title>": "", "&#0;&#xD800;&nbsp;x": "�� x",
        "<div>" * 5000 + "x": "x", "<p>" * 3000 + "y": "y", '<a title="q>z</a> text': "z text", "<style>p</style >z": "z", "<nav>n</nav>": "", MESSY: "Title & more\nFirst bold and link.\nSecond line <x> a\nThird unclosed\none\ntwo\nQuote\na\nb\nc",
        "<main><p>m</p><article><h1>T</h1><p>body of it</p></article><article class=comment><p>no</p></article></main>": "T\nbody of it", "<p>" + "word " * 200_000 + "</p>": " ".join(["word"] * 200_000),
    }
    odd |= {
        '<p title="the hidden truth, aria-hidden=true">kept</p><p hidden>not</p><p aria-hidden="true">nor</p><div style="display: none">this</div>': "kept",
        '<div class="entry-header"><h1>T</h1></div><div class="entry-content sidebar-right"><h2>U</h2><p>' + "body " * 30 + '</p></div><div class="google-ad">x</div>': "T\nU\n" + ("body " * 30).strip(),
        "<body><header><h1>Site</h1><nav>n</nav></header><main><article><header><h1>T</h1><p>by A</p></header><p>a</p><aside>s</aside><div class=share>x</div><p>b</p></article><section class=comments><article><p>a reader who has more to say than the author</p></article></section></main><footer>f</footer>": "T\na\nb",
    }
    rows = [(k, hosts[k % 4], page) for k, page in enumerate(odd)] + [(None, None, "<p>a</p>"), (2**60 + 1, hosts[0], "<p>b</p>"), (2**60 + 1, hosts[0], "<p>b</p>")]
    got = html_extract.extract(pages(spark, rows))
    assert got.columns == ["page_id", "url", "text", "n_chars"] and dict(got.dtypes)["page_id"] == "bigint"
    by = defaultdict(list)
    for r in got.collect():
        by[r["page_id"]].append((r["text"], r["n_chars"], r["url"]))
    for k, text in enumerate(odd.values()):
        assert by[k] == [(text, len(text), hosts[k % 4])], k
    assert by[None] == [("a", 1, None)] and by[2**60 + 1] == [("b", 1, hosts[0])] * 2
    assert html_extract.extract(pages(spark, [])).count() == 0


def test_html_wrappers_too_large_to_broadcast_are_joined(spark, monkeypatch):
    monkeypatch.setattr(html_extract, "BROADCAST", -1)
    rng = random.Random(6)
    made = [blind(rng, k) for k in range(20)]
    rows = [(k, f"http://one.example/{k}" if k % 4 else None, page) for k, (page, _) in enumerate(made)]
    got = {r["page_id"]: r["text"] for r in html_extract.extract(pages(spark, rows)).collect()}
    assert len(got) == 20 and all(got[k] == text for k, (_, text) in enumerate(made) if k % 4)


def most_pairs(a, b):
    """Simple tree matching by its definition."""
    if a.label != b.label:
        return 0

    def best(i, j):
        return 0 if not i or not j else max(best(i - 1, j), best(i, j - 1), best(i - 1, j - 1) + most_pairs(a.kids[i - 1], b.kids[j - 1]))

    return best(len(a.kids), len(b.kids)) + 1


def test_tree_matching():
    rng = random.Random(2)

    def tree(depth):
        return dom.Slot(rng.choice("ab"), 1, kids=[tree(depth - 1) for _ in range(rng.randrange(0, 4))] if depth else [])

    for _ in range(50):
        a, b = tree(3), tree(3)
        pairs = dom.aligned(a, b)
        assert len(pairs) == most_pairs(a, b) and all(x.label == y.label for x, y in pairs)
        if pairs:
            before = len(dom.slots(a))
            dom.merge(a, b)
            assert len(dom.slots(a)) == before + len(dom.slots(b)) - len(pairs)
