"""Pages as trees of blocks, and the simple tree matching (Yang 1991) that aligns them."""

from __future__ import annotations

import html
import re
from functools import lru_cache
from hashlib import blake2b

#: Elements by what they mean to a page's text.
RAW = frozenset("script style title textarea xmp noembed noframes iframe".split())
BLOCK = frozenset(
    "address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption "
    "svg canvas audio video object picture template noscript button select option optgroup datalist label legend map math".split()
)
#: Elements that end an open element of these names when they start.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("tr", "td", "th", "thead", "tbody"), "tfoot": ("tr", "td", "th", "tbody"), "thead": ("tr", "td", "th")}
#: Elements within which such an end looks no further out.
WALLS = frozenset("ul ol dl table td th select menu dir".split())
#: Elements that are never part of an article.
APART = frozenset("nav footer aside menu search dialog template svg canvas audio video object button select option optgroup datalist label legend map noscript dir".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CONTAINERS = frozenset("article main section div td body center blockquote table tbody tr form".split())
#: Words in a class, id or role that mark what isn't the article.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot adsbygoogle banner sponsor sponsored sponsors promo promos promotion promoted "
    "nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager skiplink header masthead topbar footer colophon copyright "
    "sidebar sidebars aside complementary widget widgets related recommended recommendations popular trending teaser teasers "
    "cookie cookies consent gdpr notice notices notification notifications alert disclaimer popup modal overlay paywall newsletter subscribe subscription signup signin login "
    "comment comments commentlist disqus respond reply replies discussion share sharing social follow search searchform form contentinfo hidden".split()
)
#: Of these, what makes an article another than the page's, and what stands at the head or foot of a page though it may hold its title.
OTHERS = frozenset("ad ads advert sponsored promo comment comments reply related recommended popular trending teaser teasers widget hidden".split())
HEADS = frozenset("nav navbar menu header masthead topbar footer hidden".split())
#: Marks that say where an element lies rather than what it is, which one that is named as content may have beside.
LAYOUT = frozenset("sidebar sidebars header footer nav menu social share".split())
#: Block elements that don't end a paragraph.
PHRASES = frozenset("option optgroup label button svg canvas audio video object picture map math select datalist template noscript".split())
RAW_ENDS = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}
#: Words that turn a mark after them into a remark about the page, and words that name the article.
ABOUT, OWNERS = frozenset("with has no without".split()), frozenset("entry post article story content".split())

TOKEN = re.compile(r"<!--(?:>|->|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>|<[!?/][^>]*>?|<[a-zA-Z][^>]*(?:>|\Z)|[^<]++|<", re.S)
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
#: The share of a container's text that an inner one must have to be taken for it.
MOST = 0.7
#: Elements nested deeper are blocks of the element at this depth.
DEPTH = 60


class Node:
    """An element: its label, inner elements, own blocks (place in the page, text, letters within links), its marks and whether it lies apart."""

    __slots__ = ("apart", "blocks", "kids", "label", "marks", "tag")

    def __init__(self, tag: str, label: str, marks: frozenset[str]):
        self.tag, self.label, self.marks, self.apart, self.kids, self.blocks = tag, label, marks, False, [], []


@lru_cache(20_000)
def described(tag: str, attributes: str) -> tuple[str, str, frozenset[str]]:
    """(tag or what its role stands for, label, marks) of a start tag."""
    if not attributes.strip(" /\t\r\n"):
        return tag, tag, frozenset()
    found: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(attributes):
        found.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
    if found.get("role") in ("main", "article"):
        tag = found["role"]
    elif "articlebody" in found.get("itemprop", "").lower():
        tag = "article"
    hidden = "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()
    marks, good = {"hidden"} if hidden else set(), False
    for w in (w for key in ("class", "id", "role") for w in found.get(key, "").split()):
        parts = [p.lower() for p in PARTS.findall(w)]
        good = good or (bool(OWNERS & set(parts)) and not MARKS & set(parts))
        marks |= {p for k, p in enumerate(parts) if p in MARKS and not (k and (parts[k - 1] in ABOUT or (p == "header" and parts[k - 1] in OWNERS)))}
    marks -= LAYOUT if good else set()
    kinds = sorted({re.sub(r"\d+", "#", w) for key in ("class", "id") for w in found.get(key, "").split()})
    return tag, ".".join([tag, *kinds]), frozenset(marks)


def parse(page: str) -> Node:
    """The page's tree. Unclosed, misnested and unknown tags, broken references and text after the end are taken as browsers do, roughly."""
    root = Node("body", "body", frozenset())
    stack, text, place, at, end = [root], [], 0, 0, len(page)
    linked, in_link = 0, False
    over: dict[str, int] = {}  # open elements beyond DEPTH

    def flush():
        nonlocal place, linked
        if text:
            block = " ".join("".join(text).split())
            if block:
                stack[-1].blocks.append((place, block, min(linked, len(block))))
                place += 1
            text.clear()
            linked = 0

    def close(names, walls=frozenset()) -> None:
        nonlocal in_link
        for k in range(len(stack) - 1, 0, -1):
            name = stack[k].label.split(".", 1)[0] if stack[k].tag not in names else stack[k].tag
            if name in names:
                flush()
                in_link = False
                del stack[k:]
                return
            if stack[k].tag in walls:
                return

    while at < end:
        m = TOKEN.match(page, at)
        at = m.end()
        name = m[2]
        if name is None:
            s = m[0]
            if s[0] != "<" or len(s) == 1:
                s = html.unescape(s) if "&" in s else s
                text.append(s)
                if in_link:
                    linked += len(s.strip())
            continue
        name = name.lower()
        if m[1]:
            if name == "a":
                in_link = False
            elif name == "br":
                text.append(" ")
            elif name in BLOCK:
                if name == "p":
                    flush()
                if over.get(name):
                    over[name] -= 1
                    flush()
                else:
                    close((name,), WALLS if name in ("li", "p") else ())
        elif name in RAW:
            last = RAW_ENDS[name].search(page, at)
            at = last.start() if last else end
        elif name == "a":
            in_link = True
        elif name in ("br", "img", "input"):
            text.append(" ")
        elif name == "hr":
            flush()
        elif name in BLOCK:
            flush()
            if name in ENDS:
                close(ENDS[name], WALLS - {"td", "th"} if name[0] == "t" else WALLS)
            elif name not in PHRASES:
                close(("p",), WALLS)
            if len(stack) >= DEPTH:
                over[name] = over.get(name, 0) + 1
                continue
            node = Node(*described(name, m[3]))
            stack[-1].kids.append(node)
            stack.append(node)
            in_link = False
    flush()
    settle(root)
    return root


def walk(node: Node, apart: bool = False):
    """Elements in page order; with `apart`, those that lie apart, too."""
    stack = [node]
    while stack:
        n = stack.pop()
        yield n
        stack.extend(k for k in reversed(n.kids) if apart or not k.apart)


def settle(root: Node) -> None:
    """Tells which elements lie apart.

    Those named in APART; those marked as other than the article, unless they hold it; page headers, while a header within
    an article keeps its headings; forms without article or main heading; lists of nothing but links.
    """
    order = list(walk(root, True))
    holds = {}  # whether an element holds an article, an h1 and the main element
    for n in reversed(order):
        inner = [holds[id(k)] for k in n.kids]
        own = n.tag in ("article", "main"), n.tag == "h1", n.tag == "main"
        holds[id(n)] = tuple(any(x[i] for x in inner) or own[i] for i in range(3))
    inside = {id(root): False}
    for n in order:
        within = inside.get(id(n), False) or n.tag in ("article", "main")
        for k in n.kids:
            inside[id(k)] = within
            article, heading, main = (any(holds[id(x)][i] for x in k.kids) for i in range(3))
            if k.tag in APART:
                k.apart = True
            elif k.tag == "main":
                k.apart = "hidden" in k.marks
            elif k.tag == "article":
                k.apart = bool(k.marks & OTHERS)
            elif k.tag == "header":
                k.apart = not within
                k.kids, k.blocks = [x for x in walk(k) if x.tag in HEADINGS], []
            elif k.tag in HEADINGS or k.tag == "p":
                k.apart = bool(k.marks - {"header"})
            elif k.marks & OTHERS:
                k.apart = not main
            elif k.marks:
                k.apart = not article and (not heading or bool(k.marks & HEADS))
            elif k.tag == "form":
                k.apart = not (article or heading)
            elif k.tag in ("ul", "ol"):
                blocks = [b for x in walk(k, True) for b in x.blocks]
                k.apart = bool(blocks) and all(links >= 0.9 * len(t) for _, t, links in blocks)


def key_of(path: str, text: str) -> int:
    """A 63-bit digest of a block and where it stands."""
    return int.from_bytes(blake2b(f"{path}\n{text}".encode(), digest_size=8).digest(), "big") >> 1


class Slot:
    """An aligned element: pages that have it, letters of its own blocks and of links in them, and its text's digest while it is constant."""

    __slots__ = ("chars", "kids", "label", "links", "pages", "text")

    def __init__(self, label: str, pages: int = 0, chars: int = 0, links: int = 0, text: int | None = None, kids: list | None = None):
        self.label, self.pages, self.chars, self.links, self.text, self.kids = label, pages, chars, links, text, kids or []

    @property
    def tag(self) -> str:
        return self.label.split(".", 1)[0]

    def packed(self) -> list:
        return [self.label, self.pages, self.chars, self.links, self.text, [k.packed() for k in self.kids]]

    @staticmethod
    def unpacked(v: list) -> Slot:
        return Slot(*v[:5], [Slot.unpacked(k) for k in v[5]])


class Skeleton(Slot):
    """A page's slot: siblings of one shape that follow each other are one slot. `nodes` are the elements it stands for."""

    __slots__ = ("nodes", "shape")


def skeleton(node: Node) -> Skeleton:
    """The page's slots; elements that lie apart are left out."""
    out = Skeleton(node.label, 1)
    out.nodes = [node]
    for n in node.kids:
        if n.apart:
            continue
        kid = skeleton(n)
        last = out.kids[-1] if out.kids else None
        if last is not None and last.shape == kid.shape:
            join(last, kid)
        else:
            out.kids.append(kid)
    texts = [b[1] for b in node.blocks]
    out.chars, out.links = sum(map(len, texts)), sum(b[2] for b in node.blocks)
    out.text = key_of("", "\n".join(texts)) if texts else None
    out.shape = f"{out.label}({','.join(k.shape for k in out.kids)})"
    return out


def join(a: Skeleton, b: Skeleton) -> None:
    """b, of a's shape, becomes part of a."""
    a.nodes += b.nodes
    a.chars, a.links = a.chars + b.chars, a.links + b.links
    a.text = key_of(str(a.text), str(b.text)) if a.text is not None or b.text is not None else None
    for x, y in zip(a.kids, b.kids):
        join(x, y)


def slots(s: Slot) -> list:
    """s and all below, in page order."""
    out, stack = [], [s]
    while stack:
        n = stack.pop()
        out.append(n)
        stack.extend(reversed(n.kids))
    return out


def match(a: Slot, b: Slot, memo: dict) -> int:
    """Simple tree matching: the most pairs of equal labels that keep order and ancestry, roots paired."""
    if a.label != b.label:
        return 0
    key = id(a), id(b)
    if key not in memo:
        row = [0] * (len(b.kids) + 1)
        table = [row]
        for x in a.kids:
            above, row = row, [0]
            for j, y in enumerate(b.kids):
                row.append(max(above[j + 1], row[j], above[j] + match(x, y, memo)))
            table.append(row)
        memo[key] = row[-1] + 1, table
    return memo[key][0]


def aligned(a: Slot, b: Slot, memo: dict | None = None) -> list[tuple[Slot, Slot]]:
    """Pairs of a's and b's slots that simple tree matching pairs, roots first; none if the roots differ."""
    memo = {} if memo is None else memo
    if not match(a, b, memo):
        return []
    out, todo = [], [(a, b)]
    while todo:
        x, y = todo.pop()
        out.append((x, y))
        table, i, j = memo[id(x), id(y)][1], len(x.kids), len(y.kids)
        while i and j:
            if table[i][j] == table[i - 1][j]:
                i -= 1
            elif table[i][j] == table[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                todo.append((x.kids[i], y.kids[j]))
    return out


def merge(into: Slot, page: Slot) -> dict[int, Slot]:
    """Adds a page's slots, or those of another wrapper, to a wrapper; id of each of page's slots -> its slot of the wrapper.

    Texts that differ make a slot varying; slots without a partner are inserted after their last sibling that has one.
    """
    pairs = {id(p): w for w, p in aligned(into, page)}
    for p in slots(page):
        w = pairs[id(p)]
        new = w.pages == 0
        w.text = p.text if new or w.text == p.text else None
        w.pages, w.chars, w.links = w.pages + p.pages, w.chars + p.chars, w.links + p.links
        at = 0
        for k in p.kids:
            if id(k) in pairs:
                at = next(i for i, x in enumerate(w.kids) if x is pairs[id(k)]) + 1
            else:
                pairs[id(k)] = Slot(k.label)
                w.kids.insert(at, pairs[id(k)])
                at += 1
    return pairs


def weights(wrapper: Slot, least: int) -> dict[int, int]:
    """id of each slot -> letters of varying text outside links, in it and below. Constant text of `least` pages or more weighs nothing."""
    out: dict[int, int] = {}
    for s in reversed(slots(wrapper)):
        own = 0 if s.text is not None and s.pages >= least else max(0, s.chars - 2 * s.links)
        out[id(s)] = own + sum(out[id(k)] for k in s.kids)
    return out


def content(wrapper: Slot, least: int) -> list[Slot]:
    """The slots that hold the article: a marked element (article, main) or else the innermost container of most varying text; headings before it, too."""
    weight = weights(wrapper, least)
    way, marked = [wrapper], None
    found = [s for s in slots(wrapper) if s.tag in ("article", "main") and weight[id(s)]]
    if found:
        marked = max(found, key=lambda s: weight[id(s)])
        while inner := [s for s in slots(marked)[1:] if s.tag in ("article", "main") and weight[id(s)] >= 0.6 * weight[id(marked)]]:
            marked = inner[0]
        way = path_to(wrapper, marked)
    else:
        while True:
            kids = [k for k in way[-1].kids if weight[id(k)]]
            # parts of one kind belong together
            inner = [k for k in kids if k.tag in CONTAINERS and weight[id(k)] >= MOST * weight[id(way[-1])] and sum(x.label == k.label for x in kids) == 1]
            if not inner:
                break
            way.append(inner[0])
    out = [way[-1]]
    if not any(s.tag == "h1" for s in slots(way[-1])):
        for up, down in zip(way, way[1:]):
            before = up.kids[: next(i for i, k in enumerate(up.kids) if k is down)]
            out += [x for k in before for x in slots(k) if weight[id(x)] and (x.tag == "h1" or (x is k and x.tag == "h2"))]
    return out


def path_to(root: Slot, target: Slot) -> list[Slot]:
    parents = {id(k): s for s in slots(root) for k in s.kids}
    way = [target]
    while way[-1] is not root:
        way.append(parents[id(way[-1])])
    return way[::-1]


def blocks_in(node: Node) -> list[tuple[int, str, int]]:
    """Blocks of an element and below, apart ones left out, in page order."""
    return [b for n in walk(node) for b in n.blocks]


def paths(root: Node) -> list[tuple[int, int, int]]:
    """(place, digest with the labels that lead there, letters) of all blocks that don't lie apart."""
    out, stack = [], [(root, "")]
    while stack:
        n, above = stack.pop()
        here = f"{above}/{n.label}"
        out += [(b[0], key_of(here, b[1]), len(b[1])) for b in n.blocks]
        stack.extend((k, here) for k in n.kids if not k.apart)
    return out
