"""Operator 2: main text of web pages, with removal of what a site repeats.

1. Each page is parsed by a task that sees one page at a time, and every block element of the whole page that holds text is hashed
   with its subtree, before anything is judged by its name. Spark counts each hash over the different pages of a host. Subtrees on at least
   LEAST_PAGES of them and on SHARE of all are the site's template; as each host has at most (elements of a page) / SHARE of those, the list by
   host is bounded.
2. The pages are parsed again beside their host's list, and these subtrees are deleted.
3. Of what is left, content is all outermost articles and mains (or elements of role main) in page order, the body if these hold less than HELD of its text.
   Inside it go navigation, headers but for their headings, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments,
   known by tag, role, visibility or the words of class and id; a form around an article, main or h1 is not one. Character references are decoded, white space inside a block becomes one space,
   blocks are joined by \\n.

Defined results: null or empty html gives an empty text, as does a page without content. Pages of any length and depth are taken whole, in memory linear in
their length. A null URL or one without a host takes no part in the counts. Copies of a page count once. Repeated rows are each returned; further
columns, whatever their names, are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.storage import discard, materialize
from brindle.llm.urls import host

LEAST_PAGES, SHARE = 5, 0.4
SEND_HOSTS = 50_000  # hosts with a template of a few dozen hashes, at most sent to all executors
MOSTLY = 0.8  # of a body's text: an element with more is not removed for its class alone

HELD = 0.5  # of a body's text, without what looks unwanted

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = r"script|style|textarea|title|xmp|noembed|noframes"
DROPPED = frozenset("head script style noscript template iframe object svg canvas audio video map nav footer aside form button select textarea input dialog menu menuitem title xmp noembed noframes".split())
INLINE = frozenset("math mi mn mo ms mtext mrow msup msub mfrac msqrt label a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q rb rp rt ruby s samp small span strike strong sub sup time tt u var wbr br".split())
CLOSES_P = frozenset("address article aside blockquote center details dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: tag: (tags that its start closes, tags beyond which it does not reach)
SIBLINGS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
}
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form toolbar".split())
NAMES = frozenset(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs header masthead footer sidebar aside widget widgets ad ads adv advert adverts advertisement advertising banner banners sponsor"
    " sponsored promo promos promotion cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended"
    " recommendations comment comments disqus reply replies respond responses discussion toolbar pagination pager skip hidden copyright disclaimer teaser teasers form search".split()
)
HEADER_NAMES = frozenset(("header", "masthead"))
#: Words of names that only say where something stands or what shape it has.
PLACES = frozenset(
    "article entry post posts page site content contents main body top bottom left right center first last box block section sections container wrapper wrap inner outer list links link bar area item"
    " items group row col column module panel button buttons text title icon icons id js the primary secondary global local sticky fixed small large mobile desktop unit slot zone region story stories".split()
)
DOUBTFUL = frozenset("discussion social related share sharing search notice notices responses respond recommended recommendations".split())
PROSE = 80
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{RAW})\b(?P<rawattrs>(?>[^<>\"']|\"[^\"]*\"|'[^']*')*+)>(?P<body>.*?)(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-z][^\s/<>]*+)(?P<attrs>(?>[^<>\"']|\"[^\"]*\"|'[^']*')*+)>|<[!?/][^>]*>", re.I | re.S)  # fmt: skip
_ATTR = re.compile(r"(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?(?=[\s/]|\Z)", re.I)
_SLASH = re.compile(r"=\s*[^\s\"'>]+/\Z")  # the end of a value without quotes
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_UNSEEN = re.compile(r"(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.I)


class Element:
    __slots__ = ("attrs", "children", "tag")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []


def parse(html: str) -> Element:
    """A tree of elements and strings. Unclosed and misplaced tags are put right as far as text needs it."""
    root = Element("#root", {})
    stack, at = [root], 0

    opened_forms: list[Element] = []
    opened: Counter = Counter()  # so that the stack is not searched for what is not in it

    def close(tags, beyond=()) -> None:
        if not any(opened[t] for t in tags):
            return
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in tags:
                opened.subtract(x.tag for x in stack[k:])
                del stack[k:]
                return
            if stack[k].tag in beyond:
                return

    for m in _TOKEN.finditer(html):
        if m.start() > at:
            stack[-1].children.append(html[at : m.start()])
        at = m.end()
        if not (tag := (m["tag"] or "").lower()):
            continue
        if m["end"]:
            if tag == "p" or tag not in VOID:
                close({tag}, () if tag not in INLINE else CLOSES_P)
            continue
        if tag in CLOSES_P:
            close({"p"}, {"table", "td", "th", "button", "object"})
        if tag in SIBLINGS:
            close(*SIBLINGS[tag])
        attrs = {a[1].lower(): unescape(a[2] or a[3] or a[4] or "") for a in _ATTR.finditer(m["attrs"])} if m["attrs"] else {}
        node = Element(tag, attrs)
        stack[-1].children.append(node)
        if tag == "form":
            opened_forms.append(node)
        if tag not in VOID and (not m["attrs"].endswith("/") or _SLASH.search(m["attrs"])):
            stack.append(node)
            opened[tag] += 1
    stack[-1].children.append(html[at:])
    if opened_forms:
        for x in opened_forms:  # a form around the page's content is only a box
            if any(c.tag in ("article", "main", "h1") for c in _below(x)):
                x.tag = "div"
    return root


def _named(node: Element) -> frozenset[str]:
    """The words of its class and id that mark what is unwanted. A name counts only if its other words say where something stands or what shape it has (`share-bar`, not
    `share-price`), and a doubtful one only if the element holds no running text."""
    found: set[str] = set()
    for name in f"{node.attrs.get('class', '')} {node.attrs.get('id', '')}".split():
        words = [w.lower() for w in _NAME.findall(name)]
        if (hit := NAMES.intersection(words)) and all(w in NAMES or w in PLACES for w in words):
            found |= hit
    return frozenset() if found and found <= DOUBTFUL and _prose(node) else frozenset(found)


def _prose(node: Element) -> bool:
    """Whether a paragraph of PROSE characters stands in it, not in an item of a list."""
    todo = [node]
    while todo:
        for c in todo.pop().children:
            if not isinstance(c, str):
                if c.tag == "p" and sum(len(t) for x in _below(c) for t in x.children if isinstance(t, str)) >= PROSE:
                    return True
                if c.tag in ("div", "section"):
                    todo.append(c)
    return False


def _unwanted(node: Element) -> bool:
    a = node.attrs
    return node.tag in DROPPED or a.get("role", "").lower() in ROLES or "hidden" in a or a.get("aria-hidden", "").lower() == "true" or bool(_UNSEEN.search(a.get("style", "")))


def _below(root: Element) -> list[Element]:
    """All elements, each before those in it."""
    order, todo = [], [root]
    while todo:
        x = todo.pop()
        order.append(x)
        todo += [c for c in x.children if not isinstance(c, str)]
    return order


def _chars(root: Element) -> dict[int, int]:
    """id of each element: characters in it, without elements that always go."""
    out: dict[int, int] = {}
    for x in reversed(_below(root)):
        out[id(x)] = sum(len(c) if isinstance(c, str) else 0 if c.tag in DROPPED else out[id(c)] for c in x.children)
    return out


def _seen_chars(node: Element) -> int:
    """Characters of words, without elements that look unwanted."""
    total, todo = 0, [node]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            total += sum(map(len, x.split()))
        elif x is node or not (_unwanted(x) or (x.attrs and _named(x) and x.tag not in HEADINGS)):
            todo += x.children
    return total


def content(root: Element) -> Element:
    chars = _chars(root)
    tops, body, todo, limit = [], root, [(root, False)], MOSTLY * chars[id(root)]
    while todo:
        x, taken = todo.pop()
        if isinstance(x, str) or x.tag in DROPPED or (x.tag not in ("html", "body") and (_unwanted(x) or (x.attrs and _named(x) and chars[id(x)] <= limit))):
            continue
        main = x.tag == "main" or x.attrs.get("role", "").lower() == "main"
        if x.tag == "body" and body is root:
            body = x
        if not taken and (main or (x.tag == "article" and not (_named(x) or _unwanted(x)))):
            tops.append(x)
            taken = True
        todo += [(c, taken) for c in reversed(x.children)]
    if not tops or sum(map(_seen_chars, tops)) < HELD * _seen_chars(body):
        return body
    if len(tops) == 1:
        return tops[0]
    out = Element("#content", {})
    out.children = tops
    return out


def wanted(root: Element) -> Element:
    """The content without its unwanted elements."""
    top = content(root)
    chars = _chars(top)
    limit = MOSTLY * chars[id(top)]
    todo = [(top, False)]
    while todo:
        x, inside = todo.pop()
        kept = []
        for c in x.children:
            if isinstance(c, str):
                if not inside:
                    kept.append(c)
                continue
            names = _named(c) if c.attrs and c.tag not in HEADINGS else ()
            header = c.tag == "header" or (names and names <= HEADER_NAMES)
            if _unwanted(c) or (names and not names <= HEADER_NAMES and chars[id(c)] <= limit):
                continue
            header = header and chars[id(c)] <= limit
            if inside and c.tag in HEADINGS:
                kept.append(c)
                todo.append((c, False))
            else:
                kept.append(c)
                todo.append((c, inside or header))
        x.children = kept
    return top


def hashes(root: Element) -> dict[int, int]:
    """id of an element: hash of its subtree, of tags and words, for the block elements below root that have text."""
    own: dict[int, int] = {}
    order = _below(root)
    for x in reversed(order):
        h, any_text = xxhash.xxh64(x.tag), False
        for c in x.children:
            if isinstance(c, str):
                if words := unescape(c).split():
                    h.update(" ".join(words))
                    any_text = True
            elif id(c) in own:
                h.update(own[id(c)].to_bytes(8, "little"))
                any_text = True
        if any_text:
            own[id(x)] = h.intdigest()
    blocks_ = (x for x in order if x is not root and id(x) in own and x.tag not in INLINE and x.tag not in ("html", "body"))
    return {id(x): own[id(x)] - (1 << 64) if own[id(x)] >> 63 else own[id(x)] for x in blocks_}


def without(root: Element, template: set[int]) -> Element:
    """The tree without the subtrees of these hashes. Repeated elements that always go need no deletion."""
    own = hashes(root)
    todo = [root]
    while todo:
        x = todo.pop()
        x.children = [c for c in x.children if isinstance(c, str) or own.get(id(c)) not in template]
        todo += [c for c in x.children if not isinstance(c, str)]
    return root


def blocks(top: Element) -> list[str]:
    """Each block's text."""
    out, line = [], []

    def end() -> None:
        if words := unescape("".join(line)).split():
            out.append(" ".join(words))
        line.clear()

    todo: list = list(reversed(top.children))
    while todo:
        x = todo.pop()
        if x is None:
            end()
        elif isinstance(x, str):
            line.append(x)
        elif x.tag == "br":
            line.append(" ")
        elif x.tag in INLINE:
            todo += reversed(x.children)
        else:
            end()
            todo += [None, *reversed(x.children)]
    end()
    return out


def page_blocks(html: str | None, template: set[int] | None = None) -> list[str]:
    if not html:
        return []
    root = parse(html)
    return blocks(wanted(without(root, template) if template else root))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for k in range(0, b.num_rows, 256):
            part, digest, found = b.slice(k, 256), [], []
            for h in part.column(1):
                html = h.as_py() or ""
                found.append(list(set(hashes(parse(html)).values())))
                digest.append(xxhash.xxh64_intdigest(html.encode("utf-8", "surrogatepass")) - (1 << 63))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(digest, pa.int64()), pa.array(found, pa.list_(pa.int64()))], names=["host", "digest", "hashes"])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for k in range(0, b.num_rows, 256):
            part = b.slice(k, 256)
            own = ["\n".join(page_blocks(h.as_py(), set(t or ()))) for h, t in zip(part.column(2), part.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array(own, pa.string())], names=["page_id", "url", "text"])


def templates(hashed: DataFrame) -> DataFrame:
    """host and the hashes of its template's subtrees, of host, digest, hashes."""
    seen = hashed.where("host <> ''").dropDuplicates(["host", "digest"])
    n_pages = seen.groupBy("host").agg(F.count("*").alias("pages")).where(f"pages >= {LEAST_PAGES}")
    counts = seen.select("host", F.explode("hashes").alias("hash")).groupBy("host", "hash").agg(F.count("*").alias("n")).where(f"n >= {LEAST_PAGES}")
    return counts.join(n_pages, "host").where(f"n >= {SHARE} * pages").groupBy("host").agg(F.collect_list("hash").alias("template"))


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages (page_id, url, html)."""
    pages = pages.select("page_id", "url", "html", host(F.col("url")).alias("host"))
    hashed = materialize(pages.where("html IS NOT NULL AND host <> ''").select("host", "html").mapInArrow(_hashed, "host string, digest bigint, hashes array<bigint>"), "page-hashes")
    found = materialize(templates(hashed), "templates")
    discard(hashed)
    found = F.broadcast(found) if found.count() <= SEND_HOSTS else found
    out = pages.join(found, "host", "left").select("page_id", "url", "html", "template").mapInArrow(_texts, "page_id bigint, url string, text string")
    return out.withColumn("n_chars", F.char_length("text").cast("long"))
