"""Main text of web pages by scoring the element tree.

The page becomes a tree by the usual rules for left-out end tags. Subtrees that are
never article text go first: scripts, menus, forms, what is hidden, and elements whose
role, class or id names an advert, a notice, a sidebar or comments. Every paragraph then
passes points for its length and commas to its container, half of them to the next
element up and less to those above; an element's points are discounted by the share of
its text that is links. The best container wins; an enclosing article, and siblings that
score or read alike, are taken with it. Work is linear in the page for any depth of tags.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)",
    re.S,
)
#: An attribute's name and what follows it: an opening quote, or a value without quotes.
_NEXT_ATTR = re.compile(r"""[\s/]*(?:[^\s/>][^\s/>=]*\s*(?:=\s*(?:(["'])|[^\s>"'][^\s>]*)?)?)?""")
_ATTR = re.compile(r"""([^\s=/>"']+)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in "script style textarea title noscript iframe noembed noframes xmp".split()}
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th "
    "thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Start tags that end an open paragraph.
ENDS_P = BLOCK - frozenset("body html caption dd dt li tbody td tfoot th thead tr legend option optgroup".split()) | {"li", "dd", "dt"}
#: For a start tag: the open elements that it ends, and those that it does not look beyond.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dd": ({"dd", "dt"}, {"dl"}),
    "dt": ({"dd", "dt"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "td": ({"td", "th"}, {"table"}),
    "th": ({"td", "th"}, {"table"}),
    "tr": ({"tr", "caption", "colgroup"}, {"table"}),
    "tbody": ({"tbody", "thead", "tfoot", "caption", "colgroup"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "caption", "colgroup"}, {"table"}),
}
_CELLS = frozenset(("td", "th", "table", "caption"))
_TABLE = frozenset("table tbody tfoot thead tr td th caption".split())

DROP = frozenset(
    "nav footer aside form button select template svg math object canvas audio video map dialog menu search head datalist label fieldset".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form toolbar tooltip".split())
NOISE = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense adslot adbox adunit sponsor sponsored sponsors promo promos promoted "
    "promotion banner banners sidebar sidebars rail comment comments commentlist commentary respond replies reply disqus discussion cookie cookies "
    "cookiebar consent gdpr notice notices notification notifications disclaimer popup popups modal overlay newsletter subscribe subscription signup login paywall "
    "share sharing shares social socials related recommended recommendations trending menu menus nav navbar navigation breadcrumb breadcrumbs "
    "pagination pager toolbar footer foot masthead topbar widget widgets hidden outbrain taboola skip teaser teasers toc".split()
)
WEAK_NOISE = frozenset("header head top bottom meta byline".split())
GOOD = frozenset("article body content entry hentry main post story text blog prose".split())
_WORDS = re.compile(r"[a-z]+|[A-Z][a-z]*")
_KEPT_BY_CLASS = frozenset(("html", "body", "article", "main"))
_SHARE = (1.0, 0.5, 1 / 6, 1 / 9, 1 / 12)


class Node:
    __slots__ = ("attrs", "children", "links", "parent", "score", "size", "tag")

    def __init__(self, tag: str, attrs: str, parent: Node | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Node | str] = []
        self.size = self.links = 0
        self.score = 0.0


def _tag_end(html: str, at: int, unclosed: set[str]) -> int:
    """Where the tag whose attributes begin at ``at`` has its ``>``, or the end of the page.

    A quoted value goes to its closing quote, however far; if there is none, the tag ends at the next ``>``.
    ``unclosed`` holds the quotes that the rest of the page is known not to have, so no stretch is searched twice.
    """
    while at < len(html) and html[at] != ">":
        m = _NEXT_ATTR.match(html, at)
        at = m.end()
        if m[1]:
            close = -1 if m[1] in unclosed else html.find(m[1], at)
            if close < 0:
                unclosed.add(m[1])
                end = html.find(">", at)
                return len(html) if end < 0 else end
            at = close + 1
    return at


def parse(html: str) -> Node:
    """The element tree; text stays encoded."""
    root = node = Node("html", "", None)
    opened = {"html": 1}  # how many elements of a name are open: saves walks that would find nothing
    at = 0
    unclosed: set[str] = set()

    def pop_to(stop: Node) -> None:
        nonlocal node
        while node is not stop:
            opened[node.tag] -= 1
            node = node.parent
        opened[stop.tag] -= 1
        node = stop.parent

    def close(names: set[str] | frozenset[str], until: set[str] | frozenset[str]) -> bool:
        if not any(opened.get(n) for n in names):
            return False
        here = node
        while here is not root:
            if here.tag in names:
                pop_to(here)
                return True
            if here.tag in until:
                return False
            here = here.parent
        return False

    while m := _TOKEN.search(html, at):
        if m.start() > at:
            node.children.append(html[at : m.start()])
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                node.children.append(m[0][9:].removesuffix("]]>"))
            continue
        tag = m[2].lower()
        end_of_tag = _tag_end(html, at, unclosed)
        attrs = html[at:end_of_tag]
        at = min(end_of_tag + 1, len(html))
        if m[1]:
            if tag == "br":
                node.children.append(Node("br", "", node))
            elif tag in BLOCK:
                close({tag} if tag not in HEADINGS else HEADINGS, frozenset() if tag in _TABLE else _CELLS)
            else:
                close({tag}, BLOCK)
            continue
        if tag in ("html", "body"):
            if tag == "body" and opened.get("head"):
                close({"head"}, frozenset())
            continue
        if tag in ENDS_P:
            close({"p"}, _CELLS)
        if tag in IMPLIED:
            close(*IMPLIED[tag])
        elif tag in HEADINGS and node.tag in HEADINGS:
            pop_to(node)
        if opened.get("head") and (tag in BLOCK):
            close({"head"}, frozenset())
        made = Node(tag, attrs, node)
        node.children.append(made)
        if tag in VOID or attrs.endswith("/") and tag in ("svg", "path", "use", "circle", "rect"):
            continue
        if tag in RAW:
            end = RAW[tag].search(html, at)
            at = len(html) if end is None else (html.find(">", end.end()) + 1 or len(html))
            continue
        node = made
        opened[tag] = opened.get(tag, 0) + 1
    if at < len(html):
        node.children.append(html[at:])
    return root


def _dropped(node: Node, in_article: bool) -> bool:
    tag = node.tag
    if tag in DROP or tag in RAW or tag == "header" and not in_article:
        return True
    if not node.attrs.strip(" /"):
        return False
    attrs = {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(node.attrs)}
    style = attrs.get("style", "").replace(" ", "").lower()
    if "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in style or "visibility:hidden" in style:
        return True
    if tag in _KEPT_BY_CLASS:
        return False
    if attrs.get("role", "").lower() in ROLES:
        return True
    for name in (*attrs.get("class", "").split(), attrs.get("id", "")):
        words = [w.lower() for w in _WORDS.findall(name)]
        if words and words[0] in ("has", "with", "no", "without"):
            continue
        if any(w in NOISE for w in words):
            return True
        if not in_article and any(w in WEAK_NOISE for w in words) and not any(w in GOOD for w in words):
            return True
    return False


def _good(node: Node) -> float:
    if node.tag in ("article", "main"):
        return 25.0
    if not node.attrs:
        return 0.0
    attrs = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(node.attrs)}
    words = [w.lower() for n in ("class", "id") for w in _WORDS.findall(attrs.get(n, ""))]
    return 25.0 if attrs.get("role") == "main" or attrs.get("itemprop") == "articleBody" else 10.0 * any(w in GOOD for w in words)


def _walk(root: Node) -> tuple[list[Node], list[tuple[Node, str, int, list[Node]]]]:
    """Kept elements in page order, and runs of text: (block element, text, characters in links, elements passed)."""
    kept: list[Node] = []
    runs: list[tuple[Node, str, int]] = []
    text: list[str] = []
    linked = 0
    block = root

    def flush() -> None:
        nonlocal linked
        joined = " ".join("".join(text).split())
        if joined:
            runs.append((block, joined, min(linked, len(joined))))
        text.clear()
        linked = 0

    # A stack of (element, next child, inside an article, inside a link); text between blocks belongs to the nearest one.
    kept.append(root)
    stack: list[list] = [[root, 0, False, False]]
    while stack:
        top = stack[-1]
        node, i, in_article, in_link = top
        if i == len(node.children):
            stack.pop()
            if node.tag in BLOCK:
                flush()
                block = node.parent
                while block is not None and block.tag not in BLOCK:
                    block = block.parent
            continue
        top[1] += 1
        child = node.children[i]
        if isinstance(child, str):
            plain = unescape(child) if "&" in child else child
            text.append(plain)
            if in_link:
                linked += len(plain.strip())
            continue
        if child.tag == "br":
            text.append(" ")
            continue
        if child.tag == "hr":
            flush()
            continue
        if child.tag in VOID:
            continue
        if _dropped(child, in_article):
            if child.tag in BLOCK:
                flush()
            continue
        if child.tag in BLOCK:
            flush()
            block = child
        kept.append(child)
        stack.append([child, 0, in_article or child.tag in ("article", "main"), in_link or child.tag == "a"])
    return kept, runs


def _block_parent(node: Node) -> Node:
    up = node.parent
    while up.parent is not None and up.tag not in BLOCK:
        up = up.parent
    return up


def extract(html: str) -> str:
    """Blocks of the main text, joined by a line feed; empty if there is none."""
    root = parse(html)
    kept, runs = _walk(root)
    if not runs:
        return ""
    for block, text, linked in runs:
        block.size += len(text)
        block.links += linked
        if len(text) < 25 or block.tag in HEADINGS:
            continue
        points = (1 + sum(text.count(c) for c in ",，、،") + min(len(text) / 100, 3)) * (1 - linked / len(text))
        up = block if block.tag in ("div", "section", "article", "main", "html", "td") or block.parent is None else _block_parent(block)
        for share in _SHARE:
            up.score += points * share
            if up.parent is None:
                break
            up = _block_parent(up)
    for node in reversed(kept):
        if node.parent is not None:
            node.parent.size += node.size
            node.parent.links += node.links

    def density(node: Node) -> float:
        return node.links / node.size if node.size else 0.0

    best, most = root, -1.0
    for node in kept:
        if not node.size or node.tag not in BLOCK or node.tag in HEADINGS:
            continue
        bonus = _good(node)
        value = (node.score + bonus) * (1 - density(node))
        if (node.score or bonus >= 25) and value > most:
            best, most = node, value
    up = best
    while up.parent is not None:
        if up.tag == "article" or up.tag == "main" and density(up) < 0.5:
            best = up
            break
        up = up.parent
    wanted = {id(best)}
    if best.parent is not None:
        least = max(5.0, 0.2 * most)
        semantic = best.tag in ("article", "main")
        ids = {id(n) for n in kept}
        for node in best.parent.children:
            if isinstance(node, str) or id(node) not in ids or not node.size:
                continue
            if semantic:
                alike = node.tag == best.tag and node.score * (1 - density(node)) >= least
            elif node.tag == "p":
                alike = density(node) < 0.25 and (node.size > 80 or node.links == 0)
            else:
                alike = node.tag in HEADINGS or node.score * (1 - density(node)) >= least
            if alike:
                wanted.add(id(node))
    # A list or table that is mostly links is a menu, wherever it stands.
    out = []
    state: dict[int, bool] = {id(root): id(root) in wanted}
    for node in kept[1:]:
        inside = state[id(node.parent)] or id(node) in wanted
        if inside and node.tag in ("ul", "ol", "dl") and density(node) > 0.5 and id(node) not in wanted:
            inside = False
        state[id(node)] = inside
    for block, text, _ in runs:
        if state[id(block)]:
            out.append(text)
    return "\n".join(out)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [extract(h) if h else "" for h in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def extract_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of ``pages`` (page_id, url, html).

    A null or empty page, or one without text, gives an empty text; ids and urls pass through, null
    and repeated ones too. Tags that are broken or never end are read as far as they go. No rows give no rows.
    """
    columns = pages.select(F.col("page_id").cast("bigint"), F.col("url").cast("string"), F.col("html").cast("string"))
    out = columns.mapInArrow(_extract, "page_id long, url string, text string")
    return out.withColumn("n_chars", F.length("text").cast("bigint"))
