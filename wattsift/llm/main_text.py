"""Main text of web pages by composite text density over the DOM.

A node's density is its characters for each tag below it, lowered by the share
of characters and tags that belong to links (Sun, Song and Liao, "DOM based
content extraction via text density", 2011).  The subtree whose children have
the greatest sum of densities is the main block.  The least density on the path
from it up to the body is the threshold: wherever a node reaches it, the best
subtree below that node counts as main text too.

An ``article`` or ``main`` around the main block is taken with it if the block
holds at least half of its characters.  Lists, tables and sections within the
block that are mostly links, two or more, are left out, but not those under a
heading of their own.

Elements that are never article text (scripts, navigation and so on) are left out
of the tree by tag and role.  Others are suspects: forms, footers, side bars and
the like by tag or role, and elements whose class or id names them so, as a whole
(adverts, comments of readers) or in a part (``cookie-banner``).  However large,
suspects beside an article element go, those around one stay, and those within it
go unless nothing but links is left.  Where there is none, all go at first; a suspect comes back only if nothing but links is left, or
if it is one by tag, role or a loose name and its greatest density sum exceeds
that of all that is left: then it is a wrapper around the page's text.  Suspects
within it are judged in the same way.  No share of the page decides.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
SKIPPED = frozenset("script style noscript template head title nav button select option input textarea iframe svg canvas object embed applet menu audio video map math".split())
SOFT = frozenset("footer aside form dialog header".split())
BLOCKS = frozenset("html body address article aside blockquote center details dd dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
LISTS = frozenset("ul ol dl div section table menu".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CONTENT = frozenset("html body article main".split())
#: An opening tag closes an open element of these names, unless one of the second names stands between.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"thead", "tbody", "tr"}, {"table"}), "tfoot": ({"thead", "tbody", "tr"}, {"table"}),
    "body": ({"head"}, set()),
}
_P_STOPS = frozenset("html body table td th caption button object article section main div li ul ol dd dl blockquote aside nav header footer form fieldset figure details".split())
_ROLES = frozenset("navigation search alert menu menubar toolbar".split())
_SOFT_ROLES = frozenset("banner contentinfo complementary dialog form".split())
#: How surely an element is no article text: a wrapper may have such a tag, role or name; or its name leaves no doubt.
LOOSE, SURE = 1, 2
#: Wrappers within wrappers that are looked into; within further ones the densities decide.
DEEPEST = 32
_WORDS = re.compile(
    r"(?<!\S)(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|side-?bar\w*|menu\w*|nav|navbar|navigation|breadcrumbs?|footer|header|masthead|cookies?|consent|gdpr|notices?|alert|pop-?up|modal|overlay|"
    r"newsletter|subscri\w*|sign-?up|log-?in|comments?|comment-?list|disqus\w*|respond|replies|reply|discussion|social|share|sharing|related|recommend\w*|widget\w*|pagination|pager|toolbar|skip-?link)(?!\S)",
    re.I,
)
#: Names, whole or as a part of a name, that leave no doubt; unless another part is one of a layout.
_SURE = frozenset("ad ads advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promotion sidebar sidebars breadcrumb breadcrumbs cookie cookies consent gdpr newsletter subscribe subscription signup disqus comments commentlist popup pager pagination footer navbar masthead skiplink".split())
_LAYOUT = frozenset("no has with without open closed layout wrap wrapper container content article post page main body entry story text site section column row grid".split())
_PART = re.compile(r"[-_\s]+|(?<=[a-z])(?=[A-Z])")
#: Every alternative is possessive and ends at the page's end at the latest, so a page is read once whatever it holds.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*+)((?:[^>\"'=]|=\s*+(?:\"[^\"]*+\"|'[^']*+')|[=\"'])*+)(?:>|\Z)", re.S)
_ENDS = {tag: re.compile(f"</{tag}", re.I | re.A) for tag in RAW}
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")


class Node:
    __slots__ = ("tag", "parent", "children", "chars", "tags", "link_chars", "link_tags", "density", "total", "best", "skip", "named")

    def __init__(self, tag: str, parent: "Node | None", skip: bool, named: int = 0):
        self.tag, self.parent, self.skip, self.named = tag, parent, skip, named
        self.children: list = []  # nodes, and texts as strings


def _left_out(tag: str, attributes: str) -> bool:
    if tag in SKIPPED:
        return True
    if not attributes or tag in CONTENT:
        return False
    found = _attributes(attributes)
    return "hidden" in found or found.get("aria-hidden") == "true" or found.get("role", "").lower() in _ROLES or "display:none" in found.get("style", "").replace(" ", "").lower()


def _named(tag: str, attributes: str, inside: bool) -> int:
    """How surely an element's tag, role, class or id says that it is no article text: 0, LOOSE or SURE."""
    soft = LOOSE if tag in SOFT and not (tag == "header" and inside) else 0
    if not attributes or tag in CONTENT or tag in HEADINGS:
        return soft
    found = _attributes(attributes)
    for name in (x for k in ("class", "id") if k in found for x in found[k].split()):
        parts = {x.lower() for x in _PART.split(name) if x} | {name.lower().replace("-", "").replace("_", "")}
        if parts & _SURE and not parts & _LAYOUT:
            return SURE
        if _WORDS.search(name):
            soft = LOOSE
    return soft or (LOOSE if found.get("role", "").lower() in _SOFT_ROLES else 0)


def _attributes(attributes: str) -> dict[str, str]:
    return {k.lower(): v.strip("\"'") for k, v in _ATTRIBUTE.findall(attributes)}


def parse(page: str) -> Node:
    """A tree that forgives: unknown end tags are passed over, and open paragraphs, items and cells end where HTML ends them."""
    root = Node("html", None, False)
    node, at = root, 0
    articles = 0

    def close_to(target: Node) -> Node:
        nonlocal articles
        n = node
        while True:
            articles -= n.tag in ("article", "main")
            if n is target:
                return n.parent or root
            n = n.parent

    while m := _TOKEN.search(page, at):
        if m.start() > at:
            node.children.append(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            n, limit = node, tag in BLOCKS
            while n is not root and n.tag != tag and (limit or n.tag not in BLOCKS):
                n = n.parent
            if n is not root and n.tag == tag:
                node = close_to(n)
            elif tag in BLOCKS or tag == "br":
                node.children.append(Node("br", node, False))
            continue
        if tag == "html":
            continue
        names, stops = CLOSES.get(tag, (None, None))
        if names:
            n = node
            while n is not root and n.tag not in stops:
                if n.tag in names:
                    node = close_to(n)
                    n = node
                else:
                    n = n.parent
        if tag in BLOCKS:
            n = node
            while n is not root and n.tag not in _P_STOPS:
                if n.tag == "p":
                    node = close_to(n)
                    break
                n = n.parent
        child = Node(tag, node, node.skip or _left_out(tag, m[3]), _named(tag, m[3], articles > 0))
        node.children.append(child)
        if tag in RAW:
            stop = _ENDS[tag].search(page, at)
            end = stop.start() if stop else len(page)
            child.children.append(page[at:end])
            close = page.find(">", end)
            at = len(page) if close < 0 else close + 1
        elif tag not in VOID and not m[3].rstrip().endswith("/") or tag in BLOCKS and tag != "hr":
            node = child
            articles += tag in ("article", "main")
    if at < len(page):
        node.children.append(page[at:])
    return root


def _chars(text: str) -> int:
    return len("".join(html.unescape(text).split())) if text and not text.isspace() else 0


def _suspects(scope: Node) -> list[Node]:
    """The outermost elements below ``scope`` that may be no article text."""
    out, stack = [], [scope]
    while stack:
        n = stack.pop()
        for c in n.children:
            if not isinstance(c, str) and not c.skip:
                (out if c.named else stack).append(c)
    return out


def leave_out_named(root: Node) -> None:
    """Skip the suspects that are no wrappers of the page's text."""
    order, stack = [], [root]
    while stack:
        n = stack.pop()
        order.append(n)
        stack += [c for c in n.children if not isinstance(c, str) and not c.skip]
    if not any(n.named for n in order):
        return
    for n in reversed(order):
        n.chars = sum(_chars(c) if isinstance(c, str) else 0 if c.skip else c.chars for c in n.children)
    scopes, around = [], set()
    for n in reversed(order):  # children before parents
        if n.tag in ("article", "main") and n.chars and id(n) not in around:
            scopes.append(n)
        if n.parent is not None and (id(n) in around or scopes and scopes[-1] is n):
            around.add(id(n.parent))
    if scopes:
        inside = {id(n) for n in scopes}
        for n in order:
            if n.parent is not None and id(n.parent) in inside:
                inside.add(id(n))
            elif n.named and id(n) not in inside:
                n.skip = id(n) not in around
            if id(n) in around:
                n.named = 0
    for scope in scopes or [root]:
        for _ in range(DEEPEST):
            found = _suspects(scope)
            if not found:
                break
            for n in found:
                n.skip = True
            densities(scope)
            plain, total = scope.chars - scope.link_chars, scope.best.total
            wrappers = []
            for n in found:
                if n.named == LOOSE or not plain:
                    densities(n)
                    if n.chars and (not plain or not scopes and n.best.total > total):
                        wrappers.append(n)
            if any(n.named == LOOSE for n in wrappers):
                wrappers = [n for n in wrappers if n.named == LOOSE]
            if not wrappers:
                break
            scope = max(wrappers, key=lambda n: n.best.total)
            scope.skip, scope.named = False, 0


def measure(root: Node) -> list[Node]:
    """Fill in counts, densities and density sums of what is kept; the kept nodes, children before parents."""
    leave_out_named(root)
    order = densities(root)
    for n in order:
        n.children = [c for c in n.children if isinstance(c, str) or not c.skip]
    return order


def densities(root: Node) -> list[Node]:
    """Counts, densities and density sums of the nodes below ``root`` that are not skipped; these nodes, children before parents."""
    order, stack = [], [root]
    while stack:
        n = stack.pop()
        order.append(n)
        stack += [c for c in n.children if not isinstance(c, str) and not c.skip]
    order.reverse()
    for n in order:
        n.chars = n.tags = n.link_chars = n.link_tags = 0
        for c in n.children:
            if isinstance(c, str):
                n.chars += _chars(c)
            elif not c.skip:
                n.chars, n.tags = n.chars + c.chars, n.tags + c.tags + 1
                n.link_chars, n.link_tags = n.link_chars + c.link_chars, n.link_tags + c.link_tags + (c.tag == "a")
        if n.tag == "a":
            n.link_chars, n.link_tags = n.chars, n.tags
    share = root.link_chars / root.chars if root.chars else 0.0
    for n in order:
        if not n.chars:
            n.density = 0.0
        else:
            plain = n.chars - n.link_chars
            base = math.log(n.chars / max(plain, 1) * n.link_chars + share * n.chars + math.e)
            rest = n.chars / max(n.link_chars, 1) * max(n.tags, 1) / max(n.link_tags, 1)
            n.density = n.chars / max(n.tags, 1) * max(0.0, math.log(rest) / math.log(base) if base > 1.0000001 else math.log(rest))
        own = [c for c in n.children if not isinstance(c, str) and not c.skip]
        n.total = sum(c.density for c in own) if own else n.density
        n.best = max([n, *(c.best for c in own)], key=lambda x: x.total)
    return order


def _headed(n: Node) -> bool:
    """A heading stands right before the element."""
    before = None
    for c in n.parent.children:
        if c is n:
            break
        if not isinstance(c, str) or c.strip():
            before = c
    return before is not None and not isinstance(before, str) and before.tag in HEADINGS


def _select(root: Node) -> tuple[set[int], set[int]]:
    """(nodes whose subtree is main text, nodes within these that are not)."""
    body = next((c for c in root.children if not isinstance(c, str) and c.tag == "body"), root)
    top = body.best
    block, links, n = top, set(), top
    while n is not None and n is not body:
        if n.tag in ("article", "main") and 2 * top.chars >= n.chars:
            block = n
            break
        n = n.parent
    stack = [block]
    while stack:
        n = stack.pop()
        if n is not block and n.tag in LISTS and n.link_tags > 1 and 2 * n.link_chars > n.chars and not _headed(n):
            links.add(id(n))
        else:
            stack += [c for c in n.children if not isinstance(c, str) and c.tag in BLOCKS]
    threshold, n = top.density, top
    while n is not None and n is not body:
        n = n.parent
        threshold = min(threshold, n.density) if n is not None else threshold
    chosen, stack = {id(block)}, [body]
    while stack:
        n = stack.pop()
        if id(n) in chosen or not n.chars:
            continue
        if n is not body and n.density >= threshold and n.best.density >= threshold:
            chosen.add(id(n.best))
            if n.best is n:
                continue
        stack += [c for c in n.children if not isinstance(c, str)]
    return chosen, links


def main_text(page: str) -> str:
    """The page's main text: references decoded, blocks in page order, single spaces between words."""
    if not page:
        return ""
    root = parse(page)
    measure(root)
    if not root.chars:
        return ""
    (chosen, links), out = _select(root), []
    stack: list = [(root, False)]
    while stack:
        n, on = stack.pop()
        if isinstance(n, str):
            if on:
                out.append(html.unescape(n) if "&" in n else n)
            continue
        if id(n) in links:
            continue
        on = on or id(n) in chosen
        gap = on and (n.tag in BLOCKS or n.tag == "br") or id(n) in chosen
        if gap:
            out.append(" ")
            stack.append((" ", on))
        stack += [(c, on) for c in reversed(n.children)]
    return " ".join("".join(out).split())


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        texts = [main_text(page) for page in b.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row for each page: page_id, url, text (empty if none), n_chars.

    Null and empty html give empty text; repeated rows are extracted each; an
    empty input gives an empty result; other columns are ignored.
    """
    own = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit("")).alias("html"))
    return own.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
