"""Operator 12: the main text of a page, by scores that pass up its tree.

A page becomes a tree of elements; what no browser shows, what is never part of an
article (menus, forms, footers, sidebars) and what names itself an advert, a notice or
reader comments is cut off. Each block with text of its own then gets points for its
length and commas, whole ones for its parent, half for the next ancestor, a third for
the one after it, and so on; an ancestor's points are lessened by the share of its text
in links. The best ancestor, or the article element that holds it, is the article,
together with siblings that have points of their own, read like prose or are its
heading. Boxes of links inside it are left out.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import small_batches, take

#: A comment, a declaration, or a tag with attributes; possessive, so that a page is read in linear time.
TOKEN = re.compile(r"<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>]*+))*+)(>|\Z)|</[^>]*+(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)\s*+(?:=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]*+)))?+", re.S)
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

# Names of elements, as HTML has them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = {t: re.compile(rf"</{t}(?![a-zA-Z0-9])", re.I | re.A) for t in "script style textarea title xmp iframe noembed noframes".split()}
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption legend optgroup option".split())
CLOSES_P = BLOCKS - frozenset("tbody td tfoot th thead tr caption html body li dd dt option optgroup".split())
#: What a start tag ends if it is open, and the elements beyond which it ends nothing.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select", "datalist"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}),
    **{t: ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}) for t in ("thead", "tbody", "tfoot")},
}
SCOPES = frozenset("article aside button body caption details div figure footer form header html main nav section table td th".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that never belong to an article, and words in class, id or role that say so.
DROPPED = frozenset("head title script style noscript template iframe object embed svg math canvas audio video map form button input select textarea option datalist label fieldset nav footer aside dialog menu".split())
UNFIT = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion promoted banner"
    " nav navbar navigation menu breadcrumb breadcrumbs pager pagination toc sidebar aside complementary footer contentinfo masthead topbar toolbar"
    " comment comments commentlist disqus respond replies cookie cookies consent gdpr notice notices notification popup modal overlay dialog"
    " share sharing social newsletter subscribe subscription signup login related recommended recommendations widget widgets skip search".split()
)
#: Blocks that are parts of a container rather than containers.
PARTS = HEADINGS | frozenset("p pre blockquote ul ol dl li dt dd figure figcaption hgroup caption center address".split())
#: Words that weigh for an element.
FIT = frozenset("article content entry main post story text body blog".split())
#: Points of a container by its own name, and of the words above.
WEIGHT = {"article": 25.0, "main": 25.0, "section": 5.0, "div": 5.0, "td": 3.0}
#: Share of the best points that keeps a sibling; length and link share that keep one which is prose.
SIBLING, PROSE, LINKED = 0.2, 80, 0.25
#: Links that a box has at least, and the share of its text in them, to be left out.
BOX_LINKS, BOX_SHARE = 3, 0.6
#: How deep elements nest; what lies deeper goes into the last one.
DEEPEST = 512


class Node:
    __slots__ = ("tag", "attributes", "parent", "depth", "children", "size", "linked", "links", "points")

    def __init__(self, tag: str, attributes: str, parent: Node | None):
        self.tag, self.attributes, self.parent = tag, attributes, parent
        self.depth: int = parent.depth + 1 if parent else 0
        self.children: list = []
        self.size = self.linked = self.links = 0
        self.points = 0.0

    def words(self) -> set[str]:
        """The words of class, id and role; cut at case and marks."""
        said = {}
        for m in ATTRIBUTE.finditer(self.attributes):
            said.setdefault(m[1].lower(), next((x for x in m.groups()[1:] if x is not None), ""))
        names = ("class", "role") if self.tag in HEADINGS else ("class", "id", "role")  # the id of a heading is made of its text
        held = " ".join(html.unescape(said.get(name, "")) for name in names)
        out = {w.lower() for w in [*NAME_PART.findall(held), *held.replace("-", " ").replace("_", " ").split()]}
        hidden = "hidden" in said or said.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", said.get("style", ""), re.I)
        return out | {"\0hidden"} if hidden else out


def parse(page: str) -> Node:
    """The tree of a page: children are nodes and decoded texts. Tags that are left open or closed twice are mended as a browser would, in the main."""
    root = at = Node("#root", "", None)
    place = 0
    n = len(page)
    while place < n:
        m = TOKEN.search(page, place)
        text = page[place : m.start() if m else n]
        if text:
            at.children.append(html.unescape(text) if "&" in text else text)
        if not m:
            break
        place = m.end()
        if not m[2] or not m[4]:  # a comment, a declaration, or a tag that the page's end cuts off
            continue
        tag = m[2].lower()
        if m[1]:
            at = _closed(at, tag)
            continue
        at = _opened(at, tag)
        node = Node(tag, m[3] or "", at)
        at.children.append(node)
        if tag in RAW:
            end = RAW[tag].search(page, place)
            place = end.start() if end else n
            if end and node.depth < DEEPEST:
                at = node
        elif tag not in VOID and node.depth < DEEPEST:
            at = node
    return root


def _opened(at: Node, tag: str) -> Node:
    """Where an element of that tag goes: what it ends is closed."""
    if tag in CLOSES_P:
        up = at
        while up.parent and up.tag != "p" and up.tag not in SCOPES:
            up = up.parent
        if up.tag == "p":
            at = up.parent
        if tag in HEADINGS and at.tag in HEADINGS:
            at = at.parent
    if tag in ENDS:
        ended, within = ENDS[tag]
        up, outer = at, None
        while up.parent and up.tag not in within:
            if up.tag in ended:
                outer = up
                if tag not in ("tr", "thead", "tbody", "tfoot"):
                    break
            up = up.parent
        if outer:
            at = outer.parent
    return at


def _closed(at: Node, tag: str) -> Node:
    """The parent of the nearest open element of that tag; an end tag of an inline element does not reach beyond a block."""
    up = at
    while up.parent and up.tag != tag:
        if tag not in BLOCKS and up.tag in SCOPES and tag not in SCOPES:
            return at
        up = up.parent
    return up.parent if up.parent else at


def _order(root: Node) -> list[Node]:
    """All nodes, parents first."""
    out = [root]
    for node in out:
        out.extend(c for c in node.children if isinstance(c, Node))
    return out


def _unfit(node: Node) -> bool:
    if node.tag in DROPPED:
        return True
    if node.tag == "header":
        up = node.parent
        while up and up.tag not in ("article", "main"):
            up = up.parent
        if up is None:
            return True
    if not node.attributes or node.tag in ("html", "body", "main"):
        return False
    words = node.words()
    return bool(words & UNFIT) or "\0hidden" in words


def _prune(root: Node) -> None:
    """Cuts off what is no part of an article. An element that names itself so but holds the page's main element or article is a frame, and stays."""
    holds = set()
    for node in _order(root):
        if node.tag in ("main", "article") and not _unfit(node):
            up = node.parent
            while up and up not in holds:
                holds.add(up)
                up = up.parent
    stack = [root]
    while stack:
        node = stack.pop()
        frame = lambda c: c in holds and c.tag in ("div", "section", "td", "table", "tr", "tbody", "center", "form", "span") and not c.words() & {"comment", "comments", "commentlist", "related", "sidebar"}
        node.children = [c for c in node.children if not isinstance(c, Node) or not _unfit(c) or frame(c)]
        stack.extend(c for c in node.children if isinstance(c, Node))


def _inline_text(node: Node) -> str:
    """The text of a block outside blocks within it."""
    out: list[str] = []
    stack = list(reversed(node.children))
    while stack:
        c = stack.pop()
        if isinstance(c, str):
            out.append(c)
        elif c.tag == "br":
            out.append("\n")
        elif c.tag not in BLOCKS:
            stack.extend(reversed(c.children))
    return " ".join("".join(out).split())


def _measure(nodes: list[Node]) -> None:
    """Length of text, length of text in links, and links of each node; bottom up."""
    for node in reversed(nodes):
        own = sum(len("".join(c.split())) for c in node.children if isinstance(c, str))
        inner = [c for c in node.children if isinstance(c, Node)]
        node.size = own + sum(c.size for c in inner)
        node.linked = node.size if node.tag == "a" else sum(c.linked for c in inner)
        node.links = (node.tag == "a") + sum(c.links for c in inner)


def _share(node: Node) -> float:
    return node.linked / node.size if node.size else 0.0


def _score(nodes: list[Node]) -> None:
    for node in nodes:
        if node.tag not in BLOCKS and node.parent:
            continue
        text = _inline_text(node)
        if not text:
            continue
        points = (1 + len(text) / 100 + text.count(",") + text.count("，") + text.count("、")) * (1 - _share(node))
        up: Node | None = node
        while up and up.parent and up.tag in PARTS:  # a container has its own text's points, a part of one gives them away
            up = up.parent
        level = 1
        while up:
            up.points += points / level
            level += 1
            up = up.parent


def _best(nodes: list[Node]) -> Node | None:
    """The container with the most points after the discount for links; of equal ones the outermost."""
    found, most = None, 0.0
    for node in nodes:
        if not node.points or node.tag not in BLOCKS and node.parent:
            continue
        weight = WEIGHT.get(node.tag, 0.0) + (15.0 if node.attributes and node.words() & FIT else 0.0)
        node.points = max((node.points + weight) * (1 - _share(node)), node.points * 0.01)
        if found is None or node.points > most:
            found, most = node, node.points
    return found


def _is_heading(node: Node) -> bool:
    """Whether all text of a block lies in first or second headings."""
    stack: list = [node]
    while stack:
        c = stack.pop()
        if isinstance(c, str):
            if c.strip():
                return False
        elif c.tag not in ("h1", "h2"):
            stack.extend(c.children)
    return bool(node.size)


def _kept(best: Node) -> list[Node | str]:
    """The best container, or the article element around it, and the siblings that belong to it, in page order."""
    up: Node | None = best
    while up and up.tag != "article":
        up = up.parent
    best = up or best
    if best.parent is None or best.tag in ("body", "html"):
        return [best]
    out: list[Node | str] = []
    siblings = best.parent.children
    for c in siblings:
        if c is best:
            out.append(c)
        elif isinstance(c, Node) and c.tag in BLOCKS:
            share = _share(c)
            heading = c.tag == "header" or _is_heading(c)
            prose = c.tag in ("p", "pre", "blockquote", "ul", "ol", "table", "figure") and (c.size >= PROSE and share < LINKED or c.size and not c.links and c.tag in ("p", "pre", "blockquote"))
            if heading or prose or c.points >= SIBLING * best.points and share < LINKED:
                out.append(c)
    return out


def _is_box(node: Node) -> bool:
    """Whether a list or box inside an article is made of links."""
    return node.tag in ("ul", "ol", "dl", "div", "section", "table") and node.links >= BOX_LINKS and _share(node) >= BOX_SHARE


def _blocks(kept: list[Node | str]) -> list[str]:
    """The texts of the blocks in page order, white space as one space each."""
    out: list[str] = []
    run: list[str] = []

    def end() -> None:
        text = " ".join("".join(run).split())
        if text:
            out.append(text)
        run.clear()

    stack: list = list(reversed(kept))
    while stack:
        c = stack.pop()
        if c is None:
            end()
        elif isinstance(c, str):
            run.append(c)
        elif c.tag == "br":
            run.append("\n")
        elif c.tag in BLOCKS:
            end()
            if not _is_box(c) or c in kept:
                stack.append(None)
                stack.extend(reversed(c.children))
        else:
            stack.extend(reversed(c.children))
    end()
    return out


def main_text(page: str | bytes | None) -> str:
    """The main text of a page, empty if there is none; bytes that are no UTF-8 count as U+FFFD."""
    page = page.decode("utf-8", "replace") if isinstance(page, bytes) else page or ""
    root = parse(page)
    _prune(root)
    nodes = _order(root)
    _measure(nodes)
    _score(nodes)
    best = _best(nodes)
    return " ".join(_blocks(_kept(best))) if best else ""


def main_text_column(column):
    """The main text of a column of pages; a null page has an empty one."""

    @F.arrow_udf("string")
    def made(pages: pa.Array) -> pa.Array:
        return pa.array([main_text(p) for p in pages.to_pylist()], pa.string())

    return made(column.cast("binary"))


def extract(df: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """key, url, text, n_chars (code points): the main text of each page.

    A null or empty page, and one without text, have an empty text; nulls in key and url stay; repeated
    rows are rows each; an empty table gives an empty one; other columns are dropped. Whole pages are read, however long.
    """
    small_batches(df.sparkSession)
    own = take(df, key, url, page)
    return own.select(key, url, main_text_column(own[page]).alias("text")).withColumn("n_chars", F.char_length("text").cast("long"))
