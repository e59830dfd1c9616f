"""Main text of web pages by tree scoring.

A page is parsed into a tree with the usual implied end tags. Boilerplate elements go first (by tag, by role, by whole names in
their class and id, hidden ones); an element that holds most of the page's paragraphs is not dropped for its name. Each paragraph then scores one point, one for each comma, and one for each hundred
characters up to three; the points pass to its ancestors, in full to the parent, half to the grandparent and less above. A
container's points are discounted by its link density; the best one, with the article around it, is kept together with the siblings
that score well or read like prose. Lists and boxes inside it that are mostly links are menus and go too, except lists of references.

Text: character references decoded, white space inside a block turned into one space, blocks in page order joined by two line
feeds. Nothing is cut off.

Defined cases: null and empty pages and pages without text give an empty text; unclosed tags end where an enclosing or following
block ends them; a page without a container of its own gives the whole body; repeated pages each get their row.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigrid.llm.common import map_batches, whole_text

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?>(?:"[^"]*"|'[^']*'|[^>"'])*))>""")
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style title textarea iframe noembed noframes xmp".split())
_BLOCK = frozenset(
    """
    address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer
    form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th
    thead tr ul
    """.split()
)
#: elements that are never part of an article
_DROPPED = frozenset(
    """
    aside audio button canvas dialog embed fieldset footer form head iframe input map menu nav noembed noframes noscript
    object script select style svg template textarea title video
    """.split()
)
_DROPPED_ROLES = frozenset("alert banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
#: words of a class or id that mark boilerplate
_DROPPED_WORDS = frozenset(
    """
    ad ads advert adverts advertisement advertising adsense adslot aside banner breadcrumb breadcrumbs comment comments
    commentlist consent cookie cookies copyright disqus footer gdpr header login masthead menu menus modal nav navbar
    navigation newsletter notice notices notification outbrain overlay pager pagination popup promo promoted promotion
    recommended related replies reply respond share sharing sidebar signup social sponsor sponsored subscribe subscription
    taboola toolbar widget widgets
    """.split()
)
#: words that may stand beside them in one class name (``main-nav``, ``ad-slot-2``, ``comment-list``) without changing what it is
_NEUTRAL_WORDS = frozenset(
    """
    area bar body bottom box button buttons center col column container content cta form global group holder icon icons inline inner
    item items left link links list main outer page panel post posts primary right row secondary section site slot text top unit
    wrap wrapper
    """.split()
)
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: a start tag of the key closes an open element of the values
_CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "tbody"},
}
#: implied ends do not reach beyond these
_SCOPE = frozenset("table ul ol dl article section div main body html select button".split())
_PARAGRAPHS = frozenset("p pre td th blockquote li dd h2 h3 h4 h5 h6 section div article main".split())
_MENUS = frozenset("ul ol dl table div section".split())


class Node:
    """An element; ``children`` holds texts and elements in page order."""

    __slots__ = ("attributes", "children", "parent", "score", "tag")

    def __init__(self, tag: str, attributes: str = "", parent: Node | None = None):
        self.tag, self.attributes, self.parent = tag, attributes, parent
        self.children: list[str | Node] = []
        self.score: float | None = None


def parse(page: str) -> Node:
    root = here = Node("html")
    at, size = 0, len(page)
    while at < size:
        lt = page.find("<", at)
        if lt < 0:
            here.children.append(html.unescape(page[at:]))
            break
        if lt > at:
            here.children.append(html.unescape(page[at:lt]))
        ahead = page[lt + 1 : lt + 2]
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            if page.startswith((">", "->"), lt + 4):
                end = page.find(">", lt) - 2
            at = size if end < 0 else end + 3
        elif ahead in ("!", "?"):
            end = page.find(">", lt)
            at = size if end < 0 else end + 1
        elif ahead == "/" or ahead.isascii() and ahead.isalpha():
            close = page.find(">", lt)
            found = _TAG.match(page, lt) if close >= 0 else None
            if found is None:
                # a tag that is never closed, or whose quotes are not
                if close < 0:
                    break
                name = re.match(r"</?([a-zA-Z][^\s/>]*)", page[lt : close + 1])
                slash, tag, attributes, at = ahead == "/", name.group(1).lower() if name else "", "", close + 1
            else:
                slash, tag, attributes, at = bool(found.group(1)), found.group(2).lower(), found.group(3), found.end()
            if not tag:
                continue
            if slash:
                here = _end(here, tag)
                continue
            here = _implied(here, tag)
            if tag in ("html", "body") and here.tag in ("html", "body") and tag == here.tag:
                continue
            node = Node(tag, attributes, here)
            here.children.append(node)
            if tag in _RAW:
                end = re.compile(rf"</{tag}(?=[\s/>])", re.IGNORECASE).search(page, at)
                if end is None:
                    at = size
                else:
                    close = page.find(">", end.end())
                    at = size if close < 0 else close + 1
            elif tag not in _VOID and not attributes.endswith("/"):
                here = node
            elif attributes.endswith("/") and tag not in _VOID and tag in _BLOCK:
                here = node
        else:
            here.children.append("<")
            at = lt + 1
    return root


def _implied(here: Node, tag: str) -> Node:
    """Where a start tag belongs, after the ends it implies."""
    if tag in _BLOCK:
        # a block ends an open paragraph with everything inside it
        walk: Node | None = here
        while walk is not None and walk.tag not in _SCOPE and walk.tag not in ("li", "td", "th"):
            if walk.tag == "p" and walk.parent is not None:
                here = walk.parent
                break
            walk = walk.parent
    ended = _CLOSES.get(tag)
    if ended:
        walk = here
        while walk is not None and (walk.tag in ended or walk.tag not in _SCOPE):
            if walk.tag in ended and walk.parent is not None:
                here = walk.parent
            walk = walk.parent
    return here


def _end(here: Node, tag: str) -> Node:
    """Close the nearest open element of this name; an end tag without one is ignored."""
    walk: Node | None = here
    while walk is not None:
        if walk.tag == tag:
            return walk.parent if walk.parent is not None else walk
        # an inline end tag does not close blocks around it
        if tag not in _BLOCK and walk.tag in _BLOCK:
            return here
        if tag in ("p", "li") and walk.tag in _SCOPE:
            return here
        walk = walk.parent
    return here


def _is_boilerplate(node: Node, carrying: set[int]) -> bool:
    tag = node.tag
    if tag in _DROPPED:
        return True
    if tag == "header":
        # the heading of an article belongs to it, a page header does not
        above = node.parent
        while above is not None and above.tag not in ("article", "main"):
            above = above.parent
        return above is None
    if not node.attributes or tag in ("html", "body"):
        return False
    for name, *values in _ATTRIBUTE.findall(node.attributes):
        name, value = name.lower(), next((v for v in values if v), "")
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.IGNORECASE):
            return True
        if name == "role" and value.lower() in _DROPPED_ROLES:
            return True
        # ids of headings and paragraphs are made from their words, so they say nothing
        named = name == "class" or name == "id" and tag not in _HEADINGS and tag != "p"
        if named and tag not in ("main", "h1") and id(node) not in carrying and any(map(_names_boilerplate, value.split())):
            return True
    return False


def _names_boilerplate(token: str) -> bool:
    """Whether a whole class name or id stands for boilerplate: ``cookie-notice`` does, ``has-sidebar`` and ``social-history`` do not."""
    if token.lower() in _DROPPED_WORDS:
        return True
    parts = [w.lower() for w in _WORD.findall(token)]
    rest = [w for w in parts if w not in _DROPPED_WORDS]
    return len(rest) < len(parts) and all(w in _NEUTRAL_WORDS or w.isdigit() or len(w) == 1 for w in rest)


def _carrying(root: Node) -> set[int]:
    """Elements whose names are no reason to drop them: they hold most of the page's paragraph text, and no ``article`` or ``main``
    with paragraphs stands outside of them.
    """
    prose: dict[int, int] = {}
    tops: dict[int, int] = {}
    nodes = _ordered(root)
    for node in reversed(nodes):
        inner = [c for c in node.children if isinstance(c, Node)]
        own = len(_own_text(node)) if node.tag == "p" else 0
        prose[id(node)] = own + sum(prose[id(c)] for c in inner)
        held = node.tag in ("article", "main") and prose[id(node)] > 0
        tops[id(node)] = held + sum(tops[id(c)] for c in inner)
    whole, articles = prose[id(root)], tops[id(root)]
    above: dict[int, int] = {}
    for node in nodes:
        up = node.parent
        above[id(node)] = 0 if up is None else above[id(up)] + (up.tag in ("article", "main"))
    return {id(n) for n in nodes if 2 * prose[id(n)] > whole and tops[id(n)] + above[id(n)] >= articles}


def _strip(root: Node) -> None:
    carrying = _carrying(root)
    stack = [root]
    while stack:
        node = stack.pop()
        kept: list[str | Node] = []
        for child in node.children:
            if isinstance(child, str):
                kept.append(child)
            elif not _is_boilerplate(child, carrying):
                kept.append(child)
                stack.append(child)
            else:
                kept.append(" ")
        node.children = kept


def _ordered(root: Node) -> list[Node]:
    """All elements, parents before children."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack.extend(c for c in reversed(node.children) if isinstance(c, Node))
    return out


def _measure(nodes: list[Node]) -> dict[int, tuple[int, int, int]]:
    """Of each element: characters, characters inside links, number of links."""
    out: dict[int, tuple[int, int, int]] = {}
    for node in reversed(nodes):
        size = linked = links = 0
        for child in node.children:
            if isinstance(child, str):
                size += len(" ".join(child.split()))
            else:
                inner = out[id(child)]
                size, linked, links = size + inner[0], linked + inner[1], links + inner[2]
        out[id(node)] = (size, size, links + 1) if node.tag == "a" else (size, linked, links)
    return out


def _own_text(node: Node) -> str:
    """Text of an element outside the blocks inside it."""
    parts: list[str] = []
    stack: list[str | Node] = list(reversed(node.children))
    while stack:
        child = stack.pop()
        if isinstance(child, str):
            parts.append(child)
        elif child.tag not in _BLOCK:
            stack.extend(reversed(child.children))
    return " ".join(" ".join(parts).split())


def _density(sizes: dict[int, tuple[int, int, int]], node: Node) -> float:
    size, linked, _ = sizes[id(node)]
    return linked / size if size else 0.0


def choose(root: Node) -> list[Node]:
    """The best container and the siblings kept with it, in page order."""
    nodes = _ordered(root)
    sizes = _measure(nodes)
    for node in nodes:
        if node.tag not in _PARAGRAPHS:
            continue
        text = _own_text(node)
        if not text:
            continue
        points = 1 + text.count(",") + text.count("，") + min(len(text) / 100, 3.0)
        # a box with text of its own is the container of that text
        above = node if node.tag in ("section", "div", "article", "main") else node.parent
        level = 0
        while above is not None and level < 5:
            share = 1.0 if level == 0 else 0.5 if level == 1 else 1.0 / (3 * level)
            above.score = (above.score if above.score is not None else _start(above)) + points * share
            above = above.parent
            level += 1
    best, most = None, 0.0
    for node in nodes:
        if node.score is None or node.tag in ("p", "span", "b", "i", "em", "strong", "a"):
            continue
        value = node.score * (1 - _density(sizes, node))
        if best is None or value > most:
            best, most = node, value
    if best is None:
        articles = [n for n in nodes if n.tag in ("article", "main") and sizes[id(n)][0]]
        return articles[:1] or [root]
    if best.tag in ("ul", "ol", "dl", "tr", "tbody", "table", "li", "td") and best.parent is not None:
        # a list is a part of the container around it
        while best.tag in ("ul", "ol", "dl", "tr", "tbody", "table", "li", "td") and best.parent is not None:
            best = best.parent
    # a container inside an article, or inside the main part of a page without one, is a part of it: the others are kept with it
    for wanted in ("article", "main"):
        whole: Node | None = best
        while whole is not None and whole.tag != wanted:
            whole = whole.parent
        if whole is not None:
            best = whole
            break
    if best.parent is None:
        return [best]
    kept = []
    bar = max(10.0, most * 0.2)
    for sibling in best.parent.children:
        if sibling is best:
            kept.append(best)
        elif isinstance(sibling, Node):
            value = (sibling.score or 0.0) * (1 - _density(sizes, sibling))
            text = _own_text(sibling) if sibling.tag in ("p", "h1", "h2", "blockquote", "pre") else ""
            prose = bool(text) and _density(sizes, sibling) < 0.25
            if sibling.tag != "head" and (value >= bar or prose):
                kept.append(sibling)
    return kept


def _start(node: Node) -> float:
    return {"article": 25.0, "main": 20.0, "div": 5.0, "section": 5.0, "blockquote": 3.0}.get(node.tag, 0.0)


def _drop_menus(top: Node) -> None:
    nodes = _ordered(top)
    sizes = _measure(nodes)
    for node in nodes:
        kept: list[str | Node] = []
        before: Node | None = None
        for child in node.children:
            menu = isinstance(child, Node) and child.tag in _MENUS and sizes[id(child)][2] >= 2 and _density(sizes, child) > 0.8
            kept.append(" " if menu and not _is_reference_list(child, before, sizes) else child)
            before = child if isinstance(child, Node) else before
        node.children = kept


def _is_reference_list(menu: Node, before: Node | None, sizes: dict[int, tuple[int, int, int]]) -> bool:
    """Links of an article's own: those that a heading or an introducing paragraph announces, or whose texts are as long as titles."""
    _, linked, links = sizes[id(menu)]
    if before is not None and (before.tag in _HEADINGS or before.tag == "p"):
        said = _own_text(before)
        if any(w.lower() in _DROPPED_WORDS for w in _WORD.findall(said)) and before.tag in _HEADINGS:
            return False
        if before.tag in _HEADINGS or said.endswith(":"):
            return True
    return linked >= 25 * links


def blocks(top: Node) -> list[str]:
    """Texts of the blocks below an element, in page order."""
    out: list[str] = []
    parts: list[str] = []

    def flush() -> None:
        text = " ".join("".join(parts).split())
        if text:
            out.append(text)
        parts.clear()

    stack: list[str | Node | None] = [top]
    while stack:
        item = stack.pop()
        if item is None:
            flush()
        elif isinstance(item, str):
            parts.append(item)
        elif item.tag in _BLOCK:
            flush()
            stack.append(None)
            stack.extend(reversed(item.children))
        elif item.tag in ("br", "img", "wbr"):
            parts.append("" if item.tag == "wbr" else " ")
        else:
            stack.extend(reversed(item.children))
    flush()
    return out


def main_text(page: str) -> str:
    """Main text of a page."""
    if not page:
        return ""
    root = parse(page)
    _strip(root)
    chosen = choose(root)
    out: list[str] = []
    for node in chosen:
        _drop_menus(node)
        out += blocks(node)
    return "\n\n".join(out)


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """Per page: ``page_id``, ``url``, ``text``, ``n_chars`` (code points)."""
    source = pages.select("page_id", "url", whole_text(html_col).alias("html"))

    def run(batch: pa.RecordBatch) -> dict:
        texts = [main_text(p) for p in batch.column("html").to_pylist()]
        return {n: batch.column(n) for n in ("page_id", "url")} | {"text": texts, "n_chars": [len(t) for t in texts]}

    kinds = ", ".join(f"{n} {source.schema[n].dataType.simpleString()}" for n in ("page_id", "url"))
    return map_batches(source, run, f"{kinds}, text string, n_chars bigint").select(
        "page_id", "url", F.col("text"), "n_chars"
    )
