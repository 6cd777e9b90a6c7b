"""Main text of web pages by tree scoring.

Each page is read into a tree of containers and blocks of text. A block passes points to its
parent and half of them to its grandparent: one, one for each comma, one for each hundred
characters up to three. A container's points are discounted by the share of its text that stands
in links. The container with the most points is the article; a sibling is kept with it when it
has a fifth of those points, is a long block with few links, or is a heading or paragraph
without links.

Never part of an article: scripts, styles, templates, forms and their controls (a form that holds
most of the page's text is a container like any other), menus, page
headers and footers, asides, and containers named like adverts, notices, sidebars or comments.
Inside an article its own header counts as text. Character references are decoded, white space
inside a block becomes one space, blocks stand in page order, one per line.

A small tokenizer reads real-world markup: unclosed and stray tags, a quote inside an attribute,
markup inside scripts, references without a semicolon. Cases: null, empty and textless pages give
an empty text; rows without a page_id keep it null; repeated rows give a row each; other columns
are ignored; an empty table gives an empty result. The tree is walked without recursion, so deep
nesting is no limit.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"""
    r"""|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>"']|"[^"]*"|'[^']*')*)>|(?P<text>[^<]+|<(?![a-zA-Z/!?]))""",
    re.S,
)
_ATTR = re.compile(r"""([a-zA-Z_:][-\w:.]*)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_RAW = frozenset({"script", "style", "textarea", "title", "noscript", "iframe", "template", "svg", "xmp", "noembed", "noframes"})
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split()
)
_DROPPED = frozenset("script style template noscript iframe svg canvas object form button select option textarea input nav aside footer dialog menu title head".split())
_BAD_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar form".split())
_BAD_NAMES = re.compile(
    r"(?:^|[-_\s])(?:ad|ads|advert\w*|adsense|banner|sponsor\w*|promo\w*|sidebar|side|nav|navbar|navigation|menu|menus|breadcrumbs?|masthead|footer|foot|cookies?|"
    r"consent|gdpr|notice|notification|newsletter|subscribe|popup|modal|overlay|comments?|commentlist|disqus|respond|replies|reply|related|recommended|share|sharing|social|"
    r"widget|pagination|pager|skip|toolbar|login|signup)(?:$|[-_\s])",
    re.I,
)
_HEADER_NAMES = re.compile(r"(?:^|[-_\s])header(?:$|[-_\s])", re.I)
_BROKEN = re.compile(r"<(?P<close>/?)(?P<name>[a-zA-Z]?[^\s/>]*)(?P<attrs>[^>]*)>", re.S)
#: Opening one of these ends an open paragraph, or an open element of the same kind.
_ENDS_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main menu nav ol p pre section table ul dd dt".split()
)
_ENDS_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPES = frozenset("ul ol dl table div section article main body html".split())


class Node:
    __slots__ = ("name", "parent", "children", "dropped", "points", "chars", "linked", "block", "form")

    def __init__(self, name: str, parent: Node | None, dropped: bool = False):
        self.name, self.parent, self.dropped = name, parent, dropped
        self.children: list = []
        self.points, self.chars, self.linked, self.block, self.form = 0.0, 0, 0, False, False


def _unwanted(name: str, attrs: str, in_article: bool) -> bool:
    if name in _DROPPED or (name == "header" and not in_article):
        return True
    if not attrs or name in ("html", "body", "article", "main"):
        return bool(attrs) and name in ("article", "main") and bool(re.search(r"\bcomments?\b", attrs, re.I))
    for key, a, b, c in _ATTR.findall(attrs):
        key, value = key.lower(), a or b or c
        if key in ("class", "id") and (_BAD_NAMES.search(value) or (not in_article and _HEADER_NAMES.search(value))):
            return True
        if key == "role" and value.lower() in _BAD_ROLES or key == "aria-hidden" and value.lower() == "true":
            return True
        if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
    return bool(re.search(r"(?:^|\s)hidden(?:\s|=|/|$)", _ATTR.sub(" ", attrs)))


def parse(page: str) -> Node:
    """The tree of containers; leaves are strings."""
    root = Node("#root", None)
    here, at, articles = root, 0, 0
    page = page.replace("\r\n", "\n")
    while at < len(page):
        m = _TOKEN.match(page, at)
        if m is None:  # a stray quote in a tag, or a tag that the page's end cuts off
            m = _BROKEN.match(page, at)
            if m is None:
                break
        elif m["text"] is not None or m["cdata"] is not None:
            here.children.append(m["text"] or m["cdata"] or "")
        at = m.end()
        if not m["name"]:
            continue
        name = m["name"].lower()
        if m["close"]:
            node = here
            while node is not root and node.name != name:
                if node.name in _SCOPES and name not in _SCOPES:
                    node = root
                    break
                node = node.parent
            if node is not root:
                while True:
                    articles -= here.name == "article"
                    done = here is node
                    here = here.parent
                    if done:
                        break
            continue
        if name == "body" and here.name == "head":
            here = here.parent
        ends = _ENDS_SAME.get(name, {"p"} if name in _ENDS_P else None)
        if ends:
            node = here
            while node is not root and node.name not in ends and node.name not in _SCOPES:
                node = node.parent
            if node is not root and node.name in ends:
                here = node.parent
        node = Node(name, here, _unwanted(name, m["attrs"], articles > 0))
        node.form = name == "form" and not _unwanted("div", m["attrs"], articles > 0)
        here.children.append(node)
        if name in _RAW:
            end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
        elif name not in _VOID and not m["attrs"].rstrip().endswith("/"):
            here = node
            articles += name == "article"
    return root


def _walk(root: Node) -> list[tuple[Node, str, bool]]:
    """(container, block text, text of links in it) in page order, without dropped parts."""
    blocks: list[tuple[Node, str, int]] = []
    text: list[str] = []
    linked: list[str] = []
    owner = root
    stack: list[tuple] = [("in", root, root, False)]

    def flush() -> None:
        if text:
            line = " ".join(html.unescape("".join(text)).split())
            if line:
                blocks.append((owner, line, len(" ".join(html.unescape("".join(linked)).split()))))
            text.clear()
            linked.clear()

    while stack:
        what, node, holder, link = stack.pop()
        if what == "text":
            if holder is not owner:
                flush()
                owner = holder
            text.append(node)
            if link:
                linked.append(node)
        elif what == "out":
            flush()
        elif not node.dropped:
            if node.name == "br":
                text.append(" ")
                continue
            if node.name == "hr":
                flush()
                continue
            inline = node.name in _INLINE
            if not inline:
                flush()
                stack.append(("out", node, holder, link))
                holder = node
            link = link or node.name == "a"
            for child in reversed(node.children):
                stack.append(("text" if isinstance(child, str) else "in", child, holder, link))
    flush()
    return blocks


def _blocks(root: Node) -> list[tuple[Node, str, int]]:
    """Blocks of the page; forms with most of its text are kept, all others dropped."""
    forms, stack = [], [root]
    while stack:
        node = stack.pop()
        if node.form:
            forms.append(node)
            node.dropped = False
        stack += [] if node.dropped else [child for child in node.children if not isinstance(child, str)]
    blocks = _walk(root)
    if not forms:
        return blocks
    held: dict[int, int] = {}
    for owner, line, _ in blocks:
        node = owner
        while node is not None:
            held[id(node)] = held.get(id(node), 0) + len(line)
            node = node.parent
    for node in forms:
        node.dropped = 2 * held.get(id(node), 0) <= held.get(id(root), 0)
    return _walk(root)


_LEAF = frozenset("p h1 h2 h3 h4 h5 h6 li td th pre blockquote dd dt figcaption caption summary".split())


_SHORT = frozenset("p h1 h2 h3 h4 h5 h6".split())


def main_text(page: str | None) -> str:
    """The article of a page, blocks joined by line breaks."""
    if not page:
        return ""
    blocks = _blocks(parse(page))
    if not blocks:
        return ""
    scored: list[Node] = []
    for owner, line, linked in blocks:
        node = owner
        while node is not None:
            node.chars += len(line)
            node.linked += linked
            node = node.parent
        target = owner.parent if owner.name in _LEAF and owner.parent is not None else owner
        if len(line) < 25:
            continue
        points = 1 + line.count(",") + min(len(line) // 100, 3)
        for node, share in ((target, 1.0), (target.parent, 0.5)):
            if node is not None:
                if not node.points:
                    scored.append(node)
                node.points += points * share
    if not scored:
        best = _only(blocks)
    else:
        value = {id(n): n.points * (1 - n.linked / n.chars if n.chars else 1) for n in scored}
        best = max(scored, key=lambda n: value[id(n)])
        while best.parent is not None and best.name in _LEAF:
            best = best.parent
        node = best
        while node is not None and node.name not in ("article", "main"):
            node = node.parent
        if node is not None:
            best = node
        floor = max(10.0, value.get(id(best), 0.0) * 0.2)
        chosen = {id(best)}
        for child in best.parent.children if best.parent is not None and best.name not in ("article", "main", "body", "html") else ():
            if isinstance(child, str) or child is best or child.dropped or not child.chars:
                continue
            density = child.linked / child.chars
            if value.get(id(child), 0.0) >= floor or (child.name in _LEAF and density < 0.25 and child.chars > 80) or (child.name in _SHORT and not child.linked):
                chosen.add(id(child))
        return "\n".join(line for owner, line, _ in blocks if _within(owner, chosen))
    return "\n".join(line for owner, line, _ in blocks if _within(owner, {id(best)}))


def _only(blocks: list) -> Node:
    """Without a block worth points: the deepest article or main element, else everything."""
    for owner, _, _ in blocks:
        node = owner
        while node is not None:
            if node.name in ("article", "main"):
                return node
            node = node.parent
    node = blocks[0][0]
    while node.parent is not None:
        node = node.parent
    return node


def _within(node: Node | None, chosen: set[int]) -> bool:
    while node is not None:
        if id(node) in chosen:
            return True
        node = node.parent
    return False


def _extracted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for at in range(0, len(batch), 1000):
            part = batch.iloc[at : at + 1000]
            texts = [main_text(page) for page in part["html"]]
            yield pd.DataFrame({"page_id": part["page_id"].to_numpy(), "url": part["url"].to_numpy(), "text": texts, "n_chars": [len(t) for t in texts]})


def extract_text(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInPandas(_extracted, "page_id long, url string, text string, n_chars long")
