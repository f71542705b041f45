"""Main text of web pages by tree scoring.

A page is read into a small tree. Elements that never hold article text are left out while
reading (scripts, styles, forms, navigation, footers, asides, and elements whose class, id or role
names them as such). Every paragraph-like block then passes points for length and commas to its
ancestors, halved on each level; an ancestor's points are discounted by its link density. The best
container is kept whole, together with siblings that score well themselves or read like
paragraphs of the same article.

One map over the pages, one page in memory at a time.
"""

from __future__ import annotations

import html
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.rows import map_texts

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)\]\]>|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
# One attribute after the other, each with its value, so that neither a value nor part of a name is taken for a name.
_ATTR = re.compile(r"([^\s=>/][^\s=>/]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_SPACE = re.compile(r"\s+")
_COMMA = re.compile("[,،﹐︐、，]")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template svg math".split())
DROP = RAW | frozenset("head nav footer aside form button select option dialog menu object canvas audio video map label fieldset".split())
BLOCK = frozenset("address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot"}
PARAGRAPH = frozenset("p pre blockquote td dd li figcaption".split())
# An opening tag ends an open element of these kinds, looked for up to the given walls.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"})}
WALLS = frozenset("table td th body html article section div main".split())
# Words in class, id or role that mark furniture, and words that mark content.
FURNITURE = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|banner|breadcrumbs?|byline-social|comments?|comment-\w+|cookies?|consent|copyright|disqus|footer|gdpr|header|masthead|menu|modal|nav|navbar|navigation|newsletter|notice|pager|pagination|paywall|popup|promo\w*|recommend\w*|related|replies|respond|rss|search|share|sharing|shoutbox|sidebar|side-bar|skip|social|sponsor\w*|subscribe|tags|teaser|toolbar|tracking|widget|complementary|contentinfo|alert|signup|login)(?=$|[\s_-])",
    re.I,
)
CONTENT = re.compile(r"(?:^|[\s_-])(?:article\w*|body|content|entry\w*|main\w*|page|post\w*|story|text|blog)(?=$|[\s_-])", re.I)
# Share of the best score that a sibling needs, and the smallest such score.
SIBLING_SHARE, SIBLING_LEAST = 0.2, 10.0
# Containers that are menus when more than this share of their characters is linked.
LISTS, LINK_LIST = frozenset("ul ol dl div section table".split()), 0.6


class Node:
    __slots__ = ("tag", "names", "parent", "kids", "score", "length", "linked", "seeded")

    def __init__(self, tag: str, names: str, parent: Node | None):
        self.tag, self.names, self.parent = tag, names, parent
        self.kids: list[Node | str] = []
        self.score, self.length, self.linked, self.seeded = 0.0, 0, 0, False


def _names(attrs: str) -> tuple[str, bool]:
    """Class, id and role as one string; true if the element is hidden."""
    names, hidden = [], False
    for m in _ATTR.finditer(attrs):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key in ("class", "id", "role"):
            names.append(value)
        elif key == "hidden" or (key == "aria-hidden" and value.lower() == "true") or (key == "style" and "display:none" in value.replace(" ", "").lower()):
            hidden = True
    return " ".join(names), hidden


def _inside(node: Node | None, tags: set[str]) -> bool:
    while node is not None:
        if node.tag in tags:
            return True
        node = node.parent
    return False


def _unwanted(tag: str, names: str, hidden: bool, parent: Node) -> bool:
    if tag in DROP or hidden:
        return True
    if tag == "header":
        return not _inside(parent, {"article", "main"})
    if tag in ("body", "html", "article", "main", "a"):
        return False
    return bool(names) and FURNITURE.search(names) is not None and CONTENT.search(names) is None


def parse(page: str) -> Node:
    """The tree of a page without unwanted elements; text is kept raw, with references decoded."""
    root = Node("html", "", None)
    here, skip, at = root, "", 0
    inner: list[str] = []  # elements open inside the one that is skipped

    def add(text: str) -> None:
        if text and not skip:
            here.kids.append(html.unescape(text))

    pos = 0
    while True:
        m = _TOKEN.search(page, pos)
        if m is None:
            break
        add(page[at : m.start()])
        at = pos = m.end()
        tag = (m[3] or "").lower()
        if m[1] is not None:
            add(m[1])
            continue
        if not tag:
            continue
        if m[2]:
            if skip:
                if tag in inner:
                    while inner.pop() != tag:
                        pass
                    continue
                if tag == skip:
                    skip = ""
                    continue
                if tag not in BLOCK or not _inside(here, {tag}):
                    continue
                skip = ""  # the end of an element around it ends the skipped one as well
            node = here
            while node is not None and node.tag != tag and not (tag not in BLOCK and node.tag in BLOCK):
                node = node.parent
            if node is not None and node.tag == tag and node.parent is not None:
                here = node.parent
            continue
        closed = m[4].endswith("/") or tag in VOID
        if skip and not inner and ((skip == "p" and tag in CLOSES_P) or (tag in ENDS and skip in ENDS[tag][0])):
            skip = ""  # HTML ends the skipped element here
        if skip:
            if not closed and tag not in RAW:
                if tag in ENDS:  # an open element of the same kind ends here, up to its own list or table
                    last = max((i for i, t in enumerate(inner) if t in ENDS[tag][0]), default=-1)
                    if last >= 0 and not ENDS[tag][1] & set(inner[last + 1 :]):
                        del inner[last:]
                inner.append(tag)
                continue
            if tag not in RAW:
                continue
        if tag in RAW and not closed:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, pos)
            at = pos = end.end() if end else len(page)
            continue
        if tag == "html":
            continue
        if tag in CLOSES_P:
            node = here
            while node is not None and node.tag not in WALLS and node.tag != "p":
                node = node.parent
            if node is not None and node.tag == "p":
                here = node.parent
        if tag in ENDS:
            kinds, walls = ENDS[tag]
            node, last = here, None
            while node is not None and node.tag not in walls:
                if node.tag in kinds:
                    last = node
                node = node.parent
            if last is not None:
                here = last.parent
        names, hidden = _names(m[4]) if m[4].strip("/ ") else ("", False)
        if _unwanted(tag, names, hidden, here):
            if not closed:
                skip, inner = tag, []
            continue
        node = Node(tag, names, here)
        here.kids.append(node)
        if not closed:
            here = node
    add(page[at:] if at < len(page) and not re.match(r"<[a-zA-Z/!]", page[at:]) else re.split(r"<[a-zA-Z/!]", page[at:])[0])
    return root


def _walk(root: Node) -> list[Node]:
    """All elements, parents first; no recursion, so depth does not matter."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo += [k for k in reversed(node.kids) if isinstance(k, Node)]
    return out


def blocks(node: Node) -> list[str]:
    """Texts of the blocks below ``node`` in page order, white space collapsed; outside an article, lists of links are menus and left out."""
    out: list[str] = []
    menus = not _inside(node, {"article", "main"})
    held: list[str] = []

    def flush() -> None:
        text = _SPACE.sub(" ", "".join(held)).strip()
        held.clear()
        if text:
            out.append(text)

    todo: list = [node]
    while todo:
        k = todo.pop()
        if k is None:
            flush()
        elif isinstance(k, str):
            held.append(k)
        elif k.tag == "br":
            held.append(" ")
        elif menus and k is not node and k.tag in LISTS and k.linked and _density(k) > LINK_LIST:
            continue
        else:
            if k.tag in BLOCK:
                flush()
                todo.append(None)
            todo += reversed(k.kids)
    flush()
    return out


def _measure(nodes: list[Node]) -> None:
    """Characters and linked characters of every element, children before parents."""
    for n in reversed(nodes):
        own = sum(len(_SPACE.sub(" ", k).strip()) for k in n.kids if isinstance(k, str))
        n.length += own
        if n.tag == "a":
            n.linked = n.length
        if n.parent is not None:
            n.parent.length += n.length
            n.parent.linked += n.linked


def _density(n: Node) -> float:
    return n.linked / n.length if n.length else 0.0


def _seed(n: Node) -> float:
    """Points an element has before its paragraphs add theirs."""
    base = {"article": 10.0, "main": 8.0, "div": 3.0, "section": 3.0, "pre": 3.0, "td": 3.0, "blockquote": 3.0}.get(n.tag, -5.0 if n.tag in ("h1", "h2", "h3", "h4", "h5", "h6", "th") else -3.0 if n.tag in ("ul", "ol", "dl", "li") else 0.0)
    if n.names:
        base += 25.0 * (CONTENT.search(n.names) is not None) - 25.0 * (FURNITURE.search(n.names) is not None)
    return base


def _is_paragraph(n: Node) -> bool:
    if n.tag in PARAGRAPH:
        return True
    return n.tag in ("div", "section", "article", "main", "body", "html") and any(isinstance(k, str) and k.strip() for k in n.kids)


def main_blocks(page: str | None) -> list[str]:
    """Text blocks of the article of one page."""
    if not page:
        return []
    root = parse(page)
    nodes = _walk(root)
    _measure(nodes)
    for n in nodes:
        if not _is_paragraph(n) or not n.length:
            continue
        text = "".join(k for k in n.kids if isinstance(k, str)) if n.tag not in PARAGRAPH else " ".join(blocks(n))
        if not text.strip():
            continue
        points = 1.0 + len(_COMMA.findall(text)) + min(len(text) / 100.0, 3.0)
        up, share = (n if n.tag not in PARAGRAPH else n.parent), 1.0
        while up is not None:
            if not up.seeded:
                up.seeded, up.score = True, up.score + _seed(up)
            up.score += points * share
            up, share = up.parent, share / 2.0
    scored = [n for n in nodes if n.seeded]
    if not scored:
        return blocks(root)
    final = {id(n): n.score * (1.0 - _density(n)) for n in scored}
    best = max(scored, key=lambda n: final[id(n)])  # the first in page order wins a tie
    if best.parent is None:
        return blocks(best)
    least = max(SIBLING_LEAST, SIBLING_SHARE * final[id(best)])
    kept: list[str] = []
    for k in best.parent.kids:
        if k is best:
            kept += blocks(k)
        elif isinstance(k, Node):
            same = 0.2 * final[id(best)] if k.names and k.names == best.names else 0.0
            good = k.seeded and final[id(k)] + same >= least
            if k.tag == "p" and not good:
                good = (k.length > 80 and _density(k) < 0.25) or (0 < k.length <= 80 and not k.linked and any("." in b for b in blocks(k)))
            if good:
                kept += blocks(k)
    return kept


def _extract(ids: list, pages: list) -> dict:
    texts = ["\n".join(main_blocks(p)) for p in pages]
    return {"row": ids, "text": texts, "n_chars": [len(t) for t in texts]}


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars``, one row per input row.

    Null, empty and text-free pages give an empty text. Repeated rows are kept. Cut-off markup is
    read as far as it goes. Columns other than ``page_id``, ``url`` and ``html`` are ignored.
    """
    rows = pages.select(F.struct(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url")).alias("doc_id"), F.col("html").cast("string").alias("text"))
    return map_texts(rows, _extract, "row struct<page_id: long, url: string>, text string, n_chars long").select("row.page_id", "row.url", "text", "n_chars")
