"""Main text of web pages by composite text density.

A page becomes a tree, read as browsers do: attributes by their own quotes, tags left open end with their parents, script,
style and the like are raw text.  Every node has C, its characters; L, those that count as links; T, its tags and U, its link
tags.  Its composite density is ``C / T * log(C * T / (L * U), base ln(C * L / N + l * C / c + e))`` with N = C - L, c and l of
the body (all counts at least one); a node without text has none.  The density sum of a node adds its children's densities.

The node of greatest density sum holds the content, and the least density on the path from the body to it is the threshold.
From that node the content widens to the parent while a sibling there belongs to it too: a heading or paragraph outside
links, or a part of running text whose density reaches the threshold; it ends at an ``article`` or ``main``.  Inside the content,
parts of more link characters than others below the threshold go.

Three kinds of text bear on density rather than decide by themselves.  Elements that are never content by the meaning of their
tag (``nav``, ``footer``, ``aside``, page headers, hidden parts, controls) have no characters and no text, unless they were never closed and
hold most of the page's text.  Forms, and boxes whose class or id names boilerplate (``SUSPECT``), count all their characters
as link characters, so their density is nothing and they lose every comparison; names never empty a page, for a box with
an ``article``, ``main`` or ``h1`` in it, a heading or a paragraph is never suspect, and where all text is suspect the names are ignored.

Blocks (paragraphs, headings, list items, cells, lines of preformatted text) come in page order, character references
decoded, white space within a block made one space, trimmed, and are joined by two line feeds.

Defined cases: null or empty html gives an empty text; html cut off anywhere is read as far as it goes; a page without
a body or without tags gives the text that it has; pages of any length and depth are read whole; repeated rows are kept;
an empty table gives an empty result; of the pages' columns only id, url and html are read, so other names cannot clash.
"""

from __future__ import annotations

import html as _html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import prepare

_ATTRIBUTES = r"""(?:[\s/]++|[^\s/>=][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z)|[^\s>"'][^\s>]*+)?)?|=)*+"""
_TOKEN = re.compile(rf"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)({_ATTRIBUTES})(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"""([^\s/>=][^\s/>=]*)(?:\s*=\s*(?:"([^"]*)"?|'([^']*)'?|([^\s>"'][^\s>]*)))?""")
_ALONE = re.compile(r"""(?:^|[\s"'])/\Z""")
_CUT_TAG = re.compile(r"</?[a-zA-Z]?\Z")
_SPACES = re.compile(r"\s+")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp template svg math object select canvas video audio".split())
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Never content by the meaning of the tag.
_NEVER = frozenset("nav footer aside header head button menu dialog".split())
#: Elements that hold others; paragraphs and headings are not among them.
_BOXES = frozenset("div section ul ol dl table form fieldset details center span".split())
#: Which open tags an opening tag ends, up to the nearest of the tags that hold them.
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tr", "td", "th", "tbody", "thead"}, {"table"}), "option": ({"option"}, {"select"}),
}
_ENDS_P = _BLOCK - {"html", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "li", "dd", "dt"}
#: Names of boxes that are seldom content, and words beside them that say otherwise.
SUSPECT = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo banner cookie cookies consent gdpr notice notices popup modal overlay nav navbar navigation "
    "menu breadcrumb breadcrumbs sidebar footer masthead topbar comment comments respond disqus replies share sharing social related recommended newsletter subscribe "
    "signup login widget widgets toolbar pagination pager copyright disclaimer".split()
)
_UNLESS = frozenset("no not has have with without print post article entry content main story work works body text".split())
_NOT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar toolbar".split())
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


class Node:
    __slots__ = ("tag", "parent", "parts", "closed", "never", "suspect", "chars", "link_chars", "tags", "link_tags", "density", "total", "anchored")

    def __init__(self, tag: str, parent: Node | None, never: bool = False, suspect: bool = False):
        self.tag, self.parent, self.never, self.suspect = tag, parent, never, suspect
        self.parts: list[Node | str] = []
        self.closed = False
        self.density = self.total = 0.0


def parse(page: str) -> Node:
    """The tree of a page."""
    root = node = Node("#root", None)
    at, end = 0, len(page)
    lower = None
    while at < end:
        found = _TOKEN.search(page, at)
        if found is None:
            tail = page[at:]
            cut = tail.rfind("<")
            node.parts.append(tail[:cut] if cut >= 0 and _CUT_TAG.match(tail, cut) else tail)
            break
        if found.start() > at:
            node.parts.append(page[at : found.start()])
        at = found.end()
        tag = found[2]
        if tag is None:
            if found[0].startswith("<![CDATA["):
                node.parts.append(found[0][9:].removesuffix("]]>"))
            continue
        tag = tag.lower()
        if found[1]:
            if tag == "br":
                node.parts.append(Node("br", node))
                continue
            up = node
            while up is not root and up.tag != tag:
                if up.tag in ("table", "article", "body") and tag not in ("table", "article", "body", "html", "div", "main", "section", "form"):
                    up = root
                    break
                up = up.parent
            if up is not root:
                up.closed = True
                node = up.parent
            continue
        alone = bool(_ALONE.search(found[3]))
        if tag in _RAW:
            if alone and tag in ("svg", "math", "object", "canvas"):
                continue
            lower = page.lower() if lower is None else lower
            stop = lower.find(f"</{tag}", at)
            close = page.find(">", stop) if stop >= 0 else -1
            at = end if close < 0 else close + 1
            continue
        if tag in _VOID:
            if tag in ("br", "hr"):
                if tag == "hr" and node.tag == "p":
                    node = node.parent
                node.parts.append(Node(tag, node))
            continue
        if tag in _ENDS_P:
            up = node
            while up is not root and up.tag not in _BLOCK:
                up = up.parent
            if up.tag == "p":
                node = up.parent
        if tag in _ENDS:
            own, stop_at = _ENDS[tag]
            up = node
            while up is not root and up.tag not in stop_at:
                if up.tag in own:
                    node = up.parent
                up = up.parent
        if tag in ("html", "body") and any(n.tag == tag for n in _path(node)):
            continue
        if node.tag == "head" and tag not in ("meta", "link", "base"):
            node = node.parent  # the head ends with what cannot stand in it
        child = Node(tag, node, *_kind(tag, found[3], node))
        node.parts.append(child)
        if not (alone and (tag not in _BLOCK or child.never)):
            node = child
    return root


def _path(node: Node | None) -> Iterator[Node]:
    while node is not None:
        yield node
        node = node.parent


def _kind(tag: str, attributes: str | None, parent: Node) -> tuple[bool, bool]:
    """Whether an element is never content, and whether it is suspect."""
    never = tag in _NEVER and not (tag == "header" and any(n.tag in ("article", "main") for n in _path(parent)))  # an article's own header belongs to it
    suspect = tag in ("form", "fieldset")
    if not attributes or tag in ("html", "body", "article", "main"):
        return never, suspect
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), a or b or c
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and _HIDDEN.search(value):
            never = True
        elif name == "role" and value.lower() in _NOT_ROLES:
            never = True
        elif name in ("class", "id") and tag in _BOXES:
            for word in value.lower().split():
                parts = re.split(r"[-_]+", word)
                suspect = suspect or any(p in SUSPECT for p in parts) and not any(p in _UNLESS for p in parts)
    return never, suspect


def _order(root: Node) -> list[Node]:
    """All nodes, parents first."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack += [p for p in node.parts if isinstance(p, Node)]
    return out


def _characters(body: Node, order: list[Node]) -> None:
    """Decide what is never content: elements left open that hold most of the text are, after all."""
    size: dict[int, int] = {}
    for node in reversed(order):
        size[id(node)] = sum(size[id(p)] if isinstance(p, Node) else len(p.strip()) for p in node.parts)
        node.anchored = node.tag in ("article", "main", "h1") and not node.never or any(isinstance(p, Node) and p.anchored for p in node.parts)
    whole = size[id(body)]
    for node in order:
        if node.never and not node.closed and 2 * size[id(node)] > whole and node.tag != "head":
            node.never = False
        if node.suspect and (node.anchored or node.tag == "form" and 2 * size[id(node)] > whole):
            node.suspect = False


def measure(body: Node, names: bool = True) -> list[Node]:
    """Counts, densities and density sums of all nodes; ``names`` off ignores suspects."""
    order = _order(body)
    _characters(body, order)
    linked = {id(body): False}
    live = []
    stack = [body]
    while stack:  # nodes that are never content are left out with all that they hold
        node = stack.pop()
        live.append(node)
        for p in node.parts:
            if isinstance(p, Node) and not p.never:
                linked[id(p)] = linked[id(node)] or p.tag == "a" or names and p.suspect
                stack.append(p)
    for node in reversed(live):
        chars = link_chars = tags = link_tags = 0
        for part in node.parts:
            if isinstance(part, Node):
                if not part.never:
                    chars += part.chars
                    link_chars += part.link_chars
                    tags += part.tags + 1
                    link_tags += part.link_tags + (part.tag == "a")
            else:
                n = len(part.strip())
                chars += n
                link_chars += n if linked[id(node)] else 0
        node.chars, node.link_chars, node.tags, node.link_tags = chars, link_chars, tags, link_tags
    for node in reversed(live):
        node.density = density(node, body)
        node.total = sum(p.density for p in node.parts if isinstance(p, Node) and not p.never)
    return live


def density(node: Node, body: Node) -> float:
    """Composite text density; 0 where all characters count as links."""
    c, links = node.chars, node.link_chars
    if not c or links >= c:
        return 0.0
    tags, link_tags = max(node.tags, 1), max(node.link_tags, 1)
    base = math.log(c * max(links, 1) / (c - links) + body.link_chars * c / max(body.chars, 1) + math.e)  # above 1
    return c / tags * math.log(max(c * tags / (max(links, 1) * link_tags), 1.0)) / math.log(base)


def choose(body: Node, live: list[Node]) -> tuple[Node, float]:
    """The content's node, and the threshold."""
    best = body
    for node in live:
        if node.total > best.total or node.total == best.total and node.total > 0 and any(n is best for n in _path(node.parent)):
            best = node
    path = []
    for node in _path(best):
        path.append(node)
        if node is body:
            break
    threshold = min(n.density for n in path)
    for node in path:  # an article or a main part is taken whole
        if node.tag in ("article", "main"):
            return node, threshold
    for node, parent in zip(path, path[1:], strict=False):
        if not any(isinstance(p, Node) and p is not node and _belongs(p, threshold) for p in parent.parts) and node.tag in _BOXES | {"td"}:
            return node, threshold
    return body, threshold


def _belongs(node: Node, threshold: float) -> bool:
    """Whether a sibling of the content is content too."""
    if node.never or node.suspect or not node.chars or 2 * node.link_chars > node.chars:
        return False
    return node.tag in _HEADINGS or node.tag in ("p", "pre", "blockquote") or node.total > 0 and node.density >= threshold


def blocks(node: Node, threshold: float, names: bool = True) -> list[str]:
    """The content's blocks of text."""
    out: list[list[str]] = [[]]

    def flush() -> None:
        if out[-1]:
            out.append([])

    stack: list[tuple[Node | str | None, bool]] = [(p, False) for p in reversed(node.parts)]
    while stack:
        part, pre = stack.pop()
        if part is None:
            flush()
        elif isinstance(part, str):
            if pre:
                for k, line in enumerate(part.split("\n")):
                    if k:
                        flush()
                    out[-1].append(line)
            else:
                out[-1].append(part)
        elif part.tag == "br":
            out[-1].append("\n")
            if pre:
                flush()
        elif not part.never:
            boxed = part.tag in _BOXES and part.tag != "span"
            if boxed and part.density < threshold and (2 * part.link_chars > part.chars and (names or not part.suspect)):
                continue
            if part.tag in _BLOCK:
                flush()
                stack.append((None, False))
            stack += [(p, pre or part.tag == "pre") for p in reversed(part.parts)]
    texts = (_SPACES.sub(" ", _html.unescape("".join(parts))).strip() for parts in out)
    return [t for t in texts if t]


def main_text(page: str | None) -> str:
    """The main text of a page."""
    if not page:
        return ""
    root = parse(page)
    body = next((n for n in _order(root) if n.tag == "body"), root)
    for names in (True, False):
        live = measure(body, names)
        found = blocks(*choose(body, live), names) if any(n.density for n in live) or not names else []
        if found:
            return "\n\n".join(found)
    return ""


def extract_pages(pages: DataFrame, id_col: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Per row: id, url, ``text`` and ``n_chars``, its code points."""
    prepare(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page.as_py()) for page in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["id", "url", "text", "n_chars"])

    own = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url).alias("url"), F.col(html).alias("html"))
    return own.mapInArrow(run, "id long, url string, text string, n_chars long").withColumnsRenamed({"id": id_col, "url": url})
