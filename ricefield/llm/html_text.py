"""Main text of web pages by tree scoring.

A page is read into a tree.  Elements that are never article text (scripts, menus, forms,
...; by element, role or names in class and id) are taken out.  A name counts when all its
words are of such a kind or say where it stands, so ``no-sidebar`` and ``entry-header`` don't
count; and an element that only its name is against, a form or a dialog stays when it holds all
articles and main elements or most of the page's text, unless it is a thread of comments (its
controls and their labels go).  Every paragraph then passes points, one and more for commas and length, to its ancestors, in full to its parent and
less to each one above; an element's points are discounted by its link density.  The
element with most points is the container; the siblings that hold enough points, or are
paragraphs with few links, are kept with it.  The container grows to the article, main
element or content element around it.

Text: character references are decoded; white space within a block becomes one blank; the
blocks that hold text are joined by a line break, in page order.

Tags are read as a browser does: a quote counts only where an attribute's value begins.

Cases: a null, empty or text-free page gives the empty string; unclosed and stray tags are
read as a browser would, roughly: an open paragraph ends where a block begins; a page is
one row of any length; repeated rows are read each for itself; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ricefield.llm.common import sized, table

# Kinds of HTML elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript iframe template textarea title svg math object canvas noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead "
    "tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
NEVER = frozenset("head nav footer aside button select option input menu".split())
# Kinds of which a page may be made as a whole; a fieldset or label goes only with controls in it.
WRAPPERS = frozenset("form dialog fieldset".split())
CONTROLS = frozenset("button select input".split())
# An open element that ends when one of these begins, and the elements it does not reach over.
ENDS = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu", "dir"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
}
UNLIKELY = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner menu nav navbar navigation "
    "breadcrumb breadcrumbs sidebar aside footer header masthead topbar cookie cookies consent gdpr notice notices notification "
    "alert popup modal overlay comment comments reply replies disqus respond discussion related recommended recommendations share "
    "sharing social subscribe subscription newsletter signup login search pagination pager widget widgets toolbar skip hidden "
    "copyright".split()
)
THREADS = frozenset("comment comments reply replies disqus respond discussion".split())
# Words that may stand beside an unlikely one in a name.
PLACES = frozenset(
    "site global main primary secondary top bottom left right upper lower inner outer container wrapper wrap box block bar area "
    "list item items link links button buttons btn icon icons form posts articles stories row col column".split()
)
UNLIKELY_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog menu menubar".split())
CONTENT = frozenset("article main content post entry story body".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^=>]|=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'>][^\s>]*)?)*)(?:>|\Z)|</?[a-zA-Z][^>]*\Z", re.S
)
ATTRIBUTE = re.compile(r"([^\s=/>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>][^\s>]*))?", re.S)
WORD = re.compile(r"[a-z]+")
INVISIBLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Element:
    __slots__ = ("tag", "parent", "children", "names", "gone", "unlikely", "labels", "points", "chars", "link_chars")

    def __init__(self, tag: str, parent: Element | None, attributes: str = ""):
        self.tag, self.parent, self.children = tag, parent, []
        self.points, self.chars, self.link_chars = 0.0, 0, 0
        self.names, self.gone, self.labels = frozenset(), tag in NEVER, False
        self.unlikely = frozenset([tag]) if tag in WRAPPERS else frozenset()
        if attributes.strip():
            found = {k.lower(): (v or "").strip("\"'") for k, v in ATTRIBUTE.findall(attributes)}
            own = f"{found.get('class', '')} {found.get('id', '')}".lower()
            self.names = frozenset(WORD.findall(own))
            if self.names & UNLIKELY and tag not in ("html", "body", "article", "main"):
                for name in own.split():
                    words = frozenset(WORD.findall(name))
                    if words <= UNLIKELY | PLACES:
                        self.unlikely |= words & UNLIKELY
            if found.get("role", "").lower() in WRAPPERS:
                self.unlikely |= {found["role"].lower()}
            self.labels = tag == "label" and "for" in found
            self.gone = (
                self.gone
                or found.get("role", "").lower() in UNLIKELY_ROLES
                or "hidden" in found
                or found.get("aria-hidden", "").lower() == "true"
                or bool(INVISIBLE.search(found.get("style", "")))
            )


def parsed(page: str) -> Element:
    """The page's tree; text is kept as strings among the children."""
    here = root = Element("#root", None)
    at, end = 0, len(page)
    while at < end:
        match = TOKEN.search(page, at)
        if not match:
            here.children.append(html.unescape(page[at:]))
            break
        if match.start() > at:
            here.children.append(html.unescape(page[at : match.start()]))
        at = match.end()
        if not match[2]:
            if match[0].startswith("<![CDATA["):
                here.children.append(match[0][9:].removesuffix("]]>"))
            continue
        tag = match[2].lower()
        if match[1]:
            node = here
            while node is not root and node.tag != tag:
                node = node.parent
            if node is not root:
                here = node.parent
            continue
        if tag in RAW:
            closing = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at) if not match[3].endswith("/") else None
            at = closing.end() if closing else at if match[3].endswith("/") else end
            continue
        if tag in BLOCKS:  # a block ends an open paragraph, whatever inline elements are open in it
            node = here
            while node.parent is not None and (node.tag == "p" or node.tag not in BLOCKS):
                if node.tag == "p":
                    here = node.parent
                    break
                node = node.parent
        if tag in ENDS:
            same, reach = ENDS[tag]
            node = here
            while node.parent is not None and node.tag not in reach:
                if node.tag in same:
                    here = node.parent
                    break
                node = node.parent
        node = Element(tag, here, match[3])
        here.children.append(node)
        if tag not in VOID:
            here = node
    return root


def _spare(root: Element) -> None:
    """Mark as gone what only its name is against, and forms and dialogs, unless they hold all
    articles and main elements or most of the page's text; and the labels of controls."""
    nodes, stack = [], [root]
    while stack:
        node = stack.pop()
        nodes.append(node)
        stack += [c for c in node.children if not isinstance(c, str) and not c.gone]
    controls = set()  # elements with a control in them
    for node in reversed(nodes):
        if any(not isinstance(c, str) and (c.tag in CONTROLS or id(c) in controls) for c in node.children):
            controls.add(id(node))
    for node in nodes:
        if node.tag == "label":
            node.gone = node.labels or id(node) in controls
        elif node.tag == "fieldset" and id(node) not in controls:
            node.unlikely -= {"fieldset"}
    if not any(n.unlikely for n in nodes):
        return
    held = {}  # articles and points of each element, without those in threads
    for node in reversed(nodes):  # children before parents
        below = [held[id(c)] for c in node.children if id(c) in held]
        articles = sum(x for x, _ in below) + (node.tag in ("article", "main"))
        points = sum(x for _, x in below)
        if node.tag != "a":
            points += sum(c.count(",") + len(" ".join(c.split())) / 100 for c in node.children if isinstance(c, str))
        held[id(node)] = (0, 0.0) if node.unlikely & THREADS or node.gone else (articles, points)
    articles, points = held[id(root)]
    for node in nodes:
        if not node.unlikely or node.gone:
            continue
        own = held[id(node)]
        whole = own[0] == articles if articles else own[1] > points / 2
        node.gone = not whole or bool(node.unlikely & THREADS)


def _prune(root: Element) -> list[Element]:
    """Take out what is never article text; the elements that are left, parents first."""
    left, stack = [], [(root, False)]
    while stack:
        node, inside = stack.pop()
        left.append(node)
        inside = inside or node.tag in ("article", "main")
        node.children = [
            c for c in node.children if isinstance(c, str) or not (c.gone or c.tag == "header" and not inside)
        ]
        stack += [(c, inside) for c in reversed(node.children) if not isinstance(c, str)]
    return left


def blocks(nodes: list[Element]) -> list[str]:
    """The text blocks of elements, in page order."""
    out: list[str] = []
    own: list[str] = []

    def flush() -> None:
        text = " ".join("".join(own).split())
        if text:
            out.append(text)
        own.clear()

    stack: list = list(reversed(nodes))
    while stack:
        node = stack.pop()
        if node is None:
            flush()
        elif isinstance(node, str):
            own.append(node)
        elif node.tag == "br":
            own.append(" ")
        else:
            if node.tag in BLOCKS:
                flush()
                stack.append(None)
            stack += reversed(node.children)
    flush()
    return out


def _score(nodes: list[Element]) -> None:
    """Characters, link characters and points of every element."""
    for node in reversed(nodes):  # children before parents
        own = sum(len(" ".join(c.split())) for c in node.children if isinstance(c, str))
        node.chars += own
        if node.tag == "a":
            node.link_chars = node.chars
        if node.parent is not None:
            node.parent.chars += node.chars
            node.parent.link_chars += node.link_chars
    for node in nodes:
        text = [c for c in node.children if isinstance(c, str)]
        if node.tag in ("p", "pre", "td", "blockquote", "li") or node.tag in BLOCKS and any(not c.isspace() for c in text):
            if not node.chars or any(not isinstance(c, str) and c.tag in BLOCKS for c in node.children) and node.tag != "p":
                if not any(not c.isspace() for c in text):
                    continue
            commas = sum(c.count(",") for c in text)
            points = (1 + commas + min(node.chars / 100, 3)) * (1 - density(node))
            above, part = node.parent, 1.0
            level = 1
            while above is not None and part > 0.05:
                above.points += points * part
                above, level = above.parent, level + 1
                part = 0.5 if level == 2 else 1 / (level * 3)


def density(node: Element) -> float:
    return node.link_chars / node.chars if node.chars else 0.0


def main_text(page: str | None) -> str:
    root = parsed(page or "")
    _spare(root)
    nodes = _prune(root)
    _score(nodes)
    best = max(nodes, key=lambda n: n.points * (1 - density(n)), default=None)
    if best is None or best.points <= 0:
        whole = [n for n in nodes if n.tag in ("article", "main")] or [n for n in nodes if n.tag == "body"] or [root]
        return "\n".join(blocks(whole[:1]))
    node = best
    while node is not None:  # the article around the container, if there is one
        if node.tag in ("article", "main") or node.names & CONTENT and node.tag not in ("html", "body"):
            best = node
        node = node.parent
    kept = [best]
    if best.parent is not None and best.tag not in ("html", "body", "article", "main"):
        least = 0.2 * best.points * (1 - density(best))
        kept = [
            s for s in best.parent.children
            if s is best or not isinstance(s, str) and (
                s.points * (1 - density(s)) >= least > 0
                or s.tag in ("p", "pre", "blockquote") and s.chars and density(s) < 0.25
                or s.tag in HEADINGS and s.chars and density(s) < 0.25
            )
        ]
    return "\n".join(blocks(kept))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sized(batches, "html", 8_000_000):
        texts = [main_text(page) for page in batch.column("html").to_pylist()]
        yield pa.record_batch(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            ["page_id", "url", "text", "n_chars"],
        )


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    pages = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return pages.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")


def op3_tree_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract(table(spark, sf_dir, "pages"))
