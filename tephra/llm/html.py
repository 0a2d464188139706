"""Main text of web pages by tag-path ratios.

A page is read as a sequence of text nodes, each with the path of tags from the root to it. For every path the text
length and the punctuation are aggregated over its nodes; their ratios per node are smoothed along the page, fused (the
geometric mean of the products before and after smoothing), and paths that reach the threshold select content nodes. Parts that are no article whatever their ratio
(menus, page headers, footers, sidebars, notices, adverts, forms, comments, told by tag, role, class or id) are out before
the ratios are taken. The content is everything else below the closest element that holds all selected nodes, so that
titles and short paragraphs between long ones stay, with the headings of an article or main part around that element and
without articles in which no node was selected. The selection alone decides where the content is.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tephra.session import bounded_batches

_RAW = "script style noscript template textarea iframe svg math object canvas audio video select title xmp".split()


def _token_pattern(attributes: str) -> re.Pattern[str]:
    """Comments, raw elements, tags with attributes, declarations."""
    raw = rf"<({'|'.join(_RAW)})\b{attributes}>.*?(?:</\1\s*>|\Z)"
    tag = rf"<(/?)([a-zA-Z][^\s/>]*)({attributes})>"
    return re.compile(rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|{raw}|{tag}|<[!?][^>]*>", re.S | re.I)


_TOKEN, _PLAIN_TOKEN = _token_pattern(r"""(?:"[^"]*"|'[^']*'|[^>"'])*+"""), _token_pattern("[^>]*")
_TAG_START = re.compile(r"</?[a-zA-Z]")
#: Tags whose quotes don't close before quotes are no longer heeded.
MOST_BROKEN = 16
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rb rp rt ruby s samp small span strike strong sub sup time tt u var wbr img br picture source nobr".split()
)
#: Elements whose start ends an open element of the named kinds.
_ENDS = {
    **dict.fromkeys(
        "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split(),
        ("p",)
    ),
    "li": ("li", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "tr": ("td", "th", "tr"), "td": ("td", "th"),
    "th": ("td", "th"), "option": ("option",),
}
_PARAGRAPH_SCOPE = ("article", "section", "main", "body", "div", "table", "td", "li", "blockquote")
_SCOPE = {"li": ("ul", "ol", "menu"), "td": ("table",), "th": ("table",), "tr": ("table",), "dt": ("dl",), "dd": ("dl",)}
_OUT_TAGS = frozenset("head nav footer aside form button menu dialog fieldset input label select".split())
_OUT_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored sponsors promo promotion cookie cookies consent gdpr notice notices sidebar menu nav navbar navigation topnav breadcrumb breadcrumbs footer header masthead "
    "comment comments reply replies respond disqus share sharing social related newsletter subscribe subscription popup modal overlay pagination pager toolbar widget banner skip skiplink".split()
)
#: A class list with one of these as a whole name is a frame around parts, whatever else it says.
_FRAME_WORDS = frozenset("layout container wrapper page site grid row content main article post entry".split())
_OUT_ROLES = frozenset(
    "navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split()
)
_SPLIT = re.compile(r"[^a-z0-9]+")
_PUNCTUATION = re.compile(r"[.,;:!?…、。，！？]")
_WEIGHTS = np.array([1.0, 2.0, 3.0, 2.0, 1.0]) / 9
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Part of the mean fused ratio, weighted by text, that a path must reach.
THRESHOLD = 0.7


class _Node:
    """An element. What its ancestors decide is handed down when it opens, so that no later step climbs a deep tree."""

    __slots__ = ("tag", "parent", "path", "out", "article", "within_out", "piece", "place")

    def __init__(self, tag: str, parent: _Node | None, path: int, out: bool, place: int):
        self.tag, self.parent, self.path, self.out, self.place = tag, parent, path, out, place
        starts = tag in ("article", "main")
        self.article = starts or parent is not None and parent.article
        #: In something that is out by its tag, where no article can start.
        self.within_out = tag in _OUT_TAGS or tag == "header" or tag == "article" and out or parent is not None and parent.within_out
        #: The closest article or main element.
        self.piece = self if starts else parent.piece if parent else None


def _is_out(tag: str, attributes: str, parent: _Node) -> bool:
    if tag in _OUT_TAGS or tag == "header" and not parent.article:
        return True
    if not attributes or tag in ("html", "body", "main"):
        return False
    for name, value in _ATTRIBUTE.findall(attributes):
        name = name.lower()
        value = value.strip("\"'")
        if name in ("class", "id"):
            names = [x for x in value.split() if not x.lower().startswith(("has-", "with-", "no-"))]
            if not _FRAME_WORDS.isdisjoint(x.lower() for x in names):
                continue
            found = {
                w for x in names
                for w in (*_SPLIT.split(x.lower()), *_SPLIT.split(re.sub(r"(?<=[a-z])(?=[A-Z])", "-", x).lower()))
            } & _OUT_WORDS
            if parent.article:
                found -= {"header"}
            if found and not (
                tag == "article" and not found & {
                    "comment", "comments", "reply", "ad", "ads", "advert", "sponsored", "promo", "related"
                }
            ):
                return True
        elif name == "role" and value.lower() in _OUT_ROLES or name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True
    return False


class _Tree:
    """Open elements while a page is read: nodes in the order of opening, and how many of each tag are open."""

    def __init__(self) -> None:
        self.paths: dict[tuple[int, str], int] = {}
        self.node = _Node("", None, 0, False, 0)
        self.nodes = [self.node]
        self.open: dict[str, int] = {}

    def start(self, tag: str, out: bool) -> None:
        path = self.paths.setdefault((self.node.path, tag), len(self.paths) + 1)
        self.node = _Node(tag, self.node, path, out, len(self.nodes))
        self.nodes.append(self.node)
        self.open[tag] = self.open.get(tag, 0) + 1

    def end(self, tag: str, stop: tuple[str, ...] = ()) -> None:
        """Close the innermost open element of the tag and all in it, unless one of ``stop`` lies between."""
        if not self.open.get(tag):
            return
        back = self.node
        while back.tag != tag:
            if back.tag in stop or back.parent is None:
                return
            back = back.parent
        while self.node is not back:
            self.open[self.node.tag] -= 1
            self.node = self.node.parent
        self.open[tag] -= 1
        self.node = back.parent


def _tokens_of(page: str):
    """Matches of markup from left to right. A ``<`` that opens nothing is text.

    Quotes that never close make a tag run to the page's end; after ``MOST_BROKEN`` such tags the first ``>`` ends a tag,
    so that a page of broken quotes is read in linear time.
    """
    at, broken, pattern = page.find("<"), 0, _TOKEN
    while at >= 0:
        m = pattern.match(page, at)
        if m is None:
            if pattern is _TOKEN and _TAG_START.match(page, at):
                broken += 1
                if broken > MOST_BROKEN:
                    pattern = _PLAIN_TOKEN
                    continue
            elif pattern is _PLAIN_TOKEN and page.find(">", at) < 0:
                return
            at = page.find("<", at + 1)
        else:
            yield m
            at = page.find("<", m.end())


def blocks_of(page: str) -> list[tuple[_Node, int, str]]:
    """(innermost block element, path of the first text, text) of every block outside what is no article, in page order."""
    return _read(page)[0]


def _read(page: str) -> tuple[list[tuple[_Node, int, str]], list[_Node]]:
    """Blocks and all elements of a page."""
    tree = _Tree()
    blocks, parts, block, path = [], [], tree.node, 0

    def close() -> None:
        nonlocal parts
        text = " ".join("".join(parts).split())
        if text:
            blocks.append((block, path, text))
        parts = []

    at = 0
    for m in _tokens_of(page):
        if m.start() > at and not tree.node.out:
            if not parts:
                path = tree.node.path
            parts.append(html.unescape(page[at : m.start()]))
        at = m.end()
        tag = m[3]
        if tag is None:
            continue
        tag = tag.lower()
        if tag in ("br", "wbr"):
            if tag == "br" and not tree.node.out:
                parts.append(" ")
            continue
        inline = tag in _INLINE
        if not inline:
            close()
        if m[2]:
            tree.end(tag)
        elif tag not in _VOID:
            if not inline:
                for kind in _ENDS.get(tag, ()):
                    tree.end(kind, _SCOPE.get(tag, _PARAGRAPH_SCOPE) if kind == "p" or tag in _SCOPE else ())
            # An article inside a container that only its class tells apart is one nevertheless.
            revived = tag in ("article", "main") and not tree.node.within_out
            tree.start(tag, _is_out(tag, m[4], tree.node) or tree.node.out and not revived)
        if not inline:
            block = tree.node
    if at < len(page) and not tree.node.out:
        if not parts:
            path = tree.node.path
        parts.append(html.unescape(page[at:]))
    close()
    return blocks, tree.nodes


def _smooth(x: np.ndarray) -> np.ndarray:
    return np.convolve(np.pad(x, 2, mode="edge"), _WEIGHTS, mode="valid")


def selected(blocks: list[tuple[_Node, int, str]]) -> list[int]:
    """Positions of the blocks whose path reaches the threshold of smoothed and fused ratios.

    Smoothing ends where an article or main element begins or ends, so that a card gains nothing from its neighbours.
    """
    if not blocks:
        return []
    paths: dict[int, list[float]] = {}
    for _, path, text in blocks:
        found = paths.setdefault(path, [0.0, 0.0, 0.0])
        found[0] += len(text)
        found[1] += len(_PUNCTUATION.findall(text))
        found[2] += 1
    length = np.array([paths[p][0] / paths[p][2] for _, p, _ in blocks])
    punctuation = np.array([paths[p][1] / paths[p][2] for _, p, _ in blocks])
    pieces = [b.piece for b, _, _ in blocks]
    cuts = [0, *(k for k in range(1, len(blocks)) if pieces[k] is not pieces[k - 1]), len(blocks)]
    smoothed = np.concatenate([_smooth(length[i:j]) * _smooth(punctuation[i:j] + 0.1) for i, j in zip(cuts[:-1], cuts[1:])])
    fused = np.sqrt(smoothed * length * (punctuation + 0.1))
    best: dict[int, float] = {}
    for (_, path, _), x in zip(blocks, fused):
        best[path] = max(best.get(path, 0.0), x)
    weight = np.array([len(text) for _, _, text in blocks])
    least = THRESHOLD * float(np.average(fused, weights=weight))  # never above the best
    return [k for k, (_, path, _) in enumerate(blocks) if best[path] >= least]


def main_text(page: str | None) -> str:
    """The article's blocks joined by two line ends; empty where there is none."""
    blocks, nodes = _read(page or "")
    chosen = selected(blocks)
    if not chosen:
        return ""
    # Selected blocks at or below each element; children open after their parents.
    held = [0] * len(nodes)
    for k in chosen:
        held[blocks[k][0].place] += 1
    for node in reversed(nodes[1:]):
        held[node.parent.place] += held[node.place]
    top = max((n for n in nodes if held[n.place] == len(chosen)), key=lambda n: n.place)
    # A lone block of an article stands for the element around it.
    if top.article and top.tag not in ("article", "main") and all(blocks[k][0] is top for k in chosen):
        top = top.parent
    around, up = set(), top
    while up is not None:
        if up.tag in ("article", "main"):
            around.add(up)
        up = up.parent
    # Of each element: in another article, in the closest element, in a heading, in a part around the content.
    flags = [(False, nodes[0] is top, False, nodes[0] in around)]
    for node in nodes[1:]:
        other, inside, heading, near = flags[node.parent.place]
        # An article in which nothing was selected is another piece.
        other = other or node.tag == "article" and not held[node.place]
        flags.append((other, inside or node is top, heading or node.tag in _HEADINGS, near or node in around))
    out = []
    for block, _, text in blocks:
        other, inside, heading, near = flags[block.place]
        # Headings of the article or main part around the content belong to it.
        if not other and (inside or heading and near):
            out.append(text)
    return "\n\n".join(out)


def _extract(columns: list[str]):
    def run(batches):
        for batch in batches:
            pages = batch.column(batch.schema.get_field_index("__html"))
            for i in range(0, len(pages), 256):
                text = [main_text(x) for x in pages.slice(i, 256).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(batch.schema.get_field_index(c)).slice(i, len(text)) for c in columns),
                        pa.array(text, pa.string()), pa.array([len(x) for x in text], pa.int64())
                    ],
                    names=[*columns, "text", "n_chars"]
                )

    return run


def extract(pages: DataFrame, html_col: str = "html", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (page_id and url by default) and text string, n_chars long, one row for every input row.

    A null or empty page, and one without an article, gives an empty text and 0. Unclosed and misnested tags are taken as
    browsers take them, roughly; an unclosed script or comment reaches to the page's end. Nothing is capped.
    """
    bounded_batches(pages.sparkSession)
    keep = ["page_id", "url"] if keep is None else keep
    renamed = [f"__{i}" for i in range(len(keep))]
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}
    given = pages.select(*(F.col(c).alias(r) for c, r in zip(keep, renamed)), F.col(html_col).cast("string").alias("__html"))
    schema = ", ".join([*(f"{r} {kinds[c]}" for c, r in zip(keep, renamed)), "text string", "n_chars long"])
    return given.mapInArrow(_extract(renamed), schema).withColumnsRenamed(dict(zip(renamed, keep)))
