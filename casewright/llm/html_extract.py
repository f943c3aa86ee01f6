"""Main text of web pages by site style trees.

The DOMs of all pages of a host are merged into one style tree: pages whose elements lie on the same path of tags
and classes share its nodes, containers as well as blocks of text. A node has a presentation entropy, over the
sequences of child tags that its pages show, and a content entropy, over the texts that they hold; its own importance
is the greater one. A branch is as important as its most important node, so importance goes up the tree and a branch
goes only if all of it is dull: if its importance is under `LOW` outside an article, under `LOW_INSIDE` within one.
Each page also loses the branches that are no text by their markup: menus, headers, footers, sidebars, notices,
adverts, forms, scripts, styles and reader comments. Where a page marks its article, only branches within it count; marked
articles that are side cards of an unmarked one, which has the page's h1 and more text than they, don't.

A branch that only its class or id names so stays if it has the page's <main>, its only <article> or most of its
important text; reader comments go in any case. Names take nothing if they would take all. What goes from the middle
of a block doesn't split it.

The tree of a host is made by relational aggregates over (host, node) and its distinct pages, so no task holds a
host; its verdicts (node paths, a few bytes each) are joined back by host, by broadcast while they are few.

Edge cases: a null or empty html gives an empty text; pages without a valid host share one nameless host; open
tags are closed by their parents' ends, and only void elements by "/>"; nodes on fewer than `MIN_PAGES` distinct pages
of a host are never judged by entropy; elements deeper than `DEEPEST` levels belong to the node of their ancestor there; copies of a page (the same texts in the same nodes) count as one page of their
host and are each extracted; an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import partial
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewright.llm.common import bounded_batches, bounded_join, materialise, pieces, tidy

#: Pages of a host from which a node can be judged, and the importance below which it goes, outside and within an article.
MIN_PAGES, LOW, LOW_INSIDE = 8, 0.9, 0.2

_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
_PLAIN_PART = re.compile(r"[^<>\"']*")
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.IGNORECASE)
_RAW = {"script", "style", "noscript", "template", "textarea", "title", "svg", "math", "iframe", "object", "xmp", "noembed", "noframes"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img br".split())
_DROPPED = _RAW | set("head nav footer aside form button select option input menu dialog fieldset datalist canvas audio video".split())
_CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_PARENTS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"tr", "table"}, "th": {"tr", "table"}}
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "menu", "menubar", "dialog", "alert", "alertdialog"}
_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|banner|sponsor\w*|promo\w*|promotion|cookies?|consent|gdpr|notices?|notification\w*|alerts?|popup|modal|overlay|newsletter|subscri\w+|signup|login|"
    r"side-?bar|sidenav|widgets?|related|recommend\w*|read-?more|trending|share|sharing|social|comments?|commentlist|comment-?list|disqus|respond|replies|reply|reviews|"
    r"nav|navbar|navigation|menus?|breadcrumbs?|header|masthead|topbar|footer|foot|colophon|copyright|pagination|pager|toolbar|skip|search|byline-?links|tags|tagcloud|form|forms|hidden)(?:$|[\s_-])",
    re.IGNORECASE,
)
_READERS = re.compile(r"(?:^|[_-])(?:comments?|commentlist|comment-?list|disqus|respond|replies|reply)(?:$|[_-])", re.IGNORECASE)
#: Levels of elements that have paths of their own, and named branches that a piece of text can lie in: what is deeper
#: belongs to its ancestor there.
DEEPEST, NAMED = 256, 64
#: Names of a layout that has or lacks something, and of the head of a text.
_LAYOUT = re.compile(r"(?:^|[_-])(?:has|no|with|without)[_-]|^(?:entry|page|post|article|content|story|section)[_-]+(?:header|masthead)$", re.IGNORECASE)


class Tags:
    """The markup of a page, piece by piece, in time that is linear in the page.

    A tag ends at the first ">" outside quotes; one that meets another "<" outside quotes, or never ends, is text.
    """

    def __init__(self, html: str):
        self.html = html
        self.last = {c: html.rfind(c) for c in (">", "\"", "'", "]]>", "-->")}

    def _end(self, at: int) -> int:
        """Where the tag whose attributes begin at `at` ends, its ">" included; -1 if it doesn't."""
        while at <= self.last[">"]:
            at = _PLAIN_PART.match(self.html, at).end()
            c = self.html[at : at + 1]
            if c == ">":
                return at + 1
            if c in ("", "<") or at >= self.last[c]:
                return -1
            at = self.html.index(c, at + 1) + 1
        return -1

    def read(self, at: int) -> tuple[int, str, str, str, str] | None:
        """(end, slash, name, attributes, text) of the markup that begins with the "<" at `at`; None if that is text."""
        html = self.html
        if html.startswith("<!--", at):
            if html.startswith((">", "->"), at + 4):
                return html.index(">", at + 4) + 1, "", "", "", ""
            end = html.index("-->", at + 4) + 3 if self.last["-->"] >= at + 4 else len(html)
            return end, "", "", "", ""
        if html.startswith("<![CDATA[", at) and self.last["]]>"] >= at + 9:
            end = html.index("]]>", at + 9)
            return end + 3, "", "", "", html[at + 9 : end]
        if html.startswith(("<!", "<?"), at):
            return (html.index(">", at) + 1, "", "", "", "") if self.last[">"] > at else None
        name = _NAME.match(html, at + 1)
        end = self._end(name.end()) if name else -1
        return (end, name[1], name[2], html[name.end() : end - 1], "") if end >= 0 else None


class Branch:
    """An element that its names call no main text: whether they call it reader comments, and what it contains."""

    __slots__ = ("readers", "article", "main")

    def __init__(self, readers):
        self.readers, self.article, self.main = readers, False, False


class Block:
    """A block of text: its path in the style tree, its pieces with the named branches that each lies in, and whether it is in an article."""

    __slots__ = ("path", "pieces", "article")

    def __init__(self, path, pieces, article):
        self.path, self.pieces, self.article = path, pieces, article

    def text(self, goes=lambda branch: False) -> str:
        """The text without the pieces that lie in a branch that goes."""
        return " ".join("".join(text for text, named in self.pieces if not any(goes(b) for b in named)).split())


def _drops(tag: str, attributes: str, article: bool) -> tuple[str, bool, Branch | None]:
    """The style of an element, whether its markup says that it is no main text, and its branch if only its names do."""
    found = {m[1].lower(): (m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(attributes)} if attributes else {}
    style = " ".join(sorted(found.get("class", "").lower().split())).replace("/", "%2f")
    if tag in _DROPPED or (tag == "header" and not article):
        return style, True, None
    if tag in ("html", "body", "article", "main"):
        return style, False, None
    hidden = "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()
    names = [n for n in f"{found.get('class', '')} {found.get('id', '')}".split() if _NAMES.search(n) and not _LAYOUT.search(n)]
    return style, hidden or found.get("role", "").lower() in _ROLES, Branch(any(_READERS.search(n) for n in names)) if names else None


def blocks(html: str, shapes: dict[str, list[str]] | None = None, markup: bool = True) -> list[Block]:
    """The blocks of text of a page, in page order, without those that go by their markup.

    `shapes` is filled with the child tags of each path. Without `markup` only what is never shown goes.
    """
    out: list[Block] = []
    stack: list[tuple[str, str, bool, bool, tuple, bool]] = []  # tag, path, dropped, in article, named branches, begins a branch
    held: list[tuple[str, tuple]] = []
    ground = ("", "", False, False, (), False)

    def hold(text: str) -> None:
        top = stack[-1] if stack else ground
        if not top[2]:
            held.append((text, top[4]))

    def flush() -> None:
        if held:
            found = [(unescape(text), named) for text, named in held]
            held.clear()
            if any(text and not text.isspace() for text, _ in found):
                _, path, _, article, *_ = next((s for s in reversed(stack) if s[0] not in _INLINE), ground)
                out.append(Block(path, found, article))

    position, end, tags = 0, len(html), Tags(html)
    opened: Counter[str] = Counter()

    def close_from(at: int) -> None:
        opened.subtract(s[0] for s in stack[at:])
        del stack[at:]

    while position < end:
        start = html.find("<", position)
        if start < 0:
            hold(html[position:])
            break
        read = tags.read(start)
        if not read:
            hold(html[position : start + 1])
            position = start + 1
            continue
        if start > position:
            hold(html[position:start])
        position, slash, tag, attributes, text = read
        tag = tag.lower()
        if not tag:
            if text:
                hold(text)
            continue
        if slash:
            if not opened[tag]:
                continue
            if tag in _INLINE:
                lowest = max(-1, len(stack) - DEEPEST - 1)
                at = next((i for i in range(len(stack) - 1, lowest, -1) if stack[i][0] == tag or stack[i][0] not in _INLINE), -1)
                if at >= 0 and stack[at][0] == tag:
                    del stack[at]
                    opened[tag] -= 1
            else:
                flush()
                at = len(stack) - 1
                while stack[at][0] != tag:
                    at -= 1
                close_from(at)
            continue
        if tag == "br":
            if shapes is not None and stack and not stack[-1][2]:
                shapes.setdefault(stack[-1][1], []).append(tag)
            hold(" ")
            continue
        if tag not in _INLINE:
            flush()
            while stack and stack[-1][0] in _INLINE and not stack[-1][5]:
                close_from(len(stack) - 1)
            closes = _CLOSES.get(tag, set()) | {"p"}
            stop = _PARENTS.get(tag, set())
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in stop:
                    break
                if stack[i][0] in closes:
                    close_from(i)
                    break
                if stack[i][0] not in ("p", "td", "th", "tr", "li", "dt", "dd"):
                    break
        above = stack[-1] if stack else ground
        if shapes is not None and stack and not above[2]:
            shapes.setdefault(above[1], []).append(tag)
        if tag in _VOID:
            continue
        if tag in _RAW:
            close = re.compile(rf"</{re.escape(tag)}\s*>", re.IGNORECASE).search(html, position)
            position = close.end() if close else end
            continue
        style, dropped, branch = _drops(tag, attributes, above[3])
        if not markup:
            dropped, branch = False, None
        named = (*above[4], branch) if branch and len(above[4]) < NAMED else above[4]
        opened[tag] += 1
        if tag in _INLINE:
            stack.append((tag, above[1], above[2] or dropped, above[3], named, dropped or branch is not None))
            continue
        for b in named if tag in ("article", "main") else ():
            b.article, b.main = True, b.main or tag == "main"
        path = f"{above[1]}/{tag}" + (f".{style}" if style else "") if len(stack) < DEEPEST else above[1]
        if shapes is not None and not (above[2] or dropped):
            shapes.setdefault(path, []).append("|")  # another element of the path begins
        stack.append((tag, path, above[2] or dropped, above[3] or tag in ("article", "main"), named, dropped or branch is not None))
    flush()
    return out


def _host(url):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def _digest(text: str) -> bytes:
    return xxhash.xxh3_128_digest(text.encode("utf-8", "surrogatepass"))


def _nodes(batches, markup: bool):
    """(host, page, path, shape, content) for each node of the style tree on each page, the last ones as digests.

    A page is the digest of all its nodes; a node without text of its own has no content.
    """
    for batch in batches:
        for piece in pieces(batch, "html"):
            rows = []
            for host, html in zip(piece.column("host").to_pylist(), piece.column("html").to_pylist()):
                by: dict[str, list[str]] = {}
                shapes: dict[str, list[str]] = {}
                for b in blocks(html or "", shapes, markup):
                    by.setdefault(b.path, []).append(b.text())
                every = dict.fromkeys([*shapes, *by])
                nodes = [(path, _digest(" ".join(shapes.get(path, ()))), _digest("\n".join(by[path])) if path in by else None) for path in every]
                page = xxhash.xxh3_128_digest(b"".join(path.encode("utf-8", "surrogatepass") + shape + (content or b"") for path, shape, content in nodes))
                rows += [(host, page, *node) for node in nodes]
            kinds = (pa.string(), pa.binary(), pa.string(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["host", "page", "path", "shape", "content"])


def style_tree(pages: DataFrame, markup: bool = True) -> DataFrame:
    """Importance of each node (host, path) of pages (host, html): pages, presentation, content, importance.

    Copies of a page count once. A node's entropies have the number of its pages as base: 1 if every page differs, 0
    if all are alike; content is null where a node has no text. The importance is that of the node's whole branch.
    """
    nodes = pages.mapInArrow(tidy(partial(_nodes, markup=markup)), "host string, page binary, path string, shape binary, content binary").distinct()
    kinds = materialise(nodes.groupBy("host", "path", "content", "shape").agg(F.count(F.lit(1)).alias("n")))
    contents = kinds.groupBy("host", "path", "content").agg(F.sum("n").alias("n")).groupBy("host", "path").agg(F.sum("n").alias("pages"), F.sum(F.expr("n * ln(n)")).alias("s"), F.count("content").alias("texts"))
    shapes = kinds.groupBy("host", "path", "shape").agg(F.sum("n").alias("n")).groupBy("host", "path").agg(F.sum(F.expr("n * ln(n)")).alias("t"))
    entropy = lambda s: F.when(F.col("pages") > 1, (F.ln("pages") - F.col(s) / F.col("pages")) / F.ln("pages")).otherwise(1.0)
    tree = materialise(contents.join(shapes, ["host", "path"]).select("host", "path", "pages", entropy("t").alias("presentation"), F.when(F.col("texts") > 0, entropy("s")).alias("content")))
    # a node passes its importance on to each path that begins its own
    above = F.expr("transform(sequence(1, size(parts)), i -> concat_ws('/', slice(parts, 1, i)))")
    own = tree.withColumn("own", F.greatest("presentation", "content")).withColumn("parts", F.split("path", "/", -1))
    branches = own.select("host", F.explode(above).alias("path"), "own").groupBy("host", "path").agg(F.max("own").alias("importance"))
    return tree.join(branches, ["host", "path"])


def main_text(html: str, low: frozenset | set = frozenset(), dull_inside: frozenset | set = frozenset(), markup: bool = True) -> str:
    """The main text of a page.

    `low` has the paths that the host's style tree judges as unimportant, `dull_inside` those that go even within an article.
    """
    found = blocks(html, markup=markup)
    if low:
        verdicts: dict[tuple[str, bool], bool] = {}

        def stays(b: Block) -> bool:
            key = (b.path, b.article)
            if key not in verdicts:
                parts = b.path.split("/")
                verdicts[key] = not any("/".join(parts[:i]) in (dull_inside if b.article else low) for i in range(1, len(parts) + 1))
            return verdicts[key]

        important = [b for b in found if stays(b)]
    else:
        important = found
    goes = _going(found, important) if any(named for b in found for _, named in b.pieces) else (lambda branch: False)
    shown = [(b, b.text(goes)) for b in important]
    if any(b.article and b.text(goes) for b in found):
        body = _headed(found, shown)
        shown = [(b, text) for b, text in shown if (b.path.startswith(body) and not b.article if body else b.article)]
    return "\n".join(text for _, text in shown if text)


def _headed(found: list[Block], shown: list[tuple[Block, str]]) -> str | None:
    """The path, with a "/" at its end, of an unmarked container that is the article although others are marked so.

    It has the first h1 of a page whose articles have none, contains no article, and has more text than all of them.
    """
    if any("/main" in b.path or (b.article and "/h1" in b.path) for b in found):
        return None
    marked = sum(len(text) for b, text in shown if b.article)
    above = next((b.path.rpartition("/")[0] for b, text in shown if text and not b.article and b.path.rpartition("/")[2].split(".")[0] == "h1"), "")
    if above.rpartition("/")[2].split(".")[0] in ("", "html", "body"):
        return None
    within = [c.article for c in found if c.path.startswith(above + "/")]
    size = sum(len(text) for b, text in shown if not b.article and b.path.startswith(above + "/"))
    return above + "/" if size > marked and not any(within) else None


def _going(found: list[Block], important: list[Block]):
    """Whether a branch goes by its names, as a function."""
    total, sizes, elsewhere = 0, {}, False
    for b in important:
        for text, named in b.pieces:
            size = len(" ".join(text.split()))
            total += size
            elsewhere |= b.article and not named and size > 0
            for branch in named:
                sizes[branch] = sizes.get(branch, 0) + size

    def goes(branch: Branch) -> bool:
        if branch.main or (branch.article and not branch.readers and not elsewhere):
            return False
        return branch.readers or 2 * sizes.get(branch, 0) <= total

    return goes if any(b.text(goes) for b in important) else lambda branch: False


def _extract(batches, markup: bool):
    for batch in batches:
        for piece in pieces(batch, "html"):
            columns = (piece.column(n).to_pylist() for n in ("html", "low", "dull_inside"))
            texts = [main_text(h or "", set(p or ()), set(q or ()), markup) for h, p, q in zip(*columns)]
            kept = [piece.column(n) for n in ("page_id", "url")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(texts, pa.string()), pa.array(np.array([len(t) for t in texts], np.int64))], ["page_id", "url", "text", "n_chars"])


def extract_main_text(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_pages: int = MIN_PAGES, low: float = LOW, low_inside: float = LOW_INSIDE, markup: bool = True
) -> DataFrame:
    """page_id, url, text and n_chars of each row. Without `markup` the style tree alone decides what goes."""
    bounded_batches(pages.sparkSession)
    narrow = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), _host(F.col(url_col)).alias("host"))
    tree = style_tree(narrow.select("host", "html"), markup)
    dull = materialise(tree.where((F.col("pages") >= min_pages) & (F.col("importance") < low)).select("host", "path", "importance"))
    of_host = dull.groupBy("host").agg(F.collect_set("path").alias("low"), F.collect_set(F.when(F.col("importance") < low_inside, F.col("path"))).alias("dull_inside"))
    told = bounded_join(narrow, of_host, "host", "left", limit=20_000)
    return told.select("page_id", "url", "html", "low", "dull_inside").mapInArrow(tidy(partial(_extract, markup=markup)), "page_id long, url string, text string, n_chars long")
