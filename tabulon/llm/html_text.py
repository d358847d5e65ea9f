"""Layout-aware HTML rendering: all text that a browser would show, with blocks, lists and tables laid out.

A tree builder in the manner of browsers: void elements, implied end tags (p, li, dd, dt, option, tr, td, th, thead,
tbody), misnested end tags, raw text elements, comments, character references. Visibility rules leave out script,
style, template, head matter, hidden, aria-hidden="true", display:none and visibility:hidden. Blocks stand on lines
of their own with an empty line between paragraphs and headings; list items get "- " or their number, indented by
depth; br breaks the line; pre keeps white space; cells of a table are aligned in columns.

Defined results: a NULL page has NULL text; an empty one, or one with nothing visible, empty text; broken markup
never fails (what can't be a tag is text); nesting beyond DEPTH is read as flat; repeated rows are rendered each.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import map_batches, ready

DEPTH = 400
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("script style template head title meta link noscript iframe object svg math canvas audio video datalist noembed noframes param source track".split())
LOOSE = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure hr".split())  # an empty line before and after
BLOCK = LOOSE | frozenset("address article aside body center dd details dialog dir div dt fieldset figcaption footer form header hgroup html legend li main menu nav optgroup option search section summary tbody thead tfoot tr caption".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split())
#: An opening tag ends an open element of the first set, unless one of the second stands between.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    **{t: ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}) for t in ("tbody", "thead", "tfoot")},
    **{f"h{n}": ({f"h{k}" for k in range(1, 7)}, {"div", "section", "article", "td", "th", "li", "body"}) for n in range(1, 7)},
}
SCOPE = frozenset("table td th caption html body template button object".split())
TAG = re.compile(r"<(?:!--(?P<comment>.*?)(?:-->|$)|(?P<bogus>[!?][^>]*)(?:>|$)|/(?P<end>[a-zA-Z][^\s/>]*)[^>]*(?:>|$)|(?P<start>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|$))", re.S)
ATTR = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+)))?""")
HIDING = re.compile(r"display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)", re.I)
SPACE = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []


def parse(source: str) -> Node:
    """The tree of a page, whatever its markup."""
    root = Node("html", {})
    stack, i, n = [root], 0, len(source)

    def close_to(k: int) -> None:
        del stack[k:]

    def nearest(tags: set[str] | frozenset[str], bounds: set[str] | frozenset[str]) -> int:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in tags:
                return k
            if stack[k].tag in bounds:
                return 0
        return 0

    while i < n:
        j = source.find("<", i)
        if j < 0:
            j = n
        if j > i:
            stack[-1].children.append(html.unescape(source[i:j]))
        if j == n:
            break
        m = TAG.match(source, j)
        if not m:
            stack[-1].children.append("<")
            i = j + 1
            continue
        i = m.end()
        if name := m["start"]:
            name = name.lower()
            attrs = {}
            if m["attrs"].strip(" /\n\t"):
                for a in ATTR.finditer(m["attrs"]):
                    attrs.setdefault(a[1].lower(), html.unescape(a[2] or a[3] or a[4] or ""))
            if name in ("html", "body"):
                if name == "body":
                    if k := nearest({"head"}, frozenset()):
                        close_to(k)
                if attrs:
                    root.attrs = attrs | root.attrs
                continue
            if name == "head" and len(stack) > 1:
                continue
            if name in CLOSES_P and (k := nearest({"p"}, SCOPE)):
                close_to(k)
            if rule := IMPLIED.get(name):
                while k := nearest(*rule):
                    close_to(k)
            node = Node(name, attrs)
            stack[-1].children.append(node)
            if name in VOID:
                continue
            if name in RAW:
                end = re.compile(rf"</{name}(?=[\s/>]|$)[^>]*>?", re.I).search(source, i)
                text = source[i : end.start() if end else n]
                node.children.append(html.unescape(text) if name in ("textarea", "title") else text)
                i = end.end() if end else n
            elif len(stack) < DEPTH:
                stack.append(node)
        elif name := m["end"]:
            name = name.lower()
            if name == "br":
                stack[-1].children.append(Node("br", {}))
            elif name == "p" and not nearest({"p"}, SCOPE):
                stack[-1].children.append(Node("p", {}))
            elif name not in ("html", "body") and (k := nearest({name}, SCOPE - {name} if name not in ("table", "td", "th", "tr", "tbody", "thead", "tfoot") else {"table"} - {name})):
                close_to(k)
    return root


def hidden(node: Node) -> bool:
    a = node.attrs
    return node.tag in UNSEEN or bool(a) and ("hidden" in a or a.get("aria-hidden", "").lower() == "true" or (node.tag == "input" and a.get("type", "").lower() == "hidden") or ("style" in a and bool(HIDING.search(a["style"]))))


class Page:
    """Lines under way: loose counts the empty lines that the next text needs before it."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.now, self.gap, self.indent, self.mark, self.space = "", 0, "", "", False

    def text(self, s: str, pre: bool = False) -> None:
        if pre:
            head, *more = s.split("\n")
            self._add(head)
            for x in more:
                self.end(0, True)
                self._add(x)
            return
        body = SPACE.sub(" ", s)
        if not body:
            return
        if body == " ":
            self.space = True
            return
        if body[0] == " ":
            self.space, body = True, body[1:]
        tail = body[-1:] == " "
        self._add(body.rstrip(" "))
        self.space = tail

    def _add(self, s: str) -> None:
        if s:
            self.now += (" " if self.space and self.now else "") + s
            self.space = False

    def end(self, gap: int, force: bool = False) -> None:
        """The line ends; gap: empty lines before what follows."""
        if self.now or force:
            if self.gap and self.lines:
                self.lines += [""] * self.gap
            self.gap = 0
            head = self.indent + self.mark if self.mark else self.indent
            self.lines.append((head + self.now).rstrip())
            if self.mark:
                self.indent += " " * len(self.mark)
                self.mark = ""
        self.now, self.space = "", False
        self.gap = max(self.gap, gap)


def width(s: str) -> int:
    return len(s)


def table(node: Node) -> list[str]:
    """Its rows with cells padded to their columns; captions come first."""
    rows: list[list[list[str]]] = []
    before: list[str] = []

    def walk(x: Node) -> None:
        for c in x.children:
            if isinstance(c, str) or hidden(c):
                if isinstance(c, str) and c.strip():
                    before.append(SPACE.sub(" ", c).strip())
            elif c.tag == "tr":
                cells: list[list[str]] = []
                for d in c.children:
                    if isinstance(d, str):
                        if d.strip():
                            before.append(SPACE.sub(" ", d).strip())
                    elif not hidden(d):
                        cells.append(render_node(d))
                        span = d.attrs.get("colspan", "")
                        cells += [[]] * (min(int(span), 1000) - 1 if span.isdecimal() else 0)
                if cells:
                    rows.append(cells)
            elif c.tag in ("thead", "tbody", "tfoot", "colgroup"):
                walk(c)
            else:
                before.extend(render_node(c))

    walk(node)
    sizes: list[int] = []
    for r in rows:
        for k, cell in enumerate(r):
            if k == len(sizes):
                sizes.append(0)
            sizes[k] = max(sizes[k], *map(width, cell), 0) if cell else sizes[k]
    out = [x for x in before if x]
    for r in rows:
        for line in range(max(1, *map(len, r))):
            out.append("  ".join((cell[line] if line < len(cell) else "").ljust(sizes[k]) for k, cell in enumerate(r)).rstrip())
    return out


def render_into(node: Node, page: Page, pre: bool = False, numbers: list[int] | None = None) -> None:
    for c in node.children:
        if isinstance(c, str):
            page.text(c, pre)
            continue
        if hidden(c):
            continue
        tag = c.tag
        if tag == "br":
            page.end(0, True)
        elif tag == "hr":
            page.end(1)
        elif tag == "img":
            if c.attrs.get("alt"):
                page.text(c.attrs["alt"])
        elif tag == "input":
            if c.attrs.get("type", "").lower() in ("submit", "button", "reset") and c.attrs.get("value"):
                page.text(c.attrs["value"])
        elif tag == "table":
            page.end(1)
            for line in table(c):
                page.now = line
                page.end(0, True)
            page.end(1)
        elif tag in ("ul", "ol", "menu", "dir"):
            nested = numbers is not None
            page.end(0 if nested else 1)
            start = c.attrs.get("start", "")
            count = [int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1] if tag == "ol" else [-(1 << 40)]
            render_into(c, page, pre, count)
            page.end(0 if nested else 1)
        elif tag == "li":
            page.end(0)
            outer, page.mark = page.indent + (" " * len(page.mark) if page.mark else ""), ""
            if numbers and numbers[0] > -(1 << 40):
                mark, numbers[0] = f"{numbers[0]}. ", numbers[0] + 1
            else:
                mark = "- "
            page.indent, page.mark = outer, mark
            render_into(c, page, pre, numbers if numbers is not None else [-(1 << 40)])
            page.end(0, bool(page.mark and page.now))
            page.indent, page.mark = outer, ""
        elif tag == "pre":
            page.end(1)
            render_into(c, page, True, numbers)
            page.end(1)
        elif tag == "dd":
            page.end(0)
            outer = page.indent
            page.indent += "    "
            render_into(c, page, pre, None)
            page.end(0)
            page.indent = outer
        elif tag in LOOSE:
            page.end(1)
            render_into(c, page, pre, numbers)
            page.end(1)
        elif tag in BLOCK:
            page.end(0)
            render_into(c, page, pre, numbers)
            page.end(0)
        elif tag in ("td", "th"):  # outside a table
            page.space = True
            render_into(c, page, pre, numbers)
            page.space = True
        elif tag == "q":
            page.text('"')
            render_into(c, page, pre, numbers)
            page.text('"')
        else:
            render_into(c, page, pre, numbers)


def render_node(node: Node) -> list[str]:
    page = Page()
    render_into(node, page)
    page.end(0)
    return page.lines


def render(source: str | None) -> str | None:
    """The visible text of a page."""
    if source is None:
        return None
    root = parse(source)
    lines = [] if hidden(root) else render_node(root)
    text = "\n".join(lines)
    return re.sub(r"\n{3,}", "\n\n", text).strip("\n")


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) of each row of pages."""
    ready(pages.sparkSession)

    def f(b: pa.RecordBatch) -> pa.RecordBatch:
        return pa.record_batch([b.column("page_id"), b.column("url"), pa.array([render(x) for x in b.column("html").to_pylist()], pa.string())], ["page_id", "url", "text"])

    own = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return map_batches(own, f, "page_id bigint, url string, text string")


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
