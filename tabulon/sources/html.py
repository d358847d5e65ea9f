"""Listings, articles, links, lines and index tables out of HTML. A small tree is built from the standard library's tokenizer; the rules over it run in Arrow batches."""

from __future__ import annotations

import re
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulon.functions.dates import study_year
from tabulon.sources.schemas import parse_pdf_name

SITE = "https://www.example.edu"
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_ENDS = {"li": ("li", ("ul", "ol")), "tr": ("tr", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "option": ("option", ("select",))}
_CLOSES_P = frozenset("address article aside blockquote div dl footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_BLOCKS = frozenset("p li h1 h2 h3 h4 h5 h6 td th blockquote dd dt".split())
_GAP = re.compile("[\\s﻿]+")
_MONTHS = {m: k for k, m in enumerate("jan feb mar apr maj jun jul avg sep okt nov dec".split(), 1)}
_FOLD = str.maketrans(dict(zip("абвгдежзијклмнопрстћуфхцчшčćžš", "abvgdezzijklmnoprstcufhccscczs")))


def clean(s: str) -> str:
    return _GAP.sub(" ", s).strip()


class Element:
    def __init__(self, tag: str, attrs: dict[str, str], parent: Element | None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def walk(self):
        todo = list(reversed(self.children))
        while todo:
            x = todo.pop()
            if isinstance(x, Element):
                yield x
                todo.extend(reversed(x.children))

    def find(self, *tags: str) -> list[Element]:
        return [e for e in self.walk() if e.tag in tags]

    def text(self) -> str:
        out, todo = [], list(reversed(self.children))
        while todo:
            x = todo.pop()
            if isinstance(x, str):
                out.append(x)
            else:
                todo.extend(reversed(x.children))
        return "".join(out)

    def drop(self, *tags: str) -> None:
        for e in self.find(*tags):
            e.remove()

    def remove(self) -> None:
        if self.parent and self in self.parent.children:
            self.parent.children.remove(self)


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Element("html", {}, None)

    def _close(self, tags: str, bounds: tuple[str, ...]) -> None:
        e = self.at
        while e is not self.root and e.tag not in bounds:
            if e.tag in tags.split():
                self.at = e.parent
                return
            e = e.parent

    def handle_starttag(self, tag, attrs):
        if tag in ("html", "body", "head"):
            if tag == "body":
                self.root.attrs |= {"body": "1"}
            return
        if tag in _CLOSES_P:
            self._close("p", ("table", "td", "th", "button"))
        if tag in _ENDS:
            self._close(*_ENDS[tag])
        e = Element(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(e)
        if tag not in _VOID:
            self.at = e

    def handle_endtag(self, tag):
        e = self.at
        while e is not self.root:
            if e.tag == tag:
                self.at = e.parent
                return
            if e.tag in ("table", "td", "th") and tag not in ("table", "tr", "tbody", "thead"):
                return
            e = e.parent

    def handle_data(self, data):
        self.at.children.append(data)


def parse(source: str | None) -> Element:
    b = _Builder()
    b.feed(source or "")
    b.close()
    b.root.drop("title")
    return b.root


def absolute(href: str | None, base: str = SITE) -> str | None:
    """The full URL of a link; NULL for fragments, other schemes of contact and what can't be read."""
    if not href or href[0] == "#" or re.match("(?i)(?:tel|sms|mailto|javascript):", href):
        return None
    try:
        return urljoin(base, href.strip())
    except ValueError:
        return None


def density(e: Element) -> float:
    """How much an element looks like the article: text and blocks for it, links and containers against it."""
    length, blocks = len(clean(e.text())), len(e.find("p", "li", "table", "blockquote"))
    if not blocks or length < 80:
        return float("-inf")
    return length + 120 * blocks - 0.5 * len(clean("".join(a.text() for a in e.find("a")))) - 25 * len(e.find("main", "article", "section", "div"))


def scope(root: Element) -> Element:
    """Elements that are articles by name first, then by density; else everything. The first of equal ones."""
    named = [e for e in root.walk() if e.tag in ("main", "article") or e.attrs.get("role") == "main"]
    for some in (named, root.find("section", "div")):
        best = max(some, key=density, default=None)
        if best is not None and density(best) > float("-inf"):
            return best
    return root


_DAY = "|".join(sorted(["ned", "pon", "uto", "sre", "cet", "pet", "sub"]))
_STAMP = re.compile(rf"(?:(?:{_DAY}),?\s+)?[0-9]{{1,2}}[.]\s+\S+\s+20[0-9]{{2}}[.]?\s+(?:u\s+)?[0-9]{{1,2}}:[0-9]{{2}}")


def is_stamp(s: str) -> bool:
    return bool(_STAMP.fullmatch(clean(s).lower().translate(_FOLD)))


def article(source: str | None, url: str | None) -> dict:
    """Text, paragraphs, list items and links (each URL once) of the article in a page."""
    root = parse(source)
    root.drop("script", "style", "nav", "header", "footer")
    own = scope(root)
    for e in own.find("p", "time"):
        if is_stamp(e.text()):
            e.remove()
    links: dict[str, str] = {}
    for a in own.find("a"):
        if (to := absolute(a.attrs.get("href"), url or SITE)) and to not in links:
            links[to] = clean(a.text()) or to.rsplit("/", 1)[-1] or to
    texts = lambda tag: [t for t in (clean(e.text()) for e in own.find(tag)) if t]
    return {"text": clean(own.text()), "paragraphs": texts("p"), "list_items": texts("li"), "links": [{"label": v, "url": k} for k, v in links.items()]}


def textual_date(s: str) -> str | None:
    m = re.search(r"([0-9]{1,2})[.]\s*([^\W\d_]+)[,.]?\s*(20[0-9]{2})", s)
    month = _MONTHS.get(m[2].lower().translate(_FOLD)[:3]) if m else None
    return f"{m[3]}-{month:02d}-{int(m[1]):02d}" if m and month else None


def publication(item: Element) -> tuple[str, Element] | None:
    """The date of a listing's item: of its time element, else of the short text that looks most like a date line."""
    for e in item.find("time"):
        if m := re.match("20[0-9]{2}-[0-9]{2}-[0-9]{2}", e.attrs.get("datetime", "")):
            return m[0], e
    some = [(e, t) for e in item.find("time", "p", "small", "span") if 0 < len(t := clean(e.text())) < 160]
    rank = lambda t: 2 * bool(re.search("[0-9]{1,2}:[0-9]{2}", t)) + bool(re.match("(?i)пон|уто|сре|чет|пет|суб|нед", t))
    for e, t in sorted(some, key=lambda x: (-rank(x[1]), len(x[1]))):
        if day := textual_date(t):
            return day, e
    return None


def listing(source: str | None) -> list[dict]:
    """Items (title, summary, url, published) of a listing, each URL once."""
    root = parse(source)
    mains = [e for e in root.walk() if e.tag == "main" or e.attrs.get("role") == "main"]
    out: dict[str, dict] = {}
    for item in (li for m in mains or [root] for li in m.find("li")):
        heads = item.find(*(f"h{k}" for k in range(1, 7)))
        link = next((a for e in [*heads[:1], item] for a in e.find("a") if "href" in a.attrs), None)
        title = (clean(heads[0].text()) if heads else "") or (clean(link.text()) if link else "")
        url, found = absolute(link.attrs.get("href")) if link else None, publication(item)
        if not title or not url or not found or url in out:
            continue
        above, e = [], found[1]
        while e:
            above.append(e)
            e = e.parent
        summary = next((p for p in item.find("p") if p not in above), None)
        out[url] = {"title": title, "summary": clean(summary.text()) if summary else "", "url": url, "published": found[0]}
    return list(out.values())


def lines(source: str | None) -> list[str]:
    """The texts of blocks that hold no other block, without noise."""
    root = parse(source)
    root.drop("script", "style", "noscript", "nav", "header", "footer", "form")
    return [t for e in root.walk() if e.tag in _BLOCKS and not e.find(*_BLOCKS) and (t := clean(e.text()))]


def index_ranges(source: str | None) -> list[dict]:
    """Ranges of student numbers and their groups from the first table about them; a lecture group spans the rows below it."""
    table = next((t for t in parse(source).find("table") if "Од броја индекса" in clean(t.text())), None)
    out, lecture = [], ""
    number = lambda s: int(m[0]) if (m := re.match("-?[0-9]+", s)) else None
    for row in table.find("tr") if table else []:
        cells = [clean(c.text()) for c in row.find("td")]
        if len(cells) < 3 or number(cells[0]) is None or number(cells[1]) is None:
            continue
        lecture, exercise = (cells[2], cells[3]) if len(cells) >= 4 else (lecture, cells[2])
        if lecture and exercise:
            out.append({"index_from": number(cells[0]), "index_to": number(cells[1]), "lecture_group": lecture, "exercise_group": exercise})
    return out


ARTICLE = "struct<text:string,paragraphs:array<string>,list_items:array<string>,links:array<struct<label:string,url:string>>>"
ITEMS = "array<struct<title:string,summary:string,url:string,published:string>>"


def articles(pages: DataFrame) -> DataFrame:
    """pages (url, html, ..) with the article as a struct."""

    @F.pandas_udf(ARTICLE)
    def f(source: pd.Series, url: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([article(s, u) for s, u in zip(source, url)], columns=["text", "paragraphs", "list_items", "links"])

    return pages.withColumn("article", f("html", "url"))


def listings(pages: DataFrame) -> DataFrame:
    """One row for each item of pages (source, page, html): the first over all pages and sources that has its URL, pages after one without items or without a next page left out."""

    @F.pandas_udf(ITEMS)
    def f(source: pd.Series) -> pd.Series:
        return source.map(listing)

    linked = F.exists(F.regexp_extract_all("html", F.lit("href=[\"'][^\"']*[?&](?:amp;)?page=([0-9]+)"), 1), lambda x: x.cast("int") > F.col("page"))
    ordered = Window.partitionBy("source").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    kept = pages.withColumn("items", f("html")).withColumn("stops", F.max((F.size("items") == 0) | ~linked).over(ordered)).filter(F.coalesce(~F.col("stops"), F.lit(True)))
    rows = kept.select("source", "page", F.posexplode("items").alias("ord", "i")).select("source", "page", "ord", "i.*")
    first = Window.partitionBy("url").orderBy("source", "page", "ord")
    return rows.withColumn("__r", F.row_number().over(first)).filter("__r = 1").drop("__r")


def attachments(links: Column) -> Column:
    """Links to files: (label, url, file_name, file_type)."""
    pattern = "(?i)[.](odt|rtf|zip|pdf|docx?|xlsx?)(?:$|[?])"
    name = lambda u: F.regexp_replace(F.regexp_extract(u, "([^/]*)$", 1), "[?].*$", "")
    return F.transform(F.filter(links, lambda x: x["url"].rlike(pattern)), lambda x: F.struct(x["label"].alias("label"), x["url"].alias("url"), F.coalesce(F.try_url_decode(F.replace(name(x["url"]), F.lit("+"), F.lit("%2B"))), name(x["url"])).alias("file_name"), F.lower(F.regexp_extract(x["url"], pattern, 1)).alias("file_type")))


def resource_kind(url: Column, site: str) -> Column:
    return F.when(url.rlike("(?i)[.](odt|rtf|zip|pdf|docx?|xlsx?|pptx?)(?:$|[?])"), "dokument").when(url.startswith(site), "sip_stranica").otherwise("spoljni_link")


def related(records: DataFrame, site: str = SITE) -> DataFrame:
    """(source_url, label, url) of links to other kept records, in the order of the links."""
    out = records.select("source_url", F.posexplode("article.links").alias("ord", "l")).select("source_url", "ord", "l.label", "l.url").filter(F.col("url").startswith(f"{site}/article/"))
    return out.join(records.select(F.col("source_url").alias("url")), "url", "left_semi").orderBy("source_url", "ord")


LINKS = "array<struct<href:string,url:string,text:string>>"


def pdf_links(pages: DataFrame) -> DataFrame:
    """(pages.., ord, url, text): links of pages (page_url, html, ..) to PDF files, each URL once over all pages, the first."""

    @F.pandas_udf(LINKS)
    def f(source: pd.Series, base: pd.Series) -> pd.Series:
        return pd.Series([[{"href": h, "url": absolute(h, b), "text": clean(a.text())} for a in parse(s).find("a") if (h := a.attrs.get("href"))] for s, b in zip(source, base)])

    found = pages.withColumn("__links", f("html", "page_url")).select(*(c for c in pages.columns if c != "html"), F.posexplode("__links").alias("ord", "l"))
    some = found.filter(F.col("l.href").rlike("(?i)[.]pdf(?:$|[?])") & F.col("l.url").isNotNull()).select(*(c for c in pages.columns if c != "html"), "ord", "l.url", "l.text")
    first = Window.partitionBy("url").orderBy("page_url", "ord")
    return some.withColumn("__r", F.row_number().over(first)).filter("__r = 1").drop("__r")


def timetable_links(pages: DataFrame) -> DataFrame:
    """pdf_links of pages (page_url, level, html, ..) whose names are those of timetables, with semester, module, submodule and study_year."""
    named = pdf_links(pages).withColumn("__n", parse_pdf_name(F.col("url"))).filter("__n IS NOT NULL")
    return named.select("*", "__n.*").drop("__n").withColumn("study_year", study_year(F.col("level"), F.col("semester")))


def until_older(items: DataFrame, least: str) -> DataFrame:
    """items (source, page, published, ..) of listings, without the pages after the first one whose items are all older than a day."""
    pages = items.groupBy("source", "page").agg(F.max("published").alias("__newest"))
    w = Window.partitionBy("source").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    kept = pages.withColumn("__stop", F.coalesce(F.max(F.col("__newest") < least).over(w), F.lit(False))).filter("NOT __stop").select("source", "page")
    return items.join(kept, ["source", "page"], "left_semi")


def binary_scan(spark, path: str, pattern: str = "*.pdf") -> DataFrame:
    """(path, sha256, length, content) of files, whatever is in them."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return files.select("path", F.sha2("content", 256).alias("sha256"), "length", "content")
