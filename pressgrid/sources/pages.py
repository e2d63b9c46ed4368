"""Article fields from raw HTML pages.

Parsing a page is per-row Python by nature; it runs in ``mapInPandas`` over whatever
partitions the page table has.  Only the standard library parser is used.
"""
from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .. import constants as K
from ..functions import text as T
from ..functions.arrow import clean_body_text
from ..operators.articles import inside_dates

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_SILENT = {"script", "style", "template"}


class _Node:
    __slots__ = ("tag", "attrs", "parent", "kids")

    def __init__(self, tag, attrs, parent):
        self.tag, self.attrs, self.parent, self.kids = tag, attrs, parent, []

    def walk(self):
        todo = list(reversed(self.kids))
        while todo:
            k = todo.pop()
            yield k
            if isinstance(k, _Node):
                todo.extend(reversed(k.kids))


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = _Node("", {}, None)

    def handle_starttag(self, tag, attrs):
        node = _Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.kids.append(node)
        if tag not in _VOID:
            self.at = node

    def handle_endtag(self, tag):
        node = self.at
        while node is not self.root and node.tag != tag:
            node = node.parent
        if node is not self.root:
            self.at = node.parent

    def handle_data(self, data):
        if self.at.tag not in _SILENT:
            self.at.kids.append(data)


def _tree(html: str) -> _Node:
    t = _Tree()
    t.feed(html or "")
    t.close()
    return t.root


_PART = re.compile(r"(?P<tag>[a-zA-Z][\w-]*)?(?P<rest>(?:[.#][\w-]+|\[[^\]]+\])*)$")


def _fits(node: _Node, part: str) -> bool:
    m = _PART.match(part)
    if m["tag"] and node.tag != m["tag"]:
        return False
    for kind, name in re.findall(r"([.#])([\w-]+)", re.sub(r"\[[^\]]*\]", "", m["rest"])):
        if kind == "#" and node.attrs.get("id") != name or kind == "." and name not in node.attrs.get("class", "").split():
            return False
    return all(node.attrs.get(a) == v for a, v in re.findall(r"""\[([\w:-]+)=["']?([^"'\]]*)["']?\]""", m["rest"]))


def _matches(node: _Node, selector: str) -> bool:
    """Tag, #id, .class, [attr=value], descendant and child steps."""
    steps = selector.replace(">", " > ").split()
    if not _fits(node, steps.pop()):
        return False
    up = node.parent
    while steps:
        step = steps.pop()
        if step == ">":
            if up is None or not _fits(up, steps.pop()):
                return False
        else:
            while up is not None and not _fits(up, step):
                up = up.parent
            if up is None:
                return False
        up = up.parent
    return True


def _first(root: _Node, selectors: list[str]) -> _Node | None:
    for n in root.walk():
        if isinstance(n, _Node) and any(_matches(n, s) for s in selectors):
            return n
    return None


def _text(node: _Node, drop: list[str] = ()) -> str:
    out, todo = [], list(reversed(node.kids))
    while todo:
        k = todo.pop()
        if isinstance(k, str):
            if k.strip():
                out.append(k.strip())
        elif not any(_matches(k, s) for s in drop):
            todo.extend(reversed(k.kids))
    return " ".join(out)


def page_fields(html: str, selectors: dict[str, list[str]]) -> tuple:
    """(title, source, date text, body, reporter text); missing parts are None."""
    root = _tree(html)
    pub = _first(root, selectors["publisher"])
    source = pub.attrs.get("alt") if pub is not None else None
    if not source or source == K.UNKNOWN_SOURCE:
        meta = _first(root, ['meta[property="og:article:author"]'])
        source = meta.attrs.get("content", "").split("|")[0].strip() if meta is not None else K.UNKNOWN_SOURCE
    title, date, body, rep = (_first(root, selectors[k]) for k in ("title", "date", "body", "reporter"))
    strip = lambda n: "".join(p.strip() for p in n.walk() if isinstance(p, str))
    when = (date.attrs.get("data-date-time") or strip(date)) if date is not None else None
    return (re.sub(r"\[.*?\]", "", strip(title)) if title is not None else None, source, when,
            _text(body, selectors["drop"]) if body is not None else None, strip(rep) if rep is not None else None)


_RAW = "page_id bigint, link string, title string, source string, date_text string, content string, reporter_text string"


def html_to_article(pages: DataFrame, start: str | None = None, end: str | None = None,
                    selectors: dict[str, list[str]] = K.PAGE_SELECTORS, min_title: int = 6, min_body: int = 100) -> DataFrame:
    """(page_id, link, title, source, date, reporter, content); pages without a title, a body or inside
    the date range are left out.  Unknown dates pass."""
    def parse(batches):
        for b in batches:
            cols = list(zip(*[page_fields(h, selectors) for h in b["html"]])) or [[]] * 5
            yield pd.DataFrame({"page_id": b["page_id"], "link": b["url"], **{
                n: pd.Series(list(c), dtype=object, index=b.index) for n, c in
                zip(("title", "source", "date_text", "content", "reporter_text"), cols)}})

    raw = pages.select("page_id", "url", "html").mapInPandas(parse, _RAW)
    at = T.parse_news_date(F.col("date_text"))
    rows = raw.where((F.char_length("title") >= min_title) & (F.char_length("content") >= min_body)).withColumn("_at", at)
    if start is not None:
        rows = rows.where(inside_dates(F.col("_at"), F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")))
    return rows.select("page_id", "link", "title", "source",
                       F.coalesce(F.date_format("_at", "yyyy-MM-dd HH:mm"), F.lit(K.UNKNOWN_DATE)).alias("date"),
                       T.clean_reporter(F.coalesce("reporter_text", F.lit(K.UNKNOWN_SOURCE))).alias("reporter"), "content")


def _per_page(pages: DataFrame, fn, names: list[str]) -> DataFrame:
    def parse(batches):
        for b in batches:
            cols = list(zip(*[fn(h) for h in b["html"]])) or [[]] * len(names)
            yield pd.DataFrame({"page_id": b["page_id"], "link": b["url"],
                                **{n: pd.Series(list(c), dtype=object, index=b.index) for n, c in zip(names, cols)}})
    return pages.select("page_id", "url", "html").mapInPandas(parse, "page_id bigint, link string, " + ", ".join(f"{n} string" for n in names))


def html_to_text_generic(pages: DataFrame, max_chars: int = 4000) -> DataFrame:
    """(page_id, link, title, content) of any page: whole text, cleaned; a long text ends in '...'."""
    def one(html):
        root = _tree(html)
        t = _first(root, ["title"])
        title = " ".join(re.sub(r"\[.*?\]", "", "".join(p for p in t.walk() if isinstance(p, str)).strip()).split()) if t is not None else "Untitled"
        body = clean_body_text(" ".join(" ".join(p for p in root.walk() if isinstance(p, str)).split()))
        return title, body[:max_chars] + "..." if len(body) > max_chars else body
    return _per_page(pages, one, ["title", "content"])


def html_body_by_selector_list(pages: DataFrame, selectors: list[str] = K.DIRECT_BODY_SELECTORS,
                               drop: list[str] = K.DIRECT_DROP_SELECTORS, min_chars: int = 200) -> DataFrame:
    """(page_id, link, content): the first selector whose text is long enough; other pages are left out."""
    def one(html):
        root = _tree(html)
        for s in selectors:
            node = _first(root, [s])
            if node is not None:
                body = " ".join(_text(node, drop).split())
                if len(body) >= min_chars:
                    return (body,)
        return (None,)
    return _per_page(pages, one, ["content"]).where("content is not null")
