"""Pages from HTML: article text, title, headings, links, directives and quality signals.

The parser is the standard library's; a small tree with implied end tags is built
from its events. It runs in Arrow batches over whole pages.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import escape
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame

from .urls import resolve

CRAWLER = "quillspan"
MOST_HEADINGS, LEAST_WORDS, CANDIDATE_COST = 64, 25, 4.0

# Elements that never hold article text.
CUT_TAGS = frozenset("script style noscript template nav header footer aside form iframe svg canvas button select textarea menu dialog object embed video audio map picture".split())
# Words of class and id attributes that mark page furniture.
FURNITURE = frozenset(
    "nav navbar navigation menu sidebar side footer header masthead comment comments disqus related recommended share sharing social advert advertisement ads ad promo promotion sponsor sponsored cookie cookies consent banner popup modal overlay newsletter subscribe signup breadcrumb breadcrumbs pagination pager widget toolbar skip copyright legal".split()
)
# Elements that end a line.
BLOCK_TAGS = frozenset("p div section article main li tr br h1 h2 h3 h4 h5 h6 blockquote pre td th dd dt figcaption hr".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
CANDIDATES = frozenset(("article", "main", "div", "section"))
#: An opening tag on the left ends open tags on the right, up to the nearest list, table or block.
IMPLIED = {"li": ("li",), "p": ("p",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",)} | {t: ("p",) for t in ("div", "section", "article", "main", "ul", "ol", "table", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "hr", "form", "header", "footer", "nav", "aside")}
STOPS = frozenset(("ul", "ol", "table", "div", "section", "article", "main", "body", "dl"))


class Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def walk(self) -> Iterator[Node]:
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(c for c in reversed(node.children) if isinstance(c, Node))

    def text(self) -> str:
        out, stack = [], [self]
        while stack:
            node = stack.pop()
            if isinstance(node, str):
                out.append(node)
            else:
                stack.extend(reversed(node.children))
        return "".join(out)


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#root", {}, None)

    def handle_starttag(self, tag, attrs):
        closes = IMPLIED.get(tag, ())
        node = self.at
        while closes and node.parent is not None and node.tag not in STOPS:
            if node.tag in closes:
                self.at = node.parent
                break
            node = node.parent
        new = Node(tag, {k: v or "" for k, v in reversed(attrs)}, self.at)
        self.at.children.append(new)
        if tag not in VOID:
            self.at = new

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        node = self.at
        while node.parent is not None:
            if node.tag == tag:
                self.at = node.parent
                return
            node = node.parent

    def handle_data(self, data):
        self.at.children.append(data)


def tree(html: str) -> Node:
    t = _Tree()
    t.feed(html)
    t.close()
    return t.root


def squeeze(raw: str) -> str:
    """Runs of blanks become one blank, or one line end where they hold one; nothing outside."""
    return re.sub(r"\s+", lambda m: "\n" if "\n" in m.group() or "\r" in m.group() else " ", raw.strip())


def furniture(node: Node) -> bool:
    marks = re.split(r"[^A-Za-z0-9]+", f"{node.attrs.get('class', '')} {node.attrs.get('id', '')}")
    return any(m.lower() in FURNITURE for m in marks)


def article_text(node: Node) -> str:
    out: list[str] = []
    stack: list = [(c, False) for c in reversed(node.children)]
    while stack:
        x, closing = stack.pop()
        if closing:
            out.append("\n")
        elif isinstance(x, str):
            out.append(x + " ")
        elif x.tag not in CUT_TAGS and not furniture(x):
            if x.tag in BLOCK_TAGS:
                stack.append((x, True))
            stack.extend((c, False) for c in reversed(x.children))
    return squeeze("".join(out))


def is_candidate(n: Node) -> bool:
    return n.tag in CANDIDATES or n.attrs.get("role") == "main"


def tallies(root: Node) -> dict[int, tuple[int, int, int]]:
    """By id of each node: words of its article text, words in links, candidates inside. All three are sums over the
    children, so one pass from the leaves up is enough, however deeply elements are nested."""
    out: dict[int, tuple[int, int, int]] = {}
    for n in reversed(list(root.walk())):
        words = inside = 0
        linked = len(n.text().split()) if n.tag == "a" and "href" in n.attrs else 0
        for c in n.children:
            if isinstance(c, str):
                words += len(c.split())
                continue
            own = out[id(c)]
            if c.tag not in CUT_TAGS and not furniture(c):
                words += own[0]
            linked, inside = linked + own[1], inside + own[2] + is_candidate(c)
        out[id(n)] = words, linked, inside
    return out


def article(root: Node) -> tuple[str, float]:
    """Text and link density of the best candidate: many words, few of them linked, few candidates inside; else of the body."""
    best, chosen = None, None
    counts = tallies(root)
    for n in root.walk():
        if not is_candidate(n) or furniture(n):
            continue
        words, linked, inside = counts[id(n)]
        if words < LEAST_WORDS:
            continue
        score = words * (1 - min(linked, words) / words) - CANDIDATE_COST * inside
        if best is None or score > best:
            best, chosen = score, n
    chosen = chosen or next((n for n in root.walk() if n.tag == "body"), root if not any(n.tag == "html" for n in root.walk()) else None)
    if chosen is None:
        return "", 0.0
    words, linked, _ = counts[id(chosen)]
    return article_text(chosen), min(linked, words) / words if words else 0.0


def directives(contents: list[str]) -> dict:
    """Robots directives, applied one after another."""
    d = {"index": True, "follow": True, "archive": True, "snippet": True, "max_snippet": None}
    for content in contents:
        for word in content.lower().split(","):
            word = word.strip()
            if word in ("noindex", "none"):
                d["index"] = False
            if word in ("nofollow", "none"):
                d["follow"] = False
            if word in ("noarchive", "nocache"):
                d["archive"] = False
            if word == "nosnippet":
                d["snippet"] = False
            if word == "all":
                d.update(index=True, follow=True)
            if word.startswith("max-snippet:"):
                n = word[12:].strip()
                if n.isdigit():
                    d["max_snippet"] = int(n)
                elif n == "-1":
                    d["max_snippet"] = None
    return d


def page(html: str, base: str, header: str = "") -> dict:
    root = tree(html or "")
    nodes = list(root.walk())
    first = lambda tag: next((n for n in nodes if n.tag == tag), None)
    title, top = first("title"), first("html")
    metas = [n.attrs.get("content", "") for n in nodes if n.tag == "meta" and n.attrs.get("name", "").lower() in ("robots", CRAWLER)]
    canonical = next((n.attrs.get("href") for n in nodes if n.tag == "link" and n.attrs.get("rel", "").lower() == "canonical"), None)
    headings = [t for n in nodes if n.tag in ("h1", "h2", "h3") and (t := squeeze(n.text()))][:MOST_HEADINGS]
    links, seen = [], set()
    for n in nodes:
        if n.tag == "a" and "href" in n.attrs and (url := resolve(base, n.attrs["href"])) and url not in seen:
            seen.add(url)
            links.append({"url": url, "anchor": squeeze(n.text()), "nofollow": not {"nofollow", "ugc", "sponsored"}.isdisjoint(n.attrs.get("rel", "").lower().split())})
    text, density = article(root)
    size = len((html or "").encode())
    d = directives([header, *metas])
    return {
        "title": squeeze(title.text()) if title else "",
        "text": text,
        "headings": headings,
        "links": links,
        "lang": (top.attrs.get("lang", "").strip().lower() or None) if top else None,
        "canonical": resolve(base, canonical) if canonical else None,
        "directives": d,
        "quality": {"text_ratio": len(text.encode()) / size if size else 0.0, "link_density": density, "scripts": sum(n.tag == "script" for n in nodes), "words": len(text.split())},
    }


PAGE_SCHEMA = "title string, text string, headings array<string>, links array<struct<url:string,anchor:string,nofollow:boolean>>, lang string, canonical string, directives struct<index:boolean,follow:boolean,archive:boolean,snippet:boolean,max_snippet:int>, quality struct<text_ratio:double,link_density:double,scripts:int,words:int>"


def extract(pages: DataFrame, key: str, url: str, html: str) -> DataFrame:
    """(key, url, <PAGE_SCHEMA>) of each page; null html is an empty page."""

    def run(frames):
        for f in frames:
            rows = [page(h or "", u or "") for h, u in zip(f["html"], f["url"])]
            yield pd.DataFrame({"key": f["key"], "url": f["url"], **{k: pd.Series([r[k] for r in rows], dtype=object) for k in (rows[0] if rows else page("", ""))}})

    narrow = pages.select(pages[key].alias("key"), pages[url].alias("url"), pages[html].alias("html"))
    kind = dict(narrow.dtypes)["key"]
    return narrow.mapInPandas(run, f"key {kind}, url string, {PAGE_SCHEMA}").withColumnRenamed("key", key)


def marked(text: str, highlights: list[tuple[int, int]]) -> str:
    """Escaped HTML of a snippet, its highlights in <mark>."""
    out, at = [], 0
    for a, z in highlights:
        out += [escape(text[at:a]), "<mark>", escape(text[a:z]), "</mark>"]
        at = z
    return "".join(out) + escape(text[at:])
