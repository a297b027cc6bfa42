"""HTML documents to text, Markdown, metadata and links, batch by batch with the
standard parser."""

from __future__ import annotations

import re
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import DataFrame

from .chunking import markdown_sections as sections
from .slices import map_frames

DROPPED = frozenset("script style noscript template svg iframe canvas head object".split())
CHROME = frozenset("nav footer aside form header".split())
BLOCKS = frozenset("address article aside blockquote body dd div dl dt figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section table tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class Reader(HTMLParser):
    """Collects the title, metadata, links, headings and text blocks of a page."""

    def __init__(self, drop_chrome: bool = True) -> None:
        super().__init__(convert_charrefs=True)
        self.drop = CHROME if drop_chrome else frozenset()
        self.stack: list[str] = []
        self.hidden = 0
        self.title, self.lang = "", ""
        self.meta: dict[str, str] = {}
        self.links: list[tuple[str, str]] = []
        self.related: list[dict[str, str]] = []
        self.headings: list[tuple[int, str]] = []
        self.blocks: list[tuple[str, str]] = []
        self.open = ""
        self.anchor: list | None = None

    def _hides(self, tag: str) -> bool:
        return tag in DROPPED or tag in self.drop and not (tag == "header" and "article" in self.stack)

    def _flush(self) -> None:
        text = " ".join(self.open.split())
        self.open = ""
        if not text:
            return
        tag = next((t for t in reversed(self.stack) if t in BLOCKS), "")
        self.blocks.append((tag, text))
        if re.fullmatch("h[1-6]", tag):
            self.headings.append((int(tag[1]), text))

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = {k: v or "" for k, v in attrs}
        if tag == "html":
            self.lang = a.get("lang", "").lower()
        elif tag == "meta":
            name = (a.get("property") or a.get("name") or a.get("itemprop") or "").lower()
            if name and a.get("content"):
                self.meta.setdefault(name, a["content"].strip())
        elif tag == "link":
            self.related.append(a)
        elif tag == "a" and a.get("href") and not self.hidden:
            self.anchor = [a["href"], len(self.open)]
        if tag in BLOCKS:
            self._flush()
            if "p" in self.stack[-1:]:
                self.stack.pop()
        if tag == "br":
            self.open += "\n"
        if tag not in VOID:
            self.stack.append(tag)
            self.hidden += self._hides(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag == "a" and self.anchor:
            self.links.append((self.anchor[0], " ".join(self.open[self.anchor[1] :].split())))
            self.anchor = None
        if tag not in self.stack:
            return
        if tag in BLOCKS or tag in DROPPED:
            self._flush()
        while self.stack:
            top = self.stack.pop()
            self.hidden -= self._hides(top)
            if top == tag:
                return

    def handle_data(self, data: str) -> None:
        if self.stack[-1:] == ["title"]:
            self.title += data
        elif not self.hidden:
            self.open += data


def read(page: str | None, drop_chrome: bool = True) -> Reader:
    reader = Reader(drop_chrome)
    reader.feed(page or "")
    reader.close()
    reader._flush()
    return reader


def _mapped(rows: DataFrame, columns: list[str], schema: str, make) -> DataFrame:
    names = [part.strip().split(" ")[0] for part in re.split(r",(?![^<]*>)", schema)]

    def run(batches):
        for batch in batches:
            out = [row for values in zip(*(batch[c] for c in columns)) for row in make(*values)]
            yield pd.DataFrame(out, columns=names)

    return map_frames(rows.select(*columns), run, schema)


def readable(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, title, text): the page's blocks without menus, forms and footers."""

    def make(k, page):
        r = read(page)
        yield k, " ".join(r.title.split()), "\n".join(text for _, text in r.blocks)

    return _mapped(pages, [key, html], f"{key} {dict(pages.dtypes)[key]}, title string, text string", make)


def to_markdown(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, markdown, n_links, n_headings)."""

    def block(tag: str, text: str) -> str:
        if re.fullmatch("h[1-6]", tag):
            return "#" * int(tag[1]) + " " + text
        return f"- {text}" if tag == "li" else f"> {text}" if tag == "blockquote" else text

    def make(k, page):
        r = read(page)
        yield k, "\n\n".join(block(*b) for b in r.blocks), len(r.links), len(r.headings)

    return _mapped(pages, [key, html], f"{key} {dict(pages.dtypes)[key]}, markdown string, n_links bigint, n_headings bigint", make)


def page_meta(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, title, description, canonical, lang, site, author, published, image)."""

    def make(k, page):
        r = read(page, False)
        m = r.meta
        first = lambda *names: next((m[n] for n in names if n in m), None)
        canonical = next((a.get("href") for a in r.related if "canonical" in a.get("rel", "").lower().split()), None)
        title = first("og:title", "twitter:title") or " ".join(r.title.split()) or None
        yield k, title, first("og:description", "description", "twitter:description"), canonical, r.lang or None, first("og:site_name"), first("author", "article:author"), first("article:published_time", "date", "datepublished"), first("og:image", "twitter:image")

    kind = dict(pages.dtypes)[key]
    return _mapped(pages, [key, html], f"{key} {kind}, title string, description string, canonical string, lang string, site string, author string, published string, image string", make)


def links_of(pages: DataFrame, key: str, url: str, html: str) -> DataFrame:
    """(key, kind, href): feeds and icons that a page names, absolute."""

    def make(k, base, page):
        for a in read(page, False).related:
            rel, kind = a.get("rel", "").lower(), a.get("type", "").lower()
            if a.get("href") and "alternate" in rel and ("rss" in kind or "atom" in kind):
                yield k, "feed", urljoin(base or "", a["href"])
            elif a.get("href") and "icon" in rel:
                yield k, "icon", urljoin(base or "", a["href"])

    return _mapped(pages, [key, url, html], f"{key} {dict(pages.dtypes)[key]}, kind string, href string", make)


def markdown_sections(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, section, line, text) of Markdown texts."""

    def make(k, body):
        for path, line, content in sections(body or ""):
            yield k, path, line, content

    return _mapped(rows, [key, text], f"{key} {dict(rows.dtypes)[key]}, section string, line bigint, text string", make)
