"""Result pages of search engines to hits.

An engine's page is described, not programmed: the element that holds one hit, the
link in it, the element of its snippet, what marks an advert, and the engine's own
host, whose links are no hits. One reader walks the page by a stack and takes what
the description names; JSON answers name the paths of the same things.

Defined results: a null, empty or broken answer has no hits; hits without an address
are passed over; ranks count the hits that stay; addresses behind an engine's own
redirect are unwrapped; markup and runs of white space in titles and snippets become
one space.
"""

from __future__ import annotations

import base64
import binascii
import html as entities
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser
from urllib.parse import parse_qs, urlsplit

from pyspark.sql import DataFrame

from ..operators.extraction import mapped


@dataclass(frozen=True)
class Layout:
    """Where a page has its hits. A name is ``tag.class``, either part may be empty."""

    hit: str
    link: tuple[str, ...]  # the link lies in these, one inside the other
    snippets: tuple[str, ...]  # the first that is there
    advert: str
    host: str


# Elements of result pages, and paths of JSON answers (list, address, title, snippet, date).
LAYOUTS = {
    "ddg": Layout("div.result", ("a.result__a",), (".result__snippet",), "result--ad", "duckduckgo.com"),
    "bing": Layout("li.b_algo", ("h2", "a"), (".b_caption p", "p.b_lineclamp2", ".b_caption"), "", "bing.com"),
}
ANSWERS = {
    "searxng": (("results",), "url", "title", "content", "publishedDate"),
    "brave": (("web", "results"), "url", "title", "description", "page_age"),
}
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_SKIPPED = frozenset(("script", "style"))


class _Element:
    __slots__ = ("tag", "classes", "href", "texts", "inside")

    def __init__(self, tag: str, attrs: dict[str, str | None]) -> None:
        self.tag, self.classes, self.href = tag, frozenset((attrs.get("class") or "").split()), attrs.get("href")
        self.texts: list[str] = []
        self.inside: list[_Element] = []  # all elements below, in order

    def fits(self, name: str) -> bool:
        tag, _, kind = name.partition(".")
        return (not tag or tag == self.tag) and (not kind or kind in self.classes)

    def find(self, path: str | tuple[str, ...]) -> "_Element | None":
        """The first element of a path, one step inside the other."""
        steps, found = path.split() if isinstance(path, str) else path, self
        for step in steps:
            found = next((e for e in found.inside if e.fits(step)), None)
            if found is None:
                return None
        return found

    def text(self) -> str:
        return " ".join("".join(self.texts).split())


class _Reader(HTMLParser):
    """Collects the elements that hold a hit, with what is in them."""

    def __init__(self, hit: str) -> None:
        super().__init__(convert_charrefs=True)
        self.hit, self.hits, self.open = hit, [], []
        self.within = 0  # open elements from the outermost hit on

    def handle_starttag(self, tag: str, attrs: list) -> None:
        element = _Element(tag, dict(attrs))
        starts = element.fits(self.hit)
        if starts:
            self.hits.append(element)
        if starts or self.within:
            for e in self.open[len(self.open) - self.within :]:
                e.inside.append(element)
        if tag not in _VOID:
            self.open.append(element)
            self.within += bool(starts or self.within)

    def handle_endtag(self, tag: str) -> None:
        if any(e.tag == tag for e in self.open):
            while self.open:
                self.within = max(0, self.within - 1)
                if self.open.pop().tag == tag:
                    return

    def handle_data(self, data: str) -> None:
        if self.within and self.open[-1].tag not in _SKIPPED:
            for e in self.open[len(self.open) - self.within :]:
                e.texts.append(data)


def unwrapped(href: str | None) -> str:
    """The address behind an engine's redirect; '' for what is no web address."""
    href = entities.unescape(href or "").strip()
    if href.startswith("//"):
        href = "https:" + href
    parts = urlsplit(href)
    given = parse_qs(parts.query)
    if parts.path.rstrip("/").endswith("/l") and "uddg" in given:
        href = given["uddg"][0]
    elif parts.path.startswith("/ck/") and given.get("u", [""])[0].startswith("a1"):
        packed = given["u"][0][2:]
        try:
            href = base64.urlsafe_b64decode(packed + "=" * (-len(packed) % 4)).decode()
        except (binascii.Error, UnicodeDecodeError):
            return ""
    return href if urlsplit(href).scheme in ("http", "https") else ""


def _of_page(html: str, layout: Layout) -> Iterator[tuple[str, str, str, str | None]]:
    reader = _Reader(layout.hit)
    reader.feed(html)
    reader.close()
    for hit in reader.hits:
        link = hit.find(layout.link)
        if layout.advert and layout.advert in hit.classes or link is None:
            continue
        url = unwrapped(link.href)
        host = (urlsplit(url).hostname or "").lower()
        if url and host != layout.host and not host.endswith("." + layout.host):
            snippet = next((e for path in layout.snippets if (e := hit.find(path))), None)
            yield url, link.text(), snippet.text() if snippet else "", None


def _of_answer(text: str, names: tuple) -> Iterator[tuple[str, str, str, str | None]]:
    path, url, title, snippet, date = names
    try:
        found = json.loads(text)
    except ValueError:
        return
    for step in path:
        found = found.get(step) if isinstance(found, dict) else None
    plain = lambda item, name: " ".join(entities.unescape(re.sub(r"<[^>]+>", "", str(item.get(name) or ""))).split())
    for item in found if isinstance(found, list) else ():
        if isinstance(item, dict) and item.get(url):
            yield str(item[url]), plain(item, title), plain(item, snippet), item.get(date) or None


def hits_of(engine: str, answer: str | None) -> list[tuple[int, str, str, str, str | None]]:
    """(rank, url, title, snippet, date) of an engine's answer."""
    if engine in LAYOUTS:
        found = _of_page(answer or "", LAYOUTS[engine])
    elif engine in ANSWERS:
        found = _of_answer(answer or "", ANSWERS[engine])
    else:
        raise ValueError(f"no layout for {engine}")
    return [(rank, *hit) for rank, hit in enumerate(found, 1)]


def parsed_hits(answers: DataFrame, key: str, engine: str, answer: str) -> DataFrame:
    """(key, engine, rank, url, title, snippet, date) of every answer."""
    make = lambda k, name, body: ((k, name, *hit) for hit in hits_of(name, body))
    schema = f"{key} {dict(answers.dtypes)[key]}, engine string, rank int, url string, title string, snippet string, date string"
    return mapped(answers, [key, engine, answer], schema, make)
