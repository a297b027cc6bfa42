"""Feeds, calendars, subtitles, bookmark lists and form data to rows."""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Iterator
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.extraction import mapped


def _named(element, *names: str) -> str:
    for e in element:
        if e.tag.rsplit("}", 1)[-1] in names:
            return (e.text or "").strip() or e.get("href", "")
    return ""


def feed_items(xml: str) -> Iterator[tuple[str, str, str, str, str]]:
    """(format, id, title, link, published) of RSS, RDF and Atom items."""
    try:
        root = ElementTree.fromstring(re.sub(r"&(?!#?\w+;)", "&amp;", xml.strip()))
    except ElementTree.ParseError:
        return
    kind = {"feed": "atom", "RDF": "rdf"}.get(root.tag.rsplit("}", 1)[-1], "rss")
    for e in root.iter():
        if e.tag.rsplit("}", 1)[-1] in ("item", "entry"):
            link = _named(e, "link")
            yield kind, _named(e, "guid", "id") or link, " ".join(_named(e, "title").split()), link, _named(e, "pubDate", "published", "updated", "date")


def parse_feeds(rows: DataFrame, key: str, xml: str) -> DataFrame:
    make = lambda k, body: ((k, *item) for item in feed_items(body or ""))
    return mapped(rows, [key, xml], f"{key} {dict(rows.dtypes)[key]}, format string, id string, title string, link string, published string", make)


def github_feed(url: Column, what: str = "releases") -> Column:
    """The Atom feed of a repository page, '' for other pages."""
    repo = F.regexp_extract(url, r"^https?://(?:www\.)?github\.com/([\w.-]+/[\w.-]+)", 1)
    return F.when(repo != "", F.concat(F.lit("https://github.com/"), repo, F.lit(f"/{what}.atom"))).otherwise("")


_STAMP = r"(?:(\d+):)?(\d{1,2}):(\d{2})[.,](\d{1,3})"
_CUE = re.compile(rf"{_STAMP}\s*-->\s*{_STAMP}[^\n]*\n(.*?)(?=\n\s*\n|\Z)", re.S)
_LYRIC = re.compile(r"\[(\d+):(\d{2})(?:[.:](\d{1,3}))?\]([^\[\n]*)")


def cues(text: str) -> Iterator[tuple[float, float, str]]:
    """(start, end, text) of SRT or VTT cues, or of LRC lines (which end where the next starts)."""
    text = text.replace("\r\n", "\n")

    def seconds(h, m, s, ms) -> float:
        return int(h or 0) * 3600 + int(m) * 60 + int(s) + int(ms.ljust(3, "0")) / 1000

    found = False
    for m in _CUE.finditer(text):
        found = True
        said = " ".join(re.sub(r"<[^>]*>|\{[^}]*\}", "", m[9]).split())
        if said:
            yield seconds(*m.groups()[:4]), seconds(*m.groups()[4:8]), said
    if not found:
        lines = [(int(m[1]) * 60 + int(m[2]) + int((m[3] or "0").ljust(3, "0")) / 1000, m[4].strip()) for m in _LYRIC.finditer(text)]
        for (at, said), after in zip(lines, [*lines[1:], None]):
            if said:
                yield at, after[0] if after else at + 5, said


def parse_subtitles(rows: DataFrame, key: str, text: str) -> DataFrame:
    make = lambda k, body: ((k, i, *cue) for i, cue in enumerate(cues(body or "")))
    return mapped(rows, [key, text], f"{key} {dict(rows.dtypes)[key]}, idx bigint, start double, stop double, text string", make)


def calendar_events(text: str) -> Iterator[tuple[str, str, str, str]]:
    """(uid, summary, start, end) of an iCalendar text's events."""
    lines = re.sub(r"\r?\n[ \t]", "", text).splitlines()
    event: dict[str, str] | None = None
    for line in lines:
        name, _, value = line.partition(":")
        name = name.split(";")[0].upper()
        if line.upper() == "BEGIN:VEVENT":
            event = {}
        elif line.upper() == "END:VEVENT" and event is not None:
            yield event.get("UID", ""), re.sub(r"\\([,;\\])", r"\1", event.get("SUMMARY", "")).replace("\\n", "\n"), event.get("DTSTART", ""), event.get("DTEND", "")
            event = None
        elif event is not None:
            event.setdefault(name, value)


def parse_calendars(rows: DataFrame, key: str, text: str) -> DataFrame:
    make = lambda k, body: ((k, *e) for e in calendar_events(body or ""))
    return mapped(rows, [key, text], f"{key} {dict(rows.dtypes)[key]}, uid string, summary string, start string, stop string", make)


def imported_links(lists: DataFrame, content: str, known: DataFrame) -> DataFrame:
    """(url, state) of bookmark files and URL lists: added, or skipped when the
    identity is known; each identity once."""
    from ..functions.urls import normalize

    hrefs = F.regexp_extract_all(content, F.lit(r"(?i)href=[\"']([^\"']+)"), F.lit(1))
    listed = F.filter(F.transform(F.split(content, "\n"), lambda x: F.trim(x)), lambda x: x.rlike("(?i)^https?://"))
    found = lists.select(F.explode(F.array_union(hrefs, listed)).alias("raw")).select(normalize(F.col("raw")).alias("url")).where("url <> ''").distinct()
    old = known.select(normalize(F.col("url")).alias("url")).distinct().withColumn("_k", F.lit(1))
    return found.join(old, "url", "left").select("url", F.when(F.col("_k").isNull(), "added").otherwise("skipped").alias("state"))


def form_values(text: str) -> Iterator[tuple[str, str]]:
    """(field, value) of XFDF, plain XML, or two rows of CSV."""
    s = text.strip()
    if s.startswith("<"):
        root = ElementTree.fromstring(s)
        fields = [e for e in root.iter() if e.tag.rsplit("}", 1)[-1] == "field"]
        if fields:
            for e in fields:
                value = next(((v.text or "") for v in e if v.tag.rsplit("}", 1)[-1] == "value"), None)
                if value is not None:
                    yield e.get("name", ""), value
        else:
            for e in root:
                yield e.tag.rsplit("}", 1)[-1], e.text or ""
        return
    rows = list(csv.reader(io.StringIO(s), delimiter="\t" if "\t" in s else ","))
    yield from zip(rows[0], rows[1]) if len(rows) > 1 else ()


def parse_forms(rows: DataFrame, key: str, text: str) -> DataFrame:
    make = lambda k, body: ((k, *v) for v in form_values(body or ""))
    return mapped(rows, [key, text], f"{key} {dict(rows.dtypes)[key]}, field string, value string", make)
