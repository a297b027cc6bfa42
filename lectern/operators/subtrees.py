"""Parts that pages share: subtrees of their elements by bottom-up hashes.

An element's hash is made of its tag, attributes and what is in it, texts and the
hashes of its children, so equal hashes are equal subtrees. A page is read by a
stack, whatever its depth; tasks emit each subtree of a page once with its number
there, and the rest is one aggregate by hash, which combines before it shuffles.

Defined results: attributes count in any order, runs of white space in texts as one
space and blank texts not at all; comments, doctypes and processing marks are left
out; a tag that is not closed ends with its parent, a closing tag without a start is
passed over; a null or empty page has no subtrees; pages are told apart by their
key; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements without content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())


class _Reader(HTMLParser):
    """``found``: how often each (hash, number of elements) occurs."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: Counter[tuple[bytes, int]] = Counter()
        self._open: list[tuple[str, list[bytes], int]] = []  # tag, parts of the hash, elements before
        self._elements = 0
        self._tags: Counter[str] = Counter()

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        head = "\x00".join([tag, *sorted(f"{k}\x01{v or ''}" for k, v in attrs)])
        self._open.append((tag, [b"<" + head.encode("utf-8", "surrogatepass")], self._elements))
        self._tags[tag] += 1
        self._elements += 1
        if tag in VOID:
            self._close()

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self._close()

    def handle_endtag(self, tag: str) -> None:
        if self._tags[tag]:
            while self._close() != tag:
                pass

    def handle_data(self, data: str) -> None:
        said = " ".join(data.split())
        if said and self._open:
            self._open[-1][1].append(b"'" + said.encode("utf-8", "surrogatepass"))

    def _close(self) -> str:
        tag, parts, before = self._open.pop()
        self._tags[tag] -= 1
        made = hashlib.blake2b(b"".join(len(p).to_bytes(8, "little") + p for p in parts), digest_size=16).digest()
        self.found[made, self._elements - before] += 1
        if self._open:
            self._open[-1][1].append(b">" + made)
        return tag

    def end(self) -> None:
        self.close()
        while self._open:
            self._close()


def page_subtrees(html: str | None) -> Counter[tuple[bytes, int]]:
    """How often each subtree, (hash, number of elements), occurs on a page."""
    reader = _Reader()
    reader.feed(html or "")
    reader.end()
    return reader.found


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 100):
            part = batch.slice(at, 100)
            rows = [(i, made, size, n) for i, page in enumerate(part.column(1).to_pylist()) for (made, size), n in page_subtrees(page).items()]
            keys = part.column(0).take(pa.array([r[0] for r in rows], pa.int64()))
            yield pa.record_batch([keys, pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.int64())], names=["key", "hash", "elements", "n"])


def shared_parts(pages: DataFrame, key: str, html: str, least: int = 2) -> DataFrame:
    """hash (hex), elements, pages, occurrences, owner (the smallest key) of every
    subtree of at least ``least`` elements."""
    slim = pages.select(F.col(key).alias("key"), F.col(html).cast("string").alias("html"))
    found = slim.mapInArrow(_read, f"key {pages.schema[key].dataType.simpleString()}, hash binary, elements bigint, n bigint").where(F.col("elements") >= least)
    grouped = found.groupBy("hash", "elements").agg(F.count("*").alias("pages"), F.sum("n").alias("occurrences"), F.min("key").alias("owner"))
    return grouped.select(F.lower(F.hex("hash")).alias("hash"), "elements", "pages", "occurrences", "owner")
