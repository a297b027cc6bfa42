"""Benchmark decontamination with a broadcast hash set of test n-grams.

The windows of the benchmark (13 words; a shorter item is one window) become a
hash set that every task holds; a task maps its words to window-vocabulary ids,
keeps stretches made of such ids only, looks their rolling hashes up and
verifies each hit word by word. Documents are read once and never shuffled.

The set is built from at most ``BLOCK_BYTES`` of benchmark text at a time. A
larger benchmark is dealt into blocks, one job each over the texts alone: a block
is broadcast, the texts that it hits are written as (hash of the text, hits), and
its set is released before the next one is built. The hits of all blocks are then
merged by text and joined to the rows.

Defined results: null and empty texts have no words; very long texts and items
are scanned whole; an item with no words has no window; repeated items or rows
count one by one; windows that several items share hit all of them; an empty
benchmark hits nothing, an empty table gives no rows; ``items`` holds each
identifier once, sorted as strings; a null item id is ''; extra columns pass
through or are ignored, whatever their names; ids keep their type.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, join_groups, map_arrow, materialise, slices, text_bytes

WINDOW = 13
#: Bound of the benchmark text behind one broadcast set (a set takes some fifty
#: times as much).
BLOCK_BYTES = 2 << 20
#: A document is contaminated when at least one word in so many is hit.
SHARE = 20

_KEEP = b"0123456789abcdefghijklmnopqrstuvwxyz"
_FOLD = bytes(c if c in _KEEP or c > 127 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
_PRIME = 0x9E3779B97F4A7C15


def words(text: bytes) -> list[bytes]:
    """Words of a UTF-8 text: runs of ASCII letters (lower-cased), digits and non-ASCII."""
    return text.translate(_FOLD).split()


class WindowSet:
    """The windows of some benchmark items by length, with the items of each."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW) -> None:
        self.vocabulary: dict[bytes, int] = {}
        self.names: list[str] = []
        by_length: dict[int, dict[bytes, set[int]]] = {}
        for number, (name, text) in enumerate(items):
            self.names.append(name)
            parts = words(text)
            if not parts:
                continue
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in parts], np.int32)
            size = min(window, len(ids))
            found = by_length.setdefault(size, {})
            for i in range(len(ids) - size + 1):
                found.setdefault(ids[i : i + size].tobytes(), set()).add(number)
        self.lengths = []
        for size, found in sorted(by_length.items()):
            rows = np.frombuffer(b"".join(found), np.int32).reshape(-1, size)
            first = np.zeros(len(self.vocabulary) + 1, bool)
            last = first.copy()
            first[rows[:, 0]], last[rows[:, -1]] = True, True
            self.lengths.append((size, found, first, last, np.unique(_rolled(rows))))

    def hits(self, ids: np.ndarray) -> Iterator[tuple[int, int, set[int]]]:
        """(position, length, items) of each window that occurs in ``ids``."""
        known = np.r_[0, np.cumsum(ids > 0)]
        for size, found, first, last, hashes in self.lengths:
            if len(ids) < size:
                continue
            at = np.flatnonzero(known[size:] - known[:-size] == size)
            at = at[first[ids[at]] & last[ids[at + size - 1]]]
            if not len(at):
                continue
            rows = ids[at[:, None] + np.arange(size)]
            rolled = _rolled(rows)
            likely = hashes[np.minimum(np.searchsorted(hashes, rolled), len(hashes) - 1)] == rolled
            for i, row in zip(at[likely].tolist(), rows[likely]):
                items = found.get(row.tobytes())
                if items:
                    yield i, size, items


def _rolled(rows: np.ndarray) -> np.ndarray:
    out = np.zeros(len(rows), np.uint64)
    for j in range(rows.shape[1]):
        out = (out + rows[:, j].astype(np.uint64)) * np.uint64(_PRIME)
        out ^= out >> np.uint64(29)
    return out


@dataclass
class Marks:
    """What a scan says of a batch of texts: words, hit words (packed bits, one
    per word, empty if none) and identifiers of the items whose windows occur."""

    n_words: list[int]
    bits: list[bytes]
    items: list[list[str]]

    def n_hit(self) -> list[int]:
        return [int.from_bytes(b, "big").bit_count() for b in self.bits]

    def contaminated(self, share: int) -> list[bool]:
        return [h > 0 and share * h >= n for h, n in zip(self.n_hit(), self.n_words)]


def scan(windows: WindowSet, texts: list[bytes]) -> Marks:
    """The marks of ``texts``."""
    get, all_ids, counts = windows.vocabulary.get, [], []
    for text in texts:
        parts = words(text)
        counts.append(len(parts))
        all_ids.append(np.fromiter(map(get, parts, repeat(0)), np.int32, len(parts)))
        all_ids.append(np.zeros(1, np.int32))  # windows don't cross rows
    ids = np.concatenate(all_ids) if all_ids else np.zeros(0, np.int32)
    starts = np.r_[0, np.cumsum(np.array(counts, np.int64) + 1)]
    change = np.zeros(len(ids) + 1, np.int64)
    items: dict[int, set[str]] = {}
    for i, size, numbers in windows.hits(ids):
        change[i] += 1
        change[i + size] -= 1
        row = int(np.searchsorted(starts, i, side="right")) - 1
        items.setdefault(row, set()).update(windows.names[k] for k in numbers)
    hit = np.cumsum(change)[:-1] > 0
    bits = [np.packbits(hit[starts[row] : starts[row] + n]).tobytes() if row in items else b"" for row, n in enumerate(counts)]
    return Marks(counts, bits, [sorted(items.get(row, ())) for row in range(len(counts))])


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[str, bytes]]]:
    """The items in blocks of at most ``block_bytes`` of text (a longer item alone)."""
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"))
    block, held = [], 0
    for name, text in rows.toLocalIterator():
        if block and held + len(text) > block_bytes:
            yield block
            block, held = [], 0
        block.append((name, bytes(text)))
        held += len(text)
    yield block


def _text_key(text: bytes) -> bytes:
    return hashlib.sha256(text).digest()


def _hits(docs: DataFrame, windows: WindowSet) -> DataFrame:
    """(key, bits, items, n) of the n rows of each distinct text that a block of the benchmark hits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts = text_bytes(batch.column(0))
            found = scan(windows, texts)
            rows = [(_text_key(t), b, i) for t, b, i in zip(texts, found.bits, found.items) if b]
            yield pa.record_batch([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.binary(), pa.binary(), pa.list_(pa.string())))], names=["key", "bits", "items"])

    found = map_arrow(docs.select(F.col("text").cast("string").alias("text")), run, "key binary, bits binary, items array<string>")
    return materialise(found.groupBy("key").agg(F.first("bits").alias("bits"), F.first("items").alias("items"), F.count("*").alias("n")), "window_hits")


def _merged(hits: list[DataFrame]) -> DataFrame:
    """(key, bits, items, n): the hits of all blocks by text, one row a text."""
    rows = functools.reduce(DataFrame.unionByName, hits)
    each = rows.groupBy("key").agg(F.collect_list(F.struct("bits", "items")).alias("found"), F.max("n").alias("n"))  # a row a block
    united = F.reduce(F.transform("found", lambda f: f["items"]), F.array().cast("array<string>"), F.array_union)

    def either(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = [np.bitwise_or.reduce([np.frombuffer(b, np.uint8) for b in some]).tobytes() for some in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(bits, pa.binary()), batch.column(2), batch.column(3)], names=["key", "bits", "items", "n"])

    slim = each.select("key", F.transform("found", lambda f: f["bits"]).alias("bits"), united.alias("items"), "n")
    return materialise(map_arrow(slim, either, "key binary, bits binary, items array<string>, n bigint"), "merged_hits")


def marked(docs: DataFrame, benchmark: DataFrame, finish, schema, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``finish(batch, marks)`` of every batch of ``docs`` (columns with a string
    ``text``), which makes rows of ``schema``."""
    blocks = _blocks(benchmark, block_bytes)
    first, second = next(blocks), next(blocks, None)
    if second is None:  # the whole benchmark at once: one pass, no shuffle
        windows = WindowSet(first, window)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, "text"):
                yield finish(batch, scan(windows, text_bytes(batch.column("text"))))

        return map_arrow(docs, run, schema)
    hits = [_hits(docs, WindowSet(block, window)) for block in chain((first, second), blocks)]
    names, head = docs.columns, fresh("__", docs)
    key, bits, items, n = (f"{head}{c}" for c in ("key", "bits", "items", "n"))
    own = docs.withColumn(key, F.unhex(F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"), 256)))
    joined = join_groups(own, _merged(hits).toDF(key, bits, items, n), key, n, F.monotonically_increasing_id()).select(*names, bits, items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            counts = [len(words(t)) for t in text_bytes(batch.column("text"))]
            old_bits, old_items = ([x or empty for x in batch.column(c).to_pylist()] for c, empty in ((bits, b""), (items, [])))
            yield finish(batch.select(names), Marks(counts, old_bits, [sorted(x) for x in old_items]))

    return map_arrow(joined, run, schema)


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, share: int = SHARE) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every row."""

    def count(batch: pa.RecordBatch, marks: Marks) -> pa.RecordBatch:
        digests = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in marks.items]
        return pa.record_batch(
            [
                batch.column("doc_id"),
                pa.array(marks.n_words, pa.int64()),
                pa.array(marks.n_hit(), pa.int64()),
                pa.array(map(len, marks.items), pa.int64()),
                pa.array(digests, pa.string()),
                pa.array(marks.contaminated(share), pa.bool_()),
            ],
            names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
        )

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean"
    return marked(docs.select("doc_id", F.col("text").cast("string").alias("text")), benchmark, count, schema, window, block_bytes)


def remove(docs: DataFrame, benchmark: DataFrame, spans: bool = False, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, share: int = SHARE) -> DataFrame:
    """``docs`` without contaminated rows, or (``spans``) with every row but
    without the hit words; columns stay as they are."""

    def cut(batch: pa.RecordBatch, marks: Marks) -> pa.RecordBatch:
        if not spans:
            return batch.filter(pa.array([not bad for bad in marks.contaminated(share)], pa.bool_()))
        texts = batch.column("text").cast(pa.binary()).to_pylist()
        for i in (i for i, b in enumerate(marks.bits) if b):
            texts[i] = without(texts[i], np.unpackbits(np.frombuffer(marks.bits[i], np.uint8), count=marks.n_words[i]))
        at = batch.schema.get_field_index("text")
        return batch.set_column(at, batch.schema.field("text"), pa.array(texts, pa.binary()).cast(batch.schema.field("text").type))

    return marked(docs, benchmark, cut, docs.schema, window, block_bytes)


def without(data: bytes, hit: np.ndarray) -> bytes:
    """A text less its hit words; what stood between two removed words goes too."""
    spans = [m.span() for m in re.finditer(rb"[^ ]+", data.translate(_FOLD))]
    out, at, i = [], 0, 0
    while i < len(spans):
        if not hit[i]:
            i += 1
            continue
        j = i
        while j + 1 < len(spans) and hit[j + 1]:
            j += 1
        out.append(data[at : spans[i][0]])
        at = spans[j][1]
        i = j + 1
    return b"".join([*out, data[at:]])


_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ORACLE_SQL = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_ALPHABET}', '{_ALPHABET.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{_ALPHABET}', '{_ALPHABET.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bs AS (
  SELECT item_id, w, least(13, len(w)) AS size FROM b WHERE len(w) > 0
), bw AS (
  SELECT DISTINCT item_id, size, list_aggregate(w[i : i + size - 1], 'string_agg', ' ') AS gram
  FROM (SELECT item_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM bs)
), dw AS (
  SELECT doc_id, size, i, list_aggregate(w[i : i + size - 1], 'string_agg', ' ') AS gram
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d CROSS JOIN (SELECT DISTINCT size FROM bw) WHERE len(w) >= size)
), h AS (
  SELECT doc_id, dw.size, i, item_id FROM dw JOIN bw USING (size, gram)
), hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM (SELECT DISTINCT doc_id, size, i FROM h)) GROUP BY doc_id
), it AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM h) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""
