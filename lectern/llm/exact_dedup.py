"""Exact deduplication by Patricia-trie owners.

Every text is normalised (each run of ASCII white space becomes one space) and
keyed by byte length and content hash. Map tasks first fold the copies they see
themselves, so a text that makes up a third of the corpus travels once per
batch, not once per row. The rest is dealt out by (length, hash); each partition
inserts the full byte strings into a compressed radix trie whose terminal nodes
hold the smallest identifier and the number of rows. A trie that outgrows its
memory budget spills subtrees to files in the shared folder and works them off
one by one later, behind the bytes that they share. The rows of the largest
groups find their owner in a broadcast of bounded size, all others by a join.

Defined results: a null text counts as empty; empty texts are one group; very
long texts are compared whole; a null id sorts after every number, so it is kept
only when its group has no other; among equal ids all rows are kept or dropped
together; repeated rows each give a row; an empty table gives no rows; extra
columns are ignored, whatever their names. Ids are read as ``bigint``: map other
ids to numbers first.
"""

from __future__ import annotations

import contextlib
import hashlib
import re
import struct
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_groups, map_arrow, materialise, scratch, slices, text_bytes

_TO_SPACE = bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")
_RUN = re.compile(rb" {2,}")
#: Bytes of trie labels that a task keeps before it spills a subtree.
TRIE_BYTES = 96 << 20
#: Rough Python cost of a node besides its label, and of a spilled one.
NODE_BYTES, SPILL_ROW = 300, 1200
#: Bytes that a spill file buffers.
FILE_BUFFER = 64 << 10


def normalise(text: bytes) -> bytes:
    """Each run of ``[\\x20\\x09-\\x0D]`` as one space; nothing is trimmed."""
    text = text.translate(_TO_SPACE)
    return _RUN.sub(b" ", text) if b"  " in text else text


def _smaller(a: int | None, b: int | None) -> int | None:
    return b if a is None else a if b is None else min(a, b)


class PatriciaTrie:
    """Byte strings with an owner: ``[label, children by first byte, owner]``
    nodes, where owner is ``[smallest id, rows]`` or None. In place of a spilled
    subtree stands a node whose children are the ``Spill`` that takes its rows."""

    def __init__(self) -> None:
        self.root: list = [b"", {}, None]
        self.held = 0

    def insert(self, key: bytes, ident: int | None, rows: int) -> None:
        node, at, size = self.root, 0, len(key)
        while at < size:
            child = node[1].get(key[at])
            if child is None:
                node[1][key[at]] = [key[at:], {}, [ident, rows]]
                self.held += size - at + NODE_BYTES
                return
            label = child[0]
            if key.startswith(label, at):
                node, at = child, at + len(label)
                if node[1].__class__ is Spill:
                    node[1].put(key[at:], ident, rows)
                    return
                continue
            same = _common(label, key, at)
            branch = [label[:same], {label[same]: child}, None]
            child[0] = label[same:]
            node[1][key[at]] = branch
            self.held += NODE_BYTES
            node, at = branch, at + same
        if node[2] is None:
            node[2] = [ident, rows]
        else:
            node[2] = [_smaller(node[2][0], ident), node[2][1] + rows]

    def terminals(self, root: list | None = None, behind: int = 0) -> Iterator[tuple[bytes, int | None, int]]:
        """(byte string less its first ``behind`` bytes, smallest id, rows) below
        ``root``, depth first, without recursion."""
        stack = [(root or self.root, b"")]
        while stack:
            node, prefix = stack.pop()
            prefix += node[0]
            if node[1].__class__ is Spill:
                continue
            if node[2] is not None:
                yield prefix[behind:], *node[2]
            stack.extend((child, prefix) for child in node[1].values())

    def spills(self, root: list | None = None) -> Iterator[tuple[bytes, "Spill"]]:
        """(byte string before its rows, spill) of every spilled subtree below ``root``."""
        stack = [(root or self.root, b"")]
        while stack:
            node, prefix = stack.pop()
            prefix += node[0]
            if node[1].__class__ is Spill:
                yield prefix, node[1]
            else:
                stack.extend((child, prefix) for child in node[1].values())

    def spill_until(self, most: int, spill) -> None:
        """Spill subtrees, the largest that fit in half of what is held first,
        until at most ``most`` bytes are held or nothing is left to cut."""
        order, weights = [], {}
        stack = [self.root]
        while stack:
            node = stack.pop()
            order.append(node)
            if node[1].__class__ is not Spill:
                stack.extend(node[1].values())
        for node in reversed(order):
            below = () if node[1].__class__ is Spill else node[1].values()
            weights[id(node)] = len(node[0]) + NODE_BYTES + sum(weights[id(child)] for child in below)
        half, todo, found = self.held // 2, [self.root], []
        while todo:  # go down while a subtree is more than half of all
            node = todo.pop()
            if node[1].__class__ is Spill:
                continue
            for child in node[1].values():
                if child[1].__class__ is Spill:
                    continue
                if weights[id(child)] > half and child[1]:
                    todo.append(child)
                else:
                    found.append(child)
        for node in sorted(found, key=lambda n: -weights[id(n)]):
            if self.held <= most:
                return
            if weights[id(node)] <= SPILL_ROW:  # a spilled node would weigh as much
                return
            taker = spill()
            keep = node[0][:1]
            for row in self.terminals(node, 1):
                taker.put(*row)
            for prefix, part in self.spills(node):  # an earlier one below it moves along
                for rest, ident, rows in part.rows():
                    taker.put(prefix[1:] + rest, ident, rows)
                part.drop()
            self.held -= weights[id(node)] - SPILL_ROW
            node[0], node[1], node[2] = keep, taker, None


def _common(label: bytes, key: bytes, at: int) -> int:
    """Length of the common start of ``label`` and ``key[at:]``, by bisection."""
    low, high = 0, min(len(label), len(key) - at)
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if key.startswith(label[:mid], at) else (low, mid - 1)
    return low


class Spill:
    """Rows of a spilled subtree in a file of the shared folder."""

    _HEAD = struct.Struct("<I?qq")

    def __init__(self, folder: str) -> None:
        self.fs, base = pafs.FileSystem.from_uri(folder)
        self.fs.create_dir(base, recursive=True)
        self.path = f"{base}/subtree-{uuid.uuid4().hex}"
        self.out = self.fs.open_output_stream(self.path, buffer_size=FILE_BUFFER)

    def put(self, rest: bytes, ident: int | None, rows: int) -> None:
        self.out.write(self._HEAD.pack(len(rest), ident is None, ident or 0, rows) + rest)

    def rows(self) -> Iterator[tuple[bytes, int | None, int]]:
        self.out.close()
        with self.fs.open_input_stream(self.path, buffer_size=FILE_BUFFER) as file:
            while head := file.read(self._HEAD.size):
                size, none, ident, rows = self._HEAD.unpack(head)
                yield file.read(size), None if none else ident, rows

    def drop(self) -> None:
        self.out.close()
        with contextlib.suppress(OSError):
            self.fs.delete_file(self.path)


def owners(rows: Iterable[tuple[bytes, int | None, int]], folder: str, budget: int = TRIE_BYTES) -> Iterator[tuple[bytes, int | None, int]]:
    """One (bytes, smallest id, rows) for each distinct byte string of ``rows``.
    Tries above ``budget`` bytes spill subtrees to files below ``folder``; these
    are worked off one after the other, each of them behind the bytes that all
    its rows share."""
    waiting: list[tuple[bytes, Spill | None]] = [(b"", None)]
    try:
        while waiting:
            head, spill = waiting.pop()
            trie, limit = PatriciaTrie(), budget
            for key, ident, count in rows if spill is None else spill.rows():
                trie.insert(key, ident, count)
                if trie.held > limit:
                    trie.spill_until(budget // 2, lambda: Spill(folder))
                    limit = max(budget, 2 * trie.held)  # single strings can't be cut
            if spill is not None:
                spill.drop()
            waiting += [(head + prefix, part) for prefix, part in trie.spills()]
            for key, ident, count in trie.terminals():
                yield head + key, ident, count
    finally:
        for _, part in waiting:
            if part is not None:
                part.drop()


def _keyed(ids_and_texts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Map side: digests of every row, and each distinct text of the batch once
    (``lead``), with the smallest id and the number of rows folded into it."""
    for batch in slices(ids_and_texts, "text"):
        ids = batch.column(0).to_pylist()
        texts = [normalise(t) for t in text_bytes(batch.column(1))]
        digests = [hashlib.sha256(t).digest() for t in texts]
        folded: dict[bytes, list] = {}
        for i, key in enumerate(texts):
            seen = folded.get(key)
            if seen is None:
                folded[key] = [ids[i], 1, digests[i]]
            else:
                seen[0], seen[1] = _smaller(seen[0], ids[i]), seen[1] + 1
        yield pa.record_batch(
            [
                pa.array([v[2] for v in folded.values()], pa.binary()),
                pa.array([len(k) for k in folded], pa.int64()),
                pa.array(list(folded), pa.binary()),
                pa.array([v[0] for v in folded.values()], pa.int64()),
                pa.array([v[1] for v in folded.values()], pa.int64()),
            ],
            names=["digest", "n_bytes", "bytes", "ident", "n"],
        )


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        digests = [hashlib.sha256(normalise(t)).digest() for t in text_bytes(batch.column(1))]
        yield pa.record_batch([batch.column(0), pa.array(digests, pa.binary())], names=["doc_id", "digest"])


def _owned(folder: str, budget: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in slices(batches, "bytes"):
                yield from zip(text_bytes(batch.column(0)), batch.column(1).to_pylist(), batch.column(2).to_pylist())

        out: list[tuple] = []
        for key, ident, count in owners(rows(), folder, budget):
            out.append((hashlib.sha256(key).digest(), len(key), ident, count))
            if len(out) == 10_000:
                yield _owner_batch(out)
                out = []
        yield _owner_batch(out)

    return run


def _owner_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int64())
    return pa.record_batch([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["digest", "n_bytes", "keep_id", "group_size"])


def text_owners(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", budget: int = TRIE_BYTES) -> DataFrame:
    """(digest, n_bytes, keep_id, group_size): one row for each distinct normalised text."""
    folder = scratch(docs.sparkSession, "subtrees")
    source = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    folded = map_arrow(source, _keyed, "digest binary, n_bytes bigint, bytes binary, ident bigint, n bigint")
    dealt = folded.repartition("n_bytes", "digest").select("bytes", "ident", "n")
    return map_arrow(dealt, _owned(folder, budget), "digest binary, n_bytes bigint, keep_id bigint, group_size bigint")


def exact_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", budget: int = TRIE_BYTES) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row of ``docs``."""
    groups = materialise(text_owners(docs, doc_id, text, budget).where("group_size > 1").drop("n_bytes"), "owners")
    source = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    rows = map_arrow(source, _digested, "doc_id bigint, digest binary")
    joined = join_groups(rows, groups.withColumn("n", F.col("group_size")), "digest", "n", "doc_id")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return joined.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("bigint")).alias("group_size"),
        keep.eqNullSafe(F.col("doc_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


#: DuckDB form of the query: normalise, hash, own by smallest id.
ORACLE_SQL = r"""
WITH n AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM n WINDOW w AS (PARTITION BY text_sha256)
"""
