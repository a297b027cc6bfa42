"""Token-ID output as wavelet-matrix shards.

Documents are dealt out by ranges of their id and sorted, so that shard after
shard the tokens follow ascending ids. A task encodes its documents and writes
one file to the shared folder: blocks of about ``BLOCK_TOKENS`` tokens, each a
wavelet matrix over the block's own symbols (bit planes with a rank directory),
and a footer with the place of every block, so that readers fetch only the
ranges they need. The manifest of the files is the commit: a task that runs
again writes under a new name, and only names in the manifest are read.

File: magic, blocks, index (zstd: for each block the gaps between its symbols and
how often each occurs, 4 bytes each), footer (zstd JSON: places of blocks and
index), footer length (8 bytes), magic.
Block: header length (4 bytes), header (zstd JSON: symbols, document ids and
lengths, zeros of each plane), then for each plane, highest bit first, the rank
directory (4 bytes for every ``RANK_BITS`` bits) and the bits, raw: succinct
already, they can be read in place.

A reader of a file answers for the whole of it: the token at a position, the
count of a token between two positions, and where it occurs. Whole blocks are
counted from the index, blocks without the token are not read, and rank and select
answer in the few blocks that are left.

Defined results: a null text counts as empty (its row has the end id only, or no
token where there is no end id); very long texts are encoded whole; bytes that
are no UTF-8 read as U+FFFD; null ids come first; rows of one
id follow in the order of a hash of their texts, repeated rows one after the
other, and a partition may end among them; an empty table writes no file; extra
columns are ignored, whatever their names. Ids are read as ``bigint``.
"""

from __future__ import annotations

import functools
import json
import os
import re
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import CACHES, SPACES, map_arrow, materialise, scratch, slices, text_bytes

MAGIC = b"LWMX0002"
BLOCK_TOKENS = 1 << 18
RANK_BITS = 512
#: Bytes of pieces and ids that the encoder remembers before it starts anew,
#: and what an entry costs besides.
CACHE_BYTES, ENTRY_BYTES = 96 << 20, 136
#: Text bytes that are encoded at a time; their pieces take ten times as much.
ENCODE_BYTES = 4 << 20
#: Pieces that go to the library in one string, and what stands between them: a
#: token by itself, as it is neither letter, digit nor space.
GROUP, SEPARATOR = 64, b"\x01"
END_ID = 1

#: Bytes of texts whose every mark may be cut off when white space follows it.
_EASY = bytes(c for c in range(256) if chr(c) in "abcdefghijklmnopqrstuvwxyz0123456789,.;:!? \t\n\x0b\x0c\r" or c == 0xC3 or 0x80 <= c < 0xC0)
#: Bytes of lower-case words of Western European letters (two signs aside).
_LETTERS = bytes(c for c in range(256) if chr(c) in "abcdefghijklmnopqrstuvwxyz" or c == 0xC3 or 0x80 <= c < 0xC0)
_SHAPE = bytes(44 if chr(c) in ",.;:!?" else 32 if chr(c) in " \t\n\x0b\x0c\r" else c for c in range(256))


_SPACE = np.zeros(256, bool)
_SPACE[list(SPACES)] = True


def _spaced(text: bytes) -> bytes:
    """A text whose white-space separated parts the tokenizer handles apart: marks
    cut from the words they end, ASCII in lower case as the library will have it
    (not where special tokens may stand)."""
    if b"<" in text:
        return text
    text = text.lower()
    easy = not text.translate(None, _EASY) and b"\xc3\x97" not in text and b"\xc3\xb7" not in text
    if easy:
        shape = text.translate(_SHAPE)
        easy = shape.count(b",") == shape.count(b", ") + shape.endswith(b",")
    if easy:
        for mark in (b",", b".", b";", b":", b"!", b"?"):
            if mark in text:
                text = text.replace(mark, b" " + mark)
    return text


def _pieces(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The distinct parts of ``texts``, the number of the one at each place, and
    where each text's places end. No object is made for a place."""
    spaced = [_spaced(text) for text in texts]
    data = np.frombuffer(b"\n".join([*spaced, b""]), np.uint8)
    gap = _SPACE[data]
    edges = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    if len(data) and not gap[0]:
        edges = np.r_[0, edges]
    starts, ends = edges[::2], edges[1::2]  # the last byte is a gap
    offsets = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(ends - starts, out=offsets[1:])
    parts = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[np.flatnonzero(~gap)])]).dictionary_encode()
    upto = np.searchsorted(starts, np.cumsum([len(text) + 1 for text in spaced]))
    return parts.dictionary.to_pylist(), parts.indices.to_numpy(), upto


def drops_space(file: dict) -> bool:
    """Whether the tokenizer of a file reads texts in lower case and as runs that
    hold no white space, so that what stands between spaces has ids of its own."""

    def steps(part: dict | None, name: str) -> list[dict]:
        return [] if part is None else part[name] if part["type"] == "Sequence" else [part]

    normal = steps(file.get("normalizer"), "normalizers")
    plain = all(x["type"] in ("NFC", "Lowercase") or x["type"] == "Replace" and x["pattern"] == {"Regex": r"\s+"} and x["content"] == " " for x in normal)
    first = next(iter(steps(file.get("pre_tokenizer"), "pretokenizers")), {})
    runs = first.get("type") == "Split" and first["behavior"] == "Removed" and first["invert"]
    shape = first.get("pattern", {}).get("Regex", " ") if runs else " "
    # a run of "all but" must leave out white space, and no other part may ask for it
    spaceless = not re.search(r"\s|\\s|\\S|\\W|\.", re.sub(r"\[\^\\s[^\]]*\]", "", shape)) and not re.search(r"\[\^(?!\\s)", shape)
    ordinary = not any(re.search(r"\s", t["content"]) or t["lstrip"] or t["rstrip"] for t in file.get("added_tokens", ()))
    return plain and any(x["type"] == "Lowercase" for x in normal) and runs and spaceless and ordinary and file.get("post_processor") is None


class Encoder:
    """Ids of texts by the tokenizers library. Where a file's tokenizer puts all in
    lower case and drops white space, the ids of a text are those of its white-space
    separated pieces in order: a piece is encoded once and remembered (as 16- or
    32-bit bytes), and pieces not met before go to the library together, between
    separator tokens. Any other tokenizer gets whole texts."""

    _loaded: dict[str, "Encoder"] = {}

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.known: dict[bytes, bytes] = {}
        self.held = 0
        with open(path, encoding="utf-8") as f:
            self.by_pieces = drops_space(json.load(f))
        ids = self.tokenizer.encode(SEPARATOR.decode(), add_special_tokens=False).ids
        self.separator = ids[0] if len(ids) == 1 else None
        # which ids end a run of letters, if the vocabulary marks them
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.ends_word = np.zeros(1 + max(self.tokenizer.get_vocab().values(), default=0), bool)
        if suffix:
            self.ends_word[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith(suffix)]] = True

    @classmethod
    def of(cls, path: str) -> "Encoder":
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        if not self.by_pieces:
            said = [text.decode("utf-8", "replace") for text in texts]
            return [np.array(e.ids, self.kind) for e in self.tokenizer.encode_batch_fast(said, add_special_tokens=False)]
        used, at, upto = _pieces(texts)
        ids = self._ids([piece for piece in used if piece not in self.known])
        self.known.update(ids)
        self.held += sum(map(len, ids)) + sum(map(len, ids.values())) + ENTRY_BYTES * len(ids)
        rows = list(map(self.known.__getitem__, used))
        values = np.frombuffer(b"".join(rows), self.kind)
        sizes = np.fromiter(map(len, rows), np.int64, len(rows)) // self.kind.itemsize
        first, sizes = (np.cumsum(sizes) - sizes)[at], sizes[at]
        ends = np.cumsum(sizes)
        out = values[np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - ends + sizes, sizes)]
        cuts = np.r_[0, ends][upto].tolist()
        if self.held > CACHE_BYTES:  # go on with what is in use now
            self.known = dict(zip(used, rows))
            self.held = sum(map(len, used)) + sum(map(len, rows)) + ENTRY_BYTES * len(used)
        return [out[a:b] for a, b in zip([0, *cuts], cuts)]

    def _ids(self, pieces: list[bytes]) -> dict[bytes, bytes]:
        """The ids of pieces. Runs of letters go to the library in groups between
        spaces, where the vocabulary marks their last ids, others that hold no mark
        of a special token between separators, the rest one by one."""
        found: dict[bytes, bytes] = {}
        if self.ends_word.any():
            letters = [p for p in pieces if not p.translate(None, _LETTERS) and b"\xc3\x97" not in p and b"\xc3\xb7" not in p]
            self._grouped(letters, b" ", self.ends_word, 0, found)
        if self.separator is not None and len(found) < len(pieces):
            separates = np.zeros(len(self.ends_word), bool)
            separates[self.separator] = True
            plain = [p for p in pieces if p not in found and SEPARATOR not in p and b"<" not in p]
            self._grouped(plain, b" " + SEPARATOR + b" ", separates, 1, found)
        if len(found) < len(pieces):
            found.update((p, self._one(p)) for p in pieces if p not in found)
        return found

    def _grouped(self, pieces: list[bytes], between: bytes, is_end: np.ndarray, drop: int, found: dict[bytes, bytes]) -> None:
        """Add the ids of pieces, joined in groups; ``is_end`` marks the ids that
        end one, of which the last ``drop`` belong to no piece. Groups whose ends
        don't match their pieces are left out."""
        width = self.kind.itemsize
        for at in range(0, len(pieces), GROUP * 64):
            part = pieces[at : at + GROUP * 64]
            joined = [between.join([*part[i : i + GROUP], b""]).decode("utf-8", "replace") for i in range(0, len(part), GROUP)]
            got = self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)
            row = np.concatenate([np.array(g.ids, self.kind) for g in got])
            ends = np.flatnonzero(is_end[row]) + 1
            if len(ends) == len(part):
                data, starts, stops = row.tobytes(), width * np.r_[0, ends[:-1]], width * (ends - drop)
                found.update(zip(part, map(data.__getitem__, map(slice, starts.tolist(), stops.tolist()))))

    def _one(self, piece: bytes) -> bytes:
        return np.array(self.tokenizer.encode(piece.decode("utf-8", "replace"), add_special_tokens=False).ids, self.kind).tobytes()


CACHES["token_shards"] = Encoder._loaded.clear


def build_block(doc_ids: list, tokens: list[np.ndarray], counts: list | None = None) -> bytes:
    """The bytes of a block: the documents' tokens as one wavelet matrix. Its
    symbols and how often each occurs are added to ``counts``."""
    values = np.concatenate(tokens)
    symbols, codes = _symbols(values)
    if counts is not None:
        counts.append((symbols, np.bincount(codes, minlength=len(symbols))))
    planes, zeros = [], []
    for k in range(max(1, int(len(symbols) - 1).bit_length()) - 1, -1, -1):
        bits = (codes >> np.uint32(k) if codes.dtype == np.uint32 else codes >> np.uint16(k)) & codes.dtype.type(1)
        bits = bits.astype(bool)
        packed = np.packbits(bits, bitorder="little")
        packed = np.pad(packed, (0, -len(packed) % (RANK_BITS // 8)))
        ones = np.bitwise_count(packed.view(np.uint64)).reshape(-1, RANK_BITS // 64).sum(axis=1, dtype=np.uint32)
        ranks = np.zeros(len(ones), "<u4")
        np.cumsum(ones[:-1], out=ranks[1:])
        planes += [ranks.tobytes(), packed.tobytes()]
        low = codes.take(np.flatnonzero(~bits))  # much faster than a boolean index
        zeros.append(len(low))
        codes = np.concatenate([low, codes.take(np.flatnonzero(bits))])
    header = {"symbols": symbols.tolist(), "docs": doc_ids, "sizes": [len(t) for t in tokens], "zeros": zeros}
    packed = zstandard.ZstdCompressor(3).compress(json.dumps(header, separators=(",", ":")).encode())
    return b"".join([len(packed).to_bytes(4, "little"), packed, *planes])


def _symbols(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values in order, and each value's place among them."""
    seen = np.zeros(int(values.max(initial=0)) + 1, bool)
    seen[values] = True
    symbols = np.flatnonzero(seen)
    place = (np.cumsum(seen) - 1).astype(np.uint16 if len(symbols) <= 1 << 16 else np.uint32)
    return symbols, place[values]


class Block:
    """A wavelet matrix read from its bytes: access, count, locate, decode."""

    def __init__(self, data: bytes) -> None:
        size = int.from_bytes(data[:4], "little")
        header = json.loads(zstandard.ZstdDecompressor().decompress(data[4 : 4 + size]))
        self.symbols = np.array(header["symbols"], np.uint32)
        self.docs, self.sizes, self.zeros = header["docs"], header["sizes"], header["zeros"]
        self.n = sum(self.sizes)
        words = -(-self.n // RANK_BITS)
        self.ranks, self.bits, at = [], [], 4 + size
        for _ in self.zeros:
            self.ranks.append(np.frombuffer(data, "<u4", words, at))
            self.bits.append(np.frombuffer(data, np.uint8, words * RANK_BITS // 8, at + 4 * words))
            at += words * (4 + RANK_BITS // 8)

    def rank(self, plane: int, i: int) -> int:
        """Ones among the first ``i`` bits of a plane."""
        word = min(i // RANK_BITS, len(self.ranks[plane]) - 1)
        start = word * RANK_BITS // 8
        head, tail = divmod(i - word * RANK_BITS, 8)
        part = self.bits[plane][start : start + head]
        ones = int(self.ranks[plane][word]) + int(np.bitwise_count(part).sum())
        return ones + (int(self.bits[plane][start + head]) & ((1 << tail) - 1)).bit_count() if tail else ones

    def select(self, plane: int, bit: int, nth: int) -> int:
        """Position of the ``nth`` (from 0) ``bit`` of a plane, by bisection on rank."""
        low, high = 0, self.n
        while low < high:
            mid = (low + high) // 2
            ones = self.rank(plane, mid + 1)
            low, high = (low, mid) if (ones if bit else mid + 1 - ones) > nth else (mid + 1, high)
        return low

    def access(self, i: int) -> int:
        """The token at position ``i``."""
        code = 0
        for plane, zeros in enumerate(self.zeros):
            bit = int(self.bits[plane][i >> 3]) >> (i & 7) & 1
            ones = self.rank(plane, i)
            code, i = code << 1 | bit, zeros + ones if bit else i - ones
        return int(self.symbols[code])

    def _range(self, token: int, start: int, stop: int) -> tuple[int, int, int] | None:
        code = int(np.searchsorted(self.symbols, token))
        if code == len(self.symbols) or self.symbols[code] != token:
            return None
        for plane, zeros in enumerate(self.zeros):
            a, b = self.rank(plane, start), self.rank(plane, stop)
            start, stop = (zeros + a, zeros + b) if code >> (len(self.zeros) - 1 - plane) & 1 else (start - a, stop - b)
        return code, start, stop

    def count(self, token: int, start: int = 0, stop: int | None = None) -> int:
        """Occurrences of ``token`` in positions ``start`` to ``stop``."""
        found = self._range(token, start, self.n if stop is None else stop)
        return found[2] - found[1] if found else 0

    def locate(self, token: int, start: int = 0, stop: int | None = None) -> Iterator[int]:
        """Positions of ``token`` from ``start`` to ``stop``, ascending."""
        found = self._range(token, start, self.n if stop is None else stop)
        for i in range(found[1], found[2]) if found else ():
            for plane in range(len(self.zeros) - 1, -1, -1):
                bit = found[0] >> (len(self.zeros) - 1 - plane) & 1
                i = self.select(plane, bit, i - self.zeros[plane] if bit else i)
            yield i

    def decode(self) -> np.ndarray:
        """All tokens, plane by plane from the lowest bit."""
        kind = np.uint16 if len(self.symbols) <= 1 << 16 else np.uint32
        codes = np.zeros(self.n, kind)
        for k, plane in enumerate(range(len(self.zeros) - 1, -1, -1)):
            bits = np.unpackbits(self.bits[plane], count=self.n, bitorder="little").view(bool)
            zeros, out = self.zeros[plane], np.empty(self.n, kind)
            out[np.flatnonzero(~bits)] = codes[:zeros]
            out[np.flatnonzero(bits)] = codes[zeros:] | kind(1 << k)
            codes = out
        return self.symbols[codes]


class ShardReader:
    """Blocks of one shard file by range reads."""

    def __init__(self, uri: str) -> None:
        fs, path = pafs.FileSystem.from_uri(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        tail = self.file.read_at(16, size - 16)
        if tail[8:] != MAGIC:
            raise ValueError(f"not a token shard: {uri}")
        length = int.from_bytes(tail[:8], "little")
        footer = json.loads(zstandard.ZstdDecompressor().decompress(self.file.read_at(length, size - 16 - length)))
        self.blocks, self._index = footer["blocks"], footer["index"]
        self.starts = [0, *accumulate(b["tokens"] for b in self.blocks)]

    def block(self, i: int) -> Block:
        at, length = self.blocks[i]["at"], self.blocks[i]["bytes"]
        return Block(self.file.read_at(length, at))

    def __iter__(self) -> Iterator[Block]:
        return (self.block(i) for i in range(len(self.blocks)))

    def __len__(self) -> int:
        """Tokens in the file."""
        return self.starts[-1]

    @functools.cached_property
    def _counts(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """The symbols of each block and how often each occurs, by one range read."""
        at, length = self._index
        numbers = np.frombuffer(zstandard.ZstdDecompressor().decompress(self.file.read_at(length, at)), "<u4")
        ends = np.cumsum([2 * b["symbols"] for b in self.blocks])
        halves = [np.split(numbers[end - 2 * b["symbols"] : end], 2) for b, end in zip(self.blocks, ends)]
        return [(np.cumsum(gaps), n) for gaps, n in halves]

    def occurrences(self, block: int, token: int) -> int:
        """How often ``token`` occurs in a block, which is not read for it."""
        symbols, n = self._counts[block]
        code = int(np.searchsorted(symbols, token))
        return int(n[code]) if code < len(symbols) and symbols[code] == token else 0

    def access(self, i: int) -> int:
        """The token at position ``i`` of the file."""
        if not 0 <= i < len(self):
            raise IndexError(i)
        at = bisect_right(self.starts, i) - 1
        return self.block(at).access(i - self.starts[at])

    def count(self, token: int, start: int = 0, stop: int | None = None) -> int:
        """Occurrences of ``token`` in positions ``start`` to ``stop`` of the file."""
        found = 0
        for at, a, b in self._blocks_of(start, stop):
            most = self.occurrences(at, token)
            whole = a == 0 and b == self.blocks[at]["tokens"]
            found += most if whole or not most else self.block(at).count(token, a, b)
        return found

    def locate(self, token: int, start: int = 0, stop: int | None = None) -> Iterator[int]:
        """Positions of ``token`` in the file, ascending, from ``start`` to ``stop``."""
        for at, a, b in self._blocks_of(start, stop):
            if not self.occurrences(at, token):
                continue
            yield from (self.starts[at] + i for i in self.block(at).locate(token, a, b))

    def _blocks_of(self, start: int, stop: int | None) -> Iterator[tuple[int, int, int]]:
        """(block, start, stop in the block) of every block that a range touches."""
        stop = len(self) if stop is None else min(stop, len(self))
        at = bisect_right(self.starts, start) - 1
        while at < len(self.blocks) and self.starts[at] < stop:
            low = self.starts[at]
            yield at, max(0, start - low), min(stop, self.starts[at + 1]) - low
            at += 1


def _writer(folder: str, vocabulary: str, end_id: int | None, block_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = Encoder.of(vocabulary)
        end = np.array([] if end_id is None else [end_id], encoder.kind)
        out, places, counts, at, ids, tokens, held, docs, total = None, [], [], 0, [], [], 0, 0, 0

        def flush():
            nonlocal at, ids, tokens, held
            data = build_block(ids, tokens, counts)
            out.write(data)
            places.append({"at": at, "bytes": len(data), "docs": len(ids), "tokens": held, "symbols": len(counts[-1][0])})
            at += len(data)
            ids, tokens, held = [], [], 0

        for batch in slices(batches, "text", ENCODE_BYTES):
            if out is None:
                fs, base = pafs.FileSystem.from_uri(folder)
                fs.create_dir(base, recursive=True)
                name = f"shard-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.lwm"
                out = fs.open_output_stream(f"{base}/{name}")
                at = out.write(MAGIC) or len(MAGIC)
            encoded = encoder.encode(text_bytes(batch.column(1)))
            for ident, own in zip(batch.column(0).to_pylist(), encoded):
                own = np.concatenate([own, end])
                ids.append(ident)
                tokens.append(own)
                held += len(own)
                docs += 1
                total += len(own)
                if held >= block_tokens:
                    flush()
        if out is None:
            return
        if ids:
            flush()
        # gaps between symbols compress best
        parts = [x.astype("<u4").tobytes() for symbols, n in counts for x in (np.diff(symbols, prepend=0), n)]
        index = zstandard.ZstdCompressor(3).compress(b"".join(parts))
        out.write(index)
        footer = zstandard.ZstdCompressor(3).compress(json.dumps({"blocks": places, "index": [at, len(index)]}).encode())
        out.write(footer + len(footer).to_bytes(8, "little") + MAGIC)
        out.close()
        yield pa.record_batch(
            [pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([f"{folder}/{name}"]), pa.array([docs], pa.int64()), pa.array([total], pa.int64())],
            names=["shard", "path", "n_docs", "n_tokens"],
        )

    return run


def write_shards(docs: DataFrame, vocabulary: str, end_id: int | None = END_ID, folder: str | None = None, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Write ``docs`` (doc_id, text) as shards; returns their manifest: shard
    (ascending with the ids), path, n_docs, n_tokens, start (tokens before it)."""
    folder = folder or scratch(docs.sparkSession, "token_shards")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # one id may hold many rows, and one text of an id too: ranges go on by these
    rows = rows.select("doc_id", "text", F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("row"))
    dealt = rows.repartitionByRange("doc_id", "h", "row").sortWithinPartitions("doc_id", "h", "row").select("doc_id", "text")
    manifest = materialise(map_arrow(dealt, _writer(folder, vocabulary, end_id, block_tokens), "shard bigint, path string, n_docs bigint, n_tokens bigint", "token_shards"), "token_manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row a file
    return manifest.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0).cast("bigint")))


def read_shards(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for block in ShardReader(path):
                    ids = memoryview(block.decode().astype("<u4").view(np.uint8))
                    ends = np.cumsum(block.sizes)
                    starts = ends - block.sizes
                    crcs = [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist())]
                    yield pa.record_batch(
                        [pa.array(block.docs, pa.int64()), pa.array(starts + start, pa.int64()), pa.array(block.sizes, pa.int64()), pa.array(crcs, pa.int64())],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"],
                    )
                    start += block.n

    shards = max(1, manifest.count())
    one_each = manifest.select("path", "start", "shard").repartitionByRange(shards, "shard").select("path", "start")
    return map_arrow(one_each, run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def round_trip(docs: DataFrame, vocabulary: str, end_id: int | None = END_ID) -> DataFrame:
    return read_shards(write_shards(docs, vocabulary, end_id))
