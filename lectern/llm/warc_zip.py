"""WARC records in ZIP-packaged archives, written and range-read.

An archive is a ZIP file with stored (uncompressed) members: WARC data, in which
each record is a gzip member of its own, and an index with a line for each
record (key, JSON with member, offset, length). The reader parses the central
directory (ZIP64 records and fields included), finds where the stored members
begin, reads the index and fetches records by their ranges; nothing is
extracted. Archives of other writers are read too: relative names, numbers as
strings, gzipped indexes, plain or deflated members, any record id. Writers stream: sizes follow the data in descriptors, members start
anew above ``MEMBER_BYTES``. Files lie in the shared folder; the manifest of
written files is the commit, so a task that runs twice leaves no double records.

Of records with equal payloads the one with the largest id is the response, the
others are revisits that name it and hold the HTTP headers only. Which they are
is worked out on (id, payload hash) rows; a payload itself moves only when the
list of revisits is too large to be sent to the tasks, and then by its page id.

Defined results: a null payload counts as empty; very long payloads are written
whole; rows that repeat the largest id of a payload are responses all; null ids
sort below every number, and a payload with null ids only has responses; a null
url becomes ``about:blank``; an empty table writes no archive; extra columns are
ignored, whatever their names. Ids are read as ``bigint``.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_groups, map_arrow, materialise, scratch, slices, text_bytes

#: Payloads below this many bytes are always responses.
LEAST_PAYLOAD = 0
MEMBER_BYTES = 1 << 30
#: Neighbouring records are fetched together up to this many bytes.
FETCH_BYTES = 8 << 20
LEVEL = 4
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_LIMIT32, _LIMIT16 = 0xFFFFFFFF, 0xFFFF


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def target(url: str | None) -> str:
    """A url fit for a header or index line."""
    return quote(url, safe="!#$%&'()*+,/:;=?@[]~") if url else "about:blank"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record; with ``refers_to`` a revisit without the payload."""
    name = "" if page_id is None else page_id
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{name}>"]
    if refers_to is None:
        block += payload
    else:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    lines += [f"WARC-Target-URI: {target(url)}", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


@dataclass
class Record:
    page_id: int | None
    url: str
    kind: str
    refers_to: int | None
    digest: str
    payload_bytes: int
    payload: bytes | None
    record_id: str = ""
    refers_to_id: str = ""


_PAGE = re.compile(r"<urn:page:(-?\d+)>")


def _headers(head: bytes) -> tuple[str, dict[str, str]]:
    """The first line and the fields, names in lower case; a line that begins with
    white space goes on from the one before."""
    first, *lines = re.sub(rb"\r?\n[ \t]+", b" ", head).decode("utf-8", "replace").replace("\r\n", "\n").split("\n")
    return first, {name.strip().lower(): value.strip() for name, mark, value in (line.partition(":") for line in lines) if mark}


def _behind_blank_line(data: bytes) -> tuple[bytes, bytes]:
    m = re.search(rb"\r?\n\r?\n", data)
    return (data[: m.start()], data[m.end() :]) if m else (data, b"")


def _unchunked(body: bytes) -> bytes:
    """A chunked HTTP body as one."""
    parts, at = [], 0
    while (end := body.find(b"\r\n", at)) >= 0 and (size := int(body[at:end].split(b";")[0] or b"0", 16)):
        parts.append(body[end + 2 : end + 2 + size])
        at = end + 4 + size
    return b"".join(parts)


def _is_digest(said: str, payload: bytes) -> bool | None:
    """Whether a digest field (algorithm:value, base 32 or hex) is the payload's; None
    for an algorithm that is not known here."""
    name, _, value = said.partition(":")
    name = name.lower().replace("-", "")
    if name not in ("sha1", "sha256", "sha512", "md5"):
        return None
    made = hashlib.new(name, payload).digest()
    return value.lower() == made.hex() or value.rstrip("=").upper() == base64.b32encode(made).decode().rstrip("=")


def parse(data: bytes) -> Record:
    """A record from its bytes. The payload of an HTTP response is what follows the
    HTTP headers, of any other record the whole block; a digest of a known algorithm
    must be that of the payload as stored or as one chunk."""
    head, rest = _behind_blank_line(data)
    _, fields = _headers(head)
    block = rest[: int(fields["content-length"])]
    kind, known, size = fields["warc-type"], fields.get("warc-payload-digest", ""), None
    payload = block
    if "application/http" in fields.get("content-type", "") and kind in ("response", "revisit"):
        http, payload = _behind_blank_line(block)
        _, told = _headers(http)
        size = int(told["content-length"]) if told.get("content-length", "").isdigit() else None
        if kind == "response" and known and "chunked" in told.get("transfer-encoding", "").lower() and _is_digest(known, payload) is False:
            payload, size = _unchunked(payload), None
    cut = len(block) < int(fields["content-length"]) or kind == "response" and size is not None and len(payload) != size and "warc-truncated" not in fields
    if cut or kind == "response" and known and _is_digest(known, payload) is False:
        raise ValueError(f"damaged record {fields.get('warc-record-id')}")

    def page(name: str) -> int | None:
        m = _PAGE.fullmatch(fields.get(name, ""))
        return int(m[1]) if m else None

    digest = known.partition(":")[2] or payload_digest(payload)
    refers = page("warc-refers-to") if kind == "revisit" else None
    length = size if kind == "revisit" and size is not None else len(payload)
    url = fields.get("warc-target-uri", "").strip("<>")
    return Record(page("warc-record-id"), url, kind, refers, digest, length, None if kind == "revisit" else payload, fields.get("warc-record-id", ""), fields.get("warc-refers-to", ""))


class ZipWriter:
    """Streams stored members to ``out`` (anything with ``write``)."""

    def __init__(self, out, zip64: bool = False) -> None:
        self.out, self.at, self.zip64, self.members = out, 0, zip64, []

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def begin(self, name: str) -> None:
        self.name, self.start, self.crc, self.size = name.encode(), self.at, 0, 0
        # flags: sizes in a descriptor, UTF-8 name; the ZIP64 field makes it a wide one
        extra = struct.pack("<HHQQ", 1, 16, 0, 0)
        self._put(struct.pack("<4sHHHHHIIIHH", b"PK\3\4", 45, 0x808, 0, 0, 0x21, 0, _LIMIT32, _LIMIT32, len(self.name), len(extra)) + self.name + extra)

    def write(self, data: bytes) -> None:
        self.crc, self.size = zlib.crc32(data, self.crc), self.size + len(data)
        self._put(data)

    def end(self) -> None:
        self._put(struct.pack("<4sIQQ", b"PK\7\x08", self.crc, self.size, self.size))
        self.members.append((self.name, self.crc, self.size, self.start))

    def close(self) -> None:
        begin = self.at
        for name, crc, size, start in self.members:
            wide = self.zip64 or max(size, start) >= _LIMIT32
            extra = struct.pack("<HHQQQ", 1, 24, size, size, start) if wide else b""
            shown = (_LIMIT32, _LIMIT32, _LIMIT32) if wide else (size, size, start)
            self._put(struct.pack("<4sHHHHHHIIIHHHHHII", b"PK\1\2", 45, 45, 0x808, 0, 0, 0x21, crc, *shown[:2], len(name), len(extra), 0, 0, 0, 0, shown[2]) + name + extra)
        size, n = self.at - begin, len(self.members)
        if self.zip64 or n >= _LIMIT16 or begin >= _LIMIT32:
            end64 = self.at
            self._put(struct.pack("<4sQHHIIQQQQ", b"PK\6\6", 44, 45, 45, 0, 0, n, n, size, begin))
            self._put(struct.pack("<4sIQI", b"PK\6\7", 0, end64, 1))
            n, size, begin = _LIMIT16, _LIMIT32, _LIMIT32
        self._put(struct.pack("<4sHHHHIIH", b"PK\5\6", 0, 0, n, n, size, begin, 0))


class ZipReader:
    """The members of a ZIP file, by range reads. ``file`` has ``read_at(length,
    offset)`` and ``size()``. Stored members are read in place; of a deflated one what
    lies before a range must be inflated, ``FETCH_BYTES`` at a time, and is dropped."""

    def __init__(self, file) -> None:
        self.file, size = file, file.size()
        tail_at = max(0, size - 22 - _LIMIT16)
        tail = file.read_at(size - tail_at, tail_at)
        at = tail.rfind(b"PK\5\6")
        if at < 0:
            raise ValueError("no ZIP directory")
        n, length, begin = struct.unpack_from("<HII", tail, at + 10)
        if n == _LIMIT16 or length == _LIMIT32 or begin == _LIMIT32:
            locator = file.read_at(20, tail_at + at - 20)
            if locator[:4] == b"PK\6\7":
                (end64,) = struct.unpack_from("<Q", locator, 8)
                n, length, begin = struct.unpack_from("<QQQ", file.read_at(56, end64), 32)
        self.members: dict[str, tuple[int, int]] = {}
        self.deflated: dict[str, tuple[int, int, int]] = {}  # the third: packed bytes
        directory, at = file.read_at(length, begin), 0
        for _ in range(n):
            if directory[at : at + 4] != b"PK\1\2":
                raise ValueError("damaged ZIP directory")
            (method,) = struct.unpack_from("<H", directory, at + 10)
            packed, full, n_name, n_extra, n_note = struct.unpack_from("<IIHHH", directory, at + 20)
            (start,) = struct.unpack_from("<I", directory, at + 42)
            name = directory[at + 46 : at + 46 + n_name].decode()
            extra, i = directory[at + 46 + n_name : at + 46 + n_name + n_extra], 0
            while i + 4 <= len(extra):
                kind, width = struct.unpack_from("<HH", extra, i)
                if kind == 1:  # only the fields that did not fit, in this order
                    wide = iter(struct.unpack_from(f"<{width // 8}Q", extra, i + 4))
                    full = next(wide) if full == _LIMIT32 else full
                    packed = next(wide) if packed == _LIMIT32 else packed
                    start = next(wide) if start == _LIMIT32 else start
                i += 4 + width
            if method not in (0, 8):
                raise ValueError(f"{name}: compression method {method} is not read")
            if not name.endswith("/"):
                if method:
                    self.deflated[name] = (start, full, packed)
                else:
                    self.members[name] = (start, full)
            at += 46 + n_name + n_extra + n_note
        self._data: dict[str, int] = {}

    def __contains__(self, name: str) -> bool:
        return name in self.members or name in self.deflated

    def __iter__(self) -> Iterator[str]:
        yield from self.members
        yield from self.deflated

    def data_at(self, name: str) -> int:
        """Where a member's bytes begin (behind its local header)."""
        if name not in self._data:
            start = (self.members.get(name) or self.deflated[name])[0]
            n_name, n_extra = struct.unpack_from("<HH", self.file.read_at(30, start), 26)
            self._data[name] = start + 30 + n_name + n_extra
        return self._data[name]

    def read(self, name: str, offset: int = 0, length: int | None = None) -> bytes:
        size = (self.members.get(name) or self.deflated[name])[1]
        length = size - offset if length is None else min(length, size - offset)
        if name in self.deflated:
            return self._inflated(name, offset, length)
        return self.file.read_at(length, self.data_at(name) + offset)


    def _inflated(self, name: str, offset: int, length: int) -> bytes:
        begin, packed, at, held, out = self.data_at(name), self.deflated[name][2], 0, 0, []
        inflate = zlib.decompressobj(-15)
        while held < offset + length and at < packed:
            part = inflate.decompress(self.file.read_at(min(FETCH_BYTES, packed - at), begin + at))
            at += FETCH_BYTES
            out.append(part[max(0, offset - held) : max(0, offset + length - held)])
            held += len(part)
        return b"".join(out)


def gunzipped(data: bytes) -> bytes:
    """All gzip members of ``data`` one after the other; other bytes as they are."""
    out = []
    while data[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        out.append(member.decompress(data))
        data = member.unused_data
    return b"".join([*out, data])


def read_index(archive: ZipReader) -> list[dict]:
    """The entries of all index members: filename, offset, length, and what else a
    line's JSON says. Index members may be gzipped; a file name may be the member's
    own or leave out ``archive/``; numbers may be written as strings."""
    names = sorted(n for n in archive if re.fullmatch(r"indexes/.*\.cdxj?(\.gz)?", n))
    found = []
    for name in names:
        for line in gunzipped(archive.read(name)).splitlines():
            start = line.find(b"{")
            if start < 0 or line.startswith(b"!"):
                continue  # a blank line or the index's own description
            entry = json.loads(line[start:])
            member = entry["filename"]
            if member not in archive:
                member = f"archive/{member}"
            if member not in archive:
                raise ValueError(f"{name} names {entry['filename']}, which the archive does not hold")
            found.append(entry | {"filename": member, "offset": int(entry["offset"]), "length": int(entry["length"])})
    return found


def read_records(archive: ZipReader, entries: list[dict]) -> Iterator[Record]:
    """The records of index entries, neighbours fetched with one range read."""
    entries = sorted(entries, key=lambda e: (e["filename"], e["offset"]))
    i = 0
    while i < len(entries):
        first, j = entries[i], i + 1
        end = first["offset"] + first["length"]
        while j < len(entries) and entries[j]["filename"] == first["filename"] and entries[j]["offset"] == end and end - first["offset"] + entries[j]["length"] <= FETCH_BYTES:
            end += entries[j]["length"]
            j += 1
        data = archive.read(first["filename"], first["offset"], end - first["offset"])
        for e in entries[i:j]:
            at = e["offset"] - first["offset"]
            yield parse(gunzipped(data[at : at + e["length"]]))
        i = j


def open_archive(uri: str) -> ZipReader:
    fs, path = pafs.FileSystem.from_uri(uri)
    return ZipReader(fs.open_input_file(path))


def _writer(folder: str, member_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        archive, n, lines, parts = None, 0, [], 0
        for batch in slices(batches, "payload"):
            if archive is None:
                fs, base = pafs.FileSystem.from_uri(folder)
                fs.create_dir(base, recursive=True)
                name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.wacz"
                out = fs.open_output_stream(f"{base}/{name}")
                archive = ZipWriter(out)
            payloads = text_bytes(batch.column("payload"))
            for i, (page, url, refers) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "refers_to")))):
                if n == 0 or archive.size >= member_bytes:
                    if n:
                        archive.end()
                    member = f"archive/data-{parts:05d}.warc.gz"
                    parts += 1
                    archive.begin(member)
                digest = payload_digest(payloads[i])
                pack = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                data = pack.compress(record(page, url, payloads[i], digest, refers)) + pack.flush()
                entry = {"url": url, "digest": f"sha1:{digest}", "filename": member, "offset": archive.size, "length": len(data), "page_id": page}
                archive.write(data)
                lines.append(f"{target(url)} 19700101000000 {json.dumps(entry)}\n".encode())
                n += 1
        if archive is None:
            return
        archive.end()
        archive.begin("indexes/index.cdxj")
        archive.write(b"".join(sorted(lines)))
        archive.end()
        archive.begin("datapackage.json")
        archive.write(json.dumps({"profile": "data-package", "wacz_version": "1.1.1", "records": n}).encode())
        archive.end()
        archive.close()
        out.close()
        yield pa.record_batch([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([f"{folder}/{name}"]), pa.array([n], pa.int64())], names=["part", "path", "records"])

    return run


def write_archives(pages: DataFrame, folder: str | None = None, least_payload: int = LEAST_PAYLOAD, member_bytes: int = MEMBER_BYTES) -> DataFrame:
    """Write a record for each row (page_id, url, html); returns the manifest: part, path, records."""
    folder = folder or scratch(pages.sparkSession, "archives")
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    keyed = rows.withColumn("key", F.sha2("payload", 256))
    # payloads stay where they are: only (page, key) rows are grouped and joined
    slim = materialise(keyed.where(F.octet_length("payload") >= least_payload).select("page_id", "key"), "payload_keys")
    groups = materialise(slim.groupBy("key").agg(F.max("page_id").alias("response"), F.count("*").alias("n")).where("n > 1 and response is not null"), "payload_groups")
    told = join_groups(slim, groups, "key", "n", "page_id").where("response is not null and not page_id <=> response")
    revisits = materialise(told.select(F.col("page_id").alias("page"), F.col("key").alias("its_key"), "response").distinct(), "revisits")
    mine = F.col("page_id").eqNullSafe(F.col("page")) & (F.col("key") == F.col("its_key"))
    dealt = keyed.join(revisits, mine, "left").select("page_id", "url", "payload", F.col("response").alias("refers_to"))
    return materialise(map_arrow(dealt, _writer(folder, member_bytes), "part bigint, path string, records bigint"), "archive_manifest")


def read_archives(manifest: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                archive = open_archive(path)
                entries = read_index(archive)
                out = [(r.page_id, r.payload_bytes, r.digest, r.kind, r.refers_to) for r in read_records(archive, entries)]
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                yield pa.record_batch([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    one_each = manifest.repartitionByRange(max(1, manifest.count()), "part").select("path")
    return map_arrow(one_each, run, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint")


def round_trip(pages: DataFrame) -> DataFrame:
    return read_archives(write_archives(pages))


ORACLE_SQL = r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html FROM pages
), h AS (
  SELECT page_id, html, max(page_id) OVER (PARTITION BY html) AS response,
         list_aggregate(list_transform(range(1, 41), lambda i: ['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111'][strpos('0123456789abcdef', sha1(html)[i])]), 'string_agg', '') AS bits
  FROM p
)
SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes,
       list_aggregate(list_transform(range(0, 32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + 16 * CAST(bits[5 * i + 1] AS INT) + 8 * CAST(bits[5 * i + 2] AS INT) + 4 * CAST(bits[5 * i + 3] AS INT) + 2 * CAST(bits[5 * i + 4] AS INT) + CAST(bits[5 * i + 5] AS INT)]), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = response THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> response THEN response END AS refers_to
FROM h
"""
