"""Files to units: (path, unit_kind, number, title, text, line) from bytes.

One reader per kind, standard library only. A file is one row, so a batch of files is read at a time.
"""

from __future__ import annotations

import csv
import email
import email.policy
import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.chunking import markdown_sections
from ..operators.html import read as read_html
from ..operators.slices import map_frames
from .files import sniffed

Unit = tuple[str, int, str, str, int | None]
CSV_ROWS = 200


def decode(data: bytes) -> str:
    if data[:4] in (b"\xff\xfe\0\0", b"\0\0\xfe\xff"):
        return data.decode("utf-32", "replace")
    if data[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return data.decode("utf-16", "replace")
    for name in ("utf-8-sig", "cp1252"):
        try:
            return data.decode(name)
        except UnicodeDecodeError:
            continue
    return data.decode("latin-1")


def _local(element) -> str:
    return element.tag.rsplit("}", 1)[-1]


def _texts(element, tag: str) -> str:
    return "".join(e.text or "" for e in element.iter() if _local(e) == tag)


def markdown(data: bytes) -> Iterator[Unit]:
    for i, (title, line, text) in enumerate(markdown_sections(decode(data)), 1):
        yield "section", i, title, text, line


def plain(data: bytes) -> Iterator[Unit]:
    yield "text", 1, "", decode(data), 1


def table(data: bytes) -> Iterator[Unit]:
    """The first rows of a CSV file, cells joined by bars."""
    text = decode(data)
    try:
        dialect = csv.Sniffer().sniff(text[:4000], ",;\t|")
    except csv.Error:
        dialect = csv.excel
    rows = [" | ".join(cell.strip() for cell in row) for _, row in zip(range(CSV_ROWS), csv.reader(io.StringIO(text), dialect))]
    yield "text", 1, "", "\n".join(rows), 1


def html(data: bytes) -> Iterator[Unit]:
    """Sections at headings of the first three levels."""
    title, held, n = "", [], 0
    for tag, text in [*read_html(decode(data)).blocks, ("h1", "")]:
        if tag in ("h1", "h2", "h3"):
            if held:
                n += 1
                yield "section", n, title, "\n".join(held), None
            title, held = text, []
        else:
            held.append(text)


def epub(data: bytes) -> Iterator[Unit]:
    """Chapters in the order of the spine, the navigation left out."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        container = ElementTree.fromstring(z.read("META-INF/container.xml"))
        package = next(e.get("full-path") for e in container.iter() if _local(e) == "rootfile")
        opf = ElementTree.fromstring(z.read(package))
        items = {e.get("id"): (e.get("href"), e.get("properties") or "") for e in opf.iter() if _local(e) == "item"}
        n = 0
        for e in opf.iter():
            href, properties = items.get(e.get("idref"), (None, "")) if _local(e) == "itemref" else (None, "")
            if not href or "nav" in properties.split():
                continue
            page = read_html(decode(z.read(posixpath.normpath(posixpath.join(posixpath.dirname(package), href)))))
            text = "\n".join(t for _, t in page.blocks)
            if text:
                n += 1
                yield "chapter", n, page.headings[0][1] if page.headings else page.title.strip(), text, None


def docx(data: bytes) -> Iterator[Unit]:
    """Sections at headings; table rows as cells joined by bars."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = next(e for e in ElementTree.fromstring(z.read("word/document.xml")).iter() if _local(e) == "body")
    title, held, n = "", [], 0
    for block in [*body, None]:
        style = "" if block is None else next((v for e in block.iter() if _local(e) == "pStyle" for v in e.attrib.values()), "")
        heading = block is None or _local(block) == "p" and re.match(r"(?i)(heading|t[ií]tulo|title)\s*\d?", style)
        if heading:
            if held:
                n += 1
                yield "section", n, title, "\n".join(held), None
            title, held = "" if block is None else _texts(block, "t").strip(), []
        elif _local(block) == "tbl":
            held += [" | ".join(_texts(c, "t").strip() for c in row if _local(c) == "tc") for row in block if _local(row) == "tr"]
        elif text := _texts(block, "t").strip():
            held.append(text)


def pptx(data: bytes) -> Iterator[Unit]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = [m for m in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", m)]
        for i, name in enumerate(sorted(names, key=lambda m: int(re.findall(r"\d+", m)[-1])), 1):
            lines = [t for p in ElementTree.fromstring(z.read(name)).iter() if _local(p) == "p" and (t := _texts(p, "t").strip())]
            yield "slide", i, lines[0] if lines else "", "\n".join(lines), None


def xlsx(data: bytes) -> Iterator[Unit]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = [_texts(si, "t") for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")) if _local(si) == "si"]
        names = sorted((m for m in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", m)), key=lambda m: int(re.findall(r"\d+", m)[-1]))
        for i, name in enumerate(names, 1):
            rows = []
            for row in (e for e in ElementTree.fromstring(z.read(name)).iter() if _local(e) == "row"):
                cells = []
                for c in row:
                    value = _texts(c, "v") or _texts(c, "t")
                    cells.append(shared[int(value)] if c.get("t") == "s" and value else value)
                rows.append(" | ".join(cells))
            yield "sheet", i, f"Sheet {i}", "\n".join(rows), None


def odt(data: bytes) -> Iterator[Unit]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = ElementTree.fromstring(z.read("content.xml"))
    title, held, n = "", [], 0
    for e in [*(e for e in root.iter() if _local(e) in ("h", "p")), None]:
        if e is None or _local(e) == "h":
            if held:
                n += 1
                yield "section", n, title, "\n".join(held), None
            title, held = "" if e is None else "".join(e.itertext()).strip(), []
        elif text := "".join(e.itertext()).strip():
            held.append(text)


#: Groups that hold no text, and the marks of RTF by what they stand for.
_RTF_TABLES = re.compile(r"\{\\(?:fonttbl|colortbl|stylesheet|info|\*)[^{}]*(?:\{[^{}]*\}[^{}]*)*\}")
_RTF_MARK = re.compile(r"\\'(?P<byte>[0-9a-fA-F]{2})|\\u(?P<unit>-?\d+) ?(?:\\'[0-9a-fA-F]{2}|\?)?|\\(?P<word>[a-zA-Z]+)-?\d* ?|\\(?P<sign>[\\{}])|\\.|[{}\r\n]", re.S)


def _rtf_mark(m: re.Match) -> str:
    if m["byte"]:
        return bytes([int(m["byte"], 16)]).decode("cp1252", "replace")
    if m["unit"]:
        return chr(int(m["unit"]) % 65536)
    return m["sign"] or {"par": "\n", "line": "\n", "tab": "\t"}.get(m["word"] or "", "")


def rtf(data: bytes) -> Iterator[Unit]:
    s = _RTF_MARK.sub(_rtf_mark, _RTF_TABLES.sub("", data.decode("latin-1")))
    yield "text", 1, "", s.encode("utf-16", "surrogatepass").decode("utf-16", "replace").strip(), 1


def eml(data: bytes) -> Iterator[Unit]:
    message = email.message_from_bytes(data, policy=email.policy.default)
    body = message.get_body(("plain", "html"))
    text = "" if body is None else body.get_content()
    if body is not None and body.get_content_type() == "text/html":
        text = "\n".join(t for _, t in read_html(text).blocks)
    files = ", ".join(a.get_filename() or "?" for a in message.iter_attachments())
    head = "\n".join(f"{k}: {message[k]}" for k in ("From", "To", "Date", "Subject") if message[k])
    yield "text", 1, str(message["Subject"] or ""), "\n\n".join(x for x in (head, text.strip(), f"Attachments: {files}" if files else "") if x), 1


def pdf(data: bytes) -> Iterator[Unit]:
    """A unit a page: its lines from top to bottom."""
    from .pdf import File, shown

    file = File(data)
    for number, page in enumerate(file.pages(), 1):
        lines: list[str] = []
        at = None
        for _, y, size, text in sorted(shown(file.content(page), file.decoders(page)), key=lambda r: (-r[1], r[0])):
            if at is not None and at - y <= 0.4 * size:
                lines[-1] += f" {text}"
            else:
                lines.append(text)
            at = y
        yield "page", number, "", "\n".join(lines), None


READERS = {"md": markdown, "txt": plain, "code": plain, "csv": table, "html": html, "epub": epub, "docx": docx, "pptx": pptx, "xlsx": xlsx, "odt": odt, "rtf": rtf, "eml": eml, "pdf": pdf}


def file_units(path: str, kind: str, content: bytes) -> list[tuple]:
    """(path, unit_kind, number, title, text, line, note) of one file's units; a file
    that can't be read gives one row with the reason as its note."""
    try:
        return [(path, *unit, None) for unit in READERS.get(kind, plain)(content)]
    except Exception as e:  # a broken file is a row, not a failed job
        return [(path, "error", 0, "", "", None, f"{type(e).__name__}: {e}"[:200])]


def units(files: DataFrame) -> DataFrame:
    """``file_units`` of files (path, kind, content)."""

    def run(batches):
        for batch in batches:
            out = [u for path, kind, content in zip(batch["path"], batch["kind"], batch["content"]) for u in file_units(path, kind, bytes(content))]
            yield pd.DataFrame(out, columns=["path", "unit_kind", "number", "title", "text", "line", "note"]).astype({"line": "Int64"})

    return map_frames(files.select("path", "kind", "content"), run, "path string, unit_kind string, number bigint, title string, text string, line bigint, note string")


def read_any(files: DataFrame) -> DataFrame:
    """(path, kind, title, n_units, text, needs_ocr, note): one row a file of (path,
    content), its kind told by its bytes. A picture, or a PDF of which at least half
    of the pages have no text, needs OCR; an empty, broken, legacy or unknown file
    has no text and the reason as its note."""
    told = files.select("path", sniffed(F.col("path"), F.col("content")).alias("kind"), "content")
    names = ["path", "kind", "title", "n_units", "text", "needs_ocr", "note"]

    def one(path: str, kind: str, data: bytes) -> tuple:
        stem = posixpath.splitext(posixpath.basename(path or ""))[0]
        if not data:
            return path, kind, stem, 0, "", False, "the file is empty"
        if kind == "image":
            return path, kind, stem, 0, "", True, "a picture: its text needs OCR"
        if kind not in READERS:
            return path, kind, stem, 0, "", False, f"no reader for {kind}"
        try:
            found = list(READERS[kind](data))
        except Exception as e:  # a broken file is a row, not a failed job
            return path, kind, stem, 0, "", kind == "pdf", f"could not be read: {type(e).__name__}: {e}"[:200]
        bare = sum(not u[3].strip() for u in found)
        ocr = kind == "pdf" and 2 * bare >= max(2, len(found))
        kept = [u for u in found if u[3]]
        title = kept[0][2] if kept and len(kept) == 1 else ""
        return path, kind, title or stem, len(kept), "\n\n".join(u[3] for u in kept), ocr, f"{bare} pages have no text" if kind == "pdf" and bare else None

    def run(batches):
        for b in batches:
            yield pd.DataFrame([one(p, k, bytes(c or b"")) for p, k, c in zip(b["path"], b["kind"], b["content"])], columns=names)

    return map_frames(told, run, "path string, kind string, title string, n_units int, text string, needs_ocr boolean, note string")
