"""Texts as small files of the kinds that the readers know: the other half of a
round trip, and what an export to office formats needs. Characters that XML cannot
hold become spaces."""

from __future__ import annotations

import io
import re
import zipfile
from email.message import EmailMessage
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.slices import map_frames

_NOT_XML = re.compile(f"[^\t\n\r -{chr(0xD7FF)}{chr(0xE000)}-{chr(0xFFFD)}{chr(0x10000)}-{chr(0x10FFFF)}]")

# XML namespaces of the formats.
WORD = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
SLIDE = "http://schemas.openxmlformats.org/presentationml/2006/main"
DRAWING = "http://schemas.openxmlformats.org/drawingml/2006/main"
SHEET = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
OFFICE = "urn:oasis:names:tc:opendocument:xmlns:office:1.0"
ODF_TEXT = "urn:oasis:names:tc:opendocument:xmlns:text:1.0"
CONTAINER = "urn:oasis:names:tc:opendocument:xmlns:container"
PACKAGE = "http://www.idpf.org/2007/opf"


def _xml(text: str) -> str:
    return escape(_NOT_XML.sub(" ", text))


def _zip(members: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in members.items():
            z.writestr(zipfile.ZipInfo(name), body, zipfile.ZIP_DEFLATED)
    return out.getvalue()


def docx(title: str, text: str) -> bytes:
    """A heading and a paragraph a line."""
    run = lambda s: f'<w:r><w:t xml:space="preserve">{_xml(s)}</w:t></w:r>'
    lines = "".join(f"<w:p>{run(s)}</w:p>" for s in text.split("\n"))
    head = f'<w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr>{run(title)}</w:p>'
    return _zip({"word/document.xml": f'<w:document xmlns:w="{WORD}"><w:body>{head}{lines}</w:body></w:document>'})


def pptx(title: str, text: str) -> bytes:
    """One slide with a paragraph a line, the title first."""
    lines = "".join(f"<a:p><a:r><a:t>{_xml(s)}</a:t></a:r></a:p>" for s in [title, *text.split("\n")])
    return _zip({"ppt/slides/slide1.xml": f'<p:sld xmlns:p="{SLIDE}" xmlns:a="{DRAWING}">{lines}</p:sld>'})


def xlsx(title: str, text: str) -> bytes:
    """One sheet with a row a line, its number and the line as a shared string."""
    lines = text.split("\n")
    shared = "".join(f"<si><t>{_xml(s)}</t></si>" for s in lines)
    rows = "".join(f'<row r="{i}"><c r="A{i}"><v>{i}</v></c><c r="B{i}" t="s"><v>{i - 1}</v></c></row>' for i in range(1, len(lines) + 1))
    return _zip({"xl/sharedStrings.xml": f'<sst xmlns="{SHEET}">{shared}</sst>', "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{SHEET}"><sheetData>{rows}</sheetData></worksheet>'})


def odt(title: str, text: str) -> bytes:
    lines = "".join(f"<t:p>{_xml(s)}</t:p>" for s in text.split("\n"))
    return _zip({"content.xml": f'<o:document-content xmlns:o="{OFFICE}" xmlns:t="{ODF_TEXT}"><o:body><t:h>{_xml(title)}</t:h>{lines}</o:body></o:document-content>'})


def epub(title: str, text: str) -> bytes:
    """A chapter a line. The spine names the navigation first, and the manifest
    lists the chapters backwards, so that only the spine gives their order."""
    lines = text.split("\n")
    page = '<html xmlns="http://www.w3.org/1999/xhtml"><head><title>{0}</title></head><body><h1>{0}</h1><p>{1}</p></body></html>'
    chapters = {f"OEBPS/c{i}.xhtml": page.format(_xml(f"{title} {i}"), _xml(s)) for i, s in enumerate(lines, 1)}
    items = "".join(f'<item id="c{i}" href="c{i}.xhtml"/>' for i in range(len(lines), 0, -1))
    spine = "".join(f'<itemref idref="c{i}"/>' for i in range(1, len(lines) + 1))
    return _zip(
        {
            "META-INF/container.xml": f'<container xmlns="{CONTAINER}"><rootfiles><rootfile full-path="OEBPS/book.opf"/></rootfiles></container>',
            "OEBPS/book.opf": f'<package xmlns="{PACKAGE}"><manifest>{items}<item id="nav" href="nav.xhtml" properties="nav"/></manifest><spine><itemref idref="nav"/>{spine}</spine></package>',
            "OEBPS/nav.xhtml": page.format("Contents", "Contents"),
            **chapters,
        }
    )


def rtf(title: str, text: str) -> bytes:
    def sign(c: str) -> str:
        if c == "\n":
            return "\\par "
        if c in "\\{}":
            return "\\" + c
        if c < "\x80":
            return c
        units = c.encode("utf-16-le", "surrogatepass")
        return "".join(f"\\u{int.from_bytes(units[i : i + 2], 'little', signed=True)}?" for i in range(0, len(units), 2))

    return ("{\\rtf1\\ansi{\\fonttbl{\\f0 Arial;}}\\f0 " + "".join(map(sign, text)) + "}").encode("latin-1")


def eml(title: str, text: str) -> bytes:
    message = EmailMessage()
    message["From"], message["To"] = "a@example.org", "b@example.org"
    message["Subject"] = " ".join(title.split())
    message.set_content(text)
    return message.as_bytes()


def plain(title: str, text: str) -> bytes:
    return text.encode("utf-8", "replace")


def html(title: str, text: str) -> bytes:
    lines = "".join(f"<p>{escape(s)}</p>" for s in text.split("\n"))
    return f"<!DOCTYPE html><html><head><title>{escape(title)}</title></head><body><nav><a href='/'>Home</a></nav><article><h1>{escape(title)}</h1>{lines}</article><footer>Legal notice</footer></body></html>".encode("utf-8", "replace")


WRITERS = {"docx": docx, "pptx": pptx, "xlsx": xlsx, "odt": odt, "epub": epub, "rtf": rtf, "eml": eml, "txt": plain, "code": plain, "html": html}


def written(rows: DataFrame, path: Column, kind: Column, title: Column, text: Column) -> DataFrame:
    """(path, kind, content): each row as a file of its kind; a null text is an
    empty one, an unknown kind plain text."""

    def run(batches):
        for b in batches:
            made = [WRITERS.get(k, plain)(n or "", x or "") for k, n, x in zip(b["kind"], b["title"], b["text"])]
            yield pd.DataFrame({"path": b["path"], "kind": b["kind"], "content": made})

    cells = rows.select(path.alias("path"), kind.alias("kind"), F.coalesce(title, F.lit("")).alias("title"), F.coalesce(text, F.lit("")).alias("text"))
    return map_frames(cells, run, "path string, kind string, content binary")
