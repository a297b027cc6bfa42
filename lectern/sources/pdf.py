"""PDF files: text runs with their places, and files written from texts.

``runs`` reads what a page shows as text: objects (object streams too), the page
tree, FlateDecode content, the text operators, codes by the font's ToUnicode map or
as Windows Latin. It draws nothing, decrypts nothing and reads no image. ``written``
makes a file a text: lines on pages, a larger first line, blank lines as gaps.

Defined results: bytes that are no PDF, or are encrypted, give one row with the
reason as its note; an empty page has no runs; strings of any length are read whole.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame

from ..operators.extraction import mapped

_LEX = re.compile(rb"\s+|%[^\r\n]*|(<<|>>|\[|\])|/([^\s<>\[\]()/%{}]*)|\(|<([0-9A-Fa-f\s]*)>|([+-]?(?:\d+\.?\d*|\.\d+))|([^\s<>\[\]()/%{}]+)|.", re.S)
_ESCAPE = re.compile(rb"\\([0-7]{1,3}|\r\n|.)", re.S)
_ESCAPED = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f", b"\n": b"", b"\r": b"", b"\r\n": b""}


class Ref(int):
    """The number of another object."""


class Name(str):
    """A name (``/Font``)."""


class Operator(str):
    """A word that is neither name nor value."""


def _string(data: bytes, at: int) -> tuple[bytes, int]:
    """A literal string that begins behind its bracket at ``at``, and where it ends."""
    depth, start = 1, at
    while depth and at < len(data):
        c = data[at]
        at += 2 if c == 0x5C else 1
        depth += (c == 0x28) - (c == 0x29)
    unescape = lambda m: _ESCAPED[m[1]] if m[1] in _ESCAPED else bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() else m[1]
    return _ESCAPE.sub(unescape, data[start : at - 1]), at


def lexed(data: bytes, at: int = 0) -> Iterator[tuple[object, int]]:
    """(value or operator, end) of what stands at the top, containers whole."""
    held: list[list] = []
    while at < len(data):
        m = _LEX.match(data, at)
        at, value = m.end(), None
        mark, name, digits, number, word = m.groups()
        if mark in (b"<<", b"["):
            held.append([])
            continue
        if mark and held:
            items = held.pop()
            value = dict(zip(items[::2], items[1::2])) if mark == b">>" else items
        elif name is not None:
            value = Name(re.sub(rb"#([0-9A-Fa-f]{2})", lambda x: bytes([int(x[1], 16)]), name).decode("latin-1"))
        elif m[0] == b"(":
            value, at = _string(data, at)
        elif digits is not None:
            digits = b"".join(digits.split())
            value = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        elif number is not None:
            value = float(number) if b"." in number else int(number)
        elif word is not None:
            value = Operator(word.decode("latin-1"))
            if held and value == "R" and len(held[-1]) > 1:
                held[-1][-2:] = [Ref(held[-1][-2])]
                continue
            value = {"true": True, "false": False, "null": None}.get(value, value)
        else:
            continue
        if held:
            held[-1].append(value)
        else:
            yield value, at


class _Codes(dict):
    """By code its UTF-16, from single codes and ranges; a code is looked up once."""

    def __init__(self, single: dict[int, bytes], ranges: list[tuple[int, int, bytes]]) -> None:
        super().__init__((n, text) for n, text in single.items() if text is not None)
        self._ranges = ranges

    def __missing__(self, n: int) -> bytes:
        self[n] = text = next((bytes(first[:-2]) + (int.from_bytes(first[-2:], "big") + n - low & 0xFFFF).to_bytes(2, "big") for low, high, first in self._ranges if low <= n <= high), b"\xff\xfd")
        return text


class File:
    """The objects of a file by number: values, and the bytes of streams."""

    def __init__(self, data: bytes) -> None:
        if b"%PDF-" not in data[:1024]:
            raise ValueError("not a PDF file")
        self.values, self.streams, self.root, self._fonts = {}, {}, None, {}
        for m in re.finditer(rb"(?<!\d)(\d+)\s+\d+\s+obj\b", data):
            found = next(lexed(data, m.end()), None)
            if found is None:
                continue
            value, end = found
            self.values[int(m[1])] = value
            s = re.compile(rb"\s*stream\r?\n").match(data, end) if isinstance(value, dict) else None
            if s:
                length = value.get("Length")
                stop = s.end() + length if isinstance(length, int) and not isinstance(length, Ref) else data.find(b"endstream", s.end())
                self.streams[int(m[1])] = data[s.end() : stop]
        for n in [n for n, v in self.values.items() if isinstance(v, dict) and v.get("Type") == "ObjStm"]:
            inner, packed = self.stream(n), self.values[n]
            heads = [v for v, _ in lexed(inner[: packed["First"]])]
            for number, offset in zip(heads[::2], heads[1::2]):
                self.values.setdefault(number, next(lexed(inner, packed["First"] + offset))[0])
        if re.search(rb"/Encrypt\s+\d+\s+\d+\s+R", data):
            raise ValueError("the file is encrypted")

    def get(self, value: object) -> object:
        for _ in range(20):
            if not isinstance(value, Ref):
                break
            value = self.values.get(int(value))
        return value

    def stream(self, number: int) -> bytes:
        """A stream's bytes, inflated where Flate is its one filter."""
        kind = self.get(self.values[number].get("Filter"))
        kinds = kind if isinstance(kind, list) else [kind] if kind else []
        data = self.streams.get(number, b"")
        if kinds == ["FlateDecode"]:
            return zlib.decompressobj().decompress(data)
        return b"" if kinds else data

    def pages(self) -> Iterator[dict]:
        """The pages in order, with what they inherit."""
        root = next((v for v in self.values.values() if isinstance(v, dict) and v.get("Type") == "Catalog"), {})
        waiting, seen = [(root.get("Pages"), {})], set()
        while waiting:
            ref, above = waiting.pop()
            node = self.get(ref)
            if not isinstance(node, dict) or isinstance(ref, Ref) and int(ref) in seen:
                continue
            seen.add(int(ref) if isinstance(ref, Ref) else id(node))
            own = above | {k: node[k] for k in ("Resources",) if k in node}
            kids = self.get(node.get("Kids"))
            if isinstance(kids, list):
                waiting += [(kid, own) for kid in reversed(kids)]
            else:
                yield own | node

    def content(self, page: dict) -> bytes:
        parts = page.get("Contents")
        parts = self.get(parts) if isinstance(self.get(parts), list) else [parts]
        return b"\n".join(self.stream(int(p)) for p in parts if isinstance(p, Ref) and int(p) in self.streams)

    def decoders(self, page: dict) -> dict[str, object]:
        """By font name, how codes become text."""
        fonts = self.get((self.get(page.get("Resources")) or {}).get("Font")) or {}
        return {name: self._font(font) for name, font in fonts.items()}

    def _font(self, font: object):
        """The decoder of a font, made once for all pages that name it."""
        if not isinstance(font, Ref):
            return self._decoder(font or {})
        if int(font) not in self._fonts:
            self._fonts[int(font)] = self._decoder(self.get(font) or {})
        return self._fonts[int(font)]

    def _decoder(self, font: dict):
        ref = font.get("ToUnicode")
        wide = font.get("Subtype") == "Type0"
        if not isinstance(ref, Ref):
            return lambda code: code.decode("utf-16-be" if wide else "cp1252", "replace")
        single, ranges = _unicode_map(self.stream(int(ref)))
        codes, width = _Codes(single, ranges), 2 if wide else 1
        plain = wide and not single and ranges == [(0, 0xFFFF, b"\0\0")]  # codes are UTF-16 themselves

        def said(code: bytes) -> str:
            odd = len(code) % width
            if plain and not odd:
                return code.decode("utf-16-be", "replace")
            units = struct.unpack(f">{len(code) // 2}H", code[: len(code) - odd]) if wide else code
            return b"".join(map(codes.__getitem__, (*units, code[-1]) if odd else units)).decode("utf-16-be", "replace")

        return said


def _unicode_map(data: bytes) -> tuple[dict[int, bytes], list[tuple[int, int, bytes]]]:
    """(code to UTF-16, ranges) of a ToUnicode map."""
    single, ranges, held = {}, [], []
    for value, _ in lexed(data):
        if isinstance(value, Operator):
            if value == "endbfchar":
                single |= {int.from_bytes(a, "big"): b for a, b in zip(held[::2], held[1::2])}
            elif value == "endbfrange":
                for low, high, to in zip(held[::3], held[1::3], held[2::3]):
                    low, high = int.from_bytes(low, "big"), int.from_bytes(high, "big")
                    if isinstance(to, list):
                        single |= {low + i: x for i, x in enumerate(to)}
                    else:
                        ranges.append((low, high, to))
            held = []
        else:
            held.append(value)
    return single, ranges


def shown(content: bytes, decoders: dict) -> Iterator[tuple[float, float, float, str]]:
    """(x, y, size, text) of a page's text; y grows upwards."""
    stack, size, leading, decode = [], 0.0, 0.0, lambda code: code.decode("cp1252", "replace")
    line = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)

    def moved(x: float, y: float) -> tuple:
        a, b, c, d, e, f = line
        return a, b, c, d, a * x + c * y + e, b * x + d * y + f

    for value, _ in lexed(content):
        if not isinstance(value, Operator):
            stack.append(value)
            continue
        said = None
        if value == "BT":
            line = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
        elif value == "Tf" and len(stack) > 1:
            decode, size = decoders.get(stack[-2], decode), float(stack[-1])
        elif value == "TL" and stack:
            leading = float(stack[-1])
        elif value in ("Td", "TD") and len(stack) > 1:
            leading = -float(stack[-1]) if value == "TD" else leading
            line = moved(float(stack[-2]), float(stack[-1]))
        elif value == "Tm" and len(stack) > 5:
            line = tuple(map(float, stack[-6:]))
        elif value == "T*":
            line = moved(0, -leading)
        elif value in ("Tj", "TJ", "'", '"') and stack:
            line = moved(0, -leading) if value in ("'", '"') else line
            parts = stack[-1] if isinstance(stack[-1], list) else [stack[-1]]
            # a wide step back between two parts stands for a space
            said = "".join(decode(p) if isinstance(p, bytes) else " " if isinstance(p, (int, float)) and p < -200 else "" for p in parts)
        stack = []
        if said:
            yield line[4], line[5], abs(size * line[3]) or size, said


def page_runs(data: bytes) -> Iterator[tuple[int, int, float, float, float, str]]:
    """(page, run, x, y, size, text) of a file."""
    file = File(data)
    for number, page in enumerate(file.pages(), 1):
        for i, run in enumerate(shown(file.content(page), file.decoders(page))):
            yield number, i, *run


def runs(files: DataFrame, key: str, content: str) -> DataFrame:
    """(key, page, run, x, y, size, text, note) of every file."""

    def make(k, data):
        try:
            yield from ((k, *run, None) for run in page_runs(bytes(data or b"")))
        except (ValueError, KeyError, TypeError, zlib.error) as e:  # a broken file is a row, not a failed job
            yield k, 0, 0, 0.0, 0.0, 0.0, "", f"{type(e).__name__}: {e}"[:200]

    kind = dict(files.dtypes)[key]
    return mapped(files, [key, content], f"{key} {kind}, page int, run int, x double, y double, size double, text string, note string", make)


# Layout of written files, in points.
HEAD, BODY, LEFT, TOP, LEADING, LINES = 18, 11, 60, 780, 14, 48
_CMAP = b"/CIDInit /ProcSet findresource begin begincmap 1 begincodespacerange <0000> <FFFF> endcodespacerange 1 beginbfrange <0000> <FFFF> <0000> endbfrange endcmap end"


def written(text: str) -> bytes:
    """A file with the lines of ``text``: the first larger, blank lines as gaps."""
    shown = [(i, line) for i, line in enumerate(text.split("\n"))]
    pages = [shown[at : at + LINES] for at in range(0, len(shown), LINES)]
    objects = [b"<</Type/Catalog/Pages 2 0 R>>", b"", b"<</Type/Font/Subtype/Type0/BaseFont/Text/Encoding/Identity-H/ToUnicode 4 0 R>>", _stream(_CMAP)]
    kids = []
    for page in pages:
        lines = [f"BT /F {HEAD if i == 0 else BODY} Tf 1 0 0 1 {LEFT} {TOP - LEADING * k} Tm <{line.encode('utf-16-be', 'surrogatepass').hex()}> Tj ET" for k, (i, line) in enumerate(page) if line.strip()]
        kids.append(len(objects) + 1)
        objects.append(b"<</Type/Page/Parent 2 0 R/Resources<</Font<</F 3 0 R>>>>/Contents %d 0 R>>" % (len(objects) + 2))
        objects.append(_stream("\n".join(lines).encode()))
    objects[1] = b"<</Type/Pages/Count %d/Kids[%s]>>" % (len(kids), b" ".join(b"%d 0 R" % k for k in kids))
    out, places = b"%PDF-1.5\n", []
    for n, body in enumerate(objects, 1):
        places.append(len(out))
        out += b"%d 0 obj\n%s\nendobj\n" % (n, body)
    table = b"".join(b"%010d 00000 n \n" % p for p in places)
    return out + b"xref\n0 %d\n0000000000 65535 f \n%strailer<</Size %d/Root 1 0 R>>\nstartxref\n%d\n%%%%EOF" % (len(objects) + 1, table, len(objects) + 1, len(out))


def _stream(data: bytes) -> bytes:
    packed = zlib.compress(data)
    return b"<</Length %d/Filter/FlateDecode>>\nstream\n%s\nendstream" % (len(packed), packed)


def write_files(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, content): a file of every text."""
    return mapped(rows, [key, text], f"{key} {dict(rows.dtypes)[key]}, content binary", lambda k, body: [(k, written(body or ""))])
