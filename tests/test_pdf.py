"""PDF files written and read, other files read, and layouts."""

import re
import zlib
from collections import defaultdict

import pytest

from lectern import plans
from lectern.operators import layout
from lectern.sources import pdf


def other_file(content, font=b"<</Type/Font/Subtype/Type1/BaseFont/Helvetica>>", kids=b"[3 0 R]", extra=b""):
    stream = zlib.compress(content)
    return b"%PDF-1.4\r\n1 0 obj<</Type/Catalog/Pages 2 0 R>>endobj\n2 0 obj<</Type /Pages/Kids " + kids + b"/Resources<</Font<</F1 5 0 R>>>> >>endobj\n3 0 obj<</Type/Page/Contents [4 0 R]>>endobj\n4 0 obj<</Filter[/FlateDecode]/Length 6 0 R>>stream\r\n" + stream + b"\nendstream endobj\n6 0 obj " + str(len(stream)).encode() + b" endobj\n5 0 obj" + font + b"endobj\n" + extra


def test_files_of_other_writers():
    content = b"BT /F1 12 Tf 14 TL 72 700 Td (A \\(b\\) caf\\351 \\\\) Tj T* [(wor) 20 (d) -300 (two)] TJ (next) ' ET % note (x)\nq BT 2 0 0 2 10 20 Tm <48 69> Tj 5 -3 TD (y) Tj ET Q"
    found = list(pdf.page_runs(other_file(content)))
    assert [(r[2], r[3], r[4], r[5]) for r in found] == [(72, 700, 12, "A (b) caf\xe9 \\"), (72, 686, 12, "word two"), (72, 672, 12, "next"), (10, 20, 24, "Hi"), (20, 14, 24, "y")]
    cmap = b"2 beginbfchar <01> <00480069> <02> <d83dde00> endbfchar 2 beginbfrange <10> <12> <0061> <20> <21> [<0041> <0042>] endbfrange"
    extra = b"7 0 obj<</Length %d>>stream\n%s\nendstream endobj" % (len(cmap), cmap)
    mapped = other_file(b"BT /F1 9 Tf <0102101112202130> Tj ET", b"<</Subtype/Type1/ToUnicode 7 0 R>>", extra=extra)
    assert [r[5] for r in pdf.page_runs(mapped)] == ["Hi\U0001f600abcAB�"]
    assert list(pdf.page_runs(other_file(b"BT ET"))) == [] and list(pdf.page_runs(other_file(b"(x) Tj", kids=b"[2 0 R 3 0 R 9 0 R]")))[0][0] == 1
    inner = b"5 0 3 40 <</Type/Font/Subtype/Type1>>"
    inner = inner.ljust(8 + 40) + b"<</Type/Page/Contents 4 0 R>>"
    assert pdf.File(other_file(b"x").replace(b"3 0 obj<</Type/Page/Contents [4 0 R]>>endobj\n", b"") + b"8 0 obj<</Type/ObjStm/First 8/N 2/Length %d>>stream\n%s\nendstream endobj" % (len(inner), inner)).values[3]["Type"] == "Page"


@pytest.mark.parametrize("data", [None, b"", b"no pdf", b"%PDF-1.4 trailer<</Encrypt 5 0 R>>", b"%PDF-1.4\n1 0 obj<</Type/Catalog/Pages 2 0 R>>endobj 2 0 obj<</Kids[3 0 R]>>endobj 3 0 obj<</Contents 4 0 R>>endobj 4 0 obj<</Filter/FlateDecode/Length 3>>stream\nabc\nendstream endobj"])
def test_broken_files_are_a_row(spark, data):
    df = spark.createDataFrame([(1, data)], "k int, content binary")
    found = pdf.runs(df, "k", "content").collect()
    assert len(found) == 1 and found[0]["note"] and found[0]["text"] == ""


def test_written_files_are_read():
    for text in ("", "one", "Head\n\nA line (with) \\ brackets\n日本 \U0001f600 é\n   \nlast", "\n".join(map(str, range(200)))):
        lines = [(i, x) for i, x in enumerate(text.split("\n")) if x.strip()]
        found = list(pdf.page_runs(pdf.written(text)))
        assert [(r[0], r[5], r[4]) for r in found] == [(i // 48 + 1, x, 18 if i == 0 else 11) for i, x in lines]


def test_layouts(spark):
    runs = [(1, 1, 0, 10.0, 700.0, 20.0, "Title"), (1, 1, 1, 10.0, 670.0, 10.0, "first"), (1, 1, 2, 60.0, 671.0, 10.0, "line"), (1, 1, 3, 10.0, 658.0, 10.0, "second line"), (1, 1, 4, 10.0, 646.0, 10.0, "third"), (1, 1, 5, 10.0, 620.0, 10.0, "apart"), (1, 1, 6, 0.0, 610.0, 10.0, "  "), (1, 2, 0, 10.0, 700.0, 14.0, "Part"), (1, 2, 1, 10.0, 688.0, 10.0, "its text"), (2, 1, 0, 0.0, 0.0, 9.0, "alone")]
    lines = layout.lines(spark.createDataFrame(runs, "k int, page int, run int, x double, y double, size double, text string").repartition(3), "k")
    assert [r["text"] for r in lines.orderBy("k", "page", "line").collect()] == ["Title", "first line", "second line", "third", "apart", "Part", "its text", "alone"]
    assert [r["text"] for r in layout.paragraphs(lines, "k").orderBy("k", "page", "paragraph").collect()] == ["Title", "first line\nsecond line\nthird", "apart", "Part", "its text", "alone"]
    assert [(r["level"], r["title"]) for r in layout.outline(lines, "k").orderBy("page").collect()] == [(1, "Title"), (2, "Part")]


def test_paragraphs_and_outline_of_the_documents(spark):
    folder = "/root/testdata/sf0.001"
    expected, heads = defaultdict(list), {}
    for r in spark.read.parquet(f"{folder}/documents.parquet").collect():
        lines = r["text"].split("\n")
        for at in range(0, len(lines), 48):
            page = [(at + k, x) for k, x in enumerate(lines[at : at + 48]) if x.strip()]
            for (i, x), before in zip(page, [None, *page]):
                if before is None or i - before[0] > 1 or before[0] == 0:
                    expected[r["doc_id"]].append(x)
                else:
                    expected[r["doc_id"]][-1] += "\n" + x
        if lines[0].strip() and len(lines[0]) <= 120 and 2 * len(lines[0]) < sum(len(x) for x in lines if x.strip()):
            heads[r["doc_id"]] = lines[0].strip()
    found = defaultdict(list)
    for r in plans.QUERIES["a28_pdf_paragraphs"](spark, folder).orderBy("doc_id", "page", "paragraph").collect():
        found[r["doc_id"]].append(r["text"])
    evenly = [i for i in expected if len(expected[i]) == len(found[i])]
    assert len(evenly) > 0.9 * len(expected) and all(found[i] == expected[i] for i in evenly)
    assert all("".join(found[i]).replace("\n", "") == re.sub("\n", "", "".join(expected[i])) for i in expected)
    titles = {r["doc_id"]: r["title"] for r in plans.QUERIES["a13_pdf_outline"](spark, folder).collect()}
    assert titles == heads


def test_fonts_are_read_once_a_file(monkeypatch):
    """F8: one map of codes for all pages, each code looked up once."""
    made = []
    monkeypatch.setattr(pdf, "_unicode_map", lambda data, f=pdf._unicode_map: made.append(1) or f(data))
    assert len(list(pdf.page_runs(pdf.written("\n".join(map(str, range(200))))))) == 200 and len(made) == 1
    codes = pdf._Codes({1: b"\0A", 2: None}, [(2, 5, b"\0x\0a")])
    assert [codes[n] for n in (1, 2, 5, 6)] == [b"\0A", b"\0x\0a", b"\0x\0d", b"\xff\xfd"] and len(codes) == 4
    file = pdf.File(pdf.written("x"))
    decode = file.decoders(next(file.pages()))["F"]
    assert [decode(b) for b in (b"\0a\xd8\x3d\xde\x00", b"\xd8\x3d\0b", b"\0ab", b"")] == ["a\U0001f600", "\ufffdb", "ab", ""]


def test_layouts_read_their_runs_once(spark):
    """F8, F16: one exchange, by file, and no second reading of the files."""
    runs = spark.createDataFrame([(1, 1, 0, 10.0, 700.0, 20.0, "Title")], "k int, page int, run int, x double, y double, size double, text string")
    for layed in (layout.paragraphs, layout.outline):
        plan = layed(layout.lines(runs, "k"), "k")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and "Join" not in plan


def test_pdf_files_are_kept_before_they_are_read(spark):
    """F16: one Python worker a task at a time."""
    plan = plans.QUERIES["a13_pdf_outline"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"MapInArrow", plan)) == 1


def test_reader_of_any_file(spark):
    from lectern.sources import readers

    df = spark.createDataFrame([("a.pdf", pdf.written("Head\n\nBody text\nmore")), ("b.pdf", b"%PDF-1.4 broken")], "path string, content binary")
    found = {r["path"]: r for r in readers.read_any(df).collect()}
    assert (found["a.pdf"]["kind"], found["a.pdf"]["n_units"], found["a.pdf"]["text"], found["a.pdf"]["needs_ocr"]) == ("pdf", 1, "Head\nBody text\nmore", False)
    assert found["b.pdf"]["text"] == ""
