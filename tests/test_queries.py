"""Every registered query against its DuckDB SQL on the small tables, and cases
that the tables don't hold."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from lectern import plans
from lectern.functions import identifiers, money, ranges, times, urls
from lectern.functions import text as tx
from lectern.operators import chunking, compare, extraction, joining, media, ranking
from lectern.operators import retrieval as rt
from lectern.sources import feeds, files, readers

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("SET timezone='UTC'")
    for name in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{FOLDER}/{name}'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if value != value else round(value, 6) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    if value is None or isinstance(value, (int, str, bool)):
        return value
    try:
        return round(float(value), 6)
    except (TypeError, ValueError):
        return str(value)


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, duck, name):
    df = plans.QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    rows = sorted(str(tuple(map(plain, r))) for r in df.select(*columns).collect())
    if name not in plans.ORACLES:
        assert df.schema.fields
        return
    found = duck.execute(plans.ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    order = sorted(range(len(names)), key=names.__getitem__)
    assert rows == sorted(str(tuple(plain(r[i]) for i in order)) for r in found.fetchall())


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "raw, canonical",
    [
        ("HTTP://User:pw@WWW.Example.com:80/a/b/?b=2&utm_source=x&a=1#frag", "http://www.example.com/a/b?a=1&b=2"),
        ("example.org/x/", "https://example.org/x"),
        ("//host.net", "https://host.net"),
        ("https://h.com:8443/", "https://h.com:8443"),
        ("ftp://h.com/a", ""),
        ("not a url", ""),
        (None, ""),
        ("https://medium.com/p?ref=x&q=1", "https://medium.com/p?q=1"),
        ("https://h.com/p?ref=x", "https://h.com/p?ref=x"),
        ("https://es.linkedin.com/jobs/view/data-engineer-at-x-4012345?trk=abc", "https://www.linkedin.com/jobs/view/4012345"),
        ("linkedin.com/jobs/collections/top?a=1&currentJobId=77&b", "https://www.linkedin.com/jobs/view/77"),
        ("https://www.linkedin.com/in/someone/", "https://www.linkedin.com/in/someone"),
        ("bücher.example/a", "https://bücher.example/a"),
    ],
)
def test_url_identity(spark, raw, canonical):
    assert one(spark, urls.normalize(F.lit(raw).cast("string"))) == canonical


def test_international_hosts(spark):
    rows = spark.createDataFrame([(1, "https://bücher.example:81/a?b"), (2, "https://h.com/ü"), (3, ""), (4, None)], "id int, url string")
    found = dict(map(tuple, urls.punycoded(rows, "url").collect()))
    assert found == {1: "https://xn--bcher-kva.example:81/a?b", 2: "https://h.com/ü", 3: "", 4: None}


def test_redirects(spark):
    inner = "https://t.example/c?url=https%3A%2F%2Fshop.example%2Fa"
    assert one(spark, urls.unwrap_redirect(F.lit(inner))) == "https://shop.example/a"
    assert one(spark, urls.unwrap_redirect(F.lit("https://s.example/search?q=https%3A%2F%2Fx.y"))) == "https://s.example/search?q=https%3A%2F%2Fx.y"
    assert one(spark, urls.unwrap_redirect(F.lit("https://s.example/url?q=https%3A%2F%2Fx.y"))) == "https://x.y"


@pytest.mark.parametrize("raw, value", [("1.234,56 €", 1234.56), ("1,234.56", 1234.56), ("12,5", 12.5), ("1.234", 1234.0), ("1,234", 1234.0), ("(7.50)", -7.5), ("-3", -3.0), ("1.234.567", 1234567.0), ("abc", None), ("", None), (None, None)])
def test_amounts(spark, raw, value):
    found = one(spark, money.parse_amount(F.lit(raw).cast("string")))
    assert (None if found is None else float(found)) == value


@pytest.mark.parametrize(
    "check, good, bad",
    [
        (identifiers.iban_ok, "ES91 2100 0418 4502 0005 1332", "ES91 2100 0418 4502 0005 1333"),
        (identifiers.dni_ok, "12345678Z", "12345678A"),
        (identifiers.nie_ok, "X1234567L", "X1234567A"),
        (identifiers.cif_ok, "A58818501", "A58818502"),
        (identifiers.ean_ok, "4006381333931", "4006381333932"),
        (identifiers.isbn_ok, "0-306-40615-2", "0-306-40615-3"),
        (identifiers.luhn_ok, "4111 1111 1111 1111", "4111 1111 1111 1112"),
    ],
)
def test_check_digits(spark, check, good, bad):
    assert one(spark, check(F.lit(good))) is True and one(spark, check(F.lit(bad))) is False


def test_page_ranges(spark):
    assert one(spark, ranges.parse(F.lit("3-1, 7; x, 7"))) == [1, 2, 3, 7]
    assert one(spark, ranges.describe(F.array(*map(F.lit, (1, 2, 3, 7))))) == "1-3, 7"


def test_roll_forward_clamps_step_by_step(spark):
    rolled = times.rolled_forward(F.lit("2024-01-31").cast("date"), 1, F.lit("2024-03-10").cast("date"))
    assert one(spark, rolled) == dt.date(2024, 3, 29)


def test_text_edges(spark):
    assert one(spark, tx.clamp(F.lit("a" * 80), 10)) == "a" * 9 + "…"
    assert one(spark, tx.slug(F.lit("  Ñandú & Größe!  "))) == "nandu-grosse"
    assert one(spark, tx.clean(F.lit("un­til hy-\nphen\r\n\n\n\nend​ "))) == "until hyphen\n\nend"
    assert rt.query_terms("The THE y y zeta") == ["zeta"]


def test_chunks_cover_the_text():
    text = ("One sentence here. Another, with a comma; and more words.\n" * 60 + "\n\n") * 3
    spans = list(chunking.pieces(text))
    assert spans[0][0] == 0 and spans[-1][1] == len(text.rstrip())
    assert all(b - a <= chunking.SIZE + chunking.LEAST_TAIL for a, b in spans)
    assert all(nxt[0] <= here[1] for here, nxt in zip(spans, spans[1:]))
    assert list(chunking.pieces("")) == [] and list(chunking.pieces("short")) == [(0, 5)]
    assert chunking.without_short([(0, 10), (10, 300), (300, 310)], 120) == [(0, 310)]


def test_pieces_end_at_the_best_break():
    text = "a" * 500 + ", " + "b" * 100 + ". " + "c" * 100 + "\n" + "d" * 150 + " " + "e" * 400
    assert text[slice(*chunking.pieces(text)[0])].endswith("c")  # a line's end beats what comes later and before
    text = "w " * 300 + "x" * 200 + "\n\n" + "y" * 600
    assert text[slice(*chunking.pieces(text)[0])].endswith("x")
    text = "z" * 899 + "\n\n" + "z" * 800  # the window ends inside the blank line
    assert chunking.pieces(text)[0] == (0, 899)


def test_units_are_merged(spark):
    long = "x" * 300
    units = {
        1: [("section", "A", "tiny"), ("section", "B", long), ("section", "", "end")],
        2: [("section", "A", "a"), ("section", "B", "bbb"), ("section", "C", "cc")],
        3: [("page", "A", "tiny"), ("section", "B", long)],
        4: [("section", None, None)],
    }
    rows = spark.createDataFrame([(k, i, *u) for k, us in units.items() for i, u in enumerate(us)], "k int, o int, kind string, title string, text string")
    found = sorted(map(tuple, chunking.merged_units(rows, "k", "o", "kind", "title", "text").collect()))
    assert found == [(1, 1, "B", f"A\ntiny\n\n{long}\n\nend"), (2, 1, "B", "A\na\n\nC\ncc\n\nbbb"), (3, 0, "A", "tiny"), (3, 1, "B", long), (4, 0, "", "")]


def test_reading_plan_is_optimal():
    import itertools
    import random

    rng = random.Random(4)
    for _ in range(30):
        items = [(i, rng.randint(1, 12), rng.random() < 0.3) for i in range(9)]
        best = max(
            (c for n in range(5) for c in itertools.combinations(items, n) if sum(x[1] for x in c) <= 20), key=lambda c: (sum(x[1] for x in c), sum(x[2] for x in c), -len(c))
        )
        found = [x for x in items if x[0] in ranking.best_plan(items, 20, 4)]
        score = lambda c: (sum(x[1] for x in c), sum(x[2] for x in c), -len(c))
        assert score(found) == score(best)


def test_edits_and_anchors():
    assert compare.longest_increasing([3, 1, 2, 5, 4]) in ([1, 2, 3], [1, 2, 4])
    assert compare.edits(["a", "b", "c"], ["a", "x", "c", "d"]) == [("replace", 1, 1, ["b"], ["x"]), ("insert", 3, 3, [], ["d"])]


def test_personal_data():
    text = "Mail ana@example.org, DNI 12345678Z, card 4111 1111 1111 1111, tel 612 345 678, no 12345678A."
    assert [kind for _, _, kind, _ in extraction.personal_data(text)] == ["EMAIL", "DNI", "CARD", "PHONE_ES"]
    assert extraction.masked("ana@example.org x") == "<EMAIL> x"


def test_dates_and_periods():
    found = list(extraction.dates_in("Fecha de emisión: 3 de marzo de 2024\nVencimiento: 2024-04-02, 31/02/2024\nMarch 5, 2023"))
    assert [(day.isoformat(), role) for _, _, day, role in found] == [("2024-03-03", "issue"), ("2024-04-02", "due"), ("2023-03-05", "")]
    assert list(extraction.periods_in("alegaciones en quince días hábiles")) == [(15, "day", True, "appeal")]
    assert extraction.shifted(dt.date(2024, 1, 31), 1, "month") == dt.date(2024, 2, 29)
    assert extraction.shifted(dt.date(2024, 11, 30), 2, "month") == dt.date(2025, 1, 30)


def test_interval_join_reports_a_pair_once(spark):
    a = spark.createDataFrame([(1, 0.0, 50.0), (1, 5.0, 6.0)], "k int, s double, e double")
    b = spark.createDataFrame([(1, 3.0, 40.0), (1, 60.0, 70.0)], "k int, x double, y double")
    assert joining.interval_overlaps(a, b, ["k"], "s", "e", "x", "y", 10.0).count() == 2


def test_readers_and_feeds():
    import io
    import zipfile

    assert [u[2] for u in readers.markdown(b"# A\ntext\n```\n# no\n```\n## B\nmore")] == ["A", "A › B"]
    assert [(u[2], u[3]) for u in readers.html(b"<h1>T</h1><p>one<h2>U</h2><p>two")] == [("T", "one"), ("U", "two")]
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="w"><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>H</w:t></w:r></w:p><w:p><w:r><w:t>body</w:t></w:r></w:p></w:body></w:document>')
    assert [(u[2], u[3]) for u in readers.docx(out.getvalue())] == [("H", "body")]
    assert next(readers.rtf(rb"{\rtf1 caf\'e9\par next}"))[3] == "café\nnext"
    assert list(feeds.feed_items("<feed xmlns='http://www.w3.org/2005/Atom'><entry><id>1</id><title>T</title><link href='u'/></entry></feed>")) == [("atom", "1", "T", "u", "")]
    assert list(feeds.cues("[00:01.50]one\n[00:03.00]two")) == [(1.5, 3.0, "one"), (3.0, 8.0, "two")]
    assert media.collapsed("a b a b a b a b c") == ("a b c", 1)


def test_broken_files_are_rows(spark):
    rows = spark.createDataFrame([("a.docx", "docx", b"junk"), ("b.txt", "txt", b"ok")], "path string, kind string, content binary")
    found = {r["path"]: r for r in readers.units(rows).collect()}
    assert found["a.docx"]["unit_kind"] == "error" and found["a.docx"]["note"] and found["b.txt"]["text"] == "ok"


def test_folder_scan(spark, tmp_path):
    for name, text in (("a.md", "# x"), ("sub/b.TXT", "y"), ("sub/skip/c.md", "z"), ("d.bin", "w")):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    found = {r["rel"]: r["kind"] for r in files.scan(spark, str(tmp_path), [], ["**/skip/**"]).select("rel", "kind").collect()}
    assert found == {"a.md": "md", "sub/b.TXT": "txt"}


@pytest.mark.parametrize(
    "text, issuer, category, kind",
    [
        ("FACTURA nº 12. Base imponible 10. IVA 21 %", "", "", "invoice"),
        ("Factura simplificada. Gracias por su compra. IVA incluido", "", "", "receipt"),
        ("Boletín de denuncia: multa por infracción. Notificación. Expediente 3. Matrícula", "", "", "fine"),
        ("Nómina. Devengos, deducciones, Agencia Tributaria, IRPF, Seguridad Social", "", "", "payslip"),
        ("Contrato, póliza, tomador y prima", "", "", "insurance"),
        ("Nothing to see", "", "utility", "other"),
        ("consumo", "", "utility", "bill"),
        ("a letter", "Agencia Tributaria", "", "tax"),
        ("a letter", "", "insurer", "insurance"),
        (None, None, None, "other"),
    ],
)
def test_kinds(spark, text, issuer, category, kind):
    rows = spark.createDataFrame([(1, text, issuer, category)], "k int, text string, issuer string, category string")
    assert extraction.classified(rows, "k", "text", "issuer", "category").first()["kind"] == kind
