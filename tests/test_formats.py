"""Readers, writers, ages and evidence on cases that the tables don't hold."""

import re
import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from lectern.functions import times
from lectern.operators import chunking, extraction
from lectern.sources import files, readers, writers

ODD = "a{b}\\c é €\tx\n\n😀 \\par <&> \"q\"\x01\nlast"


@pytest.mark.parametrize("kind", ["docx", "pptx", "xlsx", "odt", "epub", "rtf", "eml", "txt", "html"])
@pytest.mark.parametrize("text", ["", "\n", ODD, "word " * 50_000])
def test_round_trip(kind, text):
    found = list(readers.READERS[kind](writers.WRITERS[kind]("Title", text)))
    got = " ".join(" ".join(u[3] for u in found).split())
    words = text.replace("\x01", " " if kind in ("docx", "pptx", "xlsx", "odt", "epub") else "\x01").split()
    if kind in ("epub", "xlsx", "pptx", "eml"):  # numbers, titles and heads stand between
        at = iter(got.split())
        assert all(w in at for w in words)
    else:
        assert got.split() == words


def test_rtf_marks():
    data = rb"{\rtf1{\fonttbl{\f0 Arial;}}\pard caf\'e9 #8364? #-10179?#-8704?\par two\tab x\{y\}\\z\b bold\b0 }".replace(b"#", b"\\" + b"u")
    assert [u[3] for u in readers.rtf(data)] == ["café € 😀\ntwo\tx{y}\\zbold"]


def test_any_file(spark):
    rows = [("a/empty.txt", b""), ("none", None), ("x.docx", b"PK\x03\x04broken"), ("p.png", b"\x89PNG\r\n\x1a\n"), ("old.doc", b"\xd0\xcf\x11\xe0"), (None, b"words"), ("a/Name.txt", b"<!doctype html><p>shown</p><script>not</script>"), ("b.xyz", b"\xff\xfeh\0i\0")]
    found = {r["path"]: r for r in readers.read_any(spark.createDataFrame(rows, "path string, content binary")).collect()}
    assert len(found) == len(rows)
    assert [found[p]["n_units"] for p, _ in rows] == [0, 0, 0, 0, 0, 1, 1, 1]
    assert found["a/Name.txt"]["kind"] == "html" and found["a/Name.txt"]["text"] == "shown" and found["a/Name.txt"]["title"] == "Name"
    assert found["p.png"]["needs_ocr"] and not found["old.doc"]["needs_ocr"]
    assert "could not be read" in found["x.docx"]["note"] and "empty" in found["a/empty.txt"]["note"]
    assert found[None]["text"] == "words"


def test_absorbed_covers_every_line(spark):
    rng = random.Random(5)
    rows = [(i, "\n".join("x" * rng.choice([0, 1, 5, 30, 80]) for _ in range(rng.randrange(12)))) for i in range(200)] + [(200, None), (201, "short")]
    got = {}
    for r in chunking.absorbed(spark.createDataFrame(rows, "id int, text string"), "id", "text", 20).collect():
        got.setdefault(r["id"], []).append((r["number"], r["start"], r["stop"]))
    for i, text in rows:
        spans = sorted(got.get(i, []))
        assert "".join(text[a:b] for _, a, b in spans).replace("\n", "") == (text or "").replace("\n", "") if text else not spans
        assert [n for n, _, _ in spans] == list(range(1, len(spans) + 1))
        assert len(spans) < 2 or all(b - a >= 20 for _, a, b in spans)


def test_since(spark):
    now = dt.datetime(2026, 10, 15, 12, 30)
    day = dt.datetime(2026, 10, 15)
    expected = {
        "1791000000": dt.datetime(1970, 1, 1) + dt.timedelta(seconds=1791000000), "2026-09-25": dt.datetime(2026, 9, 25), "2026-09-25T10:30Z": dt.datetime(2026, 9, 25, 10, 30), "2026-09-25 10:30+02:00": dt.datetime(2026, 9, 25, 8, 30),
        "2026-09-25T10:30-0130": dt.datetime(2026, 9, 25, 12, 0), "30m": now - dt.timedelta(minutes=30), "hace 2 horas": now - dt.timedelta(hours=2), "2 hours ago": now - dt.timedelta(hours=2),
        "1.5w": now - dt.timedelta(days=10.5), "1mo": now - dt.timedelta(days=30), "2 años": now - dt.timedelta(days=730), "hoy": day, "AYER": day - dt.timedelta(days=1), "esta mañana": day.replace(hour=6),
        "this week": dt.datetime(2026, 10, 12), "este mes": dt.datetime(2026, 10, 1), "la semana pasada": now - dt.timedelta(days=7), "last month": now - dt.timedelta(days=30), "última hora": now - dt.timedelta(hours=1),
        "last 3 days": now - dt.timedelta(days=3), "": None, "3 parsecs": None, "2026-13-45": None, "soon": None,
    }
    rows = spark.createDataFrame([(k, now) for k in expected] + [(None, now)], "phrase string, now timestamp_ntz")
    found = {r["phrase"]: r["since"] for r in rows.select("phrase", times.since(F.col("phrase"), F.col("now")).alias("since")).collect()}
    assert found == {**expected, None: None}


def test_evidence(spark):
    text = "İİİ cover\n\f" + "x" * 200 + " due 03/04/2025\nPaid on 2025-05-06  \f\n 7 June 2025"
    rows = spark.createDataFrame([(1, text), (2, None), (3, "")], "id int, text string")
    found = sorted(extraction.dates_with_evidence(rows, "id", "text").collect(), key=lambda r: r["start"])
    assert [(r["day"].isoformat(), r["page"], r["evidence"]) for r in found] == [("2025-04-03", 2, "x" * 170 + "…"), ("2025-05-06", 2, "Paid on 2025-05-06"), ("2025-06-07", 3, "7 June 2025")]


def test_stored_once(spark):
    rows = spark.createDataFrame([(b"a",), (b"a",), (b"",), (None,)], "content binary")
    assert sorted((r["bytes"], r["refs"]) for r in files.stored(rows, "content", "bin").collect()) == [(0, 1), (1, 2)]


def test_kind_points_are_plain_counts():
    import random

    rng = random.Random(2)
    words = ["factura", "factura simplificada", "n.º de factura", "iva", "poliza", "tomador", "garantia", "warranty", "multa", "dni", "saldo", "plan anual", "modelo 303", "owner's manual", "ley 39/2015", "xx", "recibo de salarios", "vat", "\n", "privado", "contrato"]
    rules = extraction.KindRules()
    for _ in range(200):
        text = " ".join(rng.choice(words) for _ in range(rng.randrange(30)))
        expected = [sum(w * min(cap, len(re.findall(p, text))) for p, w, cap in kind) for kind in extraction.KIND_RULES.values()]
        assert rules.points(text) == expected
    for kind in extraction.KIND_RULES.values():
        for pattern, _, _ in kind:
            literals = extraction._needed(pattern)
            assert literals is None or all(len(x) > 1 for x in literals), pattern
