"""Queries against their SQL on rows that the given tables hold few or none of."""

import datetime

import pytest
from test_queries import plain

from lectern import plans


def agrees(spark, folder, name, rows, schema, query):
    """The query's rows over one table, after they were held against the SQL's."""
    duckdb = pytest.importorskip("duckdb")
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    con = duckdb.connect()
    con.execute("SET timezone='UTC'")
    con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet/*.parquet'")
    found = con.execute(plans.ORACLES[query])
    names = [d[0] for d in found.description]
    got = sorted(str(tuple(map(plain, r))) for r in plans.QUERIES[query](spark, str(folder)).select(*names).collect())
    assert got == sorted(str(tuple(map(plain, r))) for r in found.fetchall())
    return got


EVENTS = "user_id bigint, event_id bigint, event_type string, ts timestamp_ntz, value double"


def at(seconds):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=seconds)


def test_overlaps_of_rounded_seconds_and_halves(spark, tmp_path):
    rows = [
        (1, 1, "view", at(0.6), 0.0), (1, 2, "purchase", at(60.6), 0.0),  # 1..61 and 61..121: they touch only
        (2, 3, "view", at(0), 0.5), (2, 4, "purchase", at(60), 0.0),  # a half goes down to 0
        (3, 5, "view", at(0), 1.5), (3, 6, "purchase", at(61), 0.0),  # and up to 2
        (4, 7, "view", at(0.5), 2.5), (4, 8, "purchase", at(62), 0.0),
        (5, 9, "view", at(0.7), 0.0), (5, 10, "purchase", at(60.2), 0.0),  # 1..61 and 60..120
    ]
    assert len(agrees(spark, tmp_path, "events", rows, EVENTS, "c12_interval_overlap")) == 2


def test_gaps_count_fractions_of_seconds(spark, tmp_path):
    times = [(1, 0.9), (1, 14400.1), (2, 0.1), (2, 14400.1), (3, 0.1), (3, 14400.9), (3, 28800.8), (4, 5.0), (4, None)]
    rows = [(user, k, "view", None if s is None else at(s), 0.0) for k, (user, s) in enumerate(times)]
    found = agrees(spark, tmp_path, "events", rows, EVENTS, "e9_gap_paragraphs")
    assert len(found) == 6


def test_tax_numbers_of_any_key(spark, tmp_path):
    rows = [(k,) for k in (1, 2, 3, 11_364, 11_365, 11_404, 11_405, 900_000, 899_999, 123_456_789_012, 1 << 62)]
    found = agrees(spark, tmp_path, "customer", rows, "c_custkey bigint", "j8_tax_ids")
    assert sum("True" in r for r in found) == sum(k % 3 != 2 for k, in rows)


def test_titles_keep_references_and_spaces(spark, tmp_path):
    heads = ["a &quot;b&quot; &amp;lt; &amp; c", " two  spaces\tand tabs\n", "&lt;&#39;&nbsp;x", ""]
    rows = [(i, f'<html lang="en-gb"><TITLE class=x>{h}</title>') for i, h in enumerate(heads)]
    rows += [(9, "<html lang=de><p>no title"), (10, "<HTML LANG='FR'><title>t</title>"), (11, '<html lang="pt-BR">'), (12, None)]
    agrees(spark, tmp_path, "pages", rows, "page_id bigint, html string", "m15_page_title")


def test_cover_has_a_row_for_every_document(spark, tmp_path):
    long = "words of a text, in lines.\n" * 300
    texts = [None, "", " \n\t\r ", "\xa0", "a　", "a \x0b\x0c", "\x1c", "a \n", "  a", long, long + " " * 5000, long + "\xa0" * 2000, "x" * 5000 + "\r\n", "🙂" * 1000]
    rows = list(enumerate(texts)) + [(9, "of the same id"), (9, "of the same id"), (None, "no id"), (None, None), (1 << 60 | 1, "a large id")]
    found = agrees(spark, tmp_path, "documents", rows, "doc_id bigint, text string", "m5_chunk_cover")
    assert len(found) == len(rows) and str(((1 << 60) + 1, 10)) in found
