"""Queries against their SQL on larger tables, and against brute force where there
is no SQL."""

import hashlib
import os
import re

import pytest
from test_queries import plain

from lectern import plans
from lectern.plans import sources
from lectern.tables import Tables

LARGER = "/root/testdata/sf0.01"

#: By query: a folder with more rows than the smallest one.
WHOLE = {
    **dict.fromkeys(
        (
            "a24_calendar_round_trip", "d18_character_error_rate", "d21_largest_remainder", "d6_digest_by_site", "e5_series_order", "h20_page_ranges",
            "h29_tracking_number", "i4_find_dates", "i10_add_working_days", "i11_next_working_day", "i12_working_days_between", "i13_delivery_day",
            "i15_admin_deadline", "i22_count_working_days", "n2_kinds", "n3_dated_facts", "n4_assigned_roles", "n6_first_of_roles", "n7_periods",
            "n8_chosen_amount", "n9_references", "n10_issuers", "n11_deadlines", "n12_hint_check", "o9_rolled_forward", "c13_containment", "l23_paragraph_pages",
            "i9_calendar", "l4_query_terms", "r10_freshness_codes",
        ),
        LARGER,
    ),
    "r4_waveform_peaks": "/root/testdata/sf0.1",
}


def tables(folder):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("SET timezone='UTC'")
    for name in os.listdir(folder):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{folder}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(WHOLE))
def test_whole_table(spark, name):
    folder = WHOLE[name]
    found = tables(folder).execute(plans.ORACLES[name])
    names = [d[0] for d in found.description]
    expected = sorted(str(tuple(map(plain, r))) for r in found.fetchall())
    assert expected == sorted(str(tuple(map(plain, r))) for r in plans.QUERIES[name](spark, folder).select(*names).collect())


def test_every_order_is_a_document(spark):
    found = plans.QUERIES["n1_extract_documents"](spark, LARGER).select("o_orderkey").collect()
    expected = tables(LARGER).execute("SELECT o_orderkey FROM orders ORDER BY 1").fetchall()
    assert sorted(r["o_orderkey"] for r in found) == [r[0] for r in expected]


def test_every_customer_name_is_compared(spark):
    found = {r["c_custkey"]: r["score"] for r in plans.QUERIES["g11_name_similarity"](spark, LARGER).collect()}
    expected = {}
    for key, name in tables(LARGER).execute("SELECT c_custkey, c_name FROM customer").fetchall():
        a = set(re.findall("[a-z0-9]+", name.lower()))
        b = {"c", *re.findall("[a-z0-9]+", re.sub("^.*#0*", "", name))}
        initials = sum(len(w) == 1 and any(v.startswith(w) for v in b - a) for w in a - b)
        expected[key] = round(min(1.0, (len(a & b) + 0.5 * initials) / len(a | b)), 4)
    assert found == expected


def one_line(text):
    return re.sub(r"\s+", " ", text).strip(" ")


def test_captions_hold_the_whole_text(spark):
    turns = tables(LARGER).execute("SELECT conv_id, turn, role, text FROM conversations ORDER BY ALL").fetchall()
    expected = {}
    for conv, turn, role, text in turns:
        kept, line = expected.setdefault(conv, []), f"{role} {one_line(text)}".strip()
        if any(line == old for _, old in kept[-3:]):
            continue
        if kept and line.startswith(kept[-1][1]):
            kept[-1] = (kept[-1][0], line)
        else:
            kept.append((turn, line))
    found = plans.QUERIES["e8_rolling_caption_dedupe"](spark, LARGER).select("conv_id", "turn", "text").collect()
    assert sorted(map(tuple, found)) == sorted((k, *row) for k, rows in expected.items() for row in rows)


def test_paragraphs_and_subtitles_hold_the_whole_text(spark):
    turns = tables(LARGER).execute("SELECT conv_id, turn, text FROM conversations ORDER BY ALL").fetchall()
    expected, spoken = {}, {}
    for conv, turn, text in turns:
        s, line = turn * 7.0 + (turn if conv % 3 == 0 else 0), one_line(text)
        e, done = s + 5 + len(text) % 3, expected.setdefault(conv, [])
        spoken[conv, turn] = line
        a, b, said = done[-1] if done else (0.0, 0.0, "")
        if not done or s - b >= 2 or (b - a >= 30 and said[-1:] in tuple(".!?…")) or e - a > 60:
            done.append((s, e, line))
        else:
            done[-1] = (a, e, f"{said} {line}")
    found = plans.QUERIES["e9_timed_paragraphs"](spark, LARGER).select("conv_id", "paragraph", "start", "end", "text").collect()
    assert sorted(map(tuple, found)) == sorted((k, i, *p) for k, rows in expected.items() for i, p in enumerate(rows))
    cues = sources._cues(Tables(spark, LARGER)).select("conv_id", "turn", "text").collect()
    assert {(r["conv_id"], r["turn"]): r["text"] for r in cues} == spoken


def test_every_text_is_decoded(spark, tmp_path):
    texts = ["plain", "caf\u00e9", "5 \u20ac, \u65e5\u672c \U0001f600", "tab\tand\r\nline", "\u0093c1", ""]
    rows = [(i, turn, "user", text) for i, text in enumerate(texts) for turn in range(3)]
    spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    found = plans.QUERIES["a5_decoded"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, found)) == [(i, turn, hashlib.md5(text.encode()).hexdigest()) for i, turn, _, text in rows]


def test_half_cents_are_shown(spark, tmp_path):
    prices = [1.005, 2.675, 0.125, 0.375, 1234.565, 1234567.895, 3.0]
    spark.createDataFrame(list(enumerate(prices)), "o_orderkey bigint, o_totalprice double").write.parquet(str(tmp_path / "orders.parquet"))
    found = plans.QUERIES["j4_formatted_money"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, found)) == [(i, f"{p:,.2f}".translate(str.maketrans(",.", ".,")) + " \u20ac") for i, p in enumerate(prices)]


def test_turns_with_markdown_are_read(spark, tmp_path):
    texts = {"See [a](http://x.y) and **b**, `c`\n- item\n\n\n\nend": "See a and b, c\nitem\n\nend", "plain": "plain"}
    rows = [(i, 0, "user", text) for i, text in enumerate(texts)]
    spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    found = plans.QUERIES["m12_markdown_to_text"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, found)) == [(i, 0, plain) for i, plain in enumerate(texts.values())]
