"""Queries that have no SQL, over whole tables, against plain Python that shares no
code with them."""

import itertools
import re
from bisect import bisect_left
from collections import Counter, defaultdict

import numpy as np
import pytest

from lectern import plans
from lectern.tables import Tables

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def table(spark):
    held = {}

    def read(name):
        if name not in held:
            held[name] = [r.asDict() for r in getattr(Tables(spark, FOLDER), name).collect()]
        return held[name]

    return read


def rows(spark, query, *order):
    found = [r.asDict() for r in plans.QUERIES[query](spark, FOLDER).collect()]
    return sorted(found, key=lambda r: tuple(r[c] for c in order))


def luhn(number):
    digits = [int(c) for c in number][::-1]
    return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(digits)) % 10 == 0


def test_card_numbers(spark, table):
    expected = {}
    for d in table("documents"):
        found = [re.sub("[ -]", "", x) for x in re.findall(r"(?:[0-9][ -]?){12,18}[0-9]", d["text"] or "")]
        if n := sum(12 <= len(x) <= 19 and luhn(x) for x in found):
            expected[d["doc_id"]] = n
    assert {r["doc_id"]: r["cards"] for r in rows(spark, "h28_card_numbers")} == expected and expected


def test_found_eans(spark, table):
    good = lambda s: len(s) in (8, 12, 13, 14) and sum(int(c) * (1 if i % 2 == 0 else 3) for i, c in enumerate(s[::-1])) % 10 == 0
    expected = {d["doc_id"]: n for d in table("documents") if (n := len({x for x in re.findall("[0-9]+", d["text"] or "") if good(x)}))}
    assert {r["doc_id"]: r["eans"] for r in rows(spark, "j9_found_eans")} == expected


def cues(table):
    by = defaultdict(list)
    for c in sorted(table("conversations"), key=lambda c: (c["conv_id"], c["turn"])):
        start = c["turn"] * 7.0 + (c["turn"] if c["conv_id"] % 3 == 0 else 0.0)
        by[c["conv_id"]].append((start, start + 5 + len(c["text"]) % 3, " ".join(c["text"].split())))
    return by


def test_chapters(spark, table):
    expected = []
    for conv, said in cues(table).items():
        starts, wanted = [0], said[0][0] + 20
        while wanted < said[-1][1] - 10:
            near = [i for i in range(starts[-1] + 1, len(said)) if abs(said[i][0] - wanted) <= 10]
            worth = {i: min(said[i][0] - said[i - 1][1], 3.0) + (said[i - 1][2][-1:] in (".", "!", "?", "…") and 1.0) - abs(said[i][0] - wanted) / 20 for i in near}
            if worth:
                starts.append(max(worth, key=lambda i: (worth[i], -i)))
            wanted = (said[starts[-1]][0] if worth else wanted) + 20
        ends = [said[i][0] for i in starts[1:]] + [said[-1][1]]
        expected += [(conv, k, said[i][0], e) for k, (i, e) in enumerate(zip(starts, ends))]
    assert [tuple(r[c] for c in ("conv_id", "chapter", "start", "end")) for r in rows(spark, "e10_chapters", "conv_id", "chapter")] == sorted(expected)


def test_drift_segments(spark, table):
    by = defaultdict(list)
    for e in sorted(table("embeddings"), key=lambda e: e["vec_id"]):
        by[e["vec_id"] % 10].append((e["vec_id"], np.array(e["embedding"], dtype=np.float64)))
    expected = {}
    for frames in by.values():
        n, anchor = -1, None
        for i, v in frames:
            if anchor is None or float(v @ anchor) < 0.9 * float(np.sqrt((v @ v) * (anchor @ anchor))):
                n, anchor = n + 1, v
            expected[i] = n
    assert {r["vec_id"]: r["segment"] for r in rows(spark, "e12_drift_segments")} == expected


def test_reading_plans_are_the_fullest(spark, table):
    good = {r["doc_id"]: r["toxic"] == 0 for r in table("labels") if r["quality"] == 1}
    by = defaultdict(dict)
    for d in table("documents"):
        if d["doc_id"] in good and 0 < (minutes := -(-d["n_chars"] // 1200)) <= 30:
            by[d["source"]][d["doc_id"]] = minutes
    found = defaultdict(list)
    for r in rows(spark, "f5_reading_plan", "source", "place"):
        assert by[r["source"]][r["doc_id"]] == r["minutes"]
        found[r["source"]].append(r["doc_id"])
    for source, items in by.items():
        sums = {(0, 0)}
        for m in items.values():
            sums |= {(n + 1, s + m) for n, s in sums if n < 6 and s + m <= 30}
        chosen = found[source]
        full = sum(items[i] for i in chosen)
        assert len(chosen) == len(set(chosen)) <= 6 and full == max(s for _, s in sums)
        if len(items) <= 16:  # all plans: more favourites, then fewer items, then lower ids
            every = (p for k in range(7) for p in itertools.combinations(sorted(items), k) if sum(items[i] for i in p) == full)
            assert tuple(sorted(chosen)) == min(every, key=lambda p: (-sum(good[i] for i in p), len(p), p))


def test_patience_anchors(spark, table):
    by = defaultdict(list)
    for c in sorted(table("conversations"), key=lambda c: (c["conv_id"], c["turn"])):
        by[c["conv_id"]].append(c["text"])
    found = defaultdict(list)
    for r in rows(spark, "f8_patience_anchors", "conv_id", "new_place"):
        found[r["conv_id"]].append((r["old_place"], r["new_place"]))
    for conv, old in by.items():
        new = old[1:] + old[:1]
        once = lambda lines: {x for x, n in Counter(lines).items() if n == 1}
        both = once(old) & once(new)
        order = [old.index(x) for x in new if x in both]
        tops = []
        for v in order:
            at = bisect_left(tops, v)
            tops[at : at + 1] = [v]
        pairs = found[conv]
        assert len(pairs) == len(tops) and all(old[i] == new[j] and old[i] in both for i, j in pairs)
        assert all(a[0] < b[0] and a[1] < b[1] for a, b in zip(pairs, pairs[1:]))


def test_pages_hold_the_text(spark, table):
    by = defaultdict(list)
    for r in rows(spark, "m4_split_pages", "doc_id", "page"):
        by[r["doc_id"]].append((r["page"], r["text"]))
    for d in table("documents"):
        pages = by.get(d["doc_id"], [])
        assert [p for p, _ in pages] == list(range(1, len(pages) + 1))
        assert "".join("".join(t.split()) for _, t in pages) == "".join((d["text"] or "").split())
        assert all(len(t) <= 4000 or "\n" not in t.strip("\n") for _, t in pages) and (len(d["text"] or "") > 4000 or len(pages) <= 1)


def chunks_cover(text, chunks, size):
    seen = 0
    for a, b, said in chunks:
        assert text[a:b].strip() == said and a <= seen + (len(text[seen:a]) - len(text[seen:a].strip())) + 1 and b - a <= size
        assert not text[seen:a].strip()
        seen = max(seen, b)
    assert not text[seen:].strip()


def test_chunks_of_texts(spark, table):
    by = defaultdict(list)
    for r in rows(spark, "m8_chunk_text", "doc_id", "ordinal"):
        assert r["ordinal"] == len(by[r["doc_id"]])
        by[r["doc_id"]].append((r["char_start"], r["char_end"], r["text"]))
        if r["char_start"] == 0:
            assert r["line"] == 1
    for d in table("documents"):
        text = d["text"] or ""
        chunks_cover(text, by.get(d["doc_id"], []), 900 + 200 + 120)


def test_chunks_of_units(spark, table):
    texts, got = defaultdict(list), defaultdict(list)
    for c in sorted(table("conversations"), key=lambda c: (c["conv_id"], c["turn"])):
        texts[c["conv_id"]].append(c["text"])
    for r in rows(spark, "m5_chunk_units", "conv_id", "ordinal"):
        got[r["conv_id"]].append(r)
    assert got.keys() == texts.keys()
    for conv, chunks in got.items():
        assert [c["ordinal"] for c in chunks] == list(range(len(chunks))) and [c["unit"] for c in chunks] == sorted(c["unit"] for c in chunks)
        words = Counter(w for t in texts[conv] for w in t.split())
        said = Counter(w for c in chunks for w in c["text"].split())
        assert all(said[w] >= n for w, n in words.items())  # nothing is lost; overlaps repeat words
        assert all(re.fullmatch(r"(user|assistant|system) \d+", c["section"]) for c in chunks)


def test_markdown_chunks(spark, table):
    texts = defaultdict(list)
    for c in sorted(table("conversations"), key=lambda c: (c["conv_id"], c["turn"])):
        texts[c["conv_id"]].append((c["role"], c["text"]))
    got = defaultdict(list)
    for r in rows(spark, "m9_chunk_markdown", "conv_id", "line"):
        got[r["conv_id"]].append((r["section"], r["text"]))
    for conv, turns in texts.items():
        assert got[conv] == [(f"Conversation › {role}", text.strip()) for role, text in turns if text.strip() and not re.search(r"^\s*(#|```|~~~)", text, re.M)] or any(re.search(r"^\s*(#|```|~~~)", t, re.M) for _, t in turns)


_CHROME = r"(?is)<(script|style|noscript|template|svg|iframe|canvas|head|object|nav|footer|aside|form)\b[^>]*>.*?</\1\s*>|<!--.*?-->"
_BLOCK = r"(?i)</?(?:address|article|blockquote|body|dd|div|dl|dt|figcaption|figure|h[1-6]|hr|html|li|main|ol|p|pre|section|table|tr|ul)\b[^>]*>"


def page_lines(html):
    import html as reader

    bare = re.sub(_CHROME, " ", html)
    bare = re.sub(r"(?is)<header\b[^>]*>.*?</header\s*>", " ", bare) if "<article" not in html else bare
    lines = [" ".join(reader.unescape(re.sub(r"(?s)<[^>]*>", "", re.sub("(?i)<br[^>]*>", "\n", x))).split()) for x in re.split(_BLOCK, bare)]
    return [x for x in lines if x]


def test_readable_and_markdown(spark, table):
    plain = {r["page_id"]: r for r in rows(spark, "m10_readable", "page_id")}
    marked = {r["page_id"]: r for r in rows(spark, "m11_to_markdown", "page_id")}
    same = 0
    for p in table("pages"):
        words = " ".join(page_lines(p["html"])).split()
        assert plain[p["page_id"]]["text"].split() == words
        same += plain[p["page_id"]]["text"].split("\n") == page_lines(p["html"])
        title = re.search(r"(?is)<title[^>]*>(.*?)</title>", p["html"])
        assert plain[p["page_id"]]["title"] == " ".join((title[1] if title else "").replace("&amp;", "&").split())
        unmarked = [re.sub(r"^(#{1,6}|-|>) ", "", x) for x in marked[p["page_id"]]["markdown"].split("\n\n")]
        assert unmarked == plain[p["page_id"]]["text"].split("\n")
        assert sum(x.startswith("#") for x in marked[p["page_id"]]["markdown"].split("\n\n")) == marked[p["page_id"]]["n_headings"]
    assert same == len(plain)


def test_page_meta_and_links(spark, table):
    meta = {r["page_id"]: r for r in rows(spark, "m15_page_meta", "page_id")}
    icons = defaultdict(list)
    for r in rows(spark, "m16_discovered_feeds", "page_id", "kind"):
        icons[r["page_id"]].append((r["kind"], r["href"]))
    for p in table("pages"):
        title = " ".join(re.search(r"(?is)<title[^>]*>(.*?)</title>", p["html"])[1].replace("&amp;", "&").split())
        description = re.search(r'<meta name="description" content="([^"]*)"', p["html"])
        r = meta[p["page_id"]]
        assert (r["title"], r["lang"], r["description"]) == (title, re.search('<html lang="([^"]*)"', p["html"])[1], description and description[1])
        site, _, path = re.match(r"(https?://[^/]+)((/[^?#]*)?)", p["url"]).groups()
        folder = re.match(r"https?://[^?#]*/", p["url"])[0] if path else site + "/"
        assert icons[p["page_id"]] == [("feed", f"{site}/feed.xml"), ("icon", f"{folder}fav.png")]


def test_masked_texts_follow_the_finds(spark, table):
    texts = {d["doc_id"]: d["text"] or "" for d in table("documents")}
    finds = defaultdict(list)
    for r in rows(spark, "m24_scan_pii", "doc_id", "start"):
        assert texts[r["doc_id"]][r["start"] : r["stop"]] == r["value"] and (not finds[r["doc_id"]] or finds[r["doc_id"]][-1][1] <= r["start"])
        finds[r["doc_id"]].append((r["start"], r["stop"], r["kind"]))
    masked = {r["doc_id"]: r["text"] for r in rows(spark, "m25_masked_pii", "doc_id")}
    for i, text in texts.items():
        parts, at = [], 0
        for a, b, kind in finds.get(i, []):
            parts += [text[at:a], f"<{kind}>"]
            at = b
        assert masked[i] == "".join(parts) + text[at:]
        emails = re.findall(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", text)
        assert sum(k == "EMAIL" for _, _, k in finds.get(i, [])) == len(emails)


def applied(old, changes, glue):
    out, at = [], 0
    for c in changes:
        i, gone = c["old_place"], c["old_text"].split(glue) if c["kind"] != "insert" else []
        assert old[i : i + len(gone)] == gone and c["kind"] in ("insert", "delete", "replace")
        out += old[at:i] + (c["new_text"].split(glue) if c["kind"] != "delete" else [])
        assert len(out) - (c["kind"] != "delete" and len(c["new_text"].split(glue))) == c["new_place"]
        at = i + len(gone)
    return out + old[at:]


def test_word_changes_make_the_new_text(spark, table):
    found = defaultdict(list)
    for r in rows(spark, "n19_word_changes", "line", "old_place", "new_place"):
        found[r["line"]].append(r)
    for c in table("conversations"):
        assert applied(c["text"].split(" "), found.get(c["conv_id"] * 1000 + c["turn"], []), " ") == c["text"].replace(" the ", " a ").split(" ")


def test_line_changes_make_the_new_version(spark):
    from lectern.plans.extraction import _versions

    found = defaultdict(list)
    for r in rows(spark, "n18_line_changes", "conv_id", "old_place", "new_place"):
        found[r["conv_id"]].append(r)
    for v in _versions(Tables(spark, FOLDER)).collect():
        old, new = list(v["old"]), list(v["new"])
        if not any("\n" in x for x in old + new):
            assert applied(old, found.get(v["conv_id"], []), "\n") == new


def test_a_page_of_changes(spark, table):
    found = defaultdict(list)
    for r in rows(spark, "r22_paged_changes", "doc_id", "k"):
        found[r["doc_id"]].append(r)
    hide = lambda t: re.sub(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "<EMAIL>", t)
    for d in table("documents"):
        page = found.get(d["doc_id"], [])
        assert [r["k"] for r in page] == list(range(10, 10 + len(page))) and len(page) <= 10
        changed = sum(a != b for a, b in zip(d["text"].split(" "), d["text"].replace(" the ", " a ").split(" ")))
        for r in page:  # beside an "a" that was there a change may take or bring a word more
            assert set(f"{r['old_text']} {r['new_text']}".split()) <= {"the", "a"} and r["old_text"] != r["new_text"]
        assert changed > 4 or not page


def test_collapsed_loops(spark, table):
    found = {r["line"]: r for r in rows(spark, "r2_collapsed_loops", "line")}
    for c in table("conversations"):
        words, r = c["text"].split(), found[c["conv_id"] * 1000 + c["turn"]]
        assert r["text"].split()[:2] == ["thank", "you"] and r["loops"] >= 1
        if r["loops"] == 1:
            assert r["text"] == " ".join(["thank", "you", *words])
        said = r["text"].split()
        assert not any(said[i : i + n] == said[i + n : i + 2 * n] == said[i + 2 * n : i + 3 * n] == said[i + 3 * n : i + 4 * n] for i in range(len(said)) for n in range(1, 5) if i + 4 * n <= len(said))


def test_documents_from_papers(spark, table):
    found = {r["o_orderkey"]: r for r in rows(spark, "n1_extract_documents", "o_orderkey")}
    assert found.keys() == {o["o_orderkey"] for o in table("orders")}
    import datetime as dt

    for o in table("orders"):
        r, n, key = found[o["o_orderkey"]], o["o_orderkey"] % 5, o["o_orderkey"]
        day = o["o_orderdate"].date() if isinstance(o["o_orderdate"], dt.datetime) else o["o_orderdate"]
        assert r["kind"] == ("invoice", "insurance", "fine", "warranty", "other")[n]
        assert r["ref"] == (f"{'FPXO'[n]}-{key}" if n < 4 and key >= 10 else None)
        assert (r["amount"] is None) == (n == 4) and (n == 4 or abs(r["amount"] - o["o_totalprice"]) < 0.006)
        assert r["issued"] == (day if n == 0 else None)
        assert r["n_deadlines"] == (1, 2, 1, 1, 0)[n] and r["review"] == (r["confidence"] < 60)
        if n in (0, 2):
            assert r["first_deadline"] == day + dt.timedelta(days=20)
