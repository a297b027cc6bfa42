"""Shared subtrees, prefixes and statements against plain Python."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lectern.functions import statements
from lectern.operators import prefixes, subtrees


def random_tree(rng, depth=0):
    """(html, canonical form, number of elements) of a random element."""
    tag = rng.choice(["div", "p", "ul", "b"])
    name = rng.choice(["", "x", "y"])
    inner = [random_tree(rng, depth + 1) if rng.random() < 0.5 and depth < 4 else rng.choice(["one", "two  words", " "]) for _ in range(rng.randrange(4))]
    html = f"<{tag}{f' class={name} id=k' if name else ''}>" + "<!-- c -->".join(x if isinstance(x, str) else x[0] for x in inner) + f"</{tag}>"
    said, size, texts = [], 1, []
    for x in inner:  # texts that only a comment parts are told apart by the reader
        if isinstance(x, str):
            texts = [" ".join(x.split())]
            said += [("t", texts[0])] if texts[0] else []
        else:
            said.append(x[1])
            size += x[2]
    return html, (tag, name, tuple(said)), size


def every(form):
    yield form
    for x in form[2]:
        if x[0] != "t" or len(x) == 3:
            yield from every(x)


def test_shared_parts(spark):
    rng = random.Random(5)
    pages = [(i, *random_tree(rng)) for i in range(120)]
    expected = {}
    for i, _, form, _ in pages:
        for sub, n in Counter(every(form)).items():
            expected.setdefault(sub, []).append((i, n))
    df = spark.createDataFrame([(i, html) for i, html, *_ in pages] + [(900, None), (901, ""), (902, "text only")], "page_id bigint, html string").repartition(3)
    found = subtrees.shared_parts(df, "page_id", "html", 1).collect()
    key = lambda pages, n, owner: (pages, n, owner)
    assert sorted(key(r["pages"], r["occurrences"], r["owner"]) for r in found) == sorted(key(len(v), sum(n for _, n in v), min(i for i, _ in v)) for v in expected.values())
    assert len({r["hash"] for r in found}) == len(expected)
    assert subtrees.shared_parts(df.limit(0), "page_id", "html").collect() == []


def test_deep_and_broken_pages():
    n = 50_000
    found = subtrees.page_subtrees("<div>" * n)
    assert len(found) == n and sorted(size for _, size in found) == list(range(1, n + 1))
    one = subtrees.page_subtrees("<p id=a class=b>x</p>")
    assert one == subtrees.page_subtrees("<P class='b' id='a'> x\n</P></b>") and one != subtrees.page_subtrees("<p id=a class=b>y</p>")
    assert subtrees.page_subtrees("<div><p>a<br>b</div>").total() == 3 and subtrees.page_subtrees(None).total() == 0


def test_prefixes(spark):
    rng = random.Random(2)
    terms = ["".join(rng.choices("abé", k=rng.randint(0, 6))) for _ in range(300)] + [None]
    asked = ["".join(rng.choices("abé", k=rng.randint(1, 4))) for _ in range(20)] + ["", None, "a", "a"]
    df, ask = spark.createDataFrame([(t,) for t in terms], "t string"), spark.createDataFrame([(p,) for p in asked], "p string")
    met = prefixes.beginning_with(df, "t", ask, "p")
    assert sorted(map(tuple, met.collect())) == sorted((p, t) for p in {p for p in asked if p} for t in {t for t in terms if t is not None} if t.startswith(p))
    assert "NestedLoop" not in met._jdf.queryExecution().executedPlan().toString() and "Cartesian" not in met._jdf.queryExecution().executedPlan().toString()
    assert prefixes.beginning_with(df, "t", ask.limit(0), "p").collect() == []


def test_statements():
    script = """-- one; two
    SELECT ';' AS a, "x;y", `b;``c`, 'it''s; \\'; ' /* ; /* nested; */ ; */ ; ;; -- only a comment;
    ; SELECT $$a;b$$, $tag$ ; $$ ; $tag$; /* alone */ ;select 1 -- end;"""
    found = statements.statements(script)
    assert [s.split()[-1] for s in found][1:] == ["$tag$", "end;"] and len(found) == 3 and found[0].startswith("-- one; two") and found[0].endswith("*/")
    assert "".join(text for _, text in statements.lexemes(script)) == script
    assert statements.statements(None) == statements.statements(" ; -- x\n;/* y */") == []
    assert statements.complete(script) and statements.complete("''") and statements.complete("'it''s'")
    for broken in ("'", "'a", "'a''", "select `x", "/* a /* b */", "$$ a", "$t$ a $$", "'a\\'"):
        assert not statements.complete(broken), broken


def test_ask(spark):
    events = spark.createDataFrame([(1, "it's; --"), (2, "b"), (3, None)], "id int, kind string")
    hostile = "' OR 1=1; DROP TABLE x; --"
    assert statements.ask(spark, "SELECT id FROM {t} WHERE kind = :k;", {"k": hostile}, t=events).collect() == []
    assert [r["id"] for r in statements.ask(spark, "select id from {t} where kind = :k -- ;", {"k": "it's; --"}, t=events).collect()] == [1]
    for bad in ("SELECT 1; SELECT 2", "DROP TABLE x", "", "-- only", "SELECT 'a", "/* x */ INSERT INTO a VALUES (1)"):
        with pytest.raises(ValueError):
            statements.ask(spark, bad)
    assert statements.name("a_1") == "a_1" and spark.range(1).select(F.lit(1).alias("a`b")).selectExpr(statements.quoted_name("a`b")).columns == ["a`b"]
    for bad in ("1a", "a b", "a;", "", None, "a`"):
        with pytest.raises(ValueError):
            statements.name(bad)


def test_counted_prefixes(spark):
    rows = [(["abc", "abd", "abc", "x"],), (["ab"],), ([],), (None,), (["xyz", ""],)]
    df, ask = spark.createDataFrame(rows, "w array<string>"), spark.createDataFrame([("ab",), ("abc",), ("x",), ("q",), ("",), (None,), ("ab",)], "p string")
    assert sorted(map(tuple, prefixes.counted(df, F.col("w"), ask, "p").collect())) == [("ab", 2, 4), ("abc", 1, 2), ("x", 2, 2)]
    assert prefixes.counted(df, F.col("w"), ask.limit(0), "p").collect() == []
