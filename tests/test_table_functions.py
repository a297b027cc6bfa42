"""Table functions of SQL against the DataFrame operators."""

import pytest
from pyspark.sql import functions as F

from lectern import plans
from lectern.functions import tables
from lectern.operators import chunking
from lectern.sources import readers

FOLDER = "/root/testdata/sf0.01"


def rows(df):
    return sorted(map(str, (tuple(r) for r in df.collect())))


@pytest.mark.parametrize("function, frame", [("px_chunk_text_function", "m8_chunk_text"), ("px_chunk_units_function", "m5_chunk_units")])
def test_functions_equal_operators(spark, function, frame):
    a, b = plans.QUERIES[function](spark, FOLDER), plans.QUERIES[frame](spark, FOLDER)
    assert a.schema.simpleString() == b.schema.simpleString() and rows(a) == rows(b)


def test_sizes_follow_arguments(spark):
    tables.register(spark)
    docs = spark.createDataFrame([("a", "one two three four five six " * 30), ("b", None), ("c", "")], "k string, body string")
    found = spark.sql("SELECT * FROM chunk_text(TABLE(SELECT k, body FROM {docs}), 200, 40)", docs=docs)
    assert found.schema.simpleString() == "struct<k:string,ordinal:bigint,line:bigint,char_start:bigint,char_end:bigint,text:string>"
    assert rows(found) == rows(chunking.chunk_texts(docs, "k", "body", 200, 40))
    for call in ("TABLE(SELECT k FROM {docs})", "TABLE(SELECT k, body, 1 AS n FROM {docs})", "TABLE(SELECT k, body FROM {docs}), 0", "TABLE(SELECT body, length(k) AS n FROM {docs})", "5"):
        with pytest.raises(Exception, match="chunk_text"):
            spark.sql(f"SELECT * FROM chunk_text({call})", docs=docs).collect()


def test_units_join_as_the_operator_does(spark):
    long, short = "long text here " * 20, "short"
    cases = {1: [long, short, short, long, short], 2: [short, "bit longer", short], 3: [short], 4: [short, long], 5: ["", None, ""], 6: [long, short]}
    units = [(k, i, "page" if k == 6 else "section", f"t{i}" if i % 2 else None, text) for k, texts in cases.items() for i, text in enumerate(texts)]
    df = spark.createDataFrame(units, "k bigint, o bigint, kind string, title string, text string").repartition(3)
    expected = {}
    for r in chunking.merged_units(df, "k", "o", "kind", "title", "text").orderBy("k", "o").collect():
        expected.setdefault(r["k"], []).append((r["title"], r["text"]))
    assert {k: chunking.joined_units([(u[2], u[3] or "", u[4] or "") for u in units if u[0] == k]) for k in cases} == expected
    tables.register(spark)
    found = spark.sql("SELECT * FROM chunk_units(TABLE(SELECT * FROM {df}) PARTITION BY k ORDER BY o)", df=df)
    assert rows(found) == rows(chunking.chunk_units(df, "k", "o", "kind", "title", "text"))
    assert spark.sql("SELECT * FROM chunk_units(TABLE(SELECT * FROM {df}) PARTITION BY k ORDER BY o)", df=df.limit(0)).collect() == []


def test_cues_and_files(spark):
    tables.register(spark)
    srt = "1\n00:00:01,000 --> 00:00:02,500\nHello\n\n2\n00:00:03,000 --> 00:00:04,000\nyou\n"
    cues = spark.sql("SELECT * FROM cues(TABLE(SELECT * FROM {t}))", t=spark.createDataFrame([(1, srt), (2, None)], "k int, text string"))
    assert [tuple(r) for r in cues.orderBy("start").collect()] == [(1, 1.0, 2.5, "Hello"), (1, 3.0, 4.0, "you")]
    files = spark.createDataFrame([("a.md", "md", b"# A\n\ntext\n\n# B\n\nmore"), ("b.csv", "csv", b"x,y\n1,2"), ("c.docx", "docx", b"broken")], "path string, kind string, content binary")
    assert rows(spark.sql("SELECT * FROM read_units(TABLE(SELECT * FROM {t}))", t=files)) == rows(readers.units(files).withColumn("line", F.col("line")))
