"""Phrase index, numbering and near-duplicate classes against plain Python."""

import random
import re

import pytest

from lectern import plans
from lectern.operators import graph, minhash, ordering, phrases
from pyspark.sql import functions as F


def test_numbered_and_paged(spark):
    rows = [(i * 7 % 101, i % 3) for i in range(101)]
    df = spark.createDataFrame(rows, "k bigint, v int").repartition(5)
    found = ordering.numbered(df, [F.desc("v"), F.asc("k")]).collect()
    expected = {r: i + 1 for i, r in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])))}
    assert {(r["k"], r["v"]): r["place"] for r in found} == expected
    pages = ordering.paged(df, "k", 20).collect()
    assert {(r["k"], r["page"], r["next_cursor"]) for r in pages} == {(k, k // 20, k // 20 * 20 + 19 if k // 20 < 5 else None) for k in range(101)}
    assert ordering.numbered(df.limit(0), [F.asc("k")]).collect() == []


def test_phrases(spark):
    rng = random.Random(1)
    text = lambda n: " ".join(rng.choice(["the", "cat", "Sat", "ON", "mat", "él"]) for _ in range(n))
    rows = [(i, text(rng.choice([0, 1, 5, 40])), rng.choice([None, text(6)])) for i in range(60)] + [(100, "the " * 3000, ""), (101, None, None), (102, "the-the,THE", "x")]
    df = spark.createDataFrame(rows, "id bigint, a string, b string").repartition(3)
    index = phrases.write_index(df, "id", {"a": F.col("a"), "b": F.col("b")})
    asked = ["the", "the the", "the the the", "cat sat on", "el Mat", "nowhere", "", None, " .,", "the cat the cat", "cat sat on"]
    found = phrases.search(spark, index, spark.createDataFrame(list(enumerate(asked)), "phrase_id int, phrase string"))
    tokens = lambda t: re.findall(r"\w+", (t or "").lower().replace("é", "e"))
    expected = set()
    for p, phrase in enumerate(asked):
        w = tokens(phrase)
        for i, a, b in rows:
            for field, t in (("a", tokens(a)), ("b", tokens(b))):
                starts = tuple(at for at in range(len(t) - len(w) + 1) if w and t[at : at + len(w)] == w)
                expected |= {(p, i, field, starts)} if starts else set()
    assert {(r["phrase_id"], r["key"], r["field"], tuple(r["starts"])) for r in found.collect()} == expected


def test_a_search_reads_its_terms_folders_only(spark):
    df = spark.createDataFrame([(i, f"w{i} shared") for i in range(100)], "id bigint, a string")
    index = phrases.write_index(df, "id", {"a": F.col("a")})
    found = phrases.search(spark, index, spark.createDataFrame([(1, "w7 shared")], "phrase_id int, phrase string"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    folders = re.search(r"PartitionFilters: \[(.*?)\]", plan)[1]
    assert "folder" in folders and "PushedFilters" in plan and [(r["key"], r["starts"]) for r in found.collect()] == [(7, [0])]


def test_a_search_shuffles_terms_once_for_all_phrases(spark):
    """rows of packed positions meet, not a row a phrase and text."""
    df = spark.createDataFrame([(i, "shared word " * 50) for i in range(400)], "id bigint, a string").coalesce(1)
    index = phrases.write_index(df, "id", {"a": F.col("a")})
    rows = spark.read.parquet(f"{index}/rows")
    assert {r["term"]: r["n"] for r in rows.groupBy("term").agg(F.count("*").alias("n")).collect()} == {None: 1, "shared": 1, "word": 1}
    assert rows.where("term is not null").agg(F.sum(F.length("packed"))).first()[0] < 50_000  # 40 000 positions
    asked = spark.createDataFrame([(i, "shared word") for i in range(300)], "phrase_id int, phrase string")
    found = phrases.search(spark, index, asked)
    assert found.count() == 300 * 400 and found.where(F.size("starts") != 50).count() == 0
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(batch") == 1 and plan.count("Exchange hashpartitioning") == 1


def test_numbers_of_any_size_are_packed():
    import numpy as np

    values = np.array([0, 1, 127, 128, 16383, 16384, 2097151, 2097152, 268435456, 2**31 - 1])
    coded, ends = phrases._coded(values)
    assert list(phrases._decoded(coded.tobytes())) == list(values) and list(np.diff(ends, prepend=0)) == [1, 1, 1, 2, 2, 3, 3, 4, 5, 5]


def test_components(spark):
    rng = random.Random(3)
    chain = [(i, i + 1) for i in range(50)] + [(100, i) for i in range(101, 300)] + [(400, 401), (401, 400), (500, 500)]
    rng.shuffle(chain)
    found = {r["id"]: r["component"] for r in graph.components(spark.createDataFrame(chain, "a bigint, b bigint")).collect()}
    assert found == {i: 0 for i in range(51)} | {i: 100 for i in range(100, 300)} | {400: 400, 401: 400}
    assert graph.components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


def brute_classes(rows, trigrams=True):
    said = {i: " ".join(re.findall(r"[^\W_]+", (t or "").lower())) for i, t in rows if i is not None}
    ids = sorted(said)
    words = {i: set(said[i].split()) for i in ids}
    joined = {i: said[i].replace(" ", "") for i in ids}
    grams = {i: {s[k : k + 3] for k in range(len(s) - 2)} or ({s} if s else set()) for i, s in joined.items()}
    above, links = {i: i for i in ids}, 0

    def root(i):
        while above[i] != i:
            i = above[i]
        return i

    jaccard = lambda x, y: len(x & y) / len(x | y) if x | y else 0.0
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if said[a] == said[b] or max(jaccard(words[a], words[b]), trigrams and jaccard(grams[a], grams[b])) >= 0.8:
                links += 1
                x, y = sorted((root(a), root(b)))
                above[y] = x
    return {i: root(i) for i in ids}


@pytest.mark.parametrize("block", [64, 4])
def test_near_duplicate_texts(spark, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    rng = random.Random(7)
    vocabulary = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(3, 8))) for _ in range(400)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    rows = [(i, " ".join(text(rng.choice([3, 30, 80])))) for i in range(40)]
    base, other = text(120), text(60)
    for i in range(60):  # near copies of one text, and a second family near the first one's words
        near = base[:]
        for _ in range(rng.randint(0, 6)):
            near[rng.randrange(120)] = rng.choice(vocabulary)
        rows.append((100 + i, " ".join(near)))
    rows += [(200 + i, " ".join(other[: 60 - i % 3])) for i in range(20)] + [(300, None), (301, ""), (302, " .,"), (303, "ab"), (304, "a b"), (None, "x"), (305, " ".join(base).upper())]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    found = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(docs).collect()}
    assert found == brute_classes(rows)
    assert minhash.near_duplicates(docs.limit(0)).collect() == []


def test_near_duplicates_of_the_small_table(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    found = {r["doc_id"]: r["class_id"] for r in plans.QUERIES["g8_near_duplicate_texts"](spark, folder).collect()}
    expected = brute_classes(rows)
    assert found.keys() == expected.keys()
    linked = [i for i in expected if expected[i] != i]
    assert sum(found[i] == expected[i] for i in linked) >= 0.9 * len(linked)
    found = {r["doc_id"]: r["class_id"] for r in plans.QUERIES["g8_near_duplicate_words"](spark, folder).collect()}
    expected = brute_classes(rows, trigrams=False)
    linked = [i for i in expected if expected[i] != i]
    assert found.keys() == expected.keys() and linked and sum(found[i] == expected[i] for i in linked) >= 0.9 * len(linked)


def test_texts_of_one_language_are_not_paired(spark, monkeypatch):
    """Random pairs of these texts share three of five trigrams: all were candidates."""
    rng, counted, verified = random.Random(11), [], minhash.verified
    words = ["".join(rng.choices("etaoinshr", k=rng.randint(3, 8))) for _ in range(20_000)]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(150, 250)))) for i in range(150)]
    rows += [(1000 + i, f"{x} {rng.choice(words)} {rng.choice(words)}") for i, x in rows[:20]]

    def count(pairs, *rest):
        counted.append(pairs.distinct().count())
        return verified(pairs, *rest)

    monkeypatch.setattr(minhash, "verified", count)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    assert {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(docs).collect()} == brute_classes(rows)
    assert sum(counted) < len(rows)


@pytest.mark.parametrize("bytes_of_block", [96 << 20, 1 << 14, 1 << 12])
def test_sets_of_many_blocks(spark, monkeypatch, bytes_of_block):
    import numpy as np

    from lectern.operators import setjoin

    monkeypatch.setattr(setjoin, "BLOCK_BYTES", bytes_of_block)
    rng, sets = np.random.default_rng(5), {}
    for size in (1, 2, 3, 4, 5, 8, 10, 64, 80, 100, 125, 700):  # ratios of 0.8 to the bit
        base = rng.choice(1 << 32, size, replace=False)
        for part in (1.0, 1.0, 0.9, 0.8, 0.8, 0.7):
            kept = base[: max(1, round(size * part))]
            sets[len(sets)] = np.unique(np.concatenate([kept, rng.choice(1 << 32, rng.integers(0, 1 + size // 8))]) if len(sets) % 2 else kept).astype(np.uint32)
    rows = spark.createDataFrame([(i, len(x), bytearray(x.tobytes())) for i, x in sets.items()] + [(999, 0, bytearray())], "id bigint, n int, items binary").repartition(3)
    found = [(r["a"], r["b"], r["score"]) for r in setjoin.links(rows, 0.8).collect()]
    jaccard = lambda x, y: len(np.intersect1d(x, y)) / len(np.union1d(x, y))
    linked = [(a, b) for a in sets for b in sets if a < b and jaccard(sets[a], sets[b]) >= 0.8]
    assert all(a < b and score == jaccard(sets[a], sets[b]) >= 0.8 for a, b, score in found)
    joined = lambda pairs: brute_roots(sets, pairs)
    assert linked and joined(linked) == joined([(a, b) for a, b, _ in found])
    assert setjoin.links(rows.limit(0), 0.8).collect() == []


def brute_roots(ids, pairs):
    above = {i: i for i in ids}

    def root(i):
        while above[i] != i:
            i = above[i]
        return i

    for a, b in pairs:
        x, y = sorted((root(a), root(b)))
        above[y] = x
    return {i: root(i) for i in ids}


def test_trigrams_as_numbers():
    text = "abc abd ÿab яab 語語語 \U0001f642\U0001f642x ab"
    assert len(minhash.trigram_items(text)) == len(minhash.trigrams_of(text)) == len(set(minhash.trigram_items(text).tolist()))
    assert len(minhash.trigram_items("")) == 0 and minhash.trigram_items("a b").tolist() == minhash.trigram_items("ab").tolist()


def brute_nearest(rows, k):
    import numpy as np

    ids = np.array([i for i, _ in rows])
    m = np.array([v for _, v in rows], dtype=np.float64)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    found = {}
    for at in np.flatnonzero(ids % 50 == 0):
        s = m @ m[at]
        s[at] = -9
        order = np.lexsort((ids, -s))[:k]
        found[int(ids[at])] = [(int(ids[i]), float(s[i])) for i in order]
    return found


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.1"])
def test_index_search(spark, folder):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    expected = brute_nearest(rows, 10)
    found = {}
    for r in plans.QUERIES["l8_index_search"](spark, folder).orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    hits = sum(len({i for i, _ in expected[q]} & {i for i, _ in found[q]}) for q in expected)
    recall = hits / (10 * len(expected))
    print("recall at 10", folder, recall)
    assert recall >= 0.9
    import numpy as np

    unit = {i: np.array(v, dtype=np.float64) / np.linalg.norm(np.array(v, dtype=np.float64)) for i, v in rows}
    assert all(abs(s - float(unit[q] @ unit[i])) < 1e-5 for q, row in found.items() for i, s in row)
    assert all(row == sorted(row, key=lambda x: (-x[1], x[0])) for row in found.values())


def test_index_of_odd_rows(spark):
    from lectern.operators import dense_index

    schema = "id bigint, v array<double>"
    odd = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [1.0, 2.0, 3.0]), (None, [1.0, 1.0])]
    assert dense_index.build(spark.createDataFrame(odd[:3], schema), "id", "v") is None
    assert dense_index.search(spark, None, spark.createDataFrame(odd, schema), "id", "v", 3).collect() == []
    df = spark.createDataFrame([*((10 + i, [1.0, i % 3 + 1.0]) for i in range(30)), *odd], schema)
    index = dense_index.build(df, "id", "v")
    found = dense_index.search(spark, index, df.where("id in (10, 3, 6, 5)"), "id", "v", 3).orderBy("rank").collect()
    assert [(r["query_id"], r["key"]) for r in found] == [(10, 13), (10, 16), (10, 19)] and all(abs(r["score"] - 1) < 1e-9 for r in found)


def test_what_a_search_holds_does_not_grow_with_the_rows(spark, monkeypatch):
    """queries come in smaller blocks where more rows are kept for each."""
    import numpy as np

    from lectern.operators import dense_index

    rng = np.random.default_rng(5)
    books = dense_index.Books(np.zeros((1000, 8)), [np.zeros((256, 4))] * 2)
    for rerank in (40, 1000, 100_000, 10**7):
        assert dense_index._block_of(books, rerank) * 2 * rerank <= max(dense_index.HELD_ROWS, 2 * rerank)
    assert dense_index._block_of(books, 40) * 8 * 1512 <= dense_index.SENT_BYTES
    df = spark.createDataFrame([(i, rng.normal(size=8).tolist()) for i in range(300)], "id bigint, v array<double>")
    index = dense_index.build(df, "id", "v")
    found = lambda: sorted(map(tuple, dense_index.search(spark, index, df.where("id % 50 = 0"), "id", "v", 5).collect()))
    expected = found()
    monkeypatch.setattr(dense_index, "HELD_ROWS", 0)
    assert len(expected) == 30 and found() == expected
