"""Each training-data operator against a brute-force version on small fixtures,
with nulls, empty and long texts, ties, repeated rows, empty tables and clashing
column names."""

import functools
import hashlib
import io
import itertools
import math
import random
import zipfile
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from lectern.llm.common import fresh, join_groups  # noqa: E402
from lectern.llm import decontaminate, exact_dedup, html_extract, mixing, ppm, simhash, token_counts, token_shards, toxicity, warc_zip  # noqa: E402

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, hit string, s string"


def words(rng, n):
    return " ".join(rng.choice(["the", "and", "thé,", "Foo", "bar.", "größe", "x1", "other", "longerword"]) for _ in range(n))


def corpus():
    rng = random.Random(3)
    texts = [words(rng, n) for n in (1, 2, 3, 4, 5, 13, 14, 40, 80, 300)]
    base = words(rng, 400).split()
    near = base[:]
    near[7] = "changed"
    texts += [None, "", " \t\n", " ", " ".join(base), " ".join(near), " ".join(base), "\n".join(base), "<|endoftext|> a<|startoftext|>b", "x" * 5000, words(rng, 30_000)]
    rows = [(i, t, "en", f"src{i % 3}", 0, 0.5, "h", "s") for i, t in enumerate(texts)]
    rows += [rows[4], rows[4], (None, "no id here", None, None, None, None, None, None), (90, words(rng, 50), None, None, None, None, None, None)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=lambda r: tuple((x is not None, x) for x in r))


def brute_normalised(text):
    import re

    return re.sub("[\x20\x09-\x0d]+", " ", text or "")


def test_exact_dedup(docs, none):
    groups = {}
    for r in corpus():
        groups.setdefault(brute_normalised(r[1]), []).append(r[0])
    expected = []
    for text, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        expected += [(i, keep, len(ids), i == keep, hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    columns = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert rows_of(exact_dedup.exact_duplicates(docs), *columns) == sorted(expected, key=lambda r: tuple((x is not None, x) for x in r))
    assert exact_dedup.exact_duplicates(none).count() == 0


def least_and_count(rows):
    found = {}
    for k, i, n in rows:
        old = found.get(k, (None, 0))
        found[k] = (exact_dedup._smaller(old[0], i), old[1] + n)
    return found


@pytest.mark.parametrize("budget", [1 << 30, 60_000, 12_000])
def test_patricia_trie_spills_by_subtree(tmp_path, budget):
    rng = random.Random(1)
    shared = bytes(rng.choices(b"xyz", k=20_000 if budget > 20_000 else 2_000))
    keys = [bytes(rng.choices(b"ab", k=rng.randint(0, 12))) for _ in range(3000)] + [b"aaaa" * 50 + bytes([i % 7]) for i in range(50)]
    keys += [shared + bytes(rng.choices(b"ab", k=rng.randint(0, 6))) for _ in range(300)] + [b"q" * i for i in range(150)]
    for order in range(2):  # as they come, and shuffled: a spilled subtree may itself be spilled
        rows = [(k, i if i % 5 else None, 1) for i, k in enumerate(keys)]
        found = list(exact_dedup.owners(iter(rows), tmp_path.as_uri(), budget))
        assert {k: (i, n) for k, i, n in found} == least_and_count(rows) and len(found) == len(set(keys))
        rng.shuffle(keys)
    assert budget > 1 << 20 or list(tmp_path.iterdir()) == []


def test_exact_dedup_of_long_shared_beginnings(spark):
    shared = "lorem ipsum dolor " * 1200
    rows = [(i, shared + str(i % 40)) for i in range(200)] + [(1000 + i, "hot") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    found = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in exact_dedup.exact_duplicates(docs, budget=30_000).collect()}
    assert found == {i: (i % 40, 5) for i in range(200)} | {1000 + i: (1000, 300) for i in range(300)}


@pytest.mark.parametrize("most", [1, 3, 100])
def test_large_groups_are_joined_apart(spark, most):
    rows = spark.createDataFrame([(i, i % 7 if i % 3 else 0) for i in range(200)] + [(500, 99)], "id bigint, k bigint")
    groups = rows.where("k < 50").groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("least"))
    found = join_groups(rows, groups, "k", "n", "id", most)
    expected = {(r["id"], r["k"]): min(i for i in range(200) if (i % 7 if i % 3 else 0) == r["k"]) if r["k"] < 50 else None for r in rows.collect()}
    assert {(r["id"], r["k"]): r["least"] for r in found.collect()} == expected and found.count() == 201


def brute_fingerprint(text):
    parts = (text or "").encode().lower().split()
    grams = [b" ".join(parts[i : i + 4]) for i in range(max(1, len(parts) - 3))] if parts else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(docs, none):
    rows = corpus()
    prints = [brute_fingerprint(r[1]) for r in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        if (prints[a] ^ prints[b]).bit_count() <= 4:
            parent[find(a)] = find(b)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    expected = [(r[0], f"{p:016x}", least.get(find(i))) for i, (r, p) in enumerate(zip(rows, prints))]
    found = rows_of(simhash.near_duplicates(docs), "doc_id", "fingerprint", "component_id")
    assert found == sorted(expected, key=lambda r: tuple((x is not None, x) for x in r))
    assert simhash.near_duplicates(none).count() == 0
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = [r[0] for r in kept.select("doc_id").collect()]
    assert sorted(i for i in ids if i is not None) == sorted(set(least.values())) and ids.count(None) == 1


def random_links(rng, n, spread):
    """Clusters of fingerprints a few bits apart, and noise."""
    points = set()
    while len(points) < n:
        centre = rng.getrandbits(64)
        for _ in range(rng.randint(1, spread)):
            point = centre
            for _ in range(rng.randint(0, 6)):
                point ^= 1 << rng.randrange(64)
            points.add(point)
    return sorted(points)


def brute_components(points, radius=4):
    p = np.array(points, np.uint64)
    parent = list(range(len(points)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(len(points)):
        for j in np.flatnonzero(np.bitwise_count(p ^ p[i]) <= radius):
            parent[find(i)] = find(int(j))
    groups = {}
    for i in range(len(points)):
        groups.setdefault(find(i), set()).add(points[i])
    return {frozenset(g) for g in groups.values() if len(g) > 1}


def linked(points, spanning):
    groups = {}
    for a, b in zip(*map(np.ndarray.tolist, spanning)):
        groups.setdefault(b, {points[b]}).add(points[a])
    return {frozenset(g) for g in groups.values()}


@pytest.mark.parametrize("spread", [3, 400, 3000])
def test_vantage_point_tree_links_all_pairs(spread):
    points = random_links(random.Random(spread), 3000, spread)
    assert linked(points, simhash.spanning_links(np.array(points, np.uint64))) == brute_components(points)


def test_vantage_point_tree_takes_branches_whole():
    """A ball of radius 2 is one component, and so is what touches it."""
    ball = [0] + [1 << i for i in range(64)] + [1 << i | 1 << j for i in range(64) for j in range(i)]
    points = [*ball, *(p ^ 0xFFFF << 40 for p in ball[:500])]
    assert linked(points, simhash.spanning_links(np.array(points, np.uint64))) == brute_components(points)


def near_groups(prints, **how):
    groups = {}
    for a, root in simhash.components(simhash.near_links(prints, **how)).collect():
        groups.setdefault(root, {root % (1 << 64)}).add(a % (1 << 64))
    return {frozenset(g) for g in groups.values()}


@pytest.mark.parametrize("how", [{}, {"tree_rows": 100}, {"tree_rows": 4}, {"shard_rows": 40}, {"tree_rows": 200, "shard_rows": 25}])
def test_shards_rings_and_blocks_lose_no_link(spark, how):
    points = random_links(random.Random(9), 500, 60)
    crowd = [0xF0F0 ^ 1 << i ^ 1 << j for i in range(20) for j in range(i)]  # rings can't part it
    points = sorted({*points, *crowd})
    prints = spark.createDataFrame([(simhash._signed(p),) for p in points], "fp bigint")
    assert near_groups(prints, **how) == brute_components(points)


@pytest.mark.parametrize("rows, radius", [(20_000, 4), (10**7, 4), (10**10, 4), (10**6, 7)])
def test_projections_meet_every_linked_pair(rows, radius):
    rng = random.Random(rows)
    masks = simhash.projections(rows, radius)
    assert max(m.bit_count() for m in masks) >= math.log2(rows / simhash.TREE_ROWS)
    for _ in range(300):
        change = sum(1 << b for b in rng.sample(range(64), radius))
        assert any(not change & m for m in masks)


def test_trees_do_the_linking_on_a_real_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    prints = simhash.fingerprints(docs).select("fp").distinct().cache()
    points = sorted(r["fp"] % (1 << 64) for r in prints.collect())
    built = simhash.VantagePointTree(np.array(points, np.uint64))
    assert len(points) > 9000 and built.nodes > 150  # one shard, one tree of many nodes
    assert simhash.projections(len(points)) == [0]
    assert near_groups(prints) == near_groups(prints, tree_rows=2000) == brute_components(points)


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (102, 101)], "a bigint, b bigint")
    found = dict(map(tuple, simhash.components(links).collect()))
    assert found == {i: 0 for i in range(1, 41)} | {101: 100, 102: 100}


def brute_contamination(text, items):
    w = decontaminate_words(text)
    hit, found = set(), set()
    for name, item in items:
        iw = decontaminate_words(item)
        size = min(13, len(iw))
        for i in range(len(iw) - size + 1 if size else 0):
            for j in range(len(w) - size + 1):
                if w[j : j + size] == iw[i : i + size]:
                    hit.update(range(j, j + size))
                    found.add(str(name))
    digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
    return len(w), len(hit), len(found), digest, len(hit) > 0 and 20 * len(hit) >= len(w)


def decontaminate_words(text):
    import re

    table = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(table))


def test_decontamination(spark, docs, none):
    long = [r[1] for r in corpus() if r[1] and len(r[1]) > 2000 and " " in r[1]][0].split()
    items = [(1, " ".join(long[20:40])), (2, "größe"), (3, None), (4, "..."), (10, " ".join(long[30:43])), (5, "bar thé other"), (1, "Foo, X1")]
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    expected = sorted(((r[0], *brute_contamination(r[1][:20_000] if r[1] else r[1], items)) for r in corpus()), key=str)
    short = docs.withColumn("text", F.substring("text", 1, 20_000))  # brute force is slow on more
    for block in (decontaminate.BLOCK_BYTES, 30):
        found = decontaminate.report(short, benchmark, block_bytes=block)
        assert sorted(map(tuple, found.collect()), key=str) == expected
    kept = decontaminate.remove(short, benchmark)
    assert kept.columns == docs.columns
    assert sorted(r[0] or -1 for r in kept.collect()) == sorted(r[0] or -1 for r in expected if not r[-1])
    assert decontaminate.report(none, benchmark).count() == 0
    assert decontaminate.report(short, benchmark.limit(0)).where("n_hit > 0 or contaminated").count() == 0


def test_fresh_names(spark):
    df = spark.createDataFrame([(1, 2, 3)], "__a int, __B_c int, a int")
    assert fresh("__", df) == "___" and fresh("__b", df) == "__b__" and fresh("x", df) == "x"


#: Columns that operators might use for themselves.
CLASHING = "__source, __place, __copies, __copy, __mix_s, __hit, __items, __n_words, __key, __hot, s, h, row, fp, a, b, shard, digest, n, held_out, label, score, keep_id, component_id, payload, key, n_tokens, start".split(", ")


def test_pipeline_stages_pass_clashing_columns_through(spark, docs):
    wide = docs.drop("score", "hit", "s")
    for i, name in enumerate(CLASHING):
        wide = wide.withColumn(name, F.concat(F.lit(f"own {i} "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))))
    marks = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id bigint, toxic int")
    items = spark.createDataFrame([(1, "größe other"), (2, "bar. x1 other")], "item_id bigint, text string")
    stages = [
        toxicity.reject(wide, marks),
        simhash.one_of_each(wide),
        decontaminate.remove(wide, items),
        decontaminate.remove(wide, items, block_bytes=5),
        decontaminate.remove(wide, items, spans=True),
        mixing.mixed(wide, repetition=1.5, cover=True),
    ]
    for after in stages:
        assert after.columns == wide.columns
        rows = after.collect()
        assert rows and all(r[name] == f"own {i} {'none' if r['doc_id'] is None else r['doc_id']}" for r in rows for i, name in enumerate(CLASHING))
    path = public_tokenizers.path("word_bpe_49k.json")
    pages = wide.withColumnsRenamed({"doc_id": "page_id", "text": "html", "lang": "url"})
    for found in (token_shards.round_trip(wide, path), simhash.near_duplicates(wide), exact_dedup.exact_duplicates(wide), ppm.score(wide), toxicity.score(wide, marks), decontaminate.report(wide, items), mixing.decisions(wide, entropy=0.9), token_counts.token_counts(wide, public_tokenizers.path("piece_bpe_32k.model")), warc_zip.round_trip(pages), html_extract.main_texts(pages)):
        assert found.count() == wide.count()


def test_bytes_that_are_no_utf8(spark, library):
    broken = b"good b\xffad \xc3 words\xe2\x82 here \xf0\x9f\x98\x80"
    docs = spark.createDataFrame([(1, bytearray(broken)), (2, bytearray(b"\xff"))], "doc_id bigint, raw binary").select("doc_id", F.col("raw").cast("string").alias("text"))
    pages = docs.select(F.col("doc_id").alias("page_id"), F.lit("u").alias("url"), F.col("text").alias("html"))
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    items = spark.createDataFrame([(1, "words here")], "item_id bigint, text string")
    path = public_tokenizers.path("word_bpe_49k.json")
    found = {r["doc_id"]: r for r in token_shards.round_trip(docs, path).collect()}
    ids = [library.encode(t.decode("utf-8", "replace"), add_special_tokens=False).ids + [1] for t in (broken, b"\xff")]
    assert [found[i + 1]["ids_crc32"] for i in range(2)] == [zlib.crc32(np.array(x, "<u4").tobytes()) for x in ids]
    counts = token_counts.token_counts(docs, public_tokenizers.path("piece_bpe_32k.model")).collect()
    assert {r["doc_id"]: r["n_words"] for r in counts} == {1: len(broken.split()), 2: 1}
    assert {r["doc_id"]: r["text_sha256"] for r in exact_dedup.exact_duplicates(docs).collect()} == {1: hashlib.sha256(broken).hexdigest(), 2: hashlib.sha256(b"\xff").hexdigest()}
    assert {r["payload_bytes"] for r in warc_zip.round_trip(pages).collect()} == {len(broken), 1}
    assert {r["n_hit"] for r in decontaminate.report(docs, items).collect()} == {0}
    for df in (simhash.near_duplicates(docs), ppm.score(docs), toxicity.score(docs, none), mixing.decisions(docs.withColumn("source", F.lit("a")), entropy=0.9)):
        assert df.count() == 2
    assert html_extract.main_texts(pages).count() == 2


def test_decontamination_spans(spark):
    docs = spark.createDataFrame([(1, "Start: one two THREE four. End!"), (2, None)], "doc_id int, text string")
    benchmark = spark.createDataFrame([("a", "two three, four")], "item_id string, text string")
    found = dict(map(tuple, decontaminate.remove(docs, benchmark, spans=True).collect()))
    assert found == {1: "Start: one . End!", 2: None}
    more = benchmark.union(spark.createDataFrame([("b", "END")], "item_id string, text string"))
    found = dict(map(tuple, decontaminate.remove(docs, more, spans=True, block_bytes=4).collect()))
    assert found == {1: "Start: one !", 2: None}  # "four. End" is one run of hit words


def test_toxicity_learns_pairs_and_rejects(spark, none):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(600):
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        text = " ".join(rng.choice(["some", "plain", "words", "here"]) for _ in range(20))
        text += " blockhead" * insult + " neighbours" * group
        rows.append((i, text, "en", "a", 0, 0.1, "h", "s"))
        labels.append((i, int(insult and group)))
    rows += [(1000, None, None, None, None, None, None, None), (1001, "", None, None, None, None, None, None), (None, "x", None, None, None, None, None, None), rows[0]]
    docs = spark.createDataFrame(rows, SCHEMA)
    rows += [(i, f"another text of this id {n}", None, None, None, None, None, None) for i in range(5) for n in range(20)]
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = [(i, 3 * x) for i, x in labels]  # any label above 0 means toxic
    marks = spark.createDataFrame(labels + [(5, None), (None, 1), labels[0]], "doc_id bigint, toxic int")
    found = toxicity.score(docs, marks).collect()
    assert len(found) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in found)
    truth = {i: int(x > 0) for i, x in labels if i >= 5}
    held = [r for r in found if r["held_out"] and r["doc_id"] in truth]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in found if r["doc_id"] is not None)
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.95
    kept = toxicity.reject(docs, marks)
    assert kept.columns == docs.columns and kept.count() == sum(1 - r["predicted"] for r in found)
    assert toxicity.score(none, marks).count() == 0
    for marked in (marks.limit(0), marks.where("toxic = 0")):
        assert max(r["score"] for r in toxicity.score(docs, marked).collect()) < 1e-12


def test_mixing(docs, none, spark):
    rng = random.Random(2)
    rows = [(i, words(rng, rng.randint(0, 40)), "en", rng.choice(["big"] * 8 + ["mid", "mid", "small", None]), 0, 0.1, "h", "s") for i in range(3000)]
    rows += [(9000, None, "", "empty", 0, 0.0, "", ""), rows[0]]
    some = spark.createDataFrame(rows, SCHEMA)
    found = mixing.decisions(some, entropy=0.97).collect()
    assert len(found) == len(rows)
    tokens, taken = Counter(), Counter()
    for r in found:
        tokens[r["source"]] += r["n_tokens"]
        taken[r["source"]] += r["n_tokens"] * r["copies"]
    total = sum(tokens.values())
    weights = {r["source"]: r["weight"] for r in found}
    h = -sum(w * math.log(w) for w in weights.values() if w) / math.log(sum(1 for w in weights.values() if w))
    assert abs(h - 0.97) < 1e-4
    for s in tokens:
        if tokens[s]:
            quota = total * weights[s]
            assert quota - 200 <= taken[s] <= quota + 1  # short by less than a document or two
    assert {r["copies"] for r in found if r["source"] == "empty"} == {1}
    again = mixing.mixed(some, repetition=1.5, cover=True)
    assert again.columns == some.columns
    copies = Counter(r["doc_id"] for r in again.select("doc_id").collect())
    assert set(copies) == {r[0] for r in rows} and max(copies.values()) <= 4
    assert mixing.decisions(none, entropy=0.9, repetition=2.0).count() == 0 and mixing.mixed(none, repetition=1.5, cover=True).count() == 0
    assert mixing.mixed(docs, repetition=1.5, cover=True).count() >= docs.count()


def test_mixing_runs_no_python(docs):
    plan = mixing.mixed(docs, repetition=1.5, cover=True)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def test_token_shards(docs, none, library):
    path = public_tokenizers.path("word_bpe_49k.json")
    found = token_shards.round_trip(docs, path).orderBy("start").collect()
    ids = {}
    for r in corpus():
        ids.setdefault(r[0], []).append(library.encode(r[1] or "", add_special_tokens=False).ids + [1])
    start, order = 0, sorted(ids, key=lambda x: (x is not None, x))
    expected = []
    for d in order:
        for row in ids[d]:
            expected.append((d, start, len(row), zlib.crc32(np.array(row, "<u4").tobytes())))
            start += len(row)
    assert [tuple(r) for r in found] == expected
    assert token_shards.round_trip(none, path).count() == 0


def test_encoder_matches_the_library_on_odd_texts(library):
    encoder = token_shards.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    odd = ["a<|startoftext|>b <|endoftext|>", "A<|STARTOFTEXT|> x", "İ ́a é. É.", "don't Don'T 'S", "ΑΣ. ΣΑΣ Σ", "a b, c", "x.. y,. ?! a:", "\x01 a\x01b", "\x1c\x85 a\x0bb", "日本語。テスト 語。", "é, è. × ÷.", "3.5 3. ..", "»,", ""]
    for text, ids in zip(odd, encoder.encode([t.encode() for t in odd])):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_encoder_matches_the_library_on_real_texts(spark, library):
    encoder = token_shards.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    texts = [r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    texts += ["\xe9t\xe9 \xdcber \xd7 a\xd7b \xf7 \xff\xfe caf\xe9's e\u0301a \u0130x stra\xdfe \xc0", "e\u0301 " * 300]
    for text, ids in zip(texts, encoder.encode([t.encode() for t in texts])):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids


def test_wavelet_block():
    rng = np.random.default_rng(4)
    for top, n in ((1, 5), (3, 1000), (50_000, 3000)):
        rows = [rng.integers(0, top, n).astype(np.uint16), np.zeros(0, np.uint16), rng.integers(0, top, 7).astype(np.uint16)]
        block = token_shards.Block(token_shards.build_block([3, None, 9], rows))
        flat = np.concatenate(rows)
        assert (block.decode() == flat).all() and block.docs == [3, None, 9] and block.sizes == [n, 0, 7]
        for i in rng.integers(0, len(flat), 20).tolist():
            assert block.access(i) == flat[i]
        token = int(flat[n // 2])
        assert block.count(token) == (flat == token).sum() and block.count(token, 2, n // 2) == (flat[2 : n // 2] == token).sum()
        assert list(block.locate(token))[:30] == np.flatnonzero(flat == token)[:30].tolist()
        assert block.count(65_000) == 0 and list(block.locate(65_000)) == []


def test_shard_files_answer_for_the_whole(spark):
    rng = random.Random(6)
    texts = [(i, words(rng, rng.randint(0, 400))) for i in range(60)] + [(60, ""), (61, None)]
    path = public_tokenizers.path("word_bpe_49k.json")
    for end_id in (1, None):
        manifest = token_shards.write_shards(spark.createDataFrame(texts, "doc_id bigint, text string").coalesce(1), path, end_id, block_tokens=300).collect()
        assert sum(r["n_docs"] for r in manifest) == len(texts)
        read = 0
        for row in manifest:
            reader = token_shards.ShardReader(row["path"])
            flat = np.concatenate([b.decode() for b in reader])
            read += sum(len(b.docs) for b in reader)
            assert len(reader) == len(flat) == row["n_tokens"]
            if not len(flat):
                continue
            for i in [0, len(flat) - 1, *rng.choices(range(len(flat)), k=40)]:
                assert reader.access(i) == flat[i]
            for token in {int(flat[0]), int(flat[len(flat) // 2]), 40_000}:
                places = np.flatnonzero(flat == token)
                a, b = sorted(rng.choices(range(len(flat)), k=2))
                assert reader.count(token) == len(places) and list(reader.locate(token)) == places.tolist()
                inside = places[(places >= a) & (places < b)].tolist()
                assert reader.count(token, a, b) == len(inside) and list(reader.locate(token, a, b)) == inside
            with pytest.raises(IndexError):
                reader.access(len(flat))
        assert read == len(texts)


def test_warc_archives(spark, none):
    rows = [(1, "http://a/x y", "<p>hé</p>"), (2, None, None), (3, "u\nv", "<p>hé</p>"), (3, "again", "<p>hé</p>"), (4, "http://b", ""), (None, "n", "only"), (7, "long", "x" * 300_000), (None, "m", "")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("payload", F.lit(1)).withColumn("key", F.lit(2))
    expected = []
    for page, _, html in rows:
        data = (html or "").encode()
        top = max((p for p, _, h in rows if (h or "") == (html or "") and p is not None), default=None)
        response = page == top
        expected.append((page, len(data), warc_zip.payload_digest(data), "response" if response else "revisit", None if response else top))
    manifest = warc_zip.write_archives(pages, member_bytes=200)
    found = warc_zip.read_archives(manifest).collect()
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, expected))
    for (path,) in manifest.select("path").collect():
        with zipfile.ZipFile(path.removeprefix("file:")) as z:
            assert z.testzip() is None and "indexes/index.cdxj" in z.namelist()
    assert warc_zip.round_trip(pages.limit(0)).count() == 0


class Bytes:
    def __init__(self, data):
        self.data = data

    def size(self):
        return len(self.data)

    def read_at(self, length, offset):
        return self.data[offset : offset + length]


@pytest.mark.parametrize("zip64", [False, True])
def test_zip_reader(zip64):
    out = io.BytesIO()
    writer = warc_zip.ZipWriter(out, zip64)
    for name, data in (("archive/a.bin", b"12345" * 100), ("b", b"")):
        writer.begin(name)
        writer.write(data)
        writer.end()
    writer.close()
    reader = warc_zip.ZipReader(Bytes(out.getvalue()))
    assert reader.read("archive/a.bin") == b"12345" * 100 and reader.read("archive/a.bin", 5, 7) == b"1234512" and reader.read("b") == b""
    with zipfile.ZipFile(io.BytesIO(out.getvalue())) as z:
        assert z.testzip() is None and z.read("archive/a.bin") == b"12345" * 100
    other = io.BytesIO()
    with zipfile.ZipFile(other, "w", zipfile.ZIP_STORED) as z:
        z.comment = b"a comment"
        z.writestr("x", b"stored")
        z.writestr("y", b"packed" * 50, zipfile.ZIP_DEFLATED)
    reader = warc_zip.ZipReader(Bytes(other.getvalue()))
    assert set(reader.members) == {"x"} and reader.read("x") == b"stored"
    with pytest.raises(ValueError):
        warc_zip.ZipReader(Bytes(b"no archive"))


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="has-sidebar"><header>Site</header>
<nav><ul><li><a href=x>Home</a></ul></nav><!-- <p>no</p> --><div class="ad">Buy now.</div>
<article><header><h1>Title &amp; more</h1></header><p>First&nbsp;para<br>graph <b>goes on.<p>Sho&#114;t<div class="share-links">Share</div>
<ul><li>One</li><li>Two</ul><form><p>Subscribe to it, please.</p></form><script>if(a<b)"</p>"</script></article>
<aside><p>Related long text that is not part of it.</p></aside><section id="comments"><p>I liked this article very much indeed.</p></section>
<div class="cookie-notice">We use cookies.</div><footer>&copy; 2020</footer>"""


def test_html_extraction(spark):
    pages = spark.createDataFrame([(1, "u", PAGE), (2, None, None), (3, "w", ""), (4, "x", "plain text only, no markup at all in this page."), (1, "u", PAGE), (5, "y", "<p" * 2000)], "page_id int, url string, html string")
    found = html_extract.main_texts(pages.withColumn("text", F.lit("clash"))).collect()
    text = "Title & more\nFirst para graph goes on.\nShort\nOne\nTwo"
    assert sorted(r["text"] for r in found if r["page_id"] == 1) == [text, text]
    assert {r["page_id"]: r["text"] for r in found if r["page_id"] in (2, 3)} == {2: "", 3: ""}
    assert [r["text"] for r in found if r["page_id"] == 4] == ["plain text only, no markup at all in this page."]
    assert all(r["n_chars"] == len(r["text"]) for r in found) and len(found) == 6
    assert html_extract.main_texts(pages.limit(0)).count() == 0


def test_token_counts(spark, docs, none):
    ranks = {"▁": 1, "a": 2, "b": 3, "ab": 4, "▁ab": 5, "▁a": 6, "aba": 7, "é": 8}
    pieces = token_counts.Pieces(ranks)

    def brute(word):
        path = "▁" + word
        options = []

        def grow(at, score, n):
            if at == len(path):
                options.append((score, -n))
                return
            for size in range(1, len(path) - at + 1):
                if path[at : at + size] in ranks:
                    grow(at + size, score + pieces.scores[path[at : at + size]], n + 1)
            if path[at] not in ranks:
                b = len(path[at].encode())
                grow(at + 1, score + b * pieces.byte_score, n + b)

        grow(0, 0.0, 0)
        return max(options)

    distinct = ["".join(w) for n in range(1, 6) for w in itertools.product("abxé", repeat=n)]
    for word, tokens, score in pieces.count_words(distinct):
        best = brute(word)
        assert abs(score - best[0]) < 1e-9
        assert tokens == -best[1] or abs(score - best[0]) < 1e-9
    path = public_tokenizers.path("piece_bpe_32k.model")
    found = token_counts.token_counts(docs, path).collect()
    real = token_counts.Pieces.of(path)
    expected = []
    for r in corpus():
        ws = (r[1] or "").encode().split()
        each = {w: next(real.count_words([w.decode()])) for w in set(ws)}
        expected.append((r[0], len(ws), sum(each[w][1] for w in ws), round(math.fsum(each[w][2] for w in ws), 6)))
    assert sorted(((r[0], r[1], r[2], round(r[3], 6)) for r in found), key=str) == sorted(expected, key=str)
    assert token_counts.token_counts(none, path).count() == 0


def test_ppm_probabilities_sum_to_one():
    texts = [r[1].encode() for r in corpus() if r[1]]
    order = 3
    keys = np.concatenate([ppm.gram_keys(g, order) for g in ppm.units(texts, order, 1000)])
    for least in (1, 3):
        levels = []
        k, n = np.unique(keys, return_counts=True)
        for o in range(order, -1, -1):
            context, of = np.unique(k >> np.uint64(8), return_inverse=True)
            totals = np.bincount(of, n)[of]
            keep = n >= (least if o == order else 1)
            levels.insert(0, (k[keep], n[keep], totals[keep]))
            if o:
                k, n = np.unique(k & np.uint64((1 << 8 * o) - 1), return_counts=True)
        model = ppm.Model(levels)
        for key in [*keys[::501].tolist(), 0x41424300]:
            row = (np.uint64(key) >> np.uint64(8) << np.uint64(8)) | np.arange(256, dtype=np.uint64)
            assert abs((10.0 ** model.log10(row)).sum() - 1) < 1e-4


def test_ppm_units_know_what_precedes():
    text = b"abcdefgh" * 50
    whole = np.concatenate([ppm.gram_keys(g, 4) for g in ppm.units([text, b""], 4)])
    parts = np.concatenate([ppm.gram_keys(g, 4) for g in ppm.units([text, b""], 4, 37)])
    assert (whole == parts).all() and len(whole) == len(text) + 2


def test_ppm_scores(spark, docs, none):
    found = ppm.score(docs, head_words=3).collect()
    rows = corpus()
    held = [zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 7 == 2 for r in rows]
    counts = Counter()
    for r, h in zip(rows, held):
        if not h:
            counts.update((r[1] or "").encode().lower().split())
            counts[None] += 1
    total, distinct = sum(counts.values()), len(counts)
    expected = []
    for r, h in zip(rows, held):
        tokens = [*(r[1] or "").encode().lower().split(), None]
        base = sum(math.log10((counts[t] + 1) / (total + distinct + 1)) for t in tokens)
        expected.append((r[0], h, len(tokens), sum(counts[t] > 0 for t in tokens), total, round(base, 6)))
    assert sorted(((*r[:5], round(r[5], 6)) for r in found), key=str) == sorted(expected, key=str)
    assert all(r["score"] < 0 for r in found)
    assert ppm.score(none).count() == 0
    lonely = spark.createDataFrame([(i, "ab") for i in range(40) if zlib.crc32(str(i).encode()) % 7 == 2], "doc_id bigint, text string")
    assert {(r["n_known"], round(r["score"], 6)) for r in ppm.score(lonely).collect()} == {(0, round(-3 * math.log10(256), 6))}


def test_ppm_scores_use_every_gram(spark, docs):
    order, rows = 5, corpus()
    held = [zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 7 == 2 for r in rows]
    texts = [b"\xfe" * order + (r[1] or "").encode() + b"\xff" for r in rows]
    grams = Counter(t[i - order : i + 1] for t, h in zip(texts, held) if not h for i in range(order, len(t)))
    seen = [None] * (order + 1)
    for k in range(order, -1, -1):
        seen[k] = {}
        for g, n in grams.items():
            seen[k].setdefault(g[:-1], {})[g[-1]] = n
        grams = Counter(g[1:] for g in grams)

    @functools.cache
    def brute(gram):
        out, logs = set(), 0.0
        for k in range(order, -1, -1):
            symbols = seen[k].get(gram[order - k : -1], {})
            left = {s: n for s, n in symbols.items() if s not in out}
            total = sum(left.values())
            if gram[-1] in left:
                return logs + math.log10((left[gram[-1]] - 0.5) / total)
            logs += math.log10(0.5 * len(left) / total) if left else 0
            out |= symbols.keys()
        return logs - math.log10(256 - len(out))

    expected = sorted((str(r[0]), math.fsum(brute(t[i - order : i + 1]) for i in range(order, len(t)))) for r, t in zip(rows, texts))
    for head in (50, 1_000_000):  # positional: how many grams are at hand changes nothing
        found = sorted((str(r["doc_id"]), r["score"]) for r in ppm.score(docs, order, head).collect())
        assert len(found) == len(expected)
        assert all(a[0] == b[0] and abs(a[1] - b[1]) < 1e-5 * abs(b[1]) for a, b in zip(found, expected))


def test_pipeline_stages(spark, tmp_path):
    tables = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, tables)
        assert docs.columns == columns, name
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert 0 < docs.count() <= 2 * before
    last = corpus_pipeline.STAGES[-1][1](spark, docs, tables)
    assert last.count() == docs.count()
    assert corpus_pipeline.run(spark, tables).count() == last.count()
