"""Exact top-k search, the filter audit and importance resampling against brute
force, with nulls, empty and long texts, ties, repeated rows, empty tables and
clashing column names."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from lectern.llm import filter_audit, importance, topk

VECTORS = "vec_id bigint, embedding array<double>, rank int, score bigint, query_id string"


def vectors(scale=1.0):
    rng = random.Random(5)
    rows = [(i, [rng.uniform(-1, 1) * scale for _ in range(8)]) for i in range(230)]
    rows += [(300 + i, rows[7][1]) for i in range(40)]  # one common vector
    rows += [(None, rows[7][1]), (None, rows[3][1]), (400, None), (450, [1.0, None] + [0.5] * 6), (500, [float("nan")] + [0.0] * 7)]
    rows += [(550, [float("inf")] * 8), (600, [0.25, 0.5]), (650, []), (651, []), (601, [0.125, -0.5]), rows[50], (50, rows[60][1]), rows[9]]
    return [(i, v, 1, 2, "x") for i, v in rows]


def brute_top(rows, k):
    whole = [(i, [math.floor(256 * x) for x in v]) for i, v, *_ in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    asked = {(i, tuple(v)) for i, v in whole if i is not None and i % 50 == 0}
    out = []
    for q, v in asked:
        found = [(-max(min(sum(a * b for a, b in zip(v, w)), 2**63 - 1), -(2**63)), i is None, i or 0) for i, w in whole if i != q and len(w) == len(v)]
        out += [(q, at + 1, None if none else i, -score) for at, (score, none, i) in enumerate(sorted(found)[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("scale", [1.0, 1e5, 1e7, 1e12, 1e30])
def test_top_k(spark, scale, monkeypatch):
    monkeypatch.setattr(topk, "SHARD_ROWS", 50)
    monkeypatch.setattr(topk, "TILE_QUERIES", 2)
    monkeypatch.setattr(topk, "FAN", 3)
    monkeypatch.setattr(topk, "BLOCK_BYTES", 100)
    rows = vectors(scale)
    df = spark.createDataFrame(rows, VECTORS).repartition(3)
    found = topk.top_k(df, topk.ids_divisible_by(df, 50), 5)
    assert found.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted((tuple(r) for r in found.collect()), key=str) == brute_top(rows, 5)


def test_top_k_of_nothing(spark):
    none = spark.createDataFrame([], VECTORS)
    assert topk.top_k(none, none, 5).collect() == []
    one = spark.createDataFrame([(50, [1.0], 0, 0, "")], VECTORS)
    assert topk.top_k(one, one, 5).collect() == []
    some = spark.createDataFrame([(50, [1.0], 0, 0, ""), (3, [2.0], 0, 0, ""), (2, [2.0], 0, 0, "")], VECTORS)
    assert [tuple(r) for r in topk.top_k(some, topk.ids_divisible_by(some, 50), 5).orderBy("rank").collect()] == [(50, 1, 2, 131072), (50, 2, 3, 131072)]


def test_best_of_tile_keeps_the_first_of_a_tie():
    rng = np.random.default_rng(2)
    for k in (1, 3, 5, 40):
        scores = rng.integers(-3, 3, (30, 33))
        best = topk._best_of_tile(scores, k)
        for row, found in zip(scores, best):
            assert sorted(found.tolist()) == sorted(sorted(range(33), key=lambda i: (-row[i], i))[:k])


DOCS = "doc_id bigint, text string, lang string, source string, fails int, part string, good int"


def documents():
    rng = random.Random(8)
    some = ["Alpha", "beta", "GAMMA", "délta", "x1", "eps,", "\U0001f600"]
    rows = []
    for i in range(160):
        n = rng.choice([0, 3, 150, 199, 200, 260])
        pool = [f"w{rng.randrange(200)}" for _ in range(n)] if i % 2 else [rng.choice(some) for _ in range(n)]
        rows.append((i, " ".join(pool) + rng.choice(["", "\n", " #", " | a"]), "en", rng.choice(["a", "b", None, "c"])))
    rows += [(200 + i, rows[5][1], "en", "hot") for i in range(70)]  # copies of one text
    rows += [(900, None, None, None), (901, "", None, "a"), (902, "w " * 30_000, None, "b"), (None, rows[5][1], None, "a"), (None, "own", None, None)]
    rows += [rows[3], rows[3], (3, "another text of id 3", None, "c")]
    return [(*r, 0, "p", 1) for r in rows]


def told():
    rng = random.Random(9)
    return [(rng.randrange(230), rng.choice([0, 1, None]), rng.choice([0, 1])) for _ in range(200)] + [(None, 1, 1)]


def brute_audit(rows, labels):
    first, good, toxic = {}, set(), set()
    for i, text, *_ in rows:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    for i, q, t in labels:
        good |= {i} if q == 1 and i is not None else set()
        toxic |= {i} if t == 1 and i is not None else set()
    out, shapley = {}, Counter()
    for i, text, _, source, *_ in rows:
        text = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), "D": bool(re.search("[#$%&*|]", text)), "E": i is not None and first[text] < i}
        for order in itertools.permutations("ABCDE"):
            gone = False
            for step, f in enumerate(order, 1):
                counts = out.setdefault((source or "", "".join(order), step), Counter())
                removed = fails[f] and not gone
                counts["kept"] += not gone and not fails[f]
                counts["removed"] += removed
                counts["redundant"] += fails[f] and gone
                counts["unique_fails"] += fails[f] and sum(fails.values()) == 1
                counts["good_lost"] += removed and i in good
                counts["toxic_lost"] += removed and i in toxic
                shapley[source or "", f] += removed
                gone = gone or fails[f]
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
    return sorted((part, order, step, *[c[n] for n in names], shapley[part, order[step - 1]]) for (part, order, step), c in out.items())


@pytest.mark.parametrize("held", [1 << 20, 7])
def test_filter_audit(spark, monkeypatch, held):
    monkeypatch.setattr(filter_audit, "INDEX_ROWS", held)
    docs = spark.createDataFrame(documents(), DOCS).repartition(3)
    labels = spark.createDataFrame(told(), "doc_id bigint, quality int, toxic int").withColumnRenamed("quality", "quality")
    found = filter_audit.corpus_audit(docs, labels)
    assert found.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    rows = sorted(tuple(r) for r in found.collect())
    assert rows == brute_audit(documents(), told())
    assert len(rows) == 5 * 120 * 5 and any(r[4] == 0 for r in rows)


def test_filter_audit_of_nothing(spark):
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert filter_audit.corpus_audit(spark.createDataFrame([], DOCS), labels).collect() == []
    one = filter_audit.corpus_audit(spark.createDataFrame([(1, None, None, None, 0, "", 0)], DOCS), labels).collect()
    assert len(one) == 600 and {r["part"] for r in one} == {""} and sum(r["removed"] for r in one) == 120


def test_bitmaps_count_by_part():
    rng = np.random.default_rng(4)
    n = 1000
    parts, fails, labels = rng.integers(0, 7, n), rng.integers(0, 8, n), rng.integers(0, 2, n)
    maps = filter_audit.Bitmaps(parts, 7, fails, labels, 3, 1)
    for prefix, f, (kept, removed, redundant, unique, lost) in maps.steps():
        before, fail = fails & prefix != 0, fails >> f & 1 == 1
        for counts, rows in ((kept, ~before & ~fail), (removed, ~before & fail), (redundant, before & fail), (unique, fails == 1 << f), (lost, ~before & fail & (labels == 1))):
            assert counts.tolist() == np.bincount(parts[rows], minlength=7).tolist()


TEXTS = "doc_id bigint, text string, source string, weight bigint, place string, words int, part int, n int"


def texts():
    rng = random.Random(11)
    pool = ["the", "And", "größe", "x1", "ÀB", "long-word", "a.b", "\U0001f600", "Foo", "zeta"]
    rows = [(i, " ".join(rng.choice(pool) for _ in range(rng.choice([0, 1, 2, 3, 18, 19, 20, 21, 80])))) for i in range(150)]
    rows += [(900, None), (901, ""), (902, " \x00.,"), (903, "word " * 30_000), (None, "many words " * 20), (None, "many words " * 20), rows[4], rows[4], (-5, "many words " * 20)]
    rows += [(1000 + i, "the same text in a third of all rows " * 4) for i in range(60)]
    return [(*r, "s", 1, "p", 2, 3, 4) for r in rows]


def features(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10000 for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def brute_resample(rows, target, percent=5):
    s, t = Counter(), Counter()
    for r in rows:
        s.update(features(r[1])[1])
    for r in target:
        t.update(features(r[1])[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log(((t[b] + 1.0) * (big_s + 10000)) / ((s[b] + 1.0) * (big_t + 10000)))) for b in range(10000)]
    out, able = [], []
    for r in rows:
        n, f = features(r[1])
        h = int(hashlib.sha256(f"42:{'' if r[0] is None else r[0]}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        row = [r[0], len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None]
        out.append(row)
        if n >= 20:
            able.append(row)
    able.sort(key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    for at, row in enumerate(able[: percent * len(able) // 100]):
        row[4] = at + 1
    return sorted(map(tuple, out), key=str)


@pytest.mark.parametrize("percent", [5, 60, 100])
def test_importance_resampling(spark, percent):
    docs = spark.createDataFrame(texts(), TEXTS).repartition(4)
    items = [(str(i), t) for i, t in enumerate(["the größe of x1", None, "", "Foo and the zeta a b", "Foo and the zeta a b"])]
    found = importance.resample(docs, spark.createDataFrame(items, "item_id string, text string"), percent)
    assert found.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted((tuple(r) for r in found.collect()), key=str) == brute_resample(texts(), items, percent)


def test_importance_of_nothing(spark):
    none, items = spark.createDataFrame([], TEXTS), spark.createDataFrame([], "item_id string, text string")
    assert importance.resample(none, items).collect() == []
    docs = spark.createDataFrame(texts()[:30], TEXTS)
    assert sorted((tuple(r) for r in importance.resample(docs, items).collect()), key=str) == brute_resample(texts()[:30], [])


def test_scoring_neither_explodes_nor_joins(spark):
    docs = spark.createDataFrame(texts(), TEXTS)
    rows = importance.bucketed(docs, [docs.doc_id])
    plan = importance.scored(rows, [1] * 10_000)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Generate|Join|Exchange|Python", plan)
    assert plan.count("split(translate") <= 1 and "split(1,1" not in plan  # words once a row, gains a literal


PROBES = ["Hello World", " two  spaces\tand\nlines ", "don't A.B, c!", "<|endoftext|> x<|endoftext|>", "日本語 テスト", "é \xc9T\xc9", "", "   ", "x" * 3000, "a\x0bb\x1cc", "Ünïcode 123 456"]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_every_vocabulary_gives_the_librarys_ids(spark, name):
    from tokenizers import Tokenizer

    from lectern.llm import token_shards

    public_tokenizers = pytest.importorskip("public_tokenizers")
    path = public_tokenizers.path(name)
    library = Tokenizer.from_file(path)
    real = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    for text, ids in zip(PROBES + real, token_shards.Encoder(path).encode([t.encode() for t in PROBES + real])):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids, text[:50]
    docs = spark.createDataFrame(list(enumerate(PROBES)), "doc_id bigint, text string")
    found = {r["doc_id"]: (r["n_tokens"], r["ids_crc32"]) for r in token_shards.round_trip(docs, path, end_id=7).collect()}
    ids = [library.encode(t, add_special_tokens=False).ids + [7] for t in PROBES]
    assert found == {i: (len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in enumerate(ids)}


@pytest.mark.parametrize("name", ["byte_bpe_50k.tiktoken", "piece_bpe_32k.model"])
def test_other_files_are_an_error(name):
    from lectern.llm import token_shards

    public_tokenizers = pytest.importorskip("public_tokenizers")
    with pytest.raises(Exception):
        token_shards.Encoder(public_tokenizers.path(name))


def test_whole_blocks_are_counted_without_reading_them(spark, monkeypatch):
    from lectern.llm import token_shards

    public_tokenizers = pytest.importorskip("public_tokenizers")
    docs = spark.createDataFrame([(i, f"word{i} shared text {i % 3}" + " zeppelin" * (i == 100)) for i in range(200)], "doc_id bigint, text string").coalesce(1)
    path = token_shards.write_shards(docs, public_tokenizers.path("word_bpe_49k.json"), block_tokens=100).first()["path"]
    reader = token_shards.ShardReader(path)
    flat = np.concatenate([b.decode() for b in reader])
    read = []
    block = token_shards.ShardReader.block
    monkeypatch.setattr(token_shards.ShardReader, "block", lambda self, i: read.append(i) or block(self, i))
    for token, n in Counter(flat.tolist()).items():
        assert reader.count(token) == n
    assert reader.count(48_000) == 0 and list(reader.locate(48_000)) == [] and read == []
    rare = next(t for t, n in Counter(flat.tolist()).items() if n == 1)
    assert list(reader.locate(rare)) == np.flatnonzero(flat == rare).tolist() and len(read) == 1
    assert reader.count(1, 50, len(flat) - 50) == int((flat[50:-50] == 1).sum()) and len(read) <= 3


class Bytes:
    def __init__(self, data):
        self.data = data

    def size(self):
        return len(self.data)

    def read_at(self, length, offset):
        return self.data[offset : offset + length]


@pytest.mark.parametrize("stored, gzipped, relative", list(itertools.product([True, False], repeat=3)))
def test_archives_of_other_writers_are_read(stored, gzipped, relative):
    import base64
    import gzip
    import io
    import json
    import zipfile

    from lectern.llm import warc_zip

    def record(fields, block):
        return ("WARC/1.0\r\n" + "\r\n".join([*fields, f"Content-Length:{len(block)}"]) + "\r\n\r\n").encode() + block + b"\r\n\r\n"

    body = "é".encode() * 50
    sha1 = base64.b32encode(hashlib.sha1(body).digest()).decode()
    records = [
        record(["WARC-Type:warcinfo", "WARC-Record-ID: <urn:uuid:1>", "Content-Type: application/warc-fields"], b"software: x\r\n"),
        record(["warc-type: response", "WARC-Record-ID:<urn:uuid:2>", "WARC-Target-URI: <http://a/>", f"WARC-Payload-Digest:sha1:{sha1}", "Content-Type:application/http; msgtype=response"], b"HTTP/1.1 200 OK\r\nServer:x\r\n\r\n" + body),
        record(["WARC-Type: response", "WARC-Record-ID: <urn:uuid:3>", f"WARC-Payload-Digest: sha256:{hashlib.sha256(body).hexdigest()}", "Content-Type: application/http", "X-Long: a", "\tfolded"], b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n32\r\n" + body[:50] + b"\r\n32\r\n" + body[50:] + b"\r\n0\r\n\r\n"),
        record(["WARC-Type: resource", "WARC-Record-ID: <urn:uuid:4>", "Content-Type: text/plain"], b"plain\r\n\r\ntext"),
        record(["WARC-Type: revisit", "WARC-Record-ID: <urn:uuid:5>", "WARC-Refers-To: <urn:uuid:2>", f"WARC-Payload-Digest: sha1:{sha1}", "Content-Type: application/http"], b"HTTP/1.1 200 OK\r\nContent-Length: 100\r\n\r\n"),
    ]
    data, lines = b"", [b'!meta 0 {"format": "cdxj"}', b""]
    for i, r in enumerate(records):
        packed = gzip.compress(r) if i != 3 else r  # one record is not packed
        entry = {"url": f"http://{i}/", "filename": "x.warc.gz" if relative else "archive/x.warc.gz", "offset": str(len(data)), "length": str(len(packed))}
        lines.append(f"com,a)/{i} 2020 {json.dumps(entry)}".encode())
        data += packed
    index = b"\n".join(lines)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED if stored else zipfile.ZIP_DEFLATED) as z:
        z.writestr("archive/", b"")
        z.writestr("archive/x.warc.gz", data)
        z.writestr("indexes/index.cdx.gz" if gzipped else "indexes/index.cdx", gzip.compress(index[:90]) + gzip.compress(index[90:]) if gzipped else index)
        z.writestr("datapackage.json", "{}")
    archive = warc_zip.ZipReader(Bytes(out.getvalue()))
    entries = warc_zip.read_index(archive)
    assert all(isinstance(e["offset"], int) and e["filename"] == "archive/x.warc.gz" for e in entries)
    found = list(warc_zip.read_records(archive, entries))
    assert [(r.kind, r.record_id, r.payload_bytes) for r in found] == [("warcinfo", "<urn:uuid:1>", 13), ("response", "<urn:uuid:2>", 100), ("response", "<urn:uuid:3>", 100), ("resource", "<urn:uuid:4>", 13), ("revisit", "<urn:uuid:5>", 100)]
    assert found[1].payload == found[2].payload == body and found[1].url == "http://a/" and found[4].refers_to_id == "<urn:uuid:2>" and found[4].payload is None
    assert found[3].payload == b"plain\r\n\r\ntext" and found[1].digest == sha1
    with pytest.raises(ValueError, match="damaged"):
        warc_zip.parse(records[1].replace(body, body[:-1] + b"x"))
    with pytest.raises(ValueError, match="does not hold"):
        bad = io.BytesIO()
        with zipfile.ZipFile(bad, "w") as z:
            z.writestr("indexes/index.cdx", b'a 1 {"filename": "y", "offset": 0, "length": 1}')
        warc_zip.read_index(warc_zip.ZipReader(Bytes(bad.getvalue())))


def test_hot_contexts_are_shared_out(spark, monkeypatch):
    from pyspark.sql import functions as F

    from lectern.llm import ppm

    rng = random.Random(12)
    rows = [(i, "the same ending of all the rows here " + rng.choice("abcdef") * 3 + " ----------------------------------------------------------------------------") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    key = lambda df: {r["doc_id"]: (r["n_known"], round(r["base_score"], 6), round(r["score"], 6)) for r in df.collect()}
    plain = key(ppm.score(docs, head_grams=20, head_words=1))
    monkeypatch.setattr(ppm, "BLOCK_ASKED", 40)
    monkeypatch.setattr(ppm, "BLOCK_GRAMS", 30)
    sizes = []
    run = ppm.map_arrow
    monkeypatch.setattr(ppm, "map_arrow", lambda df, *a, **k: sizes.append(df) or run(df, *a, **k))
    assert key(ppm.score(docs, head_grams=20, head_words=1)) == plain
    dealt = next(df for df in sizes if df.columns == ["gram", "what"])
    parts = [r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect()]
    assert max(parts) < sum(parts) / 2


def test_many_sources_are_mixed_alike(spark, monkeypatch):
    from lectern.llm import mixing

    rng = random.Random(3)
    rows = [(i, "word " * rng.randint(0, 30), f"s{i % 7}" if i % 3 else "hot") for i in range(400)] + [(None, "no id", None), (900, None, "s1")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(4)
    decided = lambda: sorted(map(str, mixing.decisions(docs, entropy=0.97, repetition=3.0).collect()))
    taken = lambda: sorted(map(str, mixing.mixed(docs, repetition=1.25, cover=True).collect()))
    small = decided(), taken()
    monkeypatch.setattr(mixing, "PLAN_ROWS", 2)
    assert (decided(), taken()) == small


def test_toxicity_scores_are_those_of_the_machine(spark):
    """Every score again, from weights and factors, pair by pair."""
    from lectern.llm import toxicity

    folder = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    docs = docs.select("doc_id", "text").union(spark.createDataFrame([(9001, None), (9002, ""), (9003, "\x00 Ä IDIOT idiot idiots")], "doc_id bigint, text string"))
    model = toxicity.fit(docs, labels)
    found = {r["doc_id"]: r for r in toxicity.scored(docs, model).collect()}
    used = 0
    for r in docs.collect():
        data = (r["text"] or "").encode()
        terms = Counter()
        for word in re.findall(rb"[a-z0-9\x80-\xff]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), data)):
            terms[zlib.crc32(word) % toxicity.BUCKETS] += 1
            for size in (4, 5, 6, 7, 8):
                terms[zlib.crc32(word[:size], size) % toxicity.BUCKETS] += 1
        x = {int(model.place[b]): 1 + math.log(n) for b, n in terms.items() if model.place[b] >= 0}
        z = model.bias + sum(model.w[i] * v for i, v in x.items())
        if len(x) < 60:
            z += sum(float(model.v[i] @ model.v[j]) * x[i] * x[j] for i, j in itertools.combinations(x, 2))
        else:
            total = sum(v * model.v[i] for i, v in x.items())
            z += 0.5 * float(total @ total - sum(v * v * (model.v[i] @ model.v[i]) for i, v in x.items()))
        score = 1 / (1 + math.exp(-max(-35, min(35, z))))
        used += len(x)
        assert abs(found[r["doc_id"]]["score"] - score) < 1e-9 and found[r["doc_id"]]["predicted"] == (score >= 0.5)
        assert found[r["doc_id"]]["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
    assert used > 1000
