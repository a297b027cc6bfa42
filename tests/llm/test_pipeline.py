"""The pipeline against a version in plain Python, stage by stage, on the smallest tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

public_tokenizers = pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from lectern.llm import mixing, toxicity  # noqa: E402

TABLES = "/root/testdata/sf0.001"


def words(text):
    lowered = "".join(c.lower() if c.isascii() else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lowered)


def fingerprint(text):
    parts = text.encode().lower().split()
    grams = [b" ".join(parts[i : i + 4]) for i in range(max(1, len(parts) - 3))] if parts else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def one_of_each(docs):
    prints = {d: fingerprint(text) for d, (text, _) in docs.items()}
    left, kept = set(docs), {}
    while left:
        head = min(left)
        group, edge = {head}, [head]
        while edge:
            x = edge.pop()
            near = {y for y in left - group if (prints[x] ^ prints[y]).bit_count() <= 4}
            group |= near
            edge += near
        left -= group
        kept[head] = docs[head]
    return kept


def decontaminated(docs, items):
    windows = defaultdict(set)
    for item in items:
        w = words(item)
        size = min(13, len(w))
        for i in range(len(w) - size + 1 if w else 0):
            windows[size].add(tuple(w[i : i + size]))
    kept = {}
    for d, (text, source) in docs.items():
        w, hit = words(text), set()
        for size, found in windows.items():
            for i in range(len(w) - size + 1):
                if tuple(w[i : i + size]) in found:
                    hit.update(range(i, i + size))
        if not hit or 20 * len(hit) < len(w):
            kept[d] = (text, source)
    return kept


def mixed(docs, limit):
    md5 = lambda s: hashlib.md5(s.encode()).hexdigest()
    tokens = {d: len(re.findall("[^\x20\x09-\x0d]+", text)) for d, (text, _) in docs.items()}
    total = Counter()
    for d, (_, source) in docs.items():
        total[source] += tokens[d]
    p = {s: n / sum(total.values()) for s, n in total.items()}
    low, high = 0.0, 1.0
    for _ in range(40):
        a = (low + high) / 2
        passes = [x ** (a - 1) for x in p.values()]
        low, high = (low, a) if max(passes) / min(passes) <= limit else (a, high)
    z = sum(x**high for x in p.values())
    weights = {s: round(x**high / z, mixing.DECIMALS) for s, x in p.items()}
    budget = int(np.ceil(max(total[s] / p[s] ** high for s in p) * z))
    copies = {}
    for s in p:
        quota = max(int(budget * weights[s]), total[s])
        whole, rest = divmod(quota, total[s])
        blocks = defaultdict(list)
        for d in (d for d in docs if docs[d][1] == s):
            place = md5(f"{mixing.SEED}|{d}")
            blocks[place[:3]].append((place, d))
            copies[d] = whole
        for block in sorted(blocks, key=lambda b: md5(f"{mixing.SEED}|{s}|{b}")):
            size = sum(tokens[d] for _, d in blocks[block])
            if size > rest:
                for _, d in sorted(blocks[block]):
                    if tokens[d] > rest:
                        break
                    rest -= tokens[d]
                    copies[d] += 1
                break
            rest -= size
            for _, d in blocks[block]:
                copies[d] += 1
    return copies


def test_pipeline_against_plain_python(spark):
    from tokenizers import Tokenizer

    read = lambda name: spark.read.parquet(f"{TABLES}/{name}.parquet")
    docs = {r["doc_id"]: (r["text"], r["source"]) for r in read("documents").collect()}
    model = toxicity.fit(read("documents"), read("labels"))
    scores = dict(zip(docs, model.scores([text.encode() for text, _ in docs.values()])))
    expected = {d: v for d, v in docs.items() if scores[d] < 0.5}
    assert len(expected) < len(docs)
    expected = decontaminated(one_of_each(expected), [r["text"] for r in read("benchmark").collect()])
    copies = mixed(expected, corpus_pipeline.REPETITION)
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows, start = [], 0
    for d in sorted(copies):
        ids = library.encode(expected[d][0], add_special_tokens=False).ids + [1]
        for _ in range(copies[d]):
            rows.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            start += len(ids)
    found = corpus_pipeline.run(spark, TABLES).orderBy("start").collect()
    assert [tuple(r) for r in found] == rows
