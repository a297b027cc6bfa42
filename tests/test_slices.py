"""Batches of long texts are mapped a part at a time, with the same rows."""

import pyarrow as pa

from lectern.operators import chunking, quality, retrieval, slices


def test_parts_are_small_and_whole():
    texts = ["x" * 3000] * 2000 + ["y" * 5_000_000] + [None, ""] * 700
    batch = pa.record_batch({"id": pa.array(range(len(texts))), "text": pa.array(texts)})
    parts = list(slices.slices(batch))
    assert pa.Table.from_batches(parts).to_pylist() == batch.to_pylist()
    assert all(p.num_rows == 1 or p.nbytes <= slices.PART_BYTES and p.num_rows <= slices.PART_ROWS for p in parts)
    assert list(slices.slices(batch.slice(0, 0))) == []


def test_frames_hold_one_part(spark):
    rows = spark.range(0, 3000, 1, 1).selectExpr("id", "repeat('word ', 1000) text", "if(id % 2 = 0, id, null) n", "array('a', null) list")

    def run(frames):
        for frame in frames:
            yield frame.assign(rows=len(frame))[["id", "n", "list", "rows"]]

    found = slices.map_frames(rows, run, "id bigint, n bigint, list array<string>, rows int").collect()
    assert [r["id"] for r in found] == list(range(3000)) and [r["n"] for r in found] == [i if i % 2 == 0 else None for i in range(3000)]
    assert max(r["rows"] for r in found) * 5000 <= slices.PART_BYTES and all(list(r["list"]) == ["a", None] for r in found)


def test_rows_of_mixed_texts(spark):
    texts = [("Straße ﬁn Ⅻ " * n + f"word{n} " * n if n % 7 else None if n % 2 else "plain Text 10:32 ago " * n) for n in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1)

    def all_of():
        return [
            sorted(map(str, chunking.chunk_texts(docs, "doc_id", "text").collect())),
            sorted(map(str, retrieval.postings(docs, "doc_id", {"text": 1.0}).collect())),
            sorted(map(str, docs.select("doc_id", quality.normalise_for_hash(docs.text)).collect())),
        ]

    whole = all_of()
    assert [len(x) > 0 for x in whole] == [True] * 3 and len(whole[2]) == 200
    assert any("strasse fin xii" in x for x in whole[2])


def test_likely_pairs_hold_every_link_and_few_others():
    import random

    from lectern.operators import minhash

    draw = random.Random(3)
    words = [f"w{i}" for i in range(4000)]
    pairs = []
    for kept in (200, 90, 89, 50, 30):  # of 100 words each side has, so many are shared
        for _ in range(60):
            base = draw.sample(words, 300)
            pairs.append((" ".join(base[:100]), " ".join(base[:100][:kept] + base[100 : 200 - min(kept, 100)])))
    sketches = [[minhash.signed(t, ("words",))[1] for t in side] for side in zip(*pairs)]
    batch = pa.record_batch({"a": pa.array(range(len(pairs))), "b": pa.array(range(len(pairs))), "left": pa.array(sketches[0]), "right": pa.array(sketches[1])})
    likely = {i for part in minhash._likely([batch]) for i in part.column(0).to_pylist()}
    links = {i for i, (x, y) in enumerate(pairs) if minhash.similarity(x, y, ("words",)) >= minhash.LEAST}
    unlike = {i for i, (x, y) in enumerate(pairs) if minhash.similarity(x, y, ("words",)) < 0.4}
    assert len(links) >= 120 and links <= likely
    assert len(unlike) >= 120 and len(unlike & likely) <= 2
