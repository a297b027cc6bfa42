"""The message store as a batch and a streaming source."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from lectern.sources import messages


@pytest.fixture
def store(tmp_path):
    folder = tmp_path / "store"
    folder.mkdir()

    def add(name, ids, size=5):
        rows = {"id": pa.array(ids, pa.int64()), "text": pa.array([None if i is None else f"m{i}" for i in ids])}
        pq.write_table(pa.table(rows), folder / name, row_group_size=size)

    add("b.parquet", list(range(20, 40)))
    add("a.parquet", [*range(0, 20), None])
    (folder / "_SUCCESS").write_text("")
    return str(folder), add


def ids(df):
    return sorted((r["id"] for r in df.collect()), key=lambda i: (i is not None, i or 0))


def test_pages_are_partitions_and_bounds_reach_them(spark, store):
    path, _ = store
    every = messages.read(spark, path, "id", page_rows=10)
    assert every.rdd.getNumPartitions() == 5 and ids(every) == [None, *range(40)]
    assert ids(every.where("id > 36 or id < 2")) == [0, 1, 37, 38, 39] and ids(every.where("id = 11").union(every.where("id = 12"))) == [11, 12]
    assert [r["text"] for r in every.where("id < 2").select("text").orderBy("text").collect()] == ["m0", "m1"]
    part = messages.read(spark, path, "id", page_rows=10, after=6, until=12)
    assert ids(part) == list(range(7, 13)) and part.rdd.getNumPartitions() == 2  # a group without ids is looked into
    few = messages.Store(path, "id").pages(messages.Range(11, 14), 10)
    assert [(g.least, g.most) for p in few for g in p.groups if g.least is not None] == [(10, 14)]


def test_each_message_comes_once_over_restarts(spark, store, tmp_path):
    path, add = store
    into, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    run = lambda **o: messages.new_messages(spark, path, "id", checkpoint, into, **o)
    run(until=17)
    assert ids(spark.read.parquet(into)) == list(range(18))
    run()
    run()
    assert ids(spark.read.parquet(into)) == list(range(40))
    add("c.parquet", [41, 44, 40, 3])  # an id that was passed is not seen again
    run()
    assert ids(spark.read.parquet(into)) == [*range(41), 41, 44]


def test_a_store_without_rows(spark, tmp_path):
    pq.write_table(pa.table({"id": pa.array([], pa.int64())}), tmp_path / "none.parquet")
    assert messages.read(spark, str(tmp_path / "none.parquet"), "id").collect() == []
    messages.new_messages(spark, str(tmp_path / "none.parquet"), "id", str(tmp_path / "c"), str(tmp_path / "o"))
    assert spark.read.schema("id bigint").parquet(str(tmp_path / "o")).collect() == []
    with pytest.raises(Exception, match="no Parquet file"):
        (tmp_path / "empty").mkdir()
        messages.read(spark, str(tmp_path / "empty"), "id").collect()
