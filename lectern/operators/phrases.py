"""A positional inverted index: phrases over several text columns.

The index holds a row a term and batch of texts: which texts of the batch hold the
term, how often each, and its positions, all as gaps (the first from 0, then from
the one before) of a byte or a few, in folders by a hash of the term and sorted by
term inside a file; a row a batch names its texts by key and column. Rows are grouped
inside the Arrow batch they come from, so building shuffles packed lists and not
words; a common term's rows are dealt to several files.

A search reads only the folders of its terms. The rows of a batch of texts meet as
they are packed, each term once for all phrases; a text holds a phrase where all
its terms' positions, shifted back by their place in the phrase, meet.

Defined results: texts are folded and cut into runs of letters and digits; null
and empty texts have no rows; a phrase without such a run is found nowhere; a word
may be repeated in a phrase; equal phrases are answered each; records are told
apart by their key, rows of one key must be one; a task that runs again must read
its rows in the same order, as from files.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..functions import text as tx
from ..storage import scratch

#: Bytes of text behind one folder of the index; folders at least and at most.
FOLDER_BYTES = 64 << 20
FEWEST, MOST = 8, 4096
#: Files among which one term's rows are dealt.
SPREAD = 8
#: Words of all phrases of one search.
PHRASE_WORDS = 100_000


def _coded(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whole numbers as bytes, seven bits each, the last one below 128; and their ends."""
    sizes = 1 + sum((values >= 1 << 7 * i).astype(np.int64) for i in range(1, 5))
    ends = np.cumsum(sizes)
    out = np.empty(int(sizes.sum()), np.uint8)
    for i in range(5):
        held = sizes > i
        out[(ends - sizes)[held] + i] = (values[held] >> 7 * i & 127) | (sizes[held] > i + 1) * 128
    return out, ends


def _decoded(data: bytes) -> np.ndarray:
    """The numbers of ``_coded``."""
    coded = np.frombuffer(data, np.uint8)
    starts = np.flatnonzero(np.concatenate([[True], coded[:-1] < 128]))
    places = np.arange(len(coded)) - np.repeat(starts, np.diff(np.append(starts, len(coded))))
    return np.add.reduceat((coded & 127).astype(np.int64) << 7 * places, starts)


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, field, tokens) as a row a batch, its keys and fields, and a row a
    term and batch: how many texts hold it, which ones, how often each, and where."""
    number = TaskContext.get().partitionId() << 32
    for batch in batches:
        tokens, n = batch.column(2), batch.num_rows
        ends = np.asarray(tokens.offsets).astype(np.int64)
        sizes = np.diff(ends)
        words = tokens.flatten().dictionary_encode()
        if not len(words):
            continue
        row = np.repeat(np.arange(n), sizes)
        at = np.arange(len(words)) - np.repeat(ends[:-1] - ends[0], sizes)
        group = np.asarray(words.indices).astype(np.int64) * n + row
        order = np.argsort(group, kind="stable")
        group, at = group[order], at[order]
        first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        gaps = np.diff(at, prepend=0)
        gaps[first] = at[first]
        of, rows = np.divmod(group[first], n)
        starts = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))  # of each term, among its texts
        apart = np.diff(rows, prepend=0)
        apart[starts] = rows[starts]
        counts = np.diff(np.append(first, len(at)))
        owner = np.concatenate([of[starts], of, of, group // n])
        order = np.argsort(owner, kind="stable")
        coded, ends = _coded(np.concatenate([np.diff(np.append(starts, len(of))), apart, counts, gaps])[order])
        cuts = np.concatenate([[0], ends[np.flatnonzero(np.diff(owner[order], append=-1))]]).astype(np.int32)
        terms = len(starts)
        packed = pa.Array.from_buffers(pa.binary(), terms, [None, pa.py_buffer(cuts), pa.py_buffer(coded)])
        one = lambda i: pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), batch.column(i))
        here = pa.array(np.full(terms, number))
        named = {"term": pa.nulls(1, pa.string()), "batch": here[:1], "keys": one(0), "fields": one(1), "packed": pa.nulls(1, pa.binary())}
        yield pa.record_batch(named)
        yield pa.record_batch({"term": words.dictionary.take(pa.array(of[starts])), "batch": here, "keys": pa.nulls(terms, named["keys"].type), "fields": pa.nulls(terms, named["fields"].type), "packed": packed})
        number += 1


def positions(rows: DataFrame, key: str, columns: dict[str, Column]) -> DataFrame:
    """term, batch, keys, fields (places among ``columns``), packed: a row an Arrow
    batch with its keys and fields, and a row a term and batch with what is packed."""
    texts = F.explode(F.array(*[F.struct(F.lit(i).cast("tinyint").alias("field"), tx.tokens(F.coalesce(text, F.lit(""))).alias("tokens")) for i, text in enumerate(columns.values())])).alias("t")
    slim = rows.select(F.col(key).alias("key"), texts).select("key", "t.field", "t.tokens")
    return slim.mapInArrow(_grouped, f"term string, batch bigint, keys array<{rows.schema[key].dataType.simpleString()}>, fields array<tinyint>, packed binary")


def folders_for(rows: DataFrame, columns: dict[str, Column]) -> int:
    """Folders of an index over ``rows``: they follow the size of its texts."""
    size = rows.agg(sum((F.coalesce(F.sum(F.octet_length(c)), F.lit(0)) for c in columns.values()), F.lit(0))).first()[0]
    return min(MOST, max(FEWEST, math.ceil(size / FOLDER_BYTES)))


def _folder(term: Column, folders: int) -> Column:
    """The folder of a term; what is no term has one of its own."""
    return F.when(term.isNull(), folders).otherwise(F.pmod(F.xxhash64(term), F.lit(folders)).cast("int"))


def write_index(rows: DataFrame, key: str, columns: dict[str, Column], path: str | None = None) -> str:
    """Write the index of ``columns`` (name to text) and return its place."""
    path = path or scratch(rows.sparkSession, "phrases")
    folders = folders_for(rows, columns)
    found = positions(rows, key, columns).withColumn("folder", _folder(F.col("term"), folders))
    # a common term comes once a batch of texts: its rows are dealt by their batch
    dealt = found.repartition("folder", F.pmod(F.xxhash64("batch"), F.lit(SPREAD))).sortWithinPartitions("folder", "term")
    dealt.write.partitionBy("folder").parquet(f"{path}/rows")
    rows.sparkSession.createDataFrame([(folders, list(columns))], "folders int, columns array<string>").coalesce(1).write.parquet(f"{path}/about")
    return path


def _held(phrases: list[list[str]], kind: pa.Schema):
    """A function of the index rows of a batch: (phrase, key, field, starts) of its texts."""

    def places(data: bytes) -> np.ndarray:
        """Text and position of each occurrence, as one ascending number."""
        values = _decoded(data)
        n = values[0]
        texts, counts, gaps = np.cumsum(values[1 : n + 1]), values[n + 1 : 2 * n + 1], values[2 * n + 1 :]
        upto = np.concatenate([[0], np.cumsum(gaps)])
        return np.repeat((texts << 32) - upto[np.cumsum(counts) - counts], counts) + upto[1:]

    def held(rows: pa.Table) -> pa.Table:
        known, keys, fields = {}, None, None
        for term, own, columns, packed in zip(*(rows.column(c) for c in ("term", "keys", "fields", "packed"))):
            if term.is_valid:
                known[term.as_py()] = places(packed.as_py())
            else:
                keys, fields = own.values, columns.values
        which, sizes, texts, starts = [], [], [], []
        for number, words in enumerate(phrases):
            if not all(w in known for w in words):
                continue
            rarest, *others = sorted(((known[w], place) for place, w in enumerate(words)), key=lambda x: len(x[0]))
            at = rarest[0] - rarest[1]
            for other, place in others:
                near = np.searchsorted(other, at + place)
                at = at[other[np.minimum(near, len(other) - 1)] == at + place]
            if len(at):
                text = at >> 32
                first = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
                which.append(np.full(len(first), number, np.int32))
                sizes.append(np.diff(np.append(first, len(at))))
                texts.append(text[first])
                starts.append((at & 0xFFFFFFFF).astype(np.int32))
        if not which:
            return kind.empty_table()
        of, ends = pa.array(np.concatenate(texts)), np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int32)
        return pa.table([pa.array(np.concatenate(which)), keys.take(of), fields.take(of), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(starts)))], schema=kind)

    return held


def search(spark: SparkSession, index: str, phrases: DataFrame) -> DataFrame:
    """phrase_id, key, field, starts (ascending) of every text that holds a phrase;
    ``phrases``: phrase_id, phrase, ``PHRASE_WORDS`` words together at most."""
    folders, names = spark.read.parquet(f"{index}/about").first()
    words = phrases.select("phrase_id", tx.tokens(F.coalesce("phrase", F.lit(""))).alias("words")).withColumn("i", F.monotonically_increasing_id())
    asked = words.select("i", "phrase_id", F.posexplode("words").alias("place", "term")).select("i", "phrase_id", "place", "term", _folder(F.col("term"), folders).alias("folder")).limit(PHRASE_WORDS + 1).collect()
    if len(asked) > PHRASE_WORDS:
        raise ValueError(f"a search takes {PHRASE_WORDS} words at a time; search in parts")
    said: dict[int, tuple] = {}
    for r in sorted(asked, key=lambda r: (r["i"], r["place"])):
        said.setdefault(r["i"], (r["phrase_id"], []))[1].append(r["term"])
    distinct = list(dict.fromkeys(tuple(w) for _, w in said.values()))
    number = {w: i for i, w in enumerate(distinct)}
    ids = spark.createDataFrame([(number[tuple(w)], k) for k, w in said.values()], StructType([StructField("number", IntegerType()), phrases.schema["phrase_id"]]))
    kept = sorted({r["folder"] for r in asked}) + [folders]
    rows = spark.read.parquet(f"{index}/rows").where(F.col("folder").isin(kept) & (F.col("term").isNull() | F.col("term").isin(sorted({r["term"] for r in asked}))))
    schema = f"number int, key {dict(rows.dtypes)['keys'][6:-1]}, field tinyint, starts array<int>"
    kind = spark.createDataFrame([], schema).toArrow().schema
    hits = rows.drop("folder").groupBy("batch").applyInArrow(_held(distinct, kind), schema)
    field = F.element_at(F.array(*map(F.lit, names)), F.col("field").cast("int") + 1).alias("field")
    return hits.join(F.broadcast(ids), "number").select("phrase_id", "key", field, "starts")
