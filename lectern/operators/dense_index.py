"""An inverted file with residual product codes for vector search.

Cells are k-means centroids of the unit vectors; a row lies in the folder of its
nearest cell with a code of its residual, one byte a slice of the vector. Cells and
code books are fitted on at most ``SAMPLE_ROWS`` rows, the first by a hash of their
keys; every row is indexed. Rows of a crowded cell are dealt to several files.

How many cells a search opens (``probes``) and how many rows it scores exactly
(``rerank``) is measured while building: ``TRIED`` rows of the sample ask for their
ten nearest in the sample, and both numbers are taken so that ``SHARE`` of those
would be found.

A search takes queries in blocks of ``QUERY_BLOCK``, fewer where many rows are kept a query: the block's nearest cells are
the only folders that are read, their codes are scored by tables of the query's
products with the code books, and each task keeps the ``rerank`` best of a query.
The best of all tasks are joined with their vectors and scored exactly, so a
returned score is exact and only a missed row is an error; recall is measured in
tests. ``retrieval.top_k_of_queries`` is the exact way over all rows.

Defined results: vectors that are null, of another length than the first row's, of
length zero or hold a null or a component that is not finite are not indexed and
ask nothing; ties go to the smaller key; a query's own key is left out; fewer
probed rows than k give a shorter list; an empty index gives no rows.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import scratch

#: Rows that cells and code books are fitted on, at most.
SAMPLE_ROWS = 32_768
#: Cells at most; below, about the root of the number of rows.
MOST_CELLS = 4096
#: Components behind one byte of a code, and k-means rounds.
SLICE, ROUNDS = 4, 12
#: Rows that ask while building, how many neighbours, and the share to be found.
TRIED, NEIGHBOURS, SHARE = 128, 10, 0.98
#: Files among which a cell's rows are dealt, and queries searched at a time.
SPREAD, QUERY_BLOCK = 4, 4096
#: Rows that a task holds for the queries of a block, and bytes of products sent to it.
HELD_ROWS, SENT_BYTES = 2_000_000, 64 << 20


def _matrix(column, dim: int | None) -> tuple[np.ndarray, np.ndarray]:
    """(rows that count, as unit vectors; which rows these are)."""
    column = column.cast(pa.list_(pa.float64()))
    ends = np.asarray(column.offsets).astype(np.int64)
    values = np.asarray(column.values.to_numpy(zero_copy_only=False), dtype=np.float64)
    sizes = np.diff(ends)
    dim = dim or int(sizes[0]) if len(sizes) else 0
    whole = np.flatnonzero((sizes == dim) & np.asarray(column.is_valid()))
    rows = values[(ends[whole, None] + np.arange(dim)).ravel()].reshape(len(whole), dim)
    norms = np.sqrt((rows * rows).sum(axis=1))
    good = np.isfinite(norms) & (norms > 0)
    return rows[good] / norms[good, None], whole[good]


def _nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = (centres * centres).sum(axis=1) / 2
    return np.concatenate([np.argmax(rows[at : at + 8192] @ centres.T - half, axis=1) for at in range(0, len(rows), 8192)]) if len(rows) else np.empty(0, dtype=np.int64)


def k_means(rows: np.ndarray, k: int) -> np.ndarray:
    """``k`` centres at most (as many as there are different rows)."""
    different = np.unique(rows, axis=0)
    rng = np.random.default_rng(0)
    centres = different[rng.permutation(len(different))[:k]]
    for _ in range(ROUNDS):
        own = _nearest(rows, centres)
        sizes = np.bincount(own, minlength=len(centres))
        sums = np.stack([np.bincount(own, weights=column, minlength=len(centres)) for column in rows.T], axis=1)
        centres = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], centres)
    return centres


@dataclass
class Books:
    """Cells and the code book of each slice of a residual."""

    cells: np.ndarray
    codes: list[np.ndarray]
    probes: int = 1
    rerank: int = 1

    @classmethod
    def fit(cls, sample: np.ndarray, n_rows: int) -> Books:
        cells = k_means(sample, int(min(MOST_CELLS, max(1, math.isqrt(n_rows)))))
        rest = sample - cells[_nearest(sample, cells)]
        books = cls(cells, [k_means(rest[:, at : at + SLICE], 256) for at in range(0, sample.shape[1], SLICE)])
        books._measure(sample, n_rows)
        return books

    def _measure(self, sample: np.ndarray, n_rows: int) -> None:
        """``probes`` and ``rerank`` by what rows of the sample would need."""
        own, codes = self.encode(sample)
        opened, scored = [1], [1]
        for q in sample[:TRIED]:
            near = np.argsort(-(sample @ q), kind="stable")[: NEIGHBOURS + 1]  # the row itself among them
            place = np.empty(len(self.cells), dtype=np.int64)
            place[np.argsort(-(self.cells @ q), kind="stable")] = np.arange(1, len(self.cells) + 1)
            opened += place[own[near]].tolist()
            about = (self.cells @ q)[own] + sum(t[0][codes[:, i]] for i, t in enumerate(self.tables(q[None])))
            scored += (1 + (about[None, :] > about[near, None]).sum(axis=1)).tolist()
        self.probes = int(np.quantile(opened, SHARE, method="higher"))
        self.rerank = max(4 * NEIGHBOURS, math.ceil(np.quantile(scored, SHARE, method="higher") * n_rows / len(sample)))

    @property
    def dim(self) -> int:
        return self.cells.shape[1]

    def encode(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = _nearest(rows, self.cells)
        rest = rows - self.cells[own]
        codes = [_nearest(rest[:, i * SLICE : (i + 1) * SLICE], book) for i, book in enumerate(self.codes)]
        return own, np.stack(codes, axis=1).astype(np.uint8)

    def tables(self, queries: np.ndarray) -> list[np.ndarray]:
        """Products of the queries' slices with every entry of each book."""
        return [queries[:, i * SLICE : (i + 1) * SLICE] @ book.T for i, book in enumerate(self.codes)]

    def to_json(self) -> str:
        return json.dumps({"cells": self.cells.tolist(), "codes": [c.tolist() for c in self.codes], "probes": self.probes, "rerank": self.rerank})

    @classmethod
    def from_json(cls, text: str) -> Books:
        read = json.loads(text)
        return cls(np.array(read["cells"]), [np.array(c) for c in read["codes"]], read["probes"], read["rerank"])


def build(rows: DataFrame, key: str, vector: str, path: str | None = None) -> str | None:
    """Index ``rows`` and return its place (None: no row counts)."""
    path = path or scratch(rows.sparkSession, "dense_index")
    slim = rows.select(F.col(key).cast("bigint").alias("key"), F.col(vector).cast("array<double>").alias("vector")).where("key is not null and vector is not null and size(vector) > 0")
    n = slim.count()
    sample = slim.orderBy(F.xxhash64("key"), "key").limit(SAMPLE_ROWS).select("vector").toArrow().column(0).combine_chunks() if n else None
    fitted = _matrix(sample, None)[0] if n else np.empty((0, 0))
    if not len(fitted):
        return None
    books = Books.fit(fitted, n)
    sent = rows.sparkSession.sparkContext.broadcast(books)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit, at = _matrix(batch.column(1), sent.value.dim)
            if len(at):
                cell, codes = sent.value.encode(unit)
                lists = pa.FixedSizeListArray.from_arrays(pa.array(unit.ravel()), unit.shape[1]).cast(pa.list_(pa.float64()))
                yield pa.record_batch({"key": batch.column(0).take(pa.array(at)), "cell": pa.array(cell.astype(np.int32)), "code": pa.array([c.tobytes() for c in codes], pa.binary()), "vector": lists})

    coded = slim.mapInArrow(encode, "key bigint, cell int, code binary, vector array<double>")
    coded.repartition("cell", F.pmod(F.xxhash64("key"), F.lit(SPREAD))).write.partitionBy("cell").parquet(f"{path}/rows")
    rows.sparkSession.createDataFrame([(books.to_json(),)], "books string").coalesce(1).write.parquet(f"{path}/books")
    return path


def _probed(books: Books, queries: np.ndarray, probes: int) -> np.ndarray:
    probes = min(probes, len(books.cells))
    return np.argpartition(-(queries @ books.cells.T), probes - 1, axis=1)[:, :probes]


def _candidates(scanned: DataFrame, books: Books, ids: np.ndarray, queries: np.ndarray, probed: np.ndarray, rerank: int) -> DataFrame:
    """query_id, key, cell, about: the best rows of each task by their codes."""
    asking: dict[int, np.ndarray] = {int(c): np.flatnonzero((probed == c).any(axis=1)) for c in np.unique(probed)}
    sent = scanned.sparkSession.sparkContext.broadcast((ids, queries @ books.cells.T, books.tables(queries), asking))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, to_cells, tables, asking = sent.value
        best: dict[int, list[np.ndarray]] = {}

        def keep(q: int) -> np.ndarray:
            found = np.concatenate(best[q])
            if len(found) > rerank:
                found = found[np.lexsort((found["key"], -found["about"]))[:rerank]]
            best[q] = [found]
            return found

        for batch in batches:
            keys, cells = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            codes = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.uint8).reshape(len(keys), len(tables))
            for cell in np.unique(cells).tolist():
                at = np.flatnonzero(cells == cell)
                for q in asking.get(cell, ()):
                    about = to_cells[q, cell] + sum(table[q][codes[at, i]] for i, table in enumerate(tables))
                    rows = at[keys[at] != ids[q]]
                    hits = np.empty(len(rows), dtype=[("key", np.int64), ("cell", np.int32), ("about", np.float64)])
                    hits["key"], hits["cell"], hits["about"] = keys[rows], cell, about[keys[at] != ids[q]]
                    best.setdefault(int(q), []).append(hits)
                    if sum(map(len, best[int(q)])) > 2 * rerank:
                        keep(int(q))
        for q in best:
            found = keep(q)
            if len(found):
                yield pa.record_batch({"query_id": pa.array(np.full(len(found), ids[q])), "key": pa.array(found["key"]), "cell": pa.array(found["cell"]), "about": pa.array(found["about"])})

    return scanned.select("key", "code", "cell").mapInArrow(score, "query_id bigint, key bigint, cell int, about double")


def search(spark: SparkSession, index: str | None, queries: DataFrame, key: str, vector: str, k: int, probes: int | None = None, rerank: int | None = None) -> DataFrame:
    """query_id, rank, key, score: about the ``k`` rows of the highest cosine with
    each query; ``probes`` and ``rerank`` as measured unless given."""
    schema = "query_id bigint, rank int, key bigint, score double"
    if index is None:
        return spark.createDataFrame([], schema)
    books = Books.from_json(spark.read.parquet(f"{index}/books").first()["books"])
    probes, rerank = probes or books.probes, rerank or max(k, books.rerank)
    rows = spark.read.schema("key bigint, code binary, vector array<double>, cell int").parquet(f"{index}/rows")
    asked = queries.select(F.col(key).cast("bigint").alias("key"), F.col(vector).cast("array<double>").alias("vector")).where("key is not null and vector is not null and size(vector) > 0")
    folder = scratch(spark, "dense_hits")
    spark.createDataFrame([], schema.replace("rank int, ", "")).write.parquet(folder)
    for ids, matrix in _blocks(asked, books.dim, _block_of(books, rerank)):
        probed = _probed(books, matrix, probes)
        scanned = rows.where(F.col("cell").isin(np.unique(probed).tolist()))
        w = Window.partitionBy("query_id").orderBy(F.desc("about"), "key")
        best = _candidates(scanned, books, ids, matrix, probed, rerank).withColumn("place", F.row_number().over(w)).where(F.col("place") <= rerank)
        local = spark.createDataFrame(list(zip(ids.tolist(), matrix.tolist())), "query_id bigint, asked array<double>")
        exact = scanned.select("key", "cell", "vector").join(best.select("query_id", "key", "cell"), ["cell", "key"]).join(F.broadcast(local), "query_id")
        product = F.aggregate(F.zip_with("vector", "asked", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
        exact.select("query_id", "key", product.alias("score")).write.mode("append").parquet(folder)
    found = spark.read.parquet(folder)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "key")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "key", "score")


def _block_of(books: Books, rerank: int) -> int:
    """Queries of a block: what a task holds for them does not grow with the rows."""
    products = 8 * (len(books.cells) + sum(map(len, books.codes)))
    return max(1, min(QUERY_BLOCK, HELD_ROWS // (2 * rerank), SENT_BYTES // products))


def _blocks(asked: DataFrame, dim: int, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Queries, ``size`` at a time."""
    ids, rows = [], []
    for r in asked.toLocalIterator():
        ids.append(r["key"])
        rows.append(r["vector"])
        if len(ids) == size:
            yield from _unit(ids, rows, dim)
            ids, rows = [], []
    yield from _unit(ids, rows, dim)


def _unit(ids: list[int], rows: list, dim: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    matrix, at = _matrix(pa.array(rows, pa.list_(pa.float64())), dim)
    if len(at):
        yield np.array(ids, dtype=np.int64)[at], matrix
