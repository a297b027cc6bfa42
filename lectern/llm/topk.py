"""Exact top-k search by tiled matrix products.

Components are made integers (floor(256 x), x as double). Both sides are packed:
candidates into shard rows, queries into blocks, each a matrix with its ids. One
block of queries after the other (``BLOCK_BYTES`` at most) is sent to all tasks;
a task multiplies it with its shards tile by tile, keeps the k best of a tile for
those queries that the tile can still improve, and holds one running list a
query. The lists of the tasks are merged as a tree, ``FAN`` lists at a time, so
neither a task nor the driver ever holds the scores or the lists of all shards.

Products are exact: a tile is multiplied in single precision while the norms
bound every partial sum below 2^24, in double precision below 2^53, and in whole
numbers of any length beyond.

The work is queries times rows, as an exact search has it; the number of tasks
follows the cluster, not the table, so the lists to be merged grow with the
queries alone. A lost executor costs its tasks over written shards.

Defined results: vectors that are null, or hold a null or a component that is not
finite (times 256 too), take no part; vectors are compared with those of the same
length only, those of length 0 score 0 with each other; rows with the query's id
are the query's own, so repeated ids never match each other, and equal rows of
one id ask once while different ones ask each for themselves; a null id asks
nothing and comes last among ties as a candidate; repeated candidates are listed
each; a score beyond a long is the nearest long; an empty table gives no rows;
other columns are ignored. Ids are read as bigint.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, materialise, scratch

SCALE = 256.0
#: Bytes of query components that are sent to all tasks at a time.
BLOCK_BYTES = 16 << 20
#: Rows of a packed shard, and queries that one product takes.
SHARD_ROWS, TILE_QUERIES = 4096, 512
#: Lists of one query that a merge takes at a time.
FAN = 16

_PACKED = "dim int, ids array<bigint>, components binary"
_MOST, _LEAST = (1 << 63) - 1, -(1 << 63)


def _whole(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(components times 256, floored; ends of the rows; whether a row takes part)."""
    column = column.cast(pa.list_(pa.float64()))
    ends = np.asarray(column.offsets).astype(np.int64)
    values = np.asarray(column.values.to_numpy(zero_copy_only=False), dtype=np.float64)
    with np.errstate(over="ignore", invalid="ignore"):
        values = np.floor(values * SCALE) + 0.0  # no negative zero
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])  # a null component is NaN here
    good = (bad[ends[1:]] == bad[ends[:-1]]) & np.asarray(column.is_valid())
    return values, ends, good


def _floored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, vector) that take part, as vectors of floor(256 x) / 256."""
    for batch in batches:
        values, ends, good = _whole(batch.column(1))
        vectors = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values / SCALE))
        yield pa.record_batch({"id": batch.column(0), "vector": vectors}).filter(pa.array(good))


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, vector) as shards: rows of one length, in ascending id order,
    null ids last."""
    waiting: dict[int, list] = {}

    def shard(dim: int, rows: int) -> pa.RecordBatch:
        ids, matrix = [np.concatenate(x) for x in zip(*waiting.pop(dim))]
        if len(ids) > rows:
            waiting[dim] = [(ids[rows:], matrix[rows:])]
            ids, matrix = ids[:rows], matrix[:rows]
        order = np.lexsort((ids["id"], ids["none"]))
        ids, matrix = ids[order], matrix[order]
        ids = pa.array(ids["id"], mask=ids["none"])
        return pa.record_batch({"dim": pa.array([dim], pa.int32()), "ids": pa.array([ids], pa.list_(pa.int64())), "components": pa.array([matrix.tobytes()], pa.binary())})

    for batch in batches:
        if not batch.num_rows:
            continue
        values, ends, good = _whole(batch.column(1))
        known = batch.column(0)
        ids = np.empty(batch.num_rows, dtype=[("id", np.int64), ("none", bool)])
        ids["id"], ids["none"] = known.fill_null(0).to_numpy(), np.asarray(known.is_null())
        dims = np.diff(ends)
        for dim in np.unique(dims[good]).tolist():
            at = np.flatnonzero(good & (dims == dim))
            matrix = values[(ends[at, None] + np.arange(dim)).ravel()].reshape(len(at), dim)
            waiting.setdefault(dim, []).append((ids[at], matrix))
            while sum(len(i) for i, _ in waiting.get(dim, [])) >= SHARD_ROWS:
                yield shard(dim, SHARD_ROWS)
    for dim in list(waiting):
        yield shard(dim, SHARD_ROWS)


def _unpack(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, whether an id is known, matrix) of a packed row."""
    ids = row["ids"]
    known = np.array([i is not None for i in ids], dtype=bool)
    ids = np.array([0 if i is None else i for i in ids], dtype=np.int64)
    return ids, known, np.frombuffer(row["components"], dtype=np.float64).reshape(len(ids), row["dim"])


def _norm(matrix: np.ndarray) -> float:
    return math.sqrt(float(np.max(np.einsum("ij,ij->i", matrix, matrix), initial=0.0))) * (1 + 1e-9)


def products(queries: np.ndarray, rows: np.ndarray, bound: float) -> np.ndarray:
    """All inner products, exact; ``bound``: no partial sum is larger. They come
    as whole numbers in single or double precision, or as longs."""
    if bound < 1 << 24:
        return queries.astype(np.float32) @ rows.astype(np.float32).T
    if bound < 1 << 53:
        return queries @ rows.T
    whole = np.frompyfunc(int, 1, 1)
    exact = whole(queries) @ whole(rows).T
    return np.clip(exact, _LEAST, _MOST).astype(np.int64)


def _best_of_tile(scores: np.ndarray, k: int) -> np.ndarray:
    """Columns of the ``k`` highest scores of each row, ties to the first."""
    n = scores.shape[1]
    if n <= k:
        return np.tile(np.arange(n), (len(scores), 1))
    edge = np.partition(scores, n - k, axis=1)[:, n - k, None]
    above, level = scores > edge, scores == edge
    room = k - above.sum(axis=1, keepdims=True)
    taken = above | (level & (np.cumsum(level, axis=1) <= room))
    return np.nonzero(taken)[1].reshape(len(scores), k)


class Best:
    """The running lists of a block of queries of one length: the ``k`` highest
    scores of each, with the candidates' ids, in no order."""

    def __init__(self, ids: np.ndarray, matrix: np.ndarray, k: int) -> None:
        self.ids, self.matrix, self.k = ids, matrix, k
        self.norm = _norm(matrix)
        shape = (len(ids), k)
        self.scores, self.rows = np.full(shape, _LEAST, dtype=np.int64), np.zeros(shape, dtype=np.int64)
        self.known, self.filled = np.zeros(shape, dtype=bool), np.zeros(shape, dtype=bool)

    def add(self, ids: np.ndarray, known: np.ndarray, matrix: np.ndarray) -> None:
        """A shard: ids ascending, unknown ones last."""
        bound = self.norm * _norm(matrix)
        n_known = int(known.sum())
        for at in range(0, len(self.ids), TILE_QUERIES):
            part = slice(at, at + TILE_QUERIES)
            asked = self.ids[part]
            scores = products(self.matrix[part], matrix, bound)
            first = np.searchsorted(ids[:n_known], asked)
            own = first < np.searchsorted(ids[:n_known], asked, side="right")
            # a list that is full can only gain by a score at its least
            full = self.filled[part].all(axis=1)
            hopeful = ~full | (scores.max(axis=1) >= self.scores[part].min(axis=1))
            plain = np.flatnonzero(hopeful & ~own)
            if len(plain):
                best = _best_of_tile(scores[plain], self.k)
                self._merge(at + plain, scores[plain[:, None], best], ids[best], known[best])
            for q in np.flatnonzero(hopeful & own).tolist():  # rows with the query's own id are left out
                others = np.flatnonzero((ids != asked[q]) | ~known)
                best = others[_best_of_tile(scores[q, others][None], self.k)[0]] if len(others) else others
                self._merge(np.array([at + q]), scores[q, best][None], ids[best][None], known[best][None])

    def _merge(self, queries: np.ndarray, scores: np.ndarray, ids: np.ndarray, known: np.ndarray) -> None:
        scores = scores.astype(np.int64)
        scores = np.concatenate([self.scores[queries], scores], axis=1)
        ids = np.concatenate([self.rows[queries], ids], axis=1)
        filled = np.concatenate([self.filled[queries], np.ones((len(queries), scores.shape[1] - self.k), dtype=bool)], axis=1)
        known = np.concatenate([self.known[queries], known], axis=1)
        # ~score turns the order of longs without an overflow
        order = np.lexsort((ids, ~known, ~scores, ~filled), axis=1)[:, : self.k]
        for mine, new in ((self.scores, scores), (self.rows, ids), (self.known, known), (self.filled, filled)):
            mine[queries] = np.take_along_axis(new, order, axis=1)


def _digests(matrix: np.ndarray) -> list[bytes]:
    """What tells apart the different vectors that one id asks with."""
    return [hashlib.md5(row.tobytes()).digest() for row in matrix]


_LIST = "query_id bigint, vector binary, task int, best array<struct<turned:bigint,none:boolean,vec_id:bigint>>"


def _lists(shards: DataFrame, blocks: list[dict], k: int) -> DataFrame:
    """A row a query and task: its best candidates among the task's shards."""
    sent = shards.sparkSession.sparkContext.broadcast(blocks)
    kind = pa.struct([("turned", pa.int64()), ("none", pa.bool_()), ("vec_id", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        best: dict[int, list[Best]] = {}
        for row in sent.value:
            ids, _, matrix = _unpack(row)
            best.setdefault(row["dim"], []).append(Best(ids, matrix, k))
        for batch in batches:
            for i in range(batch.num_rows):
                shard = batch.slice(i, 1).to_pylist()[0]
                if shard["dim"] in best:
                    ids, known, matrix = _unpack(shard)
                    for lists in best[shard["dim"]]:
                        lists.add(ids, known, matrix)
        task = TaskContext.get().partitionId()
        for found in (b for lists in best.values() for b in lists):
            held = found.filled.ravel()
            ends = np.concatenate([[0], np.cumsum(found.filled.sum(axis=1))]).astype(np.int32)
            none = ~found.known.ravel()[held]
            flat = pa.StructArray.from_arrays([pa.array(~found.scores.ravel()[held]), pa.array(none), pa.array(found.rows.ravel()[held], mask=none)], fields=list(kind))
            n = len(found.ids)
            yield pa.record_batch({"query_id": pa.array(found.ids), "vector": pa.array(_digests(found.matrix), pa.binary()), "task": pa.array(np.full(n, task, dtype=np.int32)), "best": pa.ListArray.from_arrays(pa.array(ends), flat)})

    return map_arrow(shards, run, _LIST)


def _merged(lists: DataFrame, tasks: int, k: int) -> DataFrame:
    """The lists of all tasks as one a query, ``FAN`` at a time."""
    best = F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, k).alias("best")
    while tasks > 1:
        tasks = math.ceil(tasks / FAN)
        lists = lists.groupBy("query_id", "vector", (F.col("task") % tasks).alias("task")).agg(best)
    return lists


def top_k(vectors: DataFrame, queries: DataFrame, k: int, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` rows of ``vectors`` of the highest
    integer inner product with each row of ``queries``, ties to smaller ids."""
    spark = vectors.sparkSession
    tasks = max(2, 2 * spark.sparkContext.defaultParallelism)
    row = [F.col(id_column).cast("bigint").alias("id"), F.col(vector_column).alias("vector")]
    shards = materialise(map_arrow(vectors.select(*row), _pack, _PACKED), "topk_shards")
    asked = map_arrow(queries.select(*row).where("id is not null"), _floored, "id bigint, vector array<double>").distinct()
    packed = materialise(map_arrow(asked, _pack, _PACKED), "topk_queries").withColumn("bytes", F.length("components"))
    folder = scratch(spark, "topk_lists")
    spark.createDataFrame([], _LIST).write.parquet(folder)
    for block in _blocks(packed):
        _lists(shards.coalesce(tasks), block, k).write.mode("append").parquet(folder)
    best = _merged(spark.read.schema(_LIST).parquet(folder), tasks, k).select("query_id", F.posexplode("best").alias("at", "hit"))
    return best.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.bitwise_not("hit.turned").alias("score"))


def _blocks(packed: DataFrame) -> Iterator[list[dict]]:
    """Packed queries in blocks of ``BLOCK_BYTES`` (one packed row at least)."""
    block, held = [], 0
    for row in packed.toLocalIterator():
        if block and held + row["bytes"] > BLOCK_BYTES:
            yield block
            block, held = [], 0
        block.append({"dim": row["dim"], "ids": list(row["ids"]), "components": bytes(row["components"])})
        held += row["bytes"]
    if block:
        yield block


def ids_divisible_by(rows: DataFrame, divisor: int, id_column: str = "vec_id") -> DataFrame:
    return rows.where(F.col(id_column) % divisor == 0)


#: The registered query: its queries and the length of its lists.
DIVISOR, K = 50, 5

ORACLE_SQL = f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
  FROM v AS q JOIN v AS c ON q.vec_id % {DIVISOR} = 0 AND c.vec_id <> q.vec_id AND len(c.e) = len(q.e)
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= {K}
"""
