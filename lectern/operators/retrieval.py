"""Retrieval: postings, BM25, dense search, fusion, deduplication of hits."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.vectors import dot
from ..storage import materialise, scratch
from .slices import slices

K1, B = 1.2, 0.75
IDF_FLOOR = 1e-6
RRF_K = 60
#: Queries that are compared with a chunk of rows at a time, and rows of a chunk.
QUERY_BLOCK, ROW_CHUNK = 500, 50_000


def postings(docs: DataFrame, key: str, columns: dict[str, float]) -> DataFrame:
    """(key, term, wtf, len): the weighted term frequency over the text columns and
    the tokens of the whole row. Rows are told apart by their key, so a row's terms
    are counted in its Arrow batch and nothing is shuffled."""
    weights = list(map(float, columns.values()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            lists = batch.columns[1:]
            sizes = [np.diff(np.asarray(x.offsets)) for x in lists]
            words = pa.chunked_array([x.flatten() for x in lists]).combine_chunks().dictionary_encode()
            terms = words.dictionary
            if not len(terms):
                continue
            row = np.concatenate([np.repeat(np.arange(batch.num_rows), n) for n in sizes])
            weight = np.concatenate([np.full(int(n.sum()), w) for n, w in zip(sizes, weights)])
            group, of = np.unique(row * len(terms) + np.asarray(words.indices), return_inverse=True)
            rows, found = np.divmod(group, len(terms))
            yield pa.record_batch({"key": batch.column(0).take(pa.array(rows)), "term": terms.take(pa.array(found)), "wtf": pa.array(np.bincount(of, weight)), "len": pa.array(sum(sizes)[rows].astype(np.int32))})

    tokenised = docs.select(key, *[tx.tokens(F.coalesce(F.col(c), F.lit(""))).alias(f"_t{i}") for i, c in enumerate(columns)])
    found = tokenised.mapInArrow(run, f"key {docs.schema[key].dataType.simpleString()}, term string, wtf double, len int")
    return found.withColumnRenamed("key", key)


def corpus_size(docs: DataFrame, columns: list[str]) -> DataFrame:
    """One row: number of rows and average tokens of a row."""
    n = sum((F.size(tx.tokens(F.coalesce(F.col(c), F.lit("")))) for c in columns), F.lit(0))
    return docs.agg(F.count("*").alias("n_docs"), F.avg(n).alias("avg_len"))


def query_terms(text: str, most: int = 12) -> list[str]:
    """Distinct folded content words of a query, in order (driver side: a query is a parameter)."""
    import re

    folded = text.lower().translate(str.maketrans(tx.ACCENTED, tx.PLAIN))
    words = dict.fromkeys(w for w in re.findall(r"[^\W_]+", folded) if w not in tx.STOPWORDS)
    return list(words)[:most]


def _occurrences(words: Column, term: str, prefix: bool = False) -> Column:
    return F.size(F.filter(words, lambda x: F.startswith(x, F.lit(term)) if prefix else x == term))


def term_counts(docs: DataFrame, key: str, columns: dict[str, float], terms: list[str], prefix: bool = False) -> DataFrame:
    """(key, len, tf0 … or pf0 … with prefixes, and those of each column): every
    text is tokenised once, and the slim result is written, since statistics and
    hits both read it."""
    words = {c: f"_w{i}" for i, c in enumerate(columns)}
    tokenised = docs.select(key, *[tx.tokens(F.coalesce(F.col(c), F.lit(""))).alias(w) for c, w in words.items()])
    # the queries' words only: what counts below reads short arrays
    meant = lambda x: _any([F.startswith(x, F.lit(q)) for q in terms] if prefix else [x.isin(*terms)])
    length = sum((F.size(w) for w in words.values()), F.lit(0))
    slim = tokenised.select(key, length.alias("len"), *[F.size(w).alias(f"len_{c}") for c, w in words.items()], *[F.filter(w, meant).alias(w) for w in words.values()])
    counts = [(f"tf{i}_{c}", _occurrences(F.col(w), q)) for i, q in enumerate(terms) for c, w in words.items()]
    counts += [(f"pf{i}_{c}", _occurrences(F.col(w), q, True)) for i, q in enumerate(terms) for c, w in words.items() if prefix]
    weighted = [(f"{kind}{i}", sum((F.lit(float(columns[c])) * F.col(f"{kind}{i}_{c}") for c in columns), F.lit(0.0))) for kind in ("tf", "pf")[: 1 + prefix] for i in range(len(terms))]
    own = materialise(slim, "term_counts")
    return own.select(key, "len", *[f"len_{c}" for c in columns], *[v.cast("double").alias(n) for n, v in counts]).select("*", *[v.alias(n) for n, v in weighted])


def _any(conditions: list[Column]) -> Column:
    return functools.reduce(Column.__or__, conditions, F.lit(False))


def scored(rows: DataFrame, key: str, n_terms: int, counts: str = "tf", every: bool = False) -> DataFrame:
    """(key, score): BM25 of the rows of ``term_counts`` with any term, or every one."""
    tf = [F.col(f"{counts}{i}") for i in range(n_terms)]
    stats = rows.agg(F.count("*").alias("n_docs"), F.avg("len").alias("avg_len"), *[F.count_if(f > 0).alias(f"n{i}") for i, f in enumerate(tf)])
    joined = rows.where(_any([f > 0 for f in tf])).join(F.broadcast(stats))  # one row of statistics
    score, all_hit = F.lit(0.0), F.lit(True)
    for i, f in enumerate(tf):
        weight = idf(F.col("n_docs"), F.col(f"n{i}"))
        score = score + F.when(f > 0, weight * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))).otherwise(0.0)
        all_hit = all_hit & (f > 0)
    return joined.where(all_hit if every else F.lit(True)).select(key, score.alias("score"))


def bm25(docs: DataFrame, key: str, columns: dict[str, float], terms: list[str], prefix: bool = False, every: bool = False) -> DataFrame:
    """(key, score) of rows that match: any term, or ``every`` one; ``prefix``
    lets a term match the beginning of words. For many queries over one table
    build a ``search_index`` instead."""
    return scored(term_counts(docs, key, columns, terms, prefix), key, len(terms), "pf" if prefix else "tf", every)


def rescore(rows: DataFrame, key: str, columns: dict[str, float], length_column: str, terms: list[str], idf_floor: float = 0.1) -> DataFrame:
    """BM25 over a candidate set with smoothed idf; only ``length_column`` is normalised by length."""
    base = term_counts(rows, key, columns, terms).withColumn("len", F.col(f"len_{length_column}"))
    seen = lambda i: sum((F.col(f"tf{i}_{c}") for c in columns), F.lit(0.0)) > 0
    stats = base.agg(F.count("*").alias("n_docs"), F.greatest(F.avg("len"), F.lit(1e-9)).alias("avg_len"), *[F.count_if(seen(i)).alias(f"n{i}") for i in range(len(terms))])
    joined, score = base.join(F.broadcast(stats)), F.lit(0.0)  # one row of statistics
    norm = K1 * (1 - B + B * F.col("len") / F.col("avg_len"))
    for i in range(len(terms)):
        n = F.col(f"n{i}")
        weight = F.greatest(F.lit(idf_floor), F.log(1 + (F.col("n_docs") - n + 0.5) / (n + 0.5)))
        for c, w in columns.items():
            f = F.col(f"tf{i}_{c}")
            score = score + F.when(f > 0, weight * w * f * (K1 + 1) / (f + (norm if c == length_column else F.lit(K1)))).otherwise(0.0)
    return joined.select(key, score.alias("score")).where("score > 0")


def top(hits: DataFrame, key: str, k: int) -> DataFrame:
    """The k best with their rank from 1, ties by key. The limit is taken per
    partition first; only k rows reach the one that ranks them."""
    best = hits.orderBy(F.desc("score"), key).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), key)).cast("bigint"))


def dense(rows: DataFrame, key: str, vector: str, wanted: DataFrame, least: float | None = None) -> DataFrame:
    """(key, score): product of every vector with the one of ``wanted`` (one row)."""
    q = F.broadcast(wanted.select(F.col(vector).alias("_q")).limit(1))
    out = rows.join(q).select(key, dot(F.col(vector), F.col("_q")).alias("score"))
    return out if least is None else out.where(F.col("score") >= least)


def top_k_of_queries(queries: DataFrame, rows: DataFrame, key: str, vector: str, k: int, block: int = QUERY_BLOCK, chunk: int = ROW_CHUNK) -> DataFrame:
    """(query, found, score, rank): the k nearest rows of each query, itself
    excluded. The queries are written to the shared folder; a task gathers a
    ``chunk`` of its rows and reads the queries past them, ``block`` vectors at a
    time, so neither the driver nor a plan holds them and the rows are scanned once.
    What is shuffled is k rows a query and chunk."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.dataset as ds
    import pyarrow.fs as pafs

    folder = scratch(rows.sparkSession, "queries")
    queries.select(F.col(key).cast("bigint").alias("query"), F.col(vector).cast("array<double>").alias("v")).write.parquet(folder)

    def matrix(column: pa.ListArray) -> np.ndarray:
        return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)

    def nearest(own: np.ndarray, data: np.ndarray):
        fs, path = pafs.FileSystem.from_uri(folder)
        m = min(k + 1, len(own))  # the row itself may be among them
        for batch in ds.dataset(path, format="parquet", filesystem=fs).to_batches(batch_size=block):
            if not batch.num_rows:
                continue
            ids = batch.column("query").to_numpy()
            scores = matrix(batch.column("v")) @ data.T
            scores[ids[:, None] == own[None, :]] = -np.inf
            # ties at the edge: take every row that scores as the last
            edge = np.partition(scores, len(own) - m, axis=1)[:, len(own) - m]
            q, r = np.nonzero((scores >= edge[:, None]) & np.isfinite(scores))
            yield pa.record_batch([pa.array(ids[q]), pa.array(own[r]), pa.array(scores[q, r])], names=["query", "found", "score"])

    def run(batches):
        ids, vectors, held = [], [], 0
        for batch in batches:
            if batch.num_rows:
                ids.append(batch.column(0).to_numpy())
                vectors.append(matrix(batch.column(1)))
                held += batch.num_rows
            if held >= chunk:
                yield from nearest(np.concatenate(ids), np.concatenate(vectors))
                ids, vectors, held = [], [], 0
        if held:
            yield from nearest(np.concatenate(ids), np.concatenate(vectors))

    out = rows.select(F.col(key).cast("bigint").alias(key), F.col(vector).cast("array<double>").alias(vector)).mapInArrow(run, "query bigint, found bigint, score double")
    w = Window.partitionBy("query").orderBy(F.desc("score"), "found")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def fuse(legs: list[tuple[DataFrame, float]], key: str) -> DataFrame:
    """Reciprocal rank fusion of ranked legs: sum of weight / (60 + rank)."""
    union = None
    for leg, weight in legs:
        part = leg.select(key, (F.lit(float(weight)) / (RRF_K + F.col("rank"))).alias("s"))
        union = part if union is None else union.unionByName(part)
    return union.groupBy(key).agg(F.sum("s").alias("score"))


def best_per_group(hits: DataFrame, group: list[str], key: str, others: int = 3) -> DataFrame:
    """The best hit of each group; the keys of the next ``others`` as ``also``, the rest counted in ``more``."""
    w = Window.partitionBy(*group).orderBy(F.desc("score"), key)
    ranked = hits.withColumn("_k", F.row_number().over(w))
    also = F.array_sort(F.collect_list(F.when((F.col("_k") > 1) & (F.col("_k") <= others + 1), F.struct("_k", key))))
    g = ranked.groupBy(*group).agg(F.min_by(key, "_k").alias(key), F.max("score").alias("score"), F.transform(also, lambda x: x[key]).alias("also"), F.count("*").alias("_n"))
    return g.withColumn("more", F.greatest(F.col("_n") - 1 - others, F.lit(0)).cast("bigint")).drop("_n")


def ladder(docs: DataFrame, key: str, columns: dict[str, float], terms: list[str]) -> DataFrame:
    """Hits of the first rung that has any: all terms, all terms as prefixes, any
    term. All rungs read the same counts."""
    counts, n = term_counts(docs, key, columns, terms, prefix=True), len(terms)
    rungs = [scored(counts, key, n, "tf", True), scored(counts, key, n, "pf", True), scored(counts, key, n)]
    union = functools.reduce(DataFrame.unionByName, [rung.withColumn("rung", F.lit(i)) for i, rung in enumerate(rungs)])
    first = union.agg(F.min("rung").alias("rung"))  # one row
    return union.join(F.broadcast(first), "rung")


#: Partitions of a written index by a hash of the term.
INDEX_PARTS = 64


def search_index(docs: DataFrame, key: str, columns: dict[str, float], folder: str | None = None, parts: int = INDEX_PARTS) -> str:
    """Write an inverted index of the text columns and return its folder:
    ``postings`` (term, key, wtf, len) in ``parts`` folders by a hash of the term,
    sorted by term, and ``stats`` (n_docs, avg_len). A search reads the folders of
    its terms, and in them the row groups that hold them."""
    folder = folder or scratch(docs.sparkSession, "index")
    rows = postings(docs, key, columns).withColumn("part", F.pmod(F.xxhash64("term"), F.lit(parts)).cast("int"))
    rows.repartition("part", F.pmod(F.xxhash64(key), F.lit(8))).sortWithinPartitions("part", "term", key).write.partitionBy("part").parquet(f"{folder}/postings")
    own = docs.select(sum((F.size(tx.tokens(F.coalesce(F.col(c), F.lit("")))) for c in columns), F.lit(0)).alias("len"))
    own.agg(F.count("*").alias("n_docs"), F.avg("len").alias("avg_len")).write.parquet(f"{folder}/stats")
    return folder


def searched(spark: SparkSession, folder: str, key: str, terms: list[str], every: bool = False, parts: int = INDEX_PARTS) -> DataFrame:
    """(key, score): BM25 from a written index, of rows with any term or every one."""
    places = spark.range(1).select(F.explode(F.array(*map(F.lit, terms))).alias("term")).select(F.pmod(F.xxhash64("term"), F.lit(parts)).cast("int").alias("part"))
    wanted = sorted({r["part"] for r in places.collect()})  # a handful of numbers: they prune folders
    found = spark.read.parquet(f"{folder}/postings").where(F.col("part").isin(*wanted) & F.col("term").isin(*terms))
    df = found.groupBy("term").agg(F.count("*").alias("n"))  # a row a term
    stats = spark.read.parquet(f"{folder}/stats")  # one row
    f = F.col("wtf")
    score = idf(F.col("n_docs"), F.col("n")) * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    hits = found.join(F.broadcast(df), "term").join(F.broadcast(stats)).groupBy(key).agg(F.sum(score).alias("score"), F.count("*").alias("terms"))
    return (hits.where(F.col("terms") == len(terms)) if every else hits).select(key, "score")


def idf(n_docs: Column, n: Column) -> Column:
    raw = F.log((n_docs - n + 0.5) / (n + 0.5))
    return F.when(raw > 0, raw).otherwise(F.lit(IDF_FLOOR))


def rrf_score(rank: int, weight: float = 1.0) -> float:
    return weight / (RRF_K + rank)


