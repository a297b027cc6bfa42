"""Set operations and deduplication (inventory section G)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import urls
from ..operators import compare, retrieval, similarity, windows
from .registry import query


@query("g1_union_of_ids", "SELECT doc_id, min(leg) AS leg FROM (SELECT doc_id, 1 AS leg FROM documents WHERE contains(text, 'idiot') UNION ALL SELECT doc_id, 2 FROM labels WHERE toxic = 1) GROUP BY doc_id")
def union_of_ids(t):
    own = t.documents.where(F.col("text").contains("idiot")).select("doc_id", F.lit(1).alias("leg"))
    other = t.labels.where("toxic = 1").select("doc_id", F.lit(2).alias("leg"))
    return own.unionByName(other).groupBy("doc_id").agg(F.min("leg").alias("leg"))


@query(
    "g2_fused_candidates",
    """WITH a AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank FROM documents WHERE lang = 'en' QUALIFY rank <= 50), b AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id DESC) AS rank FROM documents WHERE n_chars > 1000 QUALIFY rank <= 50)
    SELECT doc_id, round(sum(s), 6) AS score FROM (SELECT doc_id, 1.0 / (60 + rank) AS s FROM a UNION ALL SELECT doc_id, 1.25 / (60 + rank) FROM b) GROUP BY doc_id""",
)
def fused_candidates(t):
    d = t.documents.select("doc_id", "lang", "n_chars")
    a = retrieval.top(d.where("lang = 'en'").select("doc_id", F.col("n_chars").alias("score")), "doc_id", 50)
    b = retrieval.top(d.where("n_chars > 1000").select("doc_id", F.col("doc_id").alias("score")), "doc_id", 50)
    return retrieval.fuse([(a, 1.0), (b, 1.25)], "doc_id").select("doc_id", F.round("score", 6).alias("score"))


@query("g3_intersection", "SELECT o_custkey AS custkey FROM orders WHERE o_orderstatus = 'P' INTERSECT SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'")
def intersection(t):
    o = t.orders
    return o.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("custkey")).intersect(o.where("o_orderpriority = '1-URGENT'").select("o_custkey"))


@query(
    "g4_line_difference",
    """WITH v AS (SELECT conv_id, list(lower(trim(text)) ORDER BY turn) FILTER (turn < 3) AS a, list(text ORDER BY turn) FILTER (turn >= 2) AS b FROM conversations GROUP BY conv_id)
    SELECT conv_id, coalesce(len(list_filter(b, lambda x: NOT list_contains(a, lower(trim(x))))), 0) AS added FROM v""",
)
def line_difference(t):
    g = t.conversations.groupBy("conv_id").agg(F.collect_list(F.when(F.col("turn") < 3, F.col("text"))).alias("a"), F.collect_list(F.when(F.col("turn") >= 2, F.col("text"))).alias("b"))
    return g.select("conv_id", F.size(compare.added_lines(F.col("a"), F.col("b"), lambda x: F.lower(F.trim(x)))).cast("bigint").alias("added"))


@query("g5_content_hash_dedup", "SELECT doc_id, sha256(text) AS hash, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) = 1 AS kept FROM documents")
def content_hash_dedup(t):
    rows = t.documents.select("doc_id", F.sha2("text", 256).alias("hash"))
    return windows.duplicates_of(rows, ["hash"], [F.asc("doc_id")])


@query("g6_url_dedup", r"SELECT k, min(page_id) AS page_id, count(*) AS n FROM (SELECT page_id, regexp_replace(regexp_extract(url, '^https?://([^?#]*)', 1), '/+$', '') AS k FROM pages) GROUP BY k")
def url_dedup(t):
    rows = t.pages.select("page_id", F.regexp_replace(F.regexp_extract("url", r"^https?://([^?#]*)", 1), "/+$", "").alias("k"))
    return rows.groupBy("k").agg(F.min("page_id").alias("page_id"), F.count("*").alias("n"))


@query(
    "g7_engine_merge",
    r"""WITH r AS (SELECT regexp_extract(url, '^https?://(?:www\.)?([^/?#]+)', 1) AS k, page_id % 3 AS engine, row_number() OVER (PARTITION BY page_id % 3 ORDER BY page_id) AS rank FROM pages),
    b AS (SELECT k, engine, min(rank) AS rank FROM r GROUP BY ALL)
    SELECT k, round(sum(1.0 / (60 + rank)), 6) AS score, string_agg(CAST(engine AS VARCHAR), '+' ORDER BY engine) AS engines FROM b GROUP BY k""",
)
def engine_merge(t):
    w = Window.partitionBy("engine").orderBy("page_id")
    ranked = t.pages.select("page_id", urls.site_of(F.col("url")).alias("k"), (F.col("page_id") % 3).alias("engine")).withColumn("rank", F.row_number().over(w))
    best = ranked.groupBy("k", "engine").agg(F.min("rank").alias("rank"))
    merged = best.groupBy("k").agg(F.round(F.sum(1.0 / (60 + F.col("rank"))), 6).alias("score"), F.array_sort(F.collect_set("engine")).alias("e"))
    return merged.select("k", "score", F.array_join(F.transform("e", lambda x: x.cast("string")), "+").alias("engines"))


@query(
    "g8_similar_texts",
    r"""WITH w AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS x FROM conversations)
    SELECT a.conv_id, a.turn, round(CASE WHEN len(list_distinct(list_concat(a.x, b.x))) > 0 THEN len(list_intersect(a.x, b.x)) / CAST(len(list_distinct(list_concat(a.x, b.x))) AS DOUBLE) ELSE 0 END, 4) AS score
    FROM w a JOIN w b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1""",
)
def similar_texts(t):
    w = t.conversations.select("conv_id", "turn", F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(tx.TOKEN), F.lit(0))).alias("x"))
    after = w.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("x").alias("y"))
    return w.join(after, ["conv_id", "turn"]).select("conv_id", "turn", F.round(tx.jaccard(F.col("x"), F.col("y")), 4).alias("score"))


@query(
    "g9_content_fingerprint",
    r"""SELECT doc_id, sha256(trim(regexp_replace(regexp_replace(lower(text), '[0-9]+', '#', 'g'), '[ \t\n\r\f\v]+', ' ', 'g'))) AS fingerprint FROM documents""",
)
def content_fingerprint(t):
    return t.documents.select("doc_id", similarity.fingerprint(F.col("text")).alias("fingerprint"))


@query(
    "g10_hash_distance",
    """WITH h AS (SELECT vec_id, list_sum(list_transform(range(1, 33), lambda i: CASE WHEN embedding[i] > embedding[i + 1] THEN CAST(1 AS BIGINT) << CAST(i - 1 AS INT) ELSE 0 END))::BIGINT AS h FROM embeddings)
    SELECT a.vec_id, bit_count(xor(a.h, b.h))::BIGINT AS distance FROM h a JOIN h b ON b.vec_id = a.vec_id + 1""",
)
def hash_distance(t):
    h = t.embeddings.select("vec_id", similarity.gradient_hash(F.col("embedding"), 32).alias("h"))
    after = h.select((F.col("vec_id") - 1).alias("vec_id"), F.col("h").alias("g"))
    return h.join(after, "vec_id").select("vec_id", F.bit_count(F.col("h").bitwiseXOR(F.col("g"))).cast("bigint").alias("distance"))


@query("g11_name_similarity")
def name_similarity(t):
    c = t.customer.select("c_custkey", F.col("c_name").alias("a"), F.concat(F.lit("C. "), F.regexp_replace("c_name", "^.*#0*", "")).alias("b"))
    return c.select("c_custkey", similarity.name_similarity(F.col("a"), F.col("b")).alias("score"))


@query(
    "g12_merchant_similarity",
    r"""WITH k AS (SELECT p_partkey, list_distinct(list_filter(regexp_extract_all(lower(p_name), '[a-z0-9]+'), lambda x: x NOT IN ('sl', 'sa', 'ltd', 'inc', 'gmbh', 'co'))) AS x FROM part)
    SELECT a.p_partkey, len(list_intersect(a.x, b.x)) >= 0.5 * least(len(a.x), len(b.x)) AS alike FROM k a JOIN k b ON b.p_partkey = a.p_partkey + 1""",
)
def merchant_similarity(t):
    k = t.part.select("p_partkey", similarity.merchant_tokens(F.col("p_name")).alias("x"))
    after = k.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("x").alias("y"))
    alike = F.size(F.array_intersect("x", "y")) >= 0.5 * F.least(F.size("x"), F.size("y"))
    return k.join(after, "p_partkey").select("p_partkey", alike.alias("alike"))


@query("g14_suppressed_notices", "SELECT user_id, event_type, CAST(ts AS DATE) AS day, min(event_id) AS event_id, count(*) - 1 AS suppressed FROM events GROUP BY ALL")
def suppressed_notices(t):
    return t.events.groupBy("user_id", "event_type", F.to_date("ts").alias("day")).agg(F.min("event_id").alias("event_id"), (F.count("*") - 1).alias("suppressed"))
