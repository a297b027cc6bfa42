"""Sorts, limits and top-k (inventory section F)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ranking, retrieval
from .registry import query


@query(
    "f1_vector_top_k",
    """WITH s AS (SELECT q.vec_id AS query, e.vec_id AS found, list_dot_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS score FROM embeddings q JOIN embeddings e ON q.vec_id % 50 = 0 AND e.vec_id <> q.vec_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, found) AS rank FROM s) SELECT query, found, round(score, 4) AS score, rank FROM r WHERE rank <= 5""",
)
def vector_top_k(t):
    best = retrieval.top_k_of_queries(t.embeddings.where("vec_id % 50 = 0"), t.embeddings, "vec_id", "embedding", 5)
    return best.select("query", "found", F.round("score", 4).alias("score"), F.col("rank").cast("bigint").alias("rank"))


@query("f2_rank_top_n", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def rank_top_n(t):
    return t.orders.select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


@query("f3_nocase_order", "SELECT p_partkey, lower(p_name) AS name FROM part ORDER BY lower(p_name), p_partkey LIMIT 40")
def nocase_order(t):
    return t.part.select("p_partkey", F.lower("p_name").alias("name")).orderBy("name", "p_partkey").limit(40)


@query(
    "f4_natural_order",
    """SELECT source, row_number() OVER (ORDER BY CAST(regexp_extract(source, '[0-9]+') AS INT), source) AS place FROM (SELECT DISTINCT source FROM documents)""",
)
def natural_order(t):
    return ranking.natural_order(t.documents.select("source").distinct(), "source")


@query("f5_reading_plan")
def reading_plan(t):
    rows = t.documents.join(t.labels, "doc_id").where("quality = 1").select("doc_id", "source", F.ceil(F.col("n_chars") / 1200).cast("int").alias("minutes"), (F.col("toxic") == 0).alias("favorite"))
    return ranking.reading_plan(rows, "source", "doc_id", "minutes", "favorite", budget=30, most=6)


@query(
    "f6_resurface",
    """WITH h AS (SELECT user_id, date_diff('day', max(ts)::DATE, DATE '2024-02-15') AS age, count(*) FILTER (event_type = 'click') AS clicks, bool_or(event_type = 'signup') AS fav FROM events GROUP BY user_id)
    SELECT user_id, CAST(least(age, 120) + 40 * fav::INT + 10 * least(clicks, 5) AS BIGINT) AS score FROM h WHERE age >= 2 ORDER BY score DESC, user_id LIMIT 15""",
)
def resurface(t):
    h = t.events.groupBy("user_id").agg(
        F.datediff(F.lit("2024-02-15").cast("date"), F.to_date(F.max("ts"))).alias("age"), F.count_if(F.col("event_type") == "click").alias("clicks"), F.bool_or(F.col("event_type") == "signup").alias("fav")
    )
    return ranking.resurfaced(h, "user_id", F.col("age"), F.col("fav"), F.least("clicks", F.lit(5)), F.lit(0), 15)


@query(
    "f7_thinned_frames",
    """WITH r AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS i, count(*) OVER (PARTITION BY label) AS n FROM embeddings)
    SELECT label, vec_id FROM r WHERE n <= 6 OR floor(i * 6 / n::DOUBLE) <> floor((i - 1) * 6 / n::DOUBLE)""",
)
def thinned_frames(t):
    return ranking.thinned(t.embeddings.select("label", "vec_id"), "label", "vec_id", 6)


@query("f8_patience_anchors")
def patience_anchors(t):
    from ..operators.compare import anchors

    c = t.conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("x")).select("conv_id", F.transform("x", lambda x: x["text"]).alias("old"))
    return anchors(c.withColumn("new", F.concat(F.slice("old", F.lit(2), F.size("old")), F.array(F.get("old", F.lit(0))))), "conv_id", "old", "new")
