"""Window-shaped queries (inventory section E)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import retrieval, windows
from .registry import query


@query(
    "e1_first_hit_per_unit",
    """WITH r AS (SELECT conv_id, role, turn, length(text) AS score, row_number() OVER (PARTITION BY conv_id, role ORDER BY length(text) DESC, turn) AS k FROM conversations)
    SELECT conv_id, role, min(turn) FILTER (k = 1) AS turn, CAST(max(score) AS DOUBLE) AS score, coalesce(string_agg(CAST(turn AS VARCHAR), ',' ORDER BY k) FILTER (k BETWEEN 2 AND 4), '') AS also, greatest(count(*) - 4, 0) AS more FROM r GROUP BY conv_id, role""",
)
def first_hit_per_unit(t):
    hits = t.conversations.select("conv_id", "role", "turn", F.length("text").cast("double").alias("score"))
    best = retrieval.best_per_group(hits, ["conv_id", "role"], "turn")
    return best.withColumn("also", F.array_join(F.transform("also", lambda x: x.cast("string")), ","))


@query("e2_best_per_chunk", "SELECT label, max_by(vec_id, (embedding[1], vec_id)) AS vec_id FROM embeddings GROUP BY label")
def best_per_chunk(t):
    return t.embeddings.groupBy("label").agg(F.max_by("vec_id", F.struct(F.get("embedding", F.lit(0)), "vec_id")).alias("vec_id"))


_AMOUNT = "CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END"
_HISTORY = f"""SELECT o_custkey, o_orderkey, o_orderdate, {_AMOUNT} AS amount,
  last_value({_AMOUNT} IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous FROM orders"""


def _amounts(t):
    return t.orders.select("o_custkey", "o_orderkey", "o_orderdate", F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("amount"))


_ORDER = [F.asc, F.desc]


@query("e3_price_history", f"SELECT o_orderkey, amount, previous, round(amount - previous, 2) AS change, CASE WHEN previous <> 0 THEN round((amount - previous) / previous * 100, 1) + 0 END AS pct FROM ({_HISTORY})")
def price_history(t):
    return windows.price_history(_amounts(t), ["o_custkey"], [F.asc("o_orderdate"), F.asc("o_orderkey")], "amount").drop("o_custkey", "o_orderdate")


@query(
    "e4_price_alerts",
    f"""WITH h AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM ({_HISTORY}))
    SELECT o_custkey, o_orderkey, round((amount - previous) / previous * 100, 1) AS pct FROM h WHERE k = 1 AND round((amount - previous) / previous * 100, 1) >= 10""",
)
def price_alerts(t):
    up, down = [F.asc("o_orderdate"), F.asc("o_orderkey")], [F.desc("o_orderdate"), F.desc("o_orderkey")]
    return windows.price_alerts(_amounts(t), ["o_custkey"], up, down, "amount", 10.0).select("o_custkey", "o_orderkey", "pct")


@query(
    "e5_series_order",
    """SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY coalesce(CASE WHEN l_returnflag = 'R' THEN l_shipdate END, CASE WHEN l_linestatus = 'O' THEN TIMESTAMP '1998-01-01' END, TIMESTAMP '1992-01-01'), l_linenumber, l_partkey) AS place FROM lineitem""",
)
def series_order(t):
    at = F.coalesce(F.when(F.col("l_returnflag") == "R", F.col("l_shipdate")), F.when(F.col("l_linestatus") == "O", F.lit("1998-01-01").cast("timestamp_ntz")), F.lit("1992-01-01").cast("timestamp_ntz"))
    w = Window.partitionBy("l_orderkey").orderBy(at, "l_linenumber", "l_partkey")
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", F.row_number().over(w).cast("bigint").alias("place"))


@query("e6_rank_positions", "SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents")
def rank_positions(t):
    w = Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")
    return t.documents.select("source", "doc_id", F.row_number().over(w).cast("bigint").alias("rank"))


@query("e7_min_max_scaled", "SELECT doc_id, round((n_chars - min(n_chars) OVER w) / CAST(max(n_chars) OVER w - min(n_chars) OVER w AS DOUBLE), 6) AS scaled FROM documents WINDOW w AS (PARTITION BY source)")
def min_max_scaled(t):
    return windows.min_max_scaled(t.documents.select("doc_id", "source", "n_chars"), "source", "n_chars").select("doc_id", F.round("scaled", 6).alias("scaled"))


@query("e8_rolling_caption_dedupe")
def rolling_caption_dedupe(t):
    from ..operators.media import rolling_dedupe

    cues = t.conversations.select("conv_id", "turn", F.concat(F.col("role"), F.lit(" "), tx.squeeze(F.col("text"))).alias("text"))
    return rolling_dedupe(cues, "conv_id", "turn", "text")


def _cues(t):
    at = F.col("turn").cast("double") * 7 + F.when(F.col("conv_id") % 3 == 0, F.col("turn").cast("double")).otherwise(0.0)
    return t.conversations.select("conv_id", "turn", at.alias("s"), (at + 5 + F.length("text") % 3).alias("e"), tx.squeeze(F.col("text")).alias("text"))


@query("e9_timed_paragraphs")
def timed_paragraphs(t):
    return windows.timed_paragraphs(_cues(t), "conv_id", "turn", "s", "e", "text")


@query(
    "e9_gap_paragraphs",
    """WITH c AS (SELECT user_id, event_id, ts, epoch(ts) - epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS gap FROM events),
    g AS (SELECT *, sum(CASE WHEN gap >= 14400 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM c)
    SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM g GROUP BY ALL""",
)
def gap_paragraphs(t):
    order = [F.asc_nulls_last("ts"), F.asc_nulls_last("event_id")]
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    gap = seconds - F.lag(seconds).over(Window.partitionBy("user_id").orderBy(*order))
    rows = t.events.select("user_id", "event_id", "ts", (gap >= 14400).alias("new"))
    grouped = windows.gap_groups(rows, ["user_id"], order, F.col("new"), "session")
    return grouped.groupBy("user_id", "session").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query("e10_chapters")
def chapters(t):
    from ..operators.media import chapters as plan

    return plan(_cues(t), "conv_id", "turn", "s", "e", "text", target=20.0)


@query(
    "e11_gap_sessions",
    """WITH c AS (SELECT conv_id, turn, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations)
    SELECT conv_id, string_agg(CASE WHEN before IS NULL THEN '' WHEN role = 'user' THEN '|' ELSE ' ' END || role, '' ORDER BY turn) AS text FROM c GROUP BY conv_id""",
)
def gap_sessions(t):
    w = Window.partitionBy("conv_id").orderBy("turn")
    before = F.lag("role").over(w)
    glue = F.when(before.isNull(), "").when(F.col("role") == "user", "|").otherwise(" ")
    parts = t.conversations.select("conv_id", "turn", F.concat(glue, "role").alias("part"))
    gathered = parts.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "part"))).alias("p"))
    return gathered.select("conv_id", F.array_join(F.transform("p", lambda x: x["part"]), "").alias("text"))


@query("e12_drift_segments")
def drift_segments(t):
    from ..operators.media import drift_segments as segments

    frames = t.embeddings.select((F.col("vec_id") % 10).alias("video"), "vec_id", "embedding")
    return segments(frames, "video", "vec_id", "embedding", 0.9)


@query(
    "e13_day_stable_pick",
    """SELECT doc_id, CAST(least(n_chars, 500) AS BIGINT) AS score, draw FROM (SELECT doc_id, n_chars, CAST(('0x' || left(sha1('2024-05-01:' || doc_id), 4)) AS BIGINT) AS draw FROM documents) ORDER BY score DESC, draw DESC, doc_id LIMIT 12""",
)
def day_stable_pick(t):
    picked = windows.stable_pick(t.documents.select("doc_id", "n_chars"), "doc_id", "2024-05-01", F.least("n_chars", F.lit(500)), 12)
    return picked.select("doc_id", "score", "draw")


@query("e14_keep_last_runs", "SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events) WHERE k <= 20")
def keep_last_runs(t):
    return windows.first_of_each(t.events.select("event_id", "user_id"), ["user_id"], [F.desc("event_id")], 20)


@query(
    "e15_duplicate_payments",
    """SELECT event_id, row_number() OVER (PARTITION BY user_id, CAST(value AS BIGINT), CAST(ts AS DATE) ORDER BY event_type <> 'purchase', event_id) = 1 AS kept FROM events""",
)
def duplicate_payments(t):
    rows = t.events.select("event_id", "user_id", "event_type", F.bround("value").cast("bigint").alias("amount"), F.to_date("ts").alias("day"))
    return windows.duplicates_of(rows, ["user_id", "amount", "day"], [F.asc(F.col("event_type") != "purchase"), F.asc("event_id")]).select("event_id", "kept")
