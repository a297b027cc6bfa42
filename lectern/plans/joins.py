"""Joins (inventory section C)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import joining
from .registry import query


@query(
    "c1_hydrate_ids",
    """SELECT l_orderkey, l_linenumber, o_orderdate, c_name, n_name FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE l_orderkey IN (1, 3, 7, 32, 100, 333, 999, 2001)""",
)
def hydrate_ids(t):
    ids = t.orders.sparkSession.createDataFrame([(i,) for i in (1, 3, 7, 32, 100, 333, 999, 2001)], "l_orderkey bigint")
    hits = t.lineitem.select("l_orderkey", "l_linenumber").join(F.broadcast(ids), "l_orderkey")  # a literal list
    full = hits.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return full.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select("l_orderkey", "l_linenumber", "o_orderdate", "c_name", "n_name")


@query("c3_without_label", "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def without_label(t):
    return joining.without(t.documents.select("doc_id", "source"), t.labels, "doc_id")


@query(
    "c4_state_counts",
    """SELECT lang, coalesce(CASE quality WHEN 1 THEN 'ok' WHEN 0 THEN 'empty' END, 'pending') AS state, count(*) AS n
    FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ALL""",
)
def state_counts(t):
    joined = t.documents.select("doc_id", "lang").join(t.labels, "doc_id", "left")
    state = F.coalesce(F.when(F.col("quality") == 1, "ok").when(F.col("quality") == 0, "empty"), F.lit("pending"))
    return joined.groupBy("lang", state.alias("state")).agg(F.count("*").alias("n"))


@query("c5_pending_or_failed", "SELECT doc_id FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NULL OR quality = 0")
def pending_or_failed(t):
    return t.documents.select("doc_id").join(t.labels, "doc_id", "left").where("quality is null or quality = 0").select("doc_id")


@query(
    "c6_collection_stats",
    """SELECT s_suppkey, count(l_orderkey) AS n_lines, round(sum(l_quantity), 2) AS quantity, max(l_shipdate) AS last_ship
    FROM supplier LEFT JOIN (SELECT * FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 49) l ON s_suppkey = l_suppkey GROUP BY s_suppkey""",
)
def collection_stats(t):
    lines = t.lineitem.where("l_returnflag = 'R' and l_quantity > 49").select("l_suppkey", "l_orderkey", "l_quantity", "l_shipdate")
    joined = t.supplier.select("s_suppkey").join(lines, F.col("s_suppkey") == F.col("l_suppkey"), "left")
    return joined.groupBy("s_suppkey").agg(F.count("l_orderkey").alias("n_lines"), F.round(F.sum("l_quantity"), 2).alias("quantity"), F.max("l_shipdate").alias("last_ship"))


@query("c7_empty_series", "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def empty_series(t):
    known = t.orders.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return joining.without(t.customer.select("c_custkey", "c_name"), known, "c_custkey")


@query(
    "c8_count_per_row",
    """SELECT d.doc_id, (SELECT count(*) FROM conversations c WHERE c.conv_id = d.doc_id) AS n_turns FROM documents d""",
)
def count_per_row(t):
    counts = t.conversations.groupBy(F.col("conv_id").alias("doc_id")).agg(F.count("*").alias("n"))
    return t.documents.select("doc_id").join(counts, "doc_id", "left").select("doc_id", F.coalesce("n", F.lit(0).cast("bigint")).alias("n_turns"))


@query(
    "c9_composite_key",
    """SELECT c.conv_id, c.turn, n.turn AS answer_turn, length(n.text) AS answer_chars FROM conversations c JOIN conversations n ON n.conv_id = c.conv_id AND n.turn = c.turn + 1
    WHERE c.role = 'user' AND n.role = 'assistant'""",
)
def composite_key(t):
    c = t.conversations
    asked = c.where("role = 'user'").select("conv_id", "turn", (F.col("turn") + 1).alias("answer_turn"))
    answers = c.where("role = 'assistant'").select("conv_id", F.col("turn").alias("answer_turn"), F.length("text").cast("bigint").alias("answer_chars"))
    return asked.join(answers, ["conv_id", "answer_turn"])


@query(
    "c10_lines_around",
    """SELECT conv_id, turn, lag(text) OVER w AS before, lead(text) OVER w AS after FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""",
)
def lines_around(t):
    w = Window.partitionBy("conv_id").orderBy("turn")
    return t.conversations.select("conv_id", "turn", F.lag("text").over(w).alias("before"), F.lead("text").over(w).alias("after"))


@query("c11_deleted", "SELECT DISTINCT o_custkey AS custkey FROM orders WHERE o_orderdate < TIMESTAMP '1997-01-01' EXCEPT SELECT o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '2000-06-01'")
def deleted(t):
    o = t.orders.select(F.col("o_custkey").alias("custkey"), "o_orderdate")
    known = o.where(F.col("o_orderdate") < F.lit("1997-01-01").cast("timestamp_ntz")).select("custkey").distinct()
    return joining.without(known, o.where(F.col("o_orderdate") >= F.lit("2000-06-01").cast("timestamp_ntz")), "custkey")


_SPANS = "SELECT user_id, event_id, epoch(ts)::BIGINT AS s, epoch(ts)::BIGINT + CAST(value AS BIGINT) % 7200 + 60 AS e FROM events"


@query(
    "c12_interval_overlap",
    f"""WITH x AS ({_SPANS} WHERE event_type = 'view'), y AS ({_SPANS} WHERE event_type = 'purchase')
    SELECT x.user_id, x.event_id AS view_id, y.event_id AS purchase_id FROM x JOIN y ON x.user_id = y.user_id AND x.s < y.e AND x.e > y.s""",
)
def interval_overlap(t):
    # halves go to the even neighbour, as in the casts of the SQL
    start = F.rint(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).cast("bigint")
    span = t.events.select("user_id", "event_id", "event_type", start.alias("s"), (start + F.rint("value").cast("bigint") % 7200 + 60).alias("e"))
    views = span.where("event_type = 'view'").select("user_id", F.col("event_id").alias("view_id"), F.col("s").alias("vs"), F.col("e").alias("ve"))
    buys = span.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("purchase_id"), F.col("s").alias("ps"), F.col("e").alias("pe"))
    return joining.interval_overlaps(views, buys, ["user_id"], "vs", "ve", "ps", "pe", 3600.0).select("user_id", "view_id", "purchase_id")


WEEK = 7 * 24 * 3600


@query(
    "c13_containment",
    """SELECT e.event_id, CAST(floor((epoch(ts) - epoch(TIMESTAMP '2024-01-01')) / 604800) AS BIGINT) AS week FROM events e""",
)
def containment(t):
    at = F.unix_timestamp("ts") - F.unix_timestamp(F.lit("2024-01-01").cast("timestamp_ntz"))
    e = t.events.select("event_id", at.alias("at"), (at + 1).alias("behind"))
    week = F.floor(F.col("at") / WEEK)
    # a row a week of the table's time, whatever it spans
    weeks = e.agg(F.min(week).alias("a"), F.max(week).alias("b")).where("a is not null").select(F.explode(F.sequence("a", "b")).alias("week"))
    weeks = weeks.select("week", (F.col("week") * WEEK).alias("start"), ((F.col("week") + 1) * WEEK).alias("stop"))
    return joining.interval_overlaps(e, weeks, [], "at", "behind", "start", "stop", float(WEEK)).select("event_id", "week")


@query(
    "c14_single_tolerance_match",
    """WITH m AS (SELECT a.o_orderkey AS invoice, b.o_orderkey AS payment, count(*) OVER (PARTITION BY a.o_orderkey) AS n
      FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey <> b.o_orderkey AND abs(date_diff('day', a.o_orderdate::DATE, b.o_orderdate::DATE)) <= 30)
    SELECT invoice, payment FROM m WHERE n = 1""",
)
def single_tolerance_match(t):
    o = t.orders.select("o_custkey", "o_orderkey", F.to_date("o_orderdate").alias("day"))
    invoices = o.select("o_custkey", F.col("o_orderkey").alias("invoice"), F.col("day").alias("due"))
    payments = o.select("o_custkey", F.col("o_orderkey").alias("payment"), "day")
    near = F.when((F.col("invoice") != F.col("payment")) & (F.abs(F.datediff("due", "day")) <= 30), 1.0).otherwise(0.0)
    return joining.single_match(invoices, payments, "o_custkey", near, 0.8).select("invoice", "payment")


@query(
    "c15_as_of_previous",
    """SELECT o_orderkey, last_value(CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous FROM orders""",
)
def as_of_previous(t):
    rows = t.orders.select("o_orderkey", "o_custkey", "o_orderdate", F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("amount"))
    return joining.as_of_previous(rows, ["o_custkey"], [F.asc("o_orderdate"), F.asc("o_orderkey")], "amount", "previous").select("o_orderkey", "previous")


@query(
    "c15_as_of_join",
    """SELECT v.event_id, v.user_id, c.value AS last_click FROM (SELECT * FROM events WHERE event_type = 'purchase') v
    ASOF LEFT JOIN (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'click' GROUP BY ALL) c ON v.user_id = c.user_id AND v.ts >= c.ts""",
)
def as_of_join(t):
    e = t.events
    buys = e.where("event_type = 'purchase'").select("user_id", "event_id", "ts")
    clicks = e.where("event_type = 'click'").groupBy("user_id", F.col("ts").alias("at")).agg(F.max("value").alias("last_click"))
    return joining.as_of_join(buys, clicks, ["user_id"], "ts", "at", ["last_click"]).select("event_id", "user_id", "last_click")


@query(
    "c16_prefix_terms",
    """WITH w AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS term FROM documents)
    SELECT doc_id, p AS prefix, count(*) AS terms FROM w JOIN (VALUES ('idio'), ('wort'), ('clow')) v(p) ON starts_with(term, p) GROUP BY ALL""",
)
def prefix_terms(t):
    words = t.documents.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)))).alias("term"))
    prefixes = t.documents.sparkSession.createDataFrame([("idio",), ("wort",), ("clow",)], "prefix string")
    return words.join(F.broadcast(prefixes), F.col("term").startswith(F.col("prefix"))).groupBy("doc_id", "prefix").agg(F.count("*").alias("terms"))


@query(
    "c17_vector_scores",
    """WITH q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 3)
    SELECT vec_id, round(list_dot_product(embedding::DOUBLE[], v), 4) AS score FROM embeddings, q WHERE vec_id <> 3 AND label % 2 = 1 AND list_dot_product(embedding::DOUBLE[], v) >= 0.1""",
)
def vector_scores(t):
    from ..functions.vectors import dot

    q = t.embeddings.where("vec_id = 3").select(F.col("embedding").alias("v"))  # one row
    rows = t.embeddings.where("vec_id <> 3 and label % 2 = 1").join(F.broadcast(q))
    return rows.select("vec_id", F.col("embedding"), "v").select("vec_id", dot(F.col("embedding"), F.col("v")).alias("s")).where("s >= 0.1").select("vec_id", F.round("s", 4).alias("score"))
