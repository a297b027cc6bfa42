"""Projections, filters and predicates (inventory section B)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import listing
from .registry import query


@query(
    "b1_list_documents",
    """WITH p AS (SELECT doc_id, lang, source, n_chars FROM documents WHERE lang = 'en' AND contains(lower(text), 'the') AND doc_id > 40 ORDER BY doc_id LIMIT 26)
    SELECT doc_id, lang, source, n_chars, (SELECT count(*) FROM p) > 25 AS has_more FROM p ORDER BY doc_id LIMIT 25""",
)
def list_documents(t):
    rows = t.documents.where((F.col("lang") == "en") & listing.contains_folded(F.col("text"), "the"))
    return listing.keyset_page(rows.select("doc_id", "lang", "source", "n_chars"), "doc_id", 40, 25)


@query(
    "b2_document_outline",
    """SELECT conv_id, turn, role, CAST(length(text) AS BIGINT) AS n_chars,
         CAST(sum(length(text)) OVER (PARTITION BY conv_id) AS BIGINT) AS total_chars, count(*) OVER (PARTITION BY conv_id) AS n_units FROM conversations""",
)
def document_outline(t):
    c = t.conversations
    totals = c.groupBy("conv_id").agg(F.sum(F.length("text")).cast("bigint").alias("total_chars"), F.count("*").alias("n_units"))
    return c.join(totals, "conv_id").select("conv_id", "turn", "role", F.length("text").cast("bigint").alias("n_chars"), "total_chars", "n_units")


@query(
    "b3_unit_neighbours",
    """SELECT conv_id, turn, role, lag(turn) OVER w AS previous_turn, lead(turn) OVER w AS next_turn, count(*) OVER (PARTITION BY conv_id) AS total
    FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""",
)
def unit_neighbours(t):
    return listing.with_neighbours(t.conversations.select("conv_id", "turn", "role"), "conv_id", "turn", "turn")


@query(
    "b4_document_json",
    """SELECT conv_id, string_agg(role || ':' || n, ',' ORDER BY role) AS roles, CAST(sum(n) AS BIGINT) AS turns
    FROM (SELECT conv_id, role, count(*) AS n FROM conversations GROUP BY ALL) GROUP BY conv_id""",
)
def document_json(t):
    counts = t.conversations.groupBy("conv_id", "role").agg(F.count("*").alias("n"))
    by_role = counts.groupBy("conv_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("role", "n")))).alias("m"), F.sum("n").alias("turns"))
    shown = F.transform(F.map_entries("m"), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string")))
    return by_role.select("conv_id", F.array_join(shown, ",").alias("roles"), "turns")


@query(
    "b5_filtered_documents",
    """SELECT o_orderkey, o_orderstatus, o_orderdate, o_totalprice FROM orders
    WHERE o_orderstatus IN ('O', 'P') AND contains(lower(o_orderpriority), 'high') AND year(o_orderdate) = 1996
    ORDER BY o_orderdate DESC, o_orderkey LIMIT 50 OFFSET 20""",
)
def filtered_documents(t):
    rows = t.orders.where(F.col("o_orderstatus").isin("O", "P") & listing.contains_folded(F.col("o_orderpriority"), "HIGH") & (F.year("o_orderdate") == 1996))
    return listing.offset_page(rows.select("o_orderkey", "o_orderstatus", "o_orderdate", "o_totalprice"), [F.desc("o_orderdate"), F.asc("o_orderkey")], 50, 20)


@query(
    "b6_deadlines_in_range",
    """SELECT l_orderkey, l_linenumber, l_shipdate, l_returnflag FROM lineitem
    WHERE l_returnflag IN ('A', 'R') AND l_shipdate >= TIMESTAMP '1995-01-01' AND l_shipdate < TIMESTAMP '1995-04-01'""",
)
def deadlines_in_range(t):
    day = F.col("l_shipdate")
    rows = t.lineitem.where(F.col("l_returnflag").isin("A", "R") & (day >= F.lit("1995-01-01").cast("timestamp_ntz")) & (day < F.lit("1995-04-01").cast("timestamp_ntz")))
    return rows.select("l_orderkey", "l_linenumber", "l_shipdate", "l_returnflag")


@query(
    "b7_list_links",
    r"""WITH m AS (SELECT page_id, url FROM pages WHERE regexp_extract(url, '^https?://([^/?#]+)', 1) LIKE '%example.com'),
    p AS (SELECT *, (SELECT count(*) FROM m) AS total FROM m ORDER BY page_id DESC LIMIT 20)
    SELECT page_id, url, total, (SELECT min(page_id) FROM p) AS next_cursor FROM p""",
)
def list_links(t):
    rows = t.pages.where(F.regexp_extract("url", r"^https?://([^/?#]+)", 1).endswith("example.com")).select("page_id", "url")
    page = rows.orderBy(F.desc("page_id")).limit(20)
    total = rows.agg(F.count("*").alias("total"))  # one row
    cursor = page.agg(F.min("page_id").alias("next_cursor"))  # one row
    return page.join(F.broadcast(total)).join(F.broadcast(cursor))


@query(
    "b8_read_state",
    """SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'unread' WHEN quality = 0 THEN 'archived' ELSE 'read' END AS state
    FROM documents d LEFT JOIN labels l USING (doc_id)""",
)
def read_state(t):
    joined = t.documents.select("doc_id").join(t.labels, "doc_id", "left")
    state = F.when(F.col("quality").isNull(), "unread").when(F.col("quality") == 0, "archived").otherwise("read")
    return joined.select("doc_id", state.alias("state"))


@query(
    "b9_recent_of_kinds",
    """SELECT event_id, ts, event_type, user_id FROM events WHERE event_type IN ('error', 'purchase') ORDER BY ts DESC, event_id DESC LIMIT 100""",
)
def recent_of_kinds(t):
    rows = t.events.where(F.col("event_type").isin("error", "purchase")).select("event_id", "ts", "event_type", "user_id")
    return rows.orderBy(F.desc("ts"), F.desc("event_id")).limit(100)


@query(
    "b10_watch_items_since",
    """SELECT event_id, user_id, ts FROM events WHERE user_id = 7 AND ts >= TIMESTAMP '2024-01-10' AND event_type <> 'view' ORDER BY ts DESC, event_id LIMIT 40""",
)
def watch_items_since(t):
    rows = t.events.where((F.col("user_id") == 7) & (F.col("ts") >= F.lit("2024-01-10").cast("timestamp_ntz")) & (F.col("event_type") != "view"))
    return rows.select("event_id", "user_id", "ts").orderBy(F.desc("ts"), "event_id").limit(40)


@query(
    "b11_collections_of_kind",
    """SELECT doc_id, source FROM documents WHERE source IN (SELECT source FROM documents GROUP BY source HAVING count(*) FILTER (lang = 'fr') >= 5)""",
)
def collections_of_kind(t):
    d = t.documents.select("doc_id", "source", "lang")
    wanted = d.groupBy("source").agg(F.count_if(F.col("lang") == "fr").alias("n")).where("n >= 5").select("source")
    return d.join(wanted, "source", "left_semi").select("doc_id", "source")


@query(
    "b12_dated_or_undated",
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE CAST(o_orderdate AS DATE) END AS day FROM orders
    WHERE o_orderstatus = 'P' OR CAST(o_orderdate AS DATE) BETWEEN DATE '1995-03-01' AND DATE '1995-09-30'""",
)
def dated_or_undated(t):
    rows = t.orders.select("o_orderkey", F.when(F.col("o_orderstatus") != "P", F.to_date("o_orderdate")).alias("day"))
    return rows.where(listing.between_or_undated(F.col("day"), "1995-03-01", "1995-09-30"))


@query(
    "b13_due_watches",
    """WITH s AS (SELECT user_id, max(ts) FILTER (event_type = 'click') AS last, bool_or(event_type = 'signup') AS enabled FROM events GROUP BY user_id)
    SELECT user_id, last FROM s WHERE enabled AND (last IS NULL OR epoch(TIMESTAMP '2024-01-30') - epoch(last) >= 3600 * (1 + user_id % 48))""",
)
def due_watches(t):
    clicks = F.when(F.col("event_type") == "click", F.col("ts"))
    s = t.events.groupBy("user_id").agg(F.max(clicks).alias("last"), F.bool_or(F.col("event_type") == "signup").alias("enabled"))
    due = listing.is_due(F.col("last"), "2024-01-30", 3600 * (1 + F.col("user_id") % 48), F.col("enabled"))
    return s.where(due).select("user_id", "last")


@query(
    "b14_stale_documents",
    """SELECT source, count(*) FILTER (n_chars < 500) AS outdated, count(*) FILTER (doc_id NOT IN (SELECT doc_id FROM labels)) AS unlabelled, count(*) AS total FROM documents GROUP BY source""",
)
def stale_documents(t):
    rows = t.documents.select("doc_id", "source", "n_chars").join(t.labels.select("doc_id", F.lit(1).alias("labelled")), "doc_id", "left")
    return rows.groupBy("source").agg(F.count_if(F.col("n_chars") < 500).alias("outdated"), F.count_if(F.col("labelled").isNull()).alias("unlabelled"), F.count("*").alias("total"))


@query(
    "b15_redacted_settings",
    """SELECT user_id, 'api_token=***,name=user ' || user_id || CASE WHEN user_id % 2 = 0 THEN ',password=***' ELSE ',password=' END AS settings
    FROM (SELECT DISTINCT user_id FROM events)""",
)
def redacted_settings(t):
    users = t.events.select("user_id").distinct()
    made = F.create_map(
        F.lit("api_token"), F.concat(F.lit("t"), F.col("user_id").cast("string")), F.lit("name"), F.concat(F.lit("user "), F.col("user_id").cast("string")), F.lit("password"), F.when(F.col("user_id") % 2 == 0, "secret").otherwise("")
    )
    shown = F.transform(F.array_sort(F.map_entries(listing.redact(made, ("token", "password", "secret")))), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return users.select("user_id", F.array_join(shown, ",").alias("settings"))


@query(
    "b16_recent_chats",
    """SELECT conv_id, max(turn) AS last_turn, count(*) AS n_turns FROM conversations GROUP BY conv_id
    HAVING bool_or(role = 'system') ORDER BY n_turns DESC, conv_id LIMIT 10""",
)
def recent_chats(t):
    g = t.conversations.groupBy("conv_id").agg(F.max("turn").alias("last_turn"), F.count("*").alias("n_turns"), F.bool_or(F.col("role") == "system").alias("has_system"))
    return g.where("has_system").drop("has_system").orderBy(F.desc("n_turns"), "conv_id").limit(10)


@query("r21_missing_ids", """SELECT i AS doc_id FROM range(0, 2000, 50) r(i) WHERE i NOT IN (SELECT doc_id FROM labels)""")
def missing_ids(t):
    wanted = t.documents.sparkSession.range(0, 2000, 50).withColumnRenamed("id", "doc_id")
    return listing.missing_ids(wanted, t.labels, "doc_id")
