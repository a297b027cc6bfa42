"""Arrays, maps, JSON and upserts (inventory section K)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import merging
from .registry import query


@query(
    "k1_tag_sets",
    "SELECT doc_id, list_aggregate(list_sort(list_filter(list_distinct([lang, source, 'new']), lambda x: x <> 'fr')), 'string_agg', ',') AS tags FROM documents",
)
def tag_sets(t):
    tags = F.array_except(F.array_union(F.array("lang", "source"), F.array(F.lit("new"))), F.array(F.lit("fr")))
    return t.documents.select("doc_id", F.array_join(F.array_sort(tags), ",").alias("tags"))


@query("k2_tolerant_json", "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN NULL ELSE CAST(json_extract(props, '$.k') AS BIGINT) END AS k FROM events")
def tolerant_json(t):
    text = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("{broken "), "props")).otherwise(F.col("props"))
    return t.events.select("event_id", F.get_json_object(F.to_json(F.from_json(text, "k bigint")), "$.k").cast("bigint").alias("k"))


@query("k3_merge_patch", "SELECT user_id, 'a=' || (user_id % 7) || ',b=' || CASE WHEN user_id % 2 = 0 THEN 'patched' ELSE 'old' END AS settings FROM (SELECT DISTINCT user_id FROM events)")
def merge_patch(t):
    users = t.events.select("user_id").distinct()
    config = F.create_map(F.lit("a"), (F.col("user_id") % 7).cast("string"), F.lit("b"), F.lit("old"))
    patch = F.create_map(F.lit("a"), F.lit(None).cast("string"), F.lit("b"), F.when(F.col("user_id") % 2 == 0, "patched"))
    entries = F.array_sort(F.map_entries(merging.merge_patch(config, patch)))
    return users.select("user_id", F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("settings"))


@query(
    "k4_upsert",
    """SELECT user_id, event_type, max_by(value, (ts, event_id)) AS value, max(event_id) AS newest FROM events GROUP BY user_id, event_type""",
)
def upsert(t):
    e = t.events.select("user_id", "event_type", "value", "ts", "event_id")
    old, new = e.where("ts < '2024-01-20'"), e.where("ts >= '2024-01-20'")
    state = merging.latest(old, ["user_id", "event_type"], ["ts", "event_id"])
    merged = merging.upsert(state, new, ["user_id", "event_type"], ["ts", "event_id"])
    newest = e.groupBy("user_id", "event_type").agg(F.max("event_id").alias("newest"))
    return merged.select("user_id", "event_type", "value").join(newest, ["user_id", "event_type"])


@query("k5_full_replace", "SELECT source, doc_id FROM documents WHERE source NOT IN ('src1', 'src2') OR n_chars > 1000")
def full_replace(t):
    d = t.documents.select("source", "doc_id", "n_chars")
    fresh = d.where("source in ('src1', 'src2') and n_chars > 1000")
    replaced = d.sparkSession.createDataFrame([("src1",), ("src2",)], "source string")
    return merging.replace_groups(d, fresh, replaced, "source").select("source", "doc_id")


@query("k6_insert_or_ignore", "SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY user_id, event_type")
def insert_or_ignore(t):
    e = t.events.select("user_id", "event_type", "event_id")
    first = e.groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id"))
    return merging.insert_or_ignore(first.where("event_id < 500"), first, ["user_id", "event_type"])


@query(
    "k7_deadline_upsert",
    """SELECT o.o_orderkey, CASE WHEN l.l_orderkey IS NULL THEN 'created' WHEN o_orderstatus = 'P' THEN 'kept_user_dismissed' WHEN CAST(l.d AS DATE) = CAST(o.o_orderdate AS DATE) THEN 'updated' ELSE 'rescheduled' END AS action
    FROM orders o LEFT JOIN (SELECT l_orderkey, min(l_shipdate) AS d FROM lineitem WHERE l_linenumber <= 3 GROUP BY 1) l ON l.l_orderkey = o.o_orderkey""",
)
def deadline_upsert(t):
    old = t.lineitem.where("l_linenumber <= 3").groupBy(F.col("l_orderkey").alias("key")).agg(F.to_date(F.min("l_shipdate")).alias("old_day"))
    new = t.orders.select(F.col("o_orderkey").alias("key"), F.to_date("o_orderdate").alias("new_day"), (F.col("o_orderstatus") == "P").alias("dismissed"))
    return merging.deadline_actions(old, new, "key").select(F.col("key").alias("o_orderkey"), "action")


@query(
    "k8_mail_ingest",
    "SELECT min(conv_id * 1000 + turn) AS message, CASE WHEN max(length(text)) > 600 THEN 'doc' WHEN max(length(text)) > 200 THEN 'maybe' ELSE 'noise' END AS kind FROM conversations WHERE role = 'user' GROUP BY md5(text)",
)
def mail_ingest(t):
    rows = t.conversations.where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("message"), F.md5("text").alias("hash"), F.length("text").alias("n"))
    first = rows.groupBy("hash").agg(F.min("message").alias("message"), F.max("n").alias("n"))
    return first.select("message", F.when(F.col("n") > 600, "doc").when(F.col("n") > 200, "maybe").otherwise("noise").alias("kind"))


@query(
    "k9_draft_merge",
    """SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'create' WHEN b.k IS NULL THEN 'delete' WHEN a.d <> b.d THEN 'update' ELSE 'keep' END AS action
    FROM (SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS d FROM orders WHERE o_orderstatus <> 'P') a FULL JOIN (SELECT o_orderkey AS k, CAST(o_orderdate + to_days(CAST(o_orderkey % 2 AS INT)) AS DATE) AS d FROM orders WHERE o_orderpriority <> '1-URGENT') b ON a.k = b.k""",
)
def draft_merge(t):
    o = t.orders.select(F.col("o_orderkey").alias("k"), F.to_date("o_orderdate").alias("d"), "o_orderstatus", "o_orderpriority")
    existing = o.where("o_orderstatus <> 'P'").select("k", "d")
    drafts = o.where("o_orderpriority <> '1-URGENT'").select("k", F.date_add("d", (F.col("k") % 2).cast("int")).alias("d"))
    return merging.draft_actions(existing, drafts, "k", "d")


@query("k10_json_nodes", "SELECT event_id, 'k' AS path, CAST(json_extract(props, '$.k') AS VARCHAR) AS value FROM events")
def json_nodes(t):
    return merging.json_leaves(t.events, "event_id", "props")


@query(
    "k11_byte_budget",
    "SELECT source, doc_id FROM (SELECT source, doc_id, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS used FROM documents) WHERE used <= 20000",
)
def byte_budget(t):
    return merging.within_budget(t.documents.select("source", "doc_id", "n_chars"), ["source"], [F.asc("doc_id")], "n_chars", 20_000).select("source", "doc_id")


@query("k12_journal", "SELECT event_id, user_id, event_type FROM events WHERE user_id IN (3, 5, 9) AND ts >= TIMESTAMP '2024-01-15' ORDER BY ts DESC, event_id LIMIT 60")
def journal(t):
    rows = t.events.where(F.col("user_id").isin(3, 5, 9) & (F.col("ts") >= F.lit("2024-01-15").cast("timestamp_ntz")))
    return rows.orderBy(F.desc("ts"), "event_id").limit(60).select("event_id", "user_id", "event_type")


_OBJECTS = "SELECT conv_id, turn, [role, CASE WHEN length(text) > 400 THEN 'long' ELSE 'short' END] AS objects FROM conversations"


@query("k13_object_overlap", f"SELECT a.conv_id, a.turn, b.turn AS later FROM ({_OBJECTS}) a JOIN ({_OBJECTS}) b ON a.conv_id = b.conv_id AND b.turn > a.turn AND list_has_any(a.objects, b.objects)")
def object_overlap(t):
    a = t.conversations.select("conv_id", "turn", F.array("role", F.when(F.length("text") > 400, "long").otherwise("short")).alias("objects"))
    b = a.select("conv_id", F.col("turn").alias("later"), F.col("objects").alias("others"))
    return a.join(b, "conv_id").where((F.col("later") > F.col("turn")) & F.arrays_overlap("objects", "others")).select("conv_id", "turn", "later")


@query("r15_override_precedence", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'user' ELSE CASE WHEN n_chars > 1000 THEN 'long' ELSE 'short' END END AS kind FROM documents")
def override_precedence(t):
    edited, given = F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("kind"))).otherwise(F.array().cast("array<string>")), F.lit("user")
    auto = F.when(F.col("n_chars") > 1000, "long").otherwise("short")
    return t.documents.select("doc_id", merging.with_override("kind", edited, given, auto).alias("kind"))


@query("r26_card_batches", "SELECT doc_id, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 20 AS batch, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def card_batches(t):
    rows = t.documents.select("doc_id", "source").join(t.labels, "doc_id", "left_anti")
    w = Window.partitionBy("source").orderBy("doc_id")
    return rows.select("doc_id", F.floor((F.row_number().over(w) - 1) / 20).cast("bigint").alias("batch"), "source")


@query(
    "r31_undo_plan",
    f"SELECT a.conv_id, a.turn, count(b.turn) > 0 AS blocked FROM ({_OBJECTS}) a LEFT JOIN ({_OBJECTS}) b ON a.conv_id = b.conv_id AND b.turn > a.turn AND list_has_any(a.objects, b.objects) GROUP BY ALL",
)
def undo_plan(t):
    entries = t.conversations.select("conv_id", "turn", F.array("role", F.when(F.length("text") > 400, "long").otherwise("short")).alias("objects"))
    return merging.undo_blocked(entries, "conv_id", "turn", "objects")
