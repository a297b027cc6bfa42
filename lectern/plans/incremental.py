"""Incremental and stateful rules in batch form (inventory section O)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import times
from ..operators import changes, media, merging
from .registry import query


@query(
    "o1_index_actions",
    """WITH k AS (SELECT doc_id, n_chars AS size, doc_id * 10.0 AS mtime, md5(text) AS hash FROM documents WHERE doc_id % 7 <> 0), p AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN n_chars + 1 ELSE n_chars END AS size, doc_id * 10.0 + CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END AS mtime, CASE WHEN doc_id % 5 = 0 THEN 'x' ELSE md5(text) END AS hash FROM documents WHERE doc_id % 11 <> 0)
    SELECT coalesce(k.doc_id, p.doc_id) AS doc_id, CASE WHEN p.doc_id IS NULL THEN 'delete' WHEN k.doc_id IS NULL THEN 'add' WHEN p.size = k.size AND abs(p.mtime - k.mtime) <= 1e-6 THEN 'skip' WHEN p.hash = k.hash THEN 'touch' ELSE 'replace' END AS action FROM k FULL JOIN p ON k.doc_id = p.doc_id""",
)
def index_actions(t):
    d = t.documents.select("doc_id", F.col("n_chars").alias("size"), (F.col("doc_id") * 10.0).alias("mtime"), F.md5("text").alias("hash"))
    known = d.where("doc_id % 7 <> 0")
    changed = F.col("doc_id") % 5 == 0
    present = d.where("doc_id % 11 <> 0").select(
        "doc_id", F.when(changed, F.col("size") + 1).otherwise(F.col("size")).alias("size"), (F.col("mtime") + F.when(F.col("doc_id") % 3 == 0, 1).otherwise(0)).alias("mtime"), F.when(changed, "x").otherwise(F.col("hash")).alias("hash")
    )
    return changes.index_actions(known, present, "doc_id")


@query("o2_session_sync", "SELECT conv_id, CASE WHEN conv_id % 2 = 0 THEN 'same' ELSE 'read' END AS action FROM (SELECT DISTINCT conv_id FROM conversations)")
def session_sync(t):
    s = t.conversations.groupBy("conv_id").agg(F.max("turn").alias("stamp"))
    state = s.select("conv_id", (F.col("stamp") - F.col("conv_id") % 2).alias("old"))
    return s.join(state, "conv_id", "left").select("conv_id", F.when(F.col("old") >= F.col("stamp"), "same").otherwise("read").alias("action"))


@query("o3_link_sync", "SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'new' WHEN page_id % 4 = 1 THEN 'changed' ELSE 'same' END AS action FROM pages")
def link_sync(t):
    now = t.pages.select("page_id", F.sha2(F.to_json(F.struct("url", F.length("html"))), 256).alias("fingerprint"))
    old = now.where("page_id % 4 <> 0").select("page_id", F.when(F.col("page_id") % 4 == 1, "old").otherwise(F.col("fingerprint")).alias("before"))
    action = F.when(F.col("before").isNull(), "new").when(F.col("before") != F.col("fingerprint"), "changed").otherwise("same")
    return now.join(old, "page_id", "left").select("page_id", action.alias("action"))


@query("o4_pending_batches", "SELECT count(*) AS rows FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def pending_batches(t):
    return changes.pending(t.documents.select("doc_id"), t.labels.select("doc_id"), "doc_id", 64).agg(F.count("*").alias("rows"))


_LOOKS = "SELECT user_id, event_id, ts, CASE WHEN event_type = 'error' THEN NULL ELSE CAST(value AS BIGINT) % 3 END AS h FROM events"


@query(
    "o5_page_changes",
    f"""SELECT event_id, CASE WHEN h IS NULL THEN 'blocked' WHEN b IS NULL THEN 'baseline' WHEN b = h THEN 'same' ELSE 'changed' END AS state
    FROM (SELECT event_id, h, last_value(h IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM ({_LOOKS}))""",
)
def page_changes(t):
    digest = F.bround("value").cast("bigint") % 3
    return changes.page_changes(t.events, "user_id", "event_id", digest, F.col("event_type") == "error").select("event_id", "state")


@query(
    "o6_new_feed_items",
    """WITH i AS (SELECT event_type AS feed, user_id AS item, CAST(ts AS DATE) AS day FROM events), f AS (SELECT feed, item, min(day) AS day FROM i GROUP BY ALL), s AS (SELECT feed, min(day) AS start FROM i GROUP BY feed)
    SELECT feed, item, day FROM (SELECT f.feed, item, day, row_number() OVER (PARTITION BY f.feed, day ORDER BY item) AS k FROM f JOIN s ON f.feed = s.feed WHERE day > start) WHERE k <= 20""",
)
def new_feed_items(t):
    items = t.events.select(F.col("event_type").alias("feed"), F.col("user_id").alias("item"), F.to_date("ts").alias("day"))
    return changes.new_items(items, "feed", "item", "day", 20)


@query(
    "o8_reminders",
    """WITH d AS (SELECT o_orderkey, date_diff('day', DATE '1998-05-01', CAST(o_orderdate AS DATE)) AS days_left, o_orderkey % 3 = 0 AS told FROM orders), l AS (SELECT *, list_min(list_filter([1, 7, 30], lambda n: n >= days_left AND NOT (told AND n = 30))) AS due FROM d)
    SELECT o_orderkey, days_left, CASE WHEN days_left >= 0 THEN due ELSE 0 END AS lead FROM l WHERE (days_left >= 0 AND due IS NOT NULL) OR (days_left < 0 AND days_left >= -14)""",
)
def reminders(t):
    rows = t.orders.select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    notified = F.when(F.col("o_orderkey") % 3 == 0, F.array(F.lit(30))).otherwise(F.array().cast("array<int>"))
    return changes.reminders(rows, "day", "1998-05-01", F.array(F.lit(1), F.lit(7), F.lit(30)), notified).select("o_orderkey", "days_left", "lead")


@query(
    "o9_rolled_forward",
    """WITH RECURSIVE r AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders UNION ALL SELECT o_orderkey, CAST(d + to_months(1) AS DATE) FROM r WHERE d <= DATE '1998-01-15') SELECT o_orderkey, max(d) AS day FROM r GROUP BY o_orderkey""",
)
def rolled_forward(t):
    rows = t.orders.select("o_orderkey", F.to_date("o_orderdate").alias("d"))
    return rows.select("o_orderkey", times.rolled_forward(F.col("d"), 1, F.lit("1998-01-15").cast("date")).alias("day"))


@query("o10_housekeeping", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' AND a > 30 THEN 'archive' WHEN o_orderstatus = 'O' AND a > 3 THEN 'roll' ELSE 'keep' END AS action FROM (SELECT o_orderkey, o_orderstatus, date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-01-15') AS a FROM orders)")
def housekeeping(t):
    age = F.datediff(F.lit("1998-01-15").cast("date"), F.to_date("o_orderdate"))
    return t.orders.select("o_orderkey", F.when((F.col("o_orderstatus") == "F") & (age > 30), "archive").when((F.col("o_orderstatus") == "O") & (age > 3), "roll").otherwise("keep").alias("action"))


@query("o12_history_route", "SELECT event_id, ts < TIMESTAMP '2024-01-28' AS history FROM events")
def history_route(t):
    return t.events.select("event_id", (F.col("ts") < F.lit("2024-01-28").cast("timestamp_ntz")).alias("history"))


@query(
    "o13_debounced",
    """WITH c AS (SELECT user_id, ts, epoch_us(ts) - epoch_us(lag(ts) OVER w) AS gap FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), g AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap >= 3600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM c)
    SELECT user_id, min(ts) AS start, count(*) AS n FROM g GROUP BY user_id, s""",
)
def debounced(t):
    at = F.col("ts").cast("timestamp")
    groups = t.events.select("user_id", at.alias("at"), "ts").groupBy("user_id", F.session_window("at", "1 hour")).agg(F.min("ts").alias("start"), F.count("*").alias("n"))
    return groups.select("user_id", "start", "n")


@query("ox_tumbling_windows", "SELECT time_bucket(INTERVAL 6 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def tumbling_windows(t):
    rows = t.events.select(F.col("ts").cast("timestamp").alias("at"), "event_type", "value")
    return rows.groupBy(F.window("at", "6 hours"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total")).select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


@query("ox_sliding_windows", "SELECT start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 12 HOUR, ts), time_bucket(INTERVAL 12 HOUR, ts) - INTERVAL 12 HOUR]) AS start FROM events) GROUP BY start")
def sliding_windows(t):
    rows = t.events.select(F.col("ts").cast("timestamp").alias("at"))
    return rows.groupBy(F.window("at", "24 hours", "12 hours")).agg(F.count("*").alias("n")).select(F.col("window.start").cast("timestamp_ntz").alias("start"), "n")


@query("ox_streamed_windows", "SELECT time_bucket(INTERVAL 6 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def streamed_windows(t):
    from ..streaming import jobs

    return jobs.run_once(t.events, jobs.windowed_counts, "complete")


@query("ox_streamed_page_changes", "SELECT user_id, count(*) AS looks FROM events GROUP BY user_id")
def streamed_page_changes(t):
    from ..streaming import jobs

    out = jobs.run_once(t.events, jobs.page_changes, "append")
    return out.groupBy("user_id").agg(F.count("*").alias("looks"))


@query("ox_streamed_dedup", "SELECT user_id, event_type, count(DISTINCT CAST(ts AS DATE)) AS days FROM events GROUP BY ALL")
def streamed_dedup(t):
    from ..streaming import jobs

    out = jobs.run_once(t.events, jobs.daily_notices, "append")
    return out.groupBy("user_id", "event_type").agg(F.count("*").alias("days"))


@query(
    "r1_clean_segments",
    """WITH s AS (SELECT conv_id, turn, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations WHERE length(text) >= 40), g AS (SELECT conv_id, turn, role, sum(CASE WHEN before = role THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY turn) AS g FROM s)
    SELECT conv_id, min(turn) AS first_turn, max(turn) AS last_turn, count(*) AS n FROM g GROUP BY conv_id, g""",
)
def clean_segments(t):
    from ..operators.windows import gap_groups

    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = t.conversations.where(F.length("text") >= 40).select("conv_id", "turn", "role").withColumn("new", ~F.col("role").eqNullSafe(F.lag("role").over(w)))
    g = gap_groups(rows, ["conv_id"], [F.asc("turn")], F.col("new"), "g")
    return g.groupBy("conv_id", "g").agg(F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"), F.count("*").alias("n")).drop("g")


@query("r2_collapsed_loops")
def collapsed_loops(t):
    looped = t.conversations.select((F.col("conv_id") * 1000 + F.col("turn")).alias("line"), F.concat(F.repeat(F.lit("thank you "), 6), "text").alias("text"))
    return media.collapse_loops(looped, "line", "text")


@query("r3_hallucinations", "SELECT conv_id, turn, turn % 4 = 0 AS invented FROM conversations")
def hallucinations(t):
    said = F.when(F.col("turn") % 4 == 0, "Thanks for watching!").otherwise(F.concat(F.lit("so "), "text"))
    return t.conversations.select("conv_id", "turn", media.invented(said).alias("invented"))


@query("r6_ip_classes", "SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'private' WHEN 1 THEN 'loopback' WHEN 2 THEN 'global' WHEN 3 THEN 'link-local' ELSE 'invalid' END AS class FROM customer")
def ip_classes(t):
    from ..functions.network import ip_class

    kind, key = F.col("c_custkey") % 5, (F.col("c_custkey") % 250).cast("string")
    ip = F.when(kind == 0, F.concat(F.lit("10.1.2."), key)).when(kind == 1, F.concat(F.lit("127.0.0."), key)).when(kind == 2, F.concat(F.lit("93.184.216."), key)).when(kind == 3, F.concat(F.lit("169.254.3."), key)).otherwise("300.1.1.1")
    return t.customer.select("c_custkey", ip_class(ip).alias("class"))


@query("r7_error_classes", "SELECT event_id, ['dns', 'timeout', 'refused', 'tls', 'other'][event_id % 5 + 1] AS class FROM events WHERE event_type = 'error'")
def error_classes(t):
    from ..functions.network import error_class

    texts = F.array(*map(F.lit, ("getaddrinfo ENOTFOUND host", "operation timed out after 20 s", "ECONNREFUSED 127.0.0.1", "certificate has expired", "something else")))
    return t.events.where("event_type = 'error'").select("event_id", error_class(F.element_at(texts, (F.col("event_id") % 5 + 1).cast("int"))).alias("class"))


@query("r17_snoozed", "SELECT o_orderkey, CAST(greatest(CAST(o_orderdate AS DATE), DATE '1998-01-15') + to_days(7) AS DATE) AS day FROM orders")
def snoozed(t):
    return t.orders.select("o_orderkey", F.date_add(F.greatest(F.to_date("o_orderdate"), F.lit("1998-01-15").cast("date")), 7).alias("day"))


@query("r19_deadline_presets", "SELECT preset, count(*) AS n FROM (SELECT CASE WHEN o_orderstatus = 'F' THEN 'done' WHEN CAST(o_orderdate AS DATE) < DATE '1998-01-15' THEN 'overdue' ELSE 'upcoming' END AS preset FROM orders) GROUP BY preset")
def deadline_presets(t):
    preset = F.when(F.col("o_orderstatus") == "F", "done").when(F.to_date("o_orderdate") < F.lit("1998-01-15").cast("date"), "overdue").otherwise("upcoming")
    return t.orders.groupBy(preset.alias("preset")).agg(F.count("*").alias("n"))


@query("r24_retry_payments", "SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F' AND CAST(o_orderdate AS DATE) BETWEEN DATE '1998-01-01' AND DATE '1998-02-15' ORDER BY o_orderdate, o_orderkey LIMIT 30")
def retry_payments(t):
    rows = t.orders.where((F.col("o_orderstatus") != "F") & F.to_date("o_orderdate").between(F.lit("1998-01-01").cast("date"), F.lit("1998-02-15").cast("date")))
    return rows.orderBy("o_orderdate", "o_orderkey").limit(30).select("o_orderkey")


@query("r25_read_marks", "SELECT user_id, min(ts) AS read_at FROM events WHERE event_type = 'view' GROUP BY user_id")
def read_marks(t):
    views = t.events.where("event_type = 'view'").select("user_id", "ts")
    old = views.where("ts < '2024-01-10'").groupBy("user_id").agg(F.min("ts").alias("read_at"))
    new = views.where("ts >= '2024-01-10'").groupBy("user_id").agg(F.min("ts").alias("again"))
    return old.join(new, "user_id", "full").select("user_id", F.coalesce("read_at", "again").alias("read_at"))


@query(
    "r27_digest_lines",
    "SELECT conv_id, string_agg('- ' || turn || ' ' || role, chr(10) ORDER BY turn) AS digest FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations) WHERE k <= 5 GROUP BY conv_id",
)
def digest_lines(t):
    from ..operators.windows import first_of_each

    top = first_of_each(t.conversations.select("conv_id", "turn", "role"), ["conv_id"], [F.asc("turn")], 5)
    lines = top.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.concat(F.lit("- "), F.col("turn").cast("string"), F.lit(" "), "role").alias("x")))).alias("l"))
    return lines.select("conv_id", F.array_join(F.transform("l", lambda x: x["x"]), "\n").alias("digest"))


@query("r28_track_choice", "SELECT source, first(lang ORDER BY CASE lang WHEN 'es' THEN 1 WHEN 'fr' THEN 2 ELSE 3 END, doc_id) AS lang FROM documents GROUP BY source")
def track_choice(t):
    order = F.struct(F.when(F.col("lang") == "es", 1).when(F.col("lang") == "fr", 2).otherwise(3), F.col("doc_id"))
    return t.documents.groupBy("source").agg(F.min_by("lang", order).alias("lang"))


@query("r36_title_case", "SELECT c_custkey, string_agg(CASE WHEN i > 1 AND w IN ('of', 'the') THEN w ELSE upper(left(w, 1)) || substr(w, 2) END, ' ' ORDER BY i) AS title FROM (SELECT c_custkey, unnest(string_split('the land of ' || lower(c_name), ' ')) AS w, generate_subscripts(string_split('the land of ' || lower(c_name), ' '), 1) AS i FROM customer) GROUP BY c_custkey")
def title_case(t):
    words = F.split(F.concat(F.lit("the land of "), F.lower("c_name")), " ")
    shown = F.transform(words, lambda w, i: F.when((i > 0) & w.isin("of", "the"), w).otherwise(F.concat(F.upper(F.left(w, F.lit(1))), F.substring(w, 2, 100))))
    return t.customer.select("c_custkey", F.array_join(shown, " ").alias("title"))


@query("r37_agenda_items", "SELECT event_id, event_type || ':' || user_id || ':' || CAST(CAST(ts AS DATE) AS VARCHAR) AS dedupe_key, CASE event_type WHEN 'error' THEN 3 WHEN 'purchase' THEN 2 ELSE 1 END AS priority FROM events WHERE event_type IN ('error', 'purchase', 'signup')")
def agenda_items(t):
    rows = t.events.where(F.col("event_type").isin("error", "purchase", "signup"))
    key = F.concat_ws(":", "event_type", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd"))
    return rows.select("event_id", key.alias("dedupe_key"), F.when(F.col("event_type") == "error", 3).when(F.col("event_type") == "purchase", 2).otherwise(1).alias("priority"))
