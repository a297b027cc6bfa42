"""Operators of the inventory's last section (R), and some of A, C, I, M, N and O."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import times, urls
from ..operators import compare, extraction, listing, merging
from ..operators import retrieval as rt
from ..sources import feeds, files, readers, results
from .registry import query


@query("a1_folder_scan", "SELECT DISTINCT lang || '/' || source AS folder, 'txt' AS kind FROM documents WHERE lang <> 'de'")
def folder_scan(t):
    """Writes the documents as files by language and source into the shared folder and scans it."""
    from ..storage import scratch

    folder = scratch(t.spark, "scan")
    t.documents.select("lang", "source", "text").write.partitionBy("lang", "source").text(folder)
    found = files.scan(t.spark, folder, ["**/*.txt"], ["lang=de/**"])
    place = F.concat_ws("/", F.regexp_extract("path", "lang=([^/]*)/", 1), F.regexp_extract("path", "source=([^/]*)/", 1))
    return found.select(place.alias("folder"), "kind").distinct()


@query("a9_html_sections", "SELECT page_id, 1 AS sections FROM pages")
def html_sections(t):
    rows = t.pages.select(F.concat(F.col("page_id").cast("string"), F.lit(".html")).alias("path"), F.lit("html").alias("kind"), F.col("html").cast("binary").alias("content"))
    found = readers.units(rows.withColumn("content", F.concat(F.lit("<h1>A</h1><p>x</p>"), F.col("content").cast("string")).cast("binary")))
    first = found.where("title = 'A' and number = 1").groupBy("path").agg(F.count("*").cast("int").alias("sections"))
    return first.select(F.regexp_extract("path", r"^(\d+)", 1).cast("bigint").alias("page_id"), "sections")


@query("a22_result_hits", r"SELECT page_id, url, row_number() OVER (PARTITION BY page_id // 20 ORDER BY page_id) AS rank FROM pages")
def result_hits(t):
    """Lists of some twenty results, each link behind a redirect."""
    anchor = F.concat(F.lit('<a class="result" href="https://r.example/url?q='), F.url_encode("url"), F.lit('">t</a><!--'), F.col("page_id").cast("string"), F.lit("-->"))
    lists = t.pages.groupBy(F.floor(F.col("page_id") / 20).alias("k")).agg(F.array_sort(F.collect_list(F.struct("page_id", anchor.alias("a")))).alias("x"))
    pages = lists.select(F.array_join(F.transform("x", lambda x: x["a"]), "\n").alias("html"))
    hits = pages.select(F.posexplode(F.split("html", "\n")).alias("i", "line"))
    return hits.select(
        F.regexp_extract("line", r"<!--(\d+)-->", 1).cast("bigint").alias("page_id"), urls.unwrap_redirect(F.regexp_extract("line", 'href="([^"]+)"', 1)).alias("url"), (F.col("i") + 1).cast("bigint").alias("rank")
    )


@query(
    "a22_parsed_hits",
    r"""WITH p AS (SELECT page_id, url, ['ddg', 'bing', 'searxng', 'brave'][page_id % 4 + 1] AS engine, 'Page ' || page_id || ' & more' AS title FROM pages)
    SELECT page_id, engine, CAST(rank AS INTEGER) AS rank, CASE rank WHEN 1 THEN url ELSE 'https://other.example/' || page_id END AS url, CASE rank WHEN 1 THEN title ELSE 'Other' END AS title, CASE rank WHEN 1 THEN 'About ' || page_id ELSE '' END AS snippet FROM p, (VALUES (1), (2)) r(rank)""",
)
def parsed_hits(t):
    """An answer of one of four engines about every page: an advert or a link to the
    engine itself first, then the page and another one."""
    key = F.col("page_id").cast("string")
    title = F.concat(F.lit("Page <b>"), key, F.lit("</b> &amp; more"))
    ddg = F.concat(F.lit('<div class="result result--ad"><a class="result__a" href="https://ad.example">Ad</a></div><div class="web result"><h2><a class="result__a" href="//duckduckgo.com/l/?uddg='), F.url_encode("url"), F.lit('&amp;rut=1">'), title, F.lit('</a></h2><a class="result__snippet">About\n '), key, F.lit('</a></div><div class="result"><a class="result__a" href="https://other.example/'), key, F.lit('">Other</a></div>'))
    packed = F.translate(F.rtrim(F.replace(F.base64(F.col("url").cast("binary")), F.lit("="), F.lit(" "))), "+/", "-_")
    bing = F.concat(F.lit('<ol><li class="b_algo"><h2><a href="https://www.bing.com/maps">Maps</a></h2></li><li class="b_algo"><h2><a href="https://www.bing.com/ck/a?!&amp;&amp;u=a1'), F.replace(packed, F.lit("\r\n"), F.lit("")), F.lit('&amp;ntb=1">'), title, F.lit('</a></h2><div class="b_caption"><p>About '), key, F.lit('</p></div></li><li class="b_algo"><h2><a href="https://other.example/'), key, F.lit('">Other</a></h2></li></ol>'))
    plain = F.concat(F.lit("Page "), key, F.lit(" & more"))
    hit = lambda said, about: F.array(F.struct("url", said.alias("title"), F.concat(F.lit("About "), key).alias(about)), F.struct(F.concat(F.lit("https://other.example/"), key).alias("url"), F.lit("Other").alias("title"), F.lit("").alias(about)))
    searxng = F.to_json(F.struct(hit(plain, "content").alias("results")))
    brave = F.to_json(F.struct(F.struct(hit(F.concat(F.lit("<strong>Page</strong> "), key, F.lit(" & more")), "description").alias("results")).alias("web")))
    n = (F.col("page_id") % 4 + 1).cast("int")
    engines = F.element_at(F.array(*map(F.lit, ("ddg", "bing", "searxng", "brave"))), n)
    answers = t.pages.select("page_id", engines.alias("engine"), F.element_at(F.array(ddg, bing, searxng, brave), n).alias("answer"))
    return results.parsed_hits(answers, "page_id", "engine", "answer").drop("date")


@query("a26_watched_folder", "SELECT count(*) AS rows FROM events")
def watched_folder(t):
    """A table folder streamed to its end with the trigger that a service would poll with."""
    from ..streaming.jobs import run_once

    def passed(stream):
        return stream.select("event_id")

    return run_once(t.events, passed, "append").agg(F.count("*").alias("rows"))


_FOLD = f"translate(lower(text), '{tx.ACCENTED}', '{tx.PLAIN}')"


@query("c2_matches_with_rows", rf"SELECT doc_id, source, lang FROM documents WHERE list_contains(regexp_extract_all({_FOLD}, '[\p{{L}}\p{{N}}]+'), 'idiot')")
def matches_with_rows(t):
    hits = rt.bm25(t.documents, "doc_id", {"text": 1.0}, ["idiot"])
    return t.documents.select("doc_id", "source", "lang").join(hits.select("doc_id"), "doc_id")


@query(
    "i5_spoken_dates",
    """SELECT o_orderkey, CAST(CASE o_orderkey % 5 WHEN 0 THEN d + to_days(1) WHEN 1 THEN d + to_days(3) WHEN 2 THEN d + to_days(CAST(CASE WHEN isodow(d) < 5 THEN 5 - isodow(d) ELSE 12 - isodow(d) END AS INT)) WHEN 3 THEN last_day(d) ELSE d + to_days(14) END AS DATE) AS due FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)""",
)
def spoken_dates(t):
    said = F.element_at(F.array(*map(F.lit, ("mañana", "en 3 días", "el viernes", "a fin de mes", "in two weeks"))), (F.col("o_orderkey") % 5 + 1).cast("int"))
    return t.orders.select("o_orderkey", times.spoken(said, F.to_date("o_orderdate")).alias("due"))


@query(
    "m6_merged_units",
    """WITH u AS (SELECT conv_id, turn, row_number() OVER l AS place, role, text, CASE WHEN length(text) >= 200 THEN turn END AS long FROM conversations WINDOW l AS (PARTITION BY conv_id ORDER BY turn)),
    o AS (SELECT *, coalesce(min(long) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), max(long) OVER d, first_value(turn) OVER (PARTITION BY conv_id ORDER BY length(text) DESC, place)) AS owner, max(long) OVER d IS NULL AS none FROM u WINDOW d AS (PARTITION BY conv_id))
    SELECT conv_id, owner AS turn, max(role) FILTER (owner = turn) AS title, md5(string_agg(CASE WHEN owner = turn THEN text ELSE role || chr(10) || text END, chr(10) || chr(10) ORDER BY CASE WHEN none AND owner = turn THEN 1 ELSE 0 END, place)) AS text FROM o GROUP BY conv_id, owner""",
)
def merged_units(t):
    from ..operators.chunking import merged_units as merge

    rows = t.conversations.select("conv_id", "turn", F.lit("section").alias("kind"), "role", "text")
    return merge(rows, "conv_id", "turn", "kind", "role", "text").select("conv_id", "turn", "title", F.md5("text").alias("text"))


@query("n4_assigned_roles", "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) + to_days(30) AS DATE) AS due, CAST(o_orderdate AS DATE) AS issued FROM orders")
def assigned_roles(t):
    o = t.orders.select("o_orderkey", F.to_date("o_orderdate").alias("d"))
    day = lambda n: F.date_format(F.date_add("d", n), "dd/MM/yyyy")
    text = F.concat(F.lit("Invoice date: "), day(0), F.lit(" and due date: "), day(30))
    found = extraction.find_dates(o.select("o_orderkey", text.alias("text")), "o_orderkey", "text")
    return found.groupBy("o_orderkey").agg(F.max(F.when(F.col("role") == "due", F.col("day"))).alias("due"), F.max(F.when(F.col("role") == "issue", F.col("day"))).alias("issued"))


@query("n20_region_difference", "SELECT a.vec_id, CAST(len(list_filter(range(1, 9), lambda r: list_max(list_transform(range(1, 9), lambda c: abs(a.embedding[8 * (r - 1) + c]::DOUBLE - b.embedding[8 * (r - 1) + c]::DOUBLE))) > 0.3)) AS BIGINT) AS regions FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def region_difference(t):
    after = t.embeddings.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    gap = F.zip_with("embedding", "other", lambda x, y: F.abs(x.cast("double") - y.cast("double")))
    j = t.embeddings.select("vec_id", "embedding").join(after, "vec_id").select("vec_id", gap.alias("g"))
    blocks = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda r: F.array_max(F.slice("g", r * 8 + 1, 8)))
    return j.select("vec_id", F.size(F.filter(blocks, lambda x: x > 0.3)).cast("bigint").alias("regions"))


@query("o7_rebaselined_watches", "SELECT user_id, CASE WHEN user_id % 3 = 0 THEN 'rebaseline' WHEN user_id % 3 = 1 THEN 'check' ELSE 'skip' END AS action FROM (SELECT DISTINCT user_id FROM events)")
def rebaselined_watches(t):
    users = t.events.select("user_id").distinct()
    engine, enabled = F.when(F.col("user_id") % 3 == 0, 1).otherwise(2), F.col("user_id") % 3 != 2
    return users.select("user_id", F.when(~enabled, "skip").when(engine < 2, "rebaseline").otherwise("check").alias("action"))


@query("o11_notice_window", "WITH x AS (SELECT user_id, event_type, event_id, ts, lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS b FROM events) SELECT event_id FROM x WHERE b IS NULL OR epoch(ts) - epoch(b) >= 86400")
def notice_window(t):
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    seconds = lambda c: F.unix_micros(c.cast("timestamp")) / 1e6
    rows = t.events.select("event_id", "user_id", "event_type", "ts").withColumn("b", F.lag("ts").over(w))
    return rows.where(F.col("b").isNull() | (seconds(F.col("ts")) - seconds(F.col("b")) >= 86_400)).select("event_id")


@query("r8_declared_charset", "SELECT c_custkey, 'café ' || c_name AS text FROM customer")
def declared_charset(t):
    text = F.concat(F.lit("café "), "c_name")
    data = F.when(F.col("c_custkey") % 2 == 0, F.encode(text, "ISO-8859-1")).otherwise(F.encode(text, "UTF-8"))
    return t.customer.select("c_custkey", files.decoded(data).alias("text"))


@query("r10_freshness_codes", "SELECT o_orderkey, CASE WHEN d <= 1 THEN 'd' WHEN d <= 7 THEN 'w' WHEN d <= 20 THEN 'm' ELSE 'y' END AS code FROM (SELECT o_orderkey, date_diff('day', max(CAST(o_orderdate AS DATE)) OVER (), CAST(o_orderdate AS DATE)) * -1 AS d FROM orders)")
def freshness_codes(t):
    """By the days between an order and the newest one."""
    newest = t.orders.agg(F.max(F.to_date("o_orderdate")).alias("newest"))  # one row
    d = F.datediff("newest", F.to_date("o_orderdate"))
    return t.orders.join(F.broadcast(newest)).select("o_orderkey", F.when(d <= 1, "d").when(d <= 7, "w").when(d <= 20, "m").otherwise("y").alias("code"))


@query("r11_unwrapped_results", "SELECT page_id, url FROM pages")
def unwrapped_results(t):
    coded = F.concat(F.lit("https://b.example/ck/a?u=a1"), F.rtrim(F.translate(F.base64(F.col("url").cast("binary")), "+/\r\n", "-_"), F.lit("=")))
    return t.pages.select("page_id", urls.unwrap_coded(coded).alias("url"))


@query("r12_diff_summary", "SELECT conv_id, n, CASE WHEN n > 8 THEN '+' || (n - 8) ELSE '' END AS more FROM (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id)")
def diff_summary(t):
    g = t.conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.concat(F.lit("line "), F.col("turn").cast("string")))).alias("new"))
    added = compare.added_lines(F.array(F.lit("other")), F.col("new"), lambda x: F.lower(F.trim(x)))
    return g.select("conv_id", F.size(added).cast("bigint").alias("n"), F.regexp_extract(compare.summary(added), r"(\+\d+)$", 1).alias("more"))


@query("r13_feed_outcome", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'not modified' WHEN 1 THEN 'blocked' WHEN 2 THEN 'error' ELSE 'items' END AS outcome FROM events")
def feed_outcome(t):
    from ..operators.quality import block_reason

    kind = F.col("event_id") % 4
    status = F.when(kind == 0, 304).when(kind == 1, 403).when(kind == 2, 500).otherwise(200)
    outcome = F.when(status == 304, "not modified").when(status >= 500, "error").when(block_reason(status, F.lit("")) != "", "blocked").otherwise("items")
    return t.events.select("event_id", outcome.alias("outcome"))


@query("r14_pasted_texts", "SELECT min(conv_id * 1000 + turn) AS id FROM conversations WHERE length(text) >= 40 GROUP BY sha256(text)")
def pasted_texts(t):
    rows = t.conversations.where(F.length("text") >= 40).select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.sha2("text", 256).alias("hash"))
    return rows.groupBy("hash").agg(F.min("id").alias("id")).select("id")


@query("r16_edited_fields", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'kind,lang' ELSE 'lang' END AS edited FROM documents")
def edited_fields(t):
    old = F.array(F.lit("lang"))
    new = F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("kind"))).otherwise(F.array().cast("array<string>"))
    return t.documents.select("doc_id", F.array_join(F.array_sort(F.array_union(old, new)), ",").alias("edited"))


@query("r18_owner_updates", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'rescheduled' ELSE 'updated' END AS action FROM orders WHERE o_orderstatus <> 'P'")
def owner_updates(t):
    o = t.orders.where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("key"), F.to_date("o_orderdate").alias("old_day"))
    new = o.select("key", F.date_add("old_day", F.when(F.col("key") % 2 == 0, 3).otherwise(0)).alias("new_day"), F.lit(False).alias("dismissed"))
    return merging.deadline_actions(o, new, "key").select(F.col("key").alias("o_orderkey"), "action")


@query("r20_overview", "SELECT o_orderstatus, count(*) AS n, min(o_orderkey) AS first_order, max(o_totalprice) AS top FROM orders GROUP BY o_orderstatus")
def overview(t):
    return t.orders.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first_order"), F.max("o_totalprice").alias("top"))


@query("r22_paged_changes")
def paged_changes(t):
    """The second page of a long comparison: changes 10 to 19 of each pair, masked.
    Texts that stay as they are have none and are not compared."""
    rows = t.documents.select("doc_id", F.col("text").alias("old"), F.regexp_replace("text", " the ", " a ").alias("new")).where("old <> new")
    found = compare.line_changes(rows, "doc_id", "old", "new", " ", first=19)
    w = Window.partitionBy("doc_id").orderBy("old_place", "new_place", "kind", "old_text", "new_text")
    page = found.withColumn("k", F.row_number().over(w)).where("k between 10 and 19")
    return page.select("doc_id", "k", "kind", tx.mask_emails(F.col("old_text")).alias("old_text"), tx.mask_emails(F.col("new_text")).alias("new_text"))


@query("r23_unit_reading", "SELECT conv_id, turn, left(text, 100) AS shown, length(text) > 100 AS cut, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS next_turn FROM conversations")
def unit_reading(t):
    rows = listing.with_neighbours(t.conversations, "conv_id", "turn", "turn")
    return rows.select("conv_id", "turn", F.left("text", F.lit(100)).alias("shown"), (F.length("text") > 100).alias("cut"), "next_turn")


@query("r29_normalised_transcript", "SELECT conv_id, count(*) AS n, CAST(max(turn) * 1.5 + 1.5 AS DOUBLE) AS last_end FROM conversations GROUP BY conv_id")
def normalised_transcript(t):
    raw = t.conversations.groupBy("conv_id").agg(F.collect_list(F.struct((F.col("turn") * 1500).alias("offset_ms"), F.lit(1500).alias("ms"), "text")).alias("raw"))
    one = F.transform("raw", lambda x: F.struct((x["offset_ms"] / 1000).alias("s"), ((x["offset_ms"] + x["ms"]) / 1000).alias("e"), tx.squeeze(x["text"]).alias("t")))
    return raw.select("conv_id", F.explode(one).alias("x")).groupBy("conv_id").agg(F.count("*").alias("n"), F.max("x.e").alias("last_end"))


@query("r30_download_totals", "SELECT lang, count(*) AS files, CAST(sum(n_chars) AS BIGINT) AS bytes FROM documents WHERE n_chars > 100 GROUP BY lang")
def download_totals(t):
    return t.documents.where("n_chars > 100").groupBy("lang").agg(F.count("*").alias("files"), F.sum("n_chars").alias("bytes"))


@query("r38_due_sources", "SELECT user_id FROM (SELECT user_id, max(ts) AS last FROM events GROUP BY user_id) WHERE epoch(TIMESTAMP '2024-01-31') - epoch(last) >= 86400 * (1 + user_id % 3)")
def due_sources(t):
    last = t.events.groupBy("user_id").agg(F.max("ts").alias("last"))
    return last.where(listing.is_due(F.col("last"), "2024-01-31", 86_400 * (1 + F.col("user_id") % 3), F.lit(True))).select("user_id")


@query("a21_news_hits", "SELECT c_custkey, 'About ' || c_name AS title, 1 AS rank FROM customer")
def news_hits(t):
    xml = F.concat(F.lit("<rss><channel><item><title>About "), "c_name", F.lit("</title><link>https://n.example/1</link></item></channel></rss>"))
    items = feeds.parse_feeds(t.customer.select("c_custkey", xml.alias("xml")), "c_custkey", "xml")
    return items.select("c_custkey", "title", F.lit(1).alias("rank"))
