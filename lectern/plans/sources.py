"""Sources and sinks (inventory section A)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..sources import feeds, files, readers, sinks
from .registry import query


def _files(t):
    """Conversation turns as files of several kinds."""
    c = t.conversations.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "role", "text")
    kind = F.col("id") % 5
    ext = F.when(kind == 0, "md").when(kind == 1, "txt").when(kind == 2, "html").when(kind == 3, "csv").otherwise("py")
    line = F.regexp_replace("text", "\n", " ")
    body = (
        F.when(kind == 0, F.concat(F.lit("# "), "role", F.lit("\n\n"), "text", F.lit("\n\n## Second\n\nMore.")))
        .when(kind == 2, F.concat(F.lit("<html><body><h1>"), "role", F.lit("</h1><p>"), line, F.lit("</p><h2>B</h2><p>More</p></body></html>")))
        .when(kind == 3, F.concat(F.lit("a,b\n1,2\n3,4\n"), F.col("id").cast("string"), F.lit(",x")))
        .otherwise(F.col("text"))
    )
    return c.select("id", F.concat(F.lit("notes/"), "role", F.lit("/"), F.col("id").cast("string"), F.lit("."), ext).alias("path"), body.cast("binary").alias("content"))


@query("a2_glob_filter", "SELECT conv_id * 1000 + turn AS id FROM conversations WHERE role = 'user' AND (conv_id * 1000 + turn) % 5 IN (0, 1)")
def glob_filter(t):
    return _files(t).where(files.accepts(F.col("path"), ["**/USER/*.md", "notes/user/*.tx?"], ["**/*.py"])).select("id")


@query("a3_kinds", "SELECT conv_id * 1000 + turn AS id, ['md', 'txt', 'html', 'csv', ''][(conv_id * 1000 + turn) % 5 + 1] AS kind FROM conversations")
def kinds(t):
    return _files(t).select("id", files.kind_of(F.col("path")).alias("kind"))


@query("a4_sniffed", "SELECT conv_id * 1000 + turn AS id, ['pdf', 'image', 'html', 'docx', 'txt'][(conv_id * 1000 + turn) % 5 + 1] AS kind FROM conversations")
def sniffed(t):
    kind = F.col("id") % 5
    head = F.when(kind == 0, F.unhex(F.lit("255044462D312E37"))).when(kind == 1, F.unhex(F.lit("89504E470D0A1A0A"))).when(kind == 2, F.lit("  <!DOCTYPE html><p>").cast("binary")).when(kind == 3, F.unhex(F.lit("504B03040000")))
    name = F.when(kind == 3, "x.docx").otherwise("x.bin")
    return _files(t).select("id", files.sniffed(name, head.otherwise(F.lit("just words").cast("binary"))).alias("kind"))


@query("a5_decoded", "SELECT conv_id, turn, md5(text) AS text FROM conversations WHERE length(regexp_replace(text, '[ -ÿ]|\\n', '', 'g')) = 0")
def decoded(t):
    kind = F.col("turn") % 3
    data = F.when(kind == 0, F.encode("text", "UTF-8")).when(kind == 1, F.encode("text", "UTF-16"))
    marked, western = F.concat(F.lit("é"), "text"), F.col("text").rlike(r"^[\x00-\x7f\xa0-\xff]*\z")  # other texts have no such bytes
    data = data.when(western, F.encode(marked, "ISO-8859-1")).otherwise(F.encode(marked, "UTF-8"))
    text = files.decoded(data)
    return t.conversations.select("conv_id", "turn", F.md5(F.when(kind == 2, F.substr(text, F.lit(2))).otherwise(text)).alias("text"))


@query(
    "a6_file_units",
    """SELECT id, n FROM (SELECT conv_id * 1000 + turn AS id, CASE (conv_id * 1000 + turn) % 5 WHEN 0 THEN 2 WHEN 2 THEN 2 ELSE 1 END AS n FROM conversations)""",
)
def file_units(t):
    read = readers.units(_files(t).withColumn("kind", files.kind_of(F.col("path"), code=True)))
    id_of = F.regexp_extract("path", r"(\d+)\.\w+$", 1).cast("bigint")
    return read.groupBy(id_of.alias("id")).agg(F.count("*").cast("int").alias("n"))


@query("a8_csv_units", "SELECT conv_id * 1000 + turn AS id, 'a | b' || chr(10) || '1 | 2' || chr(10) || '3 | 4' || chr(10) || (conv_id * 1000 + turn) || ' | x' AS text FROM conversations WHERE (conv_id * 1000 + turn) % 5 = 3")
def csv_units(t):
    read = readers.units(_files(t).where("id % 5 = 3").withColumn("kind", F.lit("csv")))
    return read.select(F.regexp_extract("path", r"(\d+)\.\w+$", 1).cast("bigint").alias("id"), "text")


@query(
    "a15_chat_documents",
    """SELECT conv_id, string_agg(role || ': ' || text, chr(10) || chr(10) ORDER BY turn) AS text, count(*) AS turns, CAST(max(k) AS BIGINT) AS last_unit FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations WHERE role IN ('user', 'assistant')) GROUP BY conv_id""",
)
def chat_documents(t):
    kept = t.conversations.where(F.col("role").isin("user", "assistant"))
    numbered = kept.withColumn("k", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")))
    g = numbered.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.concat("role", F.lit(": "), "text").alias("x")))).alias("p"), F.count("*").alias("turns"), F.max("k").cast("bigint").alias("last_unit"))
    return g.select("conv_id", F.array_join(F.transform("p", lambda p: p["x"]), "\n\n").alias("text"), "turns", "last_unit")


@query("a16_link_documents", r"SELECT page_id, url || chr(10) || regexp_replace(regexp_extract(url, '^https?://([^/?#]+)', 1), '^www\.', '') AS header, CAST(length(html) AS BIGINT) AS n FROM pages")
def link_documents(t):
    from ..functions.urls import site_of

    return t.pages.select("page_id", F.concat_ws("\n", "url", site_of(F.col("url"))).alias("header"), F.length("html").cast("bigint").alias("n"))


@query("a18_imported_links", "SELECT 'https://new.example.org/' || c_custkey AS url, CASE WHEN c_custkey % 5 = 0 THEN 'skipped' ELSE 'added' END AS state FROM customer")
def imported_links(t):
    """A link a customer, in bookmark files and in lists; every fifth is known."""
    i = F.col("c_custkey").cast("string")
    anchor = F.concat(F.lit('<DT><A HREF="https://new.example.org/'), i, F.lit('/?utm_source=x">a</A>\n'))
    lists = t.customer.select(F.when(F.col("c_custkey") % 2 == 0, anchor).otherwise(F.concat(F.lit("https://new.example.org/"), i, F.lit("\nnot a link"))).alias("content"))
    known = t.customer.where("c_custkey % 5 = 0").select(F.concat(F.lit("HTTPS://NEW.example.org/"), i, F.lit("#top")).alias("url"))
    return feeds.imported_links(lists, "content", known)


@query("a19_feed_items", "SELECT conv_id, 'rss' AS format, conv_id || '-' || turn AS id, role || ' & co' AS title FROM conversations")
def feed_items(t):
    item = F.concat(F.lit("<item><guid>"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"), F.lit("</guid><title>"), "role", F.lit(" & co</title><link>http://x/</link></item>"))
    g = t.conversations.groupBy("conv_id").agg(F.concat_ws("", F.collect_list(item)).alias("items"))
    xml = g.select("conv_id", F.concat(F.lit("<rss><channel>"), "items", F.lit("</channel></rss>")).alias("xml"))
    return feeds.parse_feeds(xml, "conv_id", "xml").select("conv_id", "format", "id", "title")


@query("a20_github_feed", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'https://github.com/o' || c_custkey || '/r/releases.atom' ELSE '' END AS feed FROM customer")
def github_feed(t):
    key = F.col("c_custkey").cast("string")
    url = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("https://www.github.com/o"), key, F.lit("/r/tree/main"))).otherwise("https://example.org/a/b")
    return t.customer.select("c_custkey", feeds.github_feed(url).alias("feed"))


def _cues(t):
    one_line = F.trim(F.regexp_replace("text", r"\s+", " "))
    return t.conversations.select("conv_id", "turn", (F.col("turn") * 2.5).alias("s"), (F.col("turn") * 2.5 + 2).alias("e"), one_line.alias("text"))


@query("a23_subtitle_round_trip", "SELECT conv_id, count(*) AS cues, CAST(max(turn * 2.5 + 2) AS DOUBLE) AS last_end FROM conversations GROUP BY conv_id")
def subtitle_round_trip(t):
    text = sinks.srt(_cues(t), "conv_id", "turn", "s", "e", "text")
    return feeds.parse_subtitles(text, "conv_id", "text").groupBy("conv_id").agg(F.count("*").alias("cues"), F.max("stop").alias("last_end"))


@query("a23_vtt_and_lrc", "SELECT conv_id, count(*) AS vtt_cues, count(*) AS lrc_cues FROM conversations GROUP BY conv_id")
def vtt_and_lrc(t):
    a = feeds.parse_subtitles(sinks.vtt(_cues(t), "conv_id", "turn", "s", "e", "text"), "conv_id", "text").groupBy("conv_id").agg(F.count("*").alias("vtt_cues"))
    b = feeds.parse_subtitles(sinks.lrc(_cues(t), "conv_id", "turn", "s", "text"), "conv_id", "text").groupBy("conv_id").agg(F.count("*").alias("lrc_cues"))
    return a.join(b, "conv_id")


@query("a24_calendar_round_trip", "SELECT o_custkey, CAST(o_orderkey AS VARCHAR) AS uid, 'Order ' || o_orderkey || ', ' || o_orderstatus AS summary, strftime(o_orderdate, '%Y%m%d') AS start FROM orders")
def calendar_round_trip(t):
    key = F.col("o_orderkey").cast("string")
    text = sinks.ics(t.orders, "o_custkey", key, F.to_date("o_orderdate"), F.concat(F.lit("Order "), key, F.lit(", "), "o_orderstatus"))
    return feeds.parse_calendars(text, "o_custkey", "text").select("o_custkey", "uid", "summary", "start")


@query("a27_form_values", "SELECT c_custkey, 'name' AS field, c_name AS value FROM customer")
def form_values(t):
    xfdf = F.concat(F.lit('<xfdf><fields><field name="name"><value>'), "c_name", F.lit("</value></field></fields></xfdf>"))
    text = F.when(F.col("c_custkey") % 2 == 0, xfdf).otherwise(F.concat(F.lit("name\n"), "c_name"))
    return feeds.parse_forms(t.customer.select("c_custkey", text.alias("text")), "c_custkey", "text")


@query("a29_table_counts", "SELECT 'orders' AS name, count(*) AS rows FROM orders UNION ALL SELECT 'events', count(*) FROM events UNION ALL SELECT 'documents', count(*) FROM documents")
def table_counts(t):
    out = None
    for name in ("orders", "events", "documents"):
        row = getattr(t, name).agg(F.lit(name).alias("name"), F.count("*").alias("rows"))
        out = row if out is None else out.unionByName(row)
    return out
