"""String scalars (inventory section H, without URLs)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import identifiers as ids
from ..functions import text as tx
from .registry import query

_FOLD = f"translate(lower(text), '{tx.ACCENTED}', '{tx.PLAIN}')"
_WS = r"[ \t\n\r\f\v]+"


@query("h9_fold", f"SELECT doc_id, md5({_FOLD}) AS folded, length({_FOLD}) = length(text) AS same_length FROM documents")
def fold(t):
    folded = tx.fold(F.col("text"))
    return t.documents.select("doc_id", F.md5(folded).alias("folded"), (F.length(folded) == F.length("text")).alias("same_length"))


@query(
    "h10_slugify",
    rf"""WITH s AS (SELECT doc_id, regexp_replace(regexp_replace(replace({_FOLD}, 'ß', 'ss'), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS s FROM documents),
    c AS (SELECT doc_id, s, left(s, 80) AS h, regexp_replace(left(s, 80), '-[^-]*$', '') AS k FROM s)
    SELECT doc_id, CASE WHEN length(s) <= 80 THEN s ELSE regexp_replace(CASE WHEN s[81:81] = '-' THEN h WHEN length(k) >= 40 THEN k ELSE h END, '^-+|-+$', '', 'g') END AS slug FROM c""",
)
def slugify(t):
    return t.documents.select("doc_id", tx.slug(F.col("text")).alias("slug"))


@query("h11_safe_filename", r"""SELECT page_id, left(trim(regexp_replace(regexp_replace(url, '[<>:"/\\|?*]+', '_', 'g'), '[ \t]+', ' ', 'g')), 120) AS name FROM pages""")
def safe_filename(t):
    name = F.trim(F.regexp_replace(F.regexp_replace("url", r'[<>:"/\\|?*]+', "_"), "[ \t]+", " "))
    return t.pages.select("page_id", F.left(name, F.lit(120)).alias("name"))


@query(
    "h12_clamp_text",
    rf"""WITH s AS (SELECT doc_id, trim(regexp_replace(text, '{_WS}', ' ', 'g')) AS s FROM documents),
    c AS (SELECT doc_id, s, left(s, 59) AS h, regexp_replace(left(s, 59), ' [^ ]*$', '') AS k FROM s)
    SELECT doc_id, CASE WHEN length(s) <= 60 THEN s ELSE regexp_replace(CASE WHEN contains(h, ' ') AND length(k) >= 0.6 * length(h) THEN k ELSE h END, '[ ,;:.-]+$', '') || '…' END AS short FROM c""",
)
def clamp_text(t):
    return t.documents.select("doc_id", tx.clamp(F.col("text"), 60).alias("short"))


@query(
    "h13_normalized_email",
    """SELECT c_custkey, 'user' || c_custkey || CASE WHEN c_custkey % 3 = 0 THEN '@gmail.com' ELSE '@mail.example.org' END AS email FROM customer WHERE c_custkey % 5 <> 0
    UNION ALL SELECT c_custkey, '' FROM customer WHERE c_custkey % 5 = 0""",
)
def normalized_email(t):
    key = F.col("c_custkey").cast("string")
    raw = F.when(F.col("c_custkey") % 5 == 0, F.concat(F.lit("not an address "), key)).when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("Name <Us.er"), key, F.lit("+tag@GoogleMail.com>")))
    raw = raw.otherwise(F.concat(F.lit("mailto:USER"), key, F.lit("+x@Mail.Example.org")))
    return t.customer.select("c_custkey", ids.normalize_email(raw).alias("email"))


@query(
    "h14_normalized_phone",
    """SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN '+346' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') WHEN 1 THEN '+336' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') WHEN 2 THEN '+346' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') ELSE '' END AS phone FROM customer""",
)
def normalized_phone(t):
    n = F.lpad(F.col("c_custkey").cast("string"), 8, "0")
    kind = F.col("c_custkey") % 4
    spaced = F.concat(F.lit("6"), F.left(n, F.lit(2)), F.lit(" "), F.substring(n, 3, 3), F.lit("-"), F.substring(n, 6, 3))
    raw = F.when(kind == 0, spaced).when(kind == 1, F.concat(F.lit("0033 6"), n)).when(kind == 2, F.concat(F.lit("34 "), F.lit("6"), n)).otherwise("12-3")
    return t.customer.select("c_custkey", ids.normalize_phone(raw).alias("phone"))


@query("h15_domain_of", r"SELECT page_id, regexp_replace(regexp_extract(url, '^https?://([^/?#]+)', 1), '^www\.', '') AS domain, 'mail.example.org' AS mail FROM pages")
def domain_of(t):
    return t.pages.select("page_id", ids.domain_of(F.col("url")).alias("domain"), ids.domain_of(F.concat(F.lit("A <a"), F.col("page_id").cast("string"), F.lit("@Mail.example.org>"))).alias("mail"))


@query("h16_sha256", "SELECT conv_id, turn, sha256(text) AS hash FROM conversations")
def sha256(t):
    return t.conversations.select("conv_id", "turn", F.sha2("text", 256).alias("hash"))


@query(
    "h17_merchant_key",
    """SELECT c_custkey, string_agg(w, ' ' ORDER BY i) AS key FROM (SELECT c_custkey, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM (SELECT c_custkey, regexp_extract_all(lower(c_name || ' S.L.'), '[a-z0-9]+') AS w FROM customer)) WHERE w NOT IN ('s', 'l') GROUP BY c_custkey""",
)
def merchant_key(t):
    from ..operators.similarity import merchant_tokens

    name = F.regexp_replace(F.concat("c_name", F.lit(" S.L.")), r"(?i)\bs\.?\s?l\.?$", "sl")
    return t.customer.select("c_custkey", F.array_join(merchant_tokens(name), " ").alias("key"))


@query(
    "h18_order_refs",
    r"""SELECT event_id, coalesce(regexp_extract('Order no. ' || event_id || '-' || user_id || ' of today', 'Order no\. ([0-9]+-[0-9]+)', 1), '') AS ref FROM events""",
)
def order_refs(t):
    said = F.concat(F.lit("Order no. "), F.col("event_id").cast("string"), F.lit("-"), F.col("user_id").cast("string"), F.lit(" of today"))
    found = F.regexp_extract_all(said, F.lit(r"(?i)(?:order|pedido|ref)[^0-9]{0,8}([0-9][0-9-]{2,})"), F.lit(1))
    return t.events.select("event_id", F.coalesce(F.get(F.slice(F.array_distinct(found), 1, 8), F.lit(0)), F.lit("")).alias("ref"))


@query(
    "h19_citation",
    """SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'Conversation ' || conv_id || ', turn ' || turn ELSE 'Conversation ' || conv_id || ', ' || role || ', turn ' || turn END AS citation FROM conversations""",
)
def citation(t):
    from ..functions.citations import cite

    title = F.concat(F.lit("Conversation "), F.col("conv_id").cast("string"))
    section = F.when(F.col("role") != "user", F.col("role"))
    return t.conversations.select("conv_id", "turn", cite(F.lit("chat"), title, section=section, turn=F.col("turn")).alias("citation"))


@query(
    "h20_page_ranges",
    """WITH e AS (SELECT o_custkey, o_orderkey % 40 AS p FROM orders GROUP BY ALL), i AS (SELECT o_custkey, p, p - row_number() OVER (PARTITION BY o_custkey ORDER BY p) AS g FROM e),
    r AS (SELECT o_custkey, min(p) AS a, max(p) AS b FROM i GROUP BY o_custkey, g)
    SELECT o_custkey, string_agg(CASE WHEN a = b THEN CAST(a AS VARCHAR) ELSE a || '-' || b END, ', ' ORDER BY a) AS pages FROM r GROUP BY o_custkey""",
)
def page_ranges(t):
    from ..functions.ranges import describe

    rows = t.orders.groupBy("o_custkey").agg(F.array_sort(F.collect_set((F.col("o_orderkey") % 40).cast("int"))).alias("p"))
    return rows.select("o_custkey", describe(F.col("p")).alias("pages"))


@query("h20_parse_ranges", "SELECT c_custkey, CAST(list_sum(list_concat(range(1, c_custkey % 8 + 3), [10], range(20, 24))) AS BIGINT) AS total FROM customer")
def parse_ranges(t):
    from ..functions.ranges import parse

    text = F.concat(F.lit("1-"), (F.col("c_custkey") % 8 + 2).cast("string"), F.lit(", 10; 20-23"))
    return t.customer.select("c_custkey", F.aggregate(parse(text), F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total"))


@query(
    "h21_excerpt",
    rf"""WITH l AS (SELECT doc_id, text, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: length(x) >= 80 AND regexp_matches(x, '[.!?…]')) AS g FROM documents),
    s AS (SELECT doc_id, trim(regexp_replace(coalesce(g[1], text), '{_WS}', ' ', 'g')) AS s FROM l), c AS (SELECT doc_id, s, left(s, 279) AS h, regexp_replace(left(s, 279), ' [^ ]*$', '') AS k FROM s)
    SELECT doc_id, CASE WHEN length(s) <= 280 THEN s ELSE regexp_replace(CASE WHEN contains(h, ' ') AND length(k) >= 0.6 * length(h) THEN k ELSE h END, '[ ,;:.-]+$', '') || '…' END AS excerpt FROM c""",
)
def excerpt(t):
    return t.documents.select("doc_id", tx.excerpt(F.col("text")).alias("excerpt"))


@query("h22_word_count", r"SELECT doc_id, CAST(len(regexp_extract_all(text, '[^ \t\n\r\f\v]+')) AS BIGINT) AS words FROM documents")
def word_count(t):
    return t.documents.select("doc_id", tx.word_count(F.col("text")).cast("bigint").alias("words"))


@query("h23_kind_of_response", r"SELECT page_id, CASE WHEN regexp_matches(url, '\.pdf($|\?)') THEN 'pdf' WHEN regexp_matches(url, '\.html($|[?#])') THEN 'page' WHEN contains(url, 'm.') THEN 'mobile' ELSE 'article' END AS kind FROM pages")
def kind_of_response(t):
    u = F.col("url")
    return t.pages.select("page_id", F.when(u.rlike(r"\.pdf($|\?)"), "pdf").when(u.rlike(r"\.html($|[?#])"), "page").when(u.contains("m."), "mobile").otherwise("article").alias("kind"))


@query("h24_decoded_entities", "SELECT page_id, (length(html) - length(replace(html, '&amp;', '')))  // 5 AS ampersands, md5(replace(replace(replace(replace(html, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&')) AS decoded FROM pages")
def decoded_entities(t):
    from ..functions.markup import decode_entities

    return t.pages.select("page_id", F.regexp_count("html", F.lit("&amp;")).cast("bigint").alias("ampersands"), F.md5(decode_entities(F.col("html"))).alias("decoded"))


@query("h25_clock", "SELECT event_id, CASE WHEN s >= 3600 THEN (s // 3600) || ':' || lpad(CAST(s % 3600 // 60 AS VARCHAR), 2, '0') ELSE CAST(s // 60 AS VARCHAR) END || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') AS clock FROM (SELECT event_id, event_id * 7 % 9000 AS s FROM events)")
def clock(t):
    from ..functions.times import clock as shown

    return t.events.select("event_id", shown(F.col("event_id") * 7 % 9000).alias("clock"))


@query("h25_parse_time", "SELECT event_id, event_id * 7 % 9000 AS seconds FROM events")
def parse_time(t):
    from ..functions.times import clock as shown
    from ..functions.times import parse_clock

    return t.events.select("event_id", parse_clock(shown(F.col("event_id") * 7 % 9000)).alias("seconds"))


@query("h26_masked_args", """SELECT event_id, 'k=' || CAST(json_extract(props, '$.k') AS VARCHAR) || ',token=***' AS args FROM events""")
def masked_args(t):
    from ..operators.listing import redact

    made = F.map_concat(F.from_json("props", "map<string,string>"), F.create_map(F.lit("token"), F.col("user_id").cast("string")))
    entries = F.array_sort(F.map_entries(redact(made, ("token", "secret"))))
    return t.events.select("event_id", F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("args"))


@query("h27_looks_like_video", r"SELECT page_id, regexp_matches(lower(url), 'example\.(org|net)') AS video FROM pages")
def looks_like_video(t):
    return t.pages.select("page_id", F.lower("url").rlike(r"example\.(org|net)").alias("video"))


@query(
    "h28_redaction_scan",
    r"""SELECT doc_id, CAST(len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}')) AS BIGINT) AS emails, CAST(len(regexp_extract_all(text, '\d{4}-\d{2}-\d{2}')) AS BIGINT) AS dates, CAST(len(regexp_extract_all(text, '\d{3}-\d{2}-\d{4}')) AS BIGINT) AS ssns FROM documents""",
)
def redaction_scan(t):
    n = lambda p: F.regexp_count("text", F.lit(p)).cast("bigint")
    return t.documents.select("doc_id", n(tx.EMAIL).alias("emails"), n(r"\d{4}-\d{2}-\d{2}").alias("dates"), n(r"\d{3}-\d{2}-\d{4}").alias("ssns"))


@query("h28_card_numbers")
def card_numbers(t):
    found = F.filter(F.regexp_extract_all("text", F.lit(r"(?:[0-9][ -]?){12,18}[0-9]"), F.lit(0)), lambda x: ids.luhn_ok(x))
    return t.documents.select("doc_id", F.size(found).cast("bigint").alias("cards")).where("cards > 0")


@query("h29_tracking_number", r"SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'ups' WHEN 1 THEN 'postal' ELSE '' END AS carrier FROM orders")
def tracking_number(t):
    from ..functions.tracking import classify

    n = F.lpad(F.col("o_orderkey").cast("string"), 9, "0")
    code = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("1Z999AA1"), n, F.lit("0"))).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("RR"), n, F.lit("ES"))).otherwise(F.concat(F.lit("x"), n))
    return t.orders.select("o_orderkey", classify(code).alias("carrier"))
