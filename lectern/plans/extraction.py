"""Information extraction (inventory section N)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import compare, extraction, facts, windows
from .registry import query


def _paper(t):
    """Paperwork written from the orders: each has a kind, dates, amounts and a number."""
    o = t.orders.select("o_orderkey", "o_totalprice", F.to_date("o_orderdate").alias("d"))
    day = lambda n: F.date_format(F.date_add("d", n), "dd/MM/yyyy")
    amount = F.translate(F.format_number("o_totalprice", 2), ",.", ".,")
    key = F.col("o_orderkey").cast("string")
    kinds = F.array(
        F.concat(F.lit("Aguas Claras S.L.\nFactura nº: F-"), key, F.lit("\nFecha de emisión: "), day(0), F.lit("\nBase imponible e IVA\nTotal a pagar: "), amount, F.lit(" €\nFecha límite: "), day(20)),
        F.concat(F.lit("Póliza: P-"), key, F.lit("\nTomador y asegurado\nPrima total: "), amount, F.lit(" €\nFecha de efecto: "), day(0), F.lit("\nVálido hasta, finaliza: "), day(365)),
        F.concat(F.lit("Ayuntamiento de Villa\nBoletín de denuncia, multa por infracción\nExpediente: X-"), key, F.lit("\nNotificado el "), day(0), F.lit("\nImporte: "), amount, F.lit(" €\nPronto pago: 20 días")),
        F.concat(F.lit("Warranty and receipt\nOrder number: O-"), key, F.lit("\nPurchased "), day(0), F.lit("\nThe warranty lasts 36 months\nTotal: $"), F.format_number("o_totalprice", 2)),
        F.concat(F.lit("A note without any paperwork "), key),
    )
    return o.select("o_orderkey", F.col("o_totalprice").alias("price"), "d", (F.col("o_orderkey") % 5).alias("n"), F.element_at(kinds, (F.col("o_orderkey") % 5 + 1).cast("int")).alias("text"))


@query("n1_extract_documents")
def extract_documents(t):
    return extraction.extract_documents(_paper(t), "o_orderkey", "text")


@query("n2_kinds", "SELECT o_orderkey, ['invoice', 'insurance', 'fine', 'warranty', 'other'][o_orderkey % 5 + 1] AS kind FROM orders")
def kinds(t):
    return extraction.classified(_paper(t), "o_orderkey", "text").select("o_orderkey", "kind")


@query(
    "n3_dated_facts",
    """SELECT o_orderkey, d AS day, ['issue', 'start', 'notified', 'purchase'][o_orderkey % 5 + 1] AS role FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders) WHERE o_orderkey % 5 < 4
    UNION ALL SELECT o_orderkey, CAST(d + to_days(CASE o_orderkey % 5 WHEN 0 THEN 20 ELSE 365 END) AS DATE), CASE o_orderkey % 5 WHEN 0 THEN 'due' ELSE 'end' END FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders) WHERE o_orderkey % 5 < 2""",
)
def dated_facts(t):
    return extraction.find_dates(_paper(t), "o_orderkey", "text").select("o_orderkey", "day", "role")


@query("n6_first_of_roles", "SELECT o_orderkey, CAST(CASE o_orderkey % 5 WHEN 0 THEN d + to_days(20) ELSE d + to_days(365) END AS DATE) AS day FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders) WHERE o_orderkey % 5 < 2")
def first_of_roles(t):
    found = extraction.find_dates(_paper(t), "o_orderkey", "text").where("role in ('due', 'end')")
    order = F.when(F.col("role") == "due", 0).otherwise(1)
    return windows.first_of_each(found, ["o_orderkey"], [order.asc(), F.asc("start")]).select("o_orderkey", "day")


@query("n7_periods", "SELECT o_orderkey, CASE o_orderkey % 5 WHEN 2 THEN 20 ELSE 36 END AS n, CASE o_orderkey % 5 WHEN 2 THEN 'day' ELSE 'month' END AS unit, CASE o_orderkey % 5 WHEN 2 THEN 'fine_discount' ELSE 'warranty' END AS purpose FROM orders WHERE o_orderkey % 5 IN (2, 3)")
def periods(t):
    make = lambda k, body: ((k, n, unit, purpose) for n, unit, _, purpose in extraction.periods_in(body or ""))
    return extraction.mapped(_paper(t), ["o_orderkey", "text"], "o_orderkey bigint, n int, unit string, purpose string", make)


@query("n8_chosen_amount", "SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 5 < 4 THEN round(CAST(o_totalprice AS DECIMAL(18, 4)), 2) END AS DOUBLE) AS amount FROM orders")
def chosen_amount(t):
    def make(k, body):
        total, _ = extraction.chosen_amount(body or "")
        yield k, None if total is None else float(total)

    return extraction.mapped(_paper(t), ["o_orderkey", "text"], "o_orderkey bigint, amount double", make)


@query("n9_references", "SELECT o_orderkey, CASE WHEN o_orderkey >= 10 THEN ['F-', 'P-', 'X-', 'O-'][o_orderkey % 5 + 1] || o_orderkey END AS ref FROM orders")
def references(t):
    make = lambda k, body: [(k, next(iter(extraction.references_in(body or "")), None))]
    return extraction.mapped(_paper(t), ["o_orderkey", "text"], "o_orderkey bigint, ref string", make)


@query("n10_issuers", "SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'Aguas Claras S.L.' WHEN 1 THEN 'Póliza: P-' || o_orderkey WHEN 2 THEN 'Ayuntamiento de Villa' WHEN 3 THEN 'Warranty and receipt' ELSE 'A note without any paperwork ' || o_orderkey END AS issuer FROM orders")
def issuers(t):
    make = lambda k, body: [(k, extraction.issuer_of(body or ""))]
    return extraction.mapped(_paper(t), ["o_orderkey", "text"], "o_orderkey bigint, issuer string", make)


@query(
    "n11_deadlines",
    """WITH o AS (SELECT o_orderkey, o_orderkey % 5 AS n, CAST(o_orderdate AS DATE) AS d FROM orders)
    SELECT o_orderkey, 'payment' AS kind, CAST(d + to_days(20) AS DATE) AS day FROM o WHERE n = 0 UNION ALL SELECT o_orderkey, 'renewal', CAST(d + to_days(365) AS DATE) FROM o WHERE n = 1 UNION ALL SELECT o_orderkey, 'cancel_by', CAST(CAST(d + to_days(365) AS DATE) - to_months(1) AS DATE) FROM o WHERE n = 1
    UNION ALL SELECT o_orderkey, 'fine_discount', CAST(d + to_days(20) AS DATE) FROM o WHERE n = 2 UNION ALL SELECT o_orderkey, 'warranty', CAST(d + to_months(36) AS DATE) FROM o WHERE n = 3""",
)
def deadlines(t):
    papers = _paper(t)
    joined = extraction.classified(papers, "o_orderkey", "text", keep=("text",))
    make = lambda k, body, kind: ((k, what, day) for what, day, _ in extraction.deadlines_of(body or "", kind))
    return extraction.mapped(joined, ["o_orderkey", "text", "kind"], "o_orderkey bigint, kind string, day date", make)


@query(
    "n13_mail_classes",
    """SELECT conv_id, turn, CASE WHEN s >= 4 THEN 'doc' WHEN s >= 2 THEN 'maybe' ELSE 'noise' END AS class FROM (SELECT conv_id, turn, CASE WHEN length(text) > 300 THEN 3 ELSE 0 END + CASE WHEN role = 'assistant' THEN 2 ELSE 0 END - CASE WHEN contains(lower(text), 'newsletter') THEN 3 ELSE 0 END AS s FROM conversations)""",
)
def mail_classes(t):
    score = F.when(F.length("text") > 300, 3).otherwise(0) + F.when(F.col("role") == "assistant", 2).otherwise(0) - F.when(F.lower("text").contains("newsletter"), 3).otherwise(0)
    return t.conversations.select("conv_id", "turn", F.when(score >= 4, "doc").when(score >= 2, "maybe").otherwise("noise").alias("class"))


@query("n14_readable_attachments", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END AS readable FROM events")
def readable_attachments(t):
    item = lambda name, size: F.struct(name.alias("name"), size.alias("size"))
    files = F.array(item(F.when(F.col("event_id") % 3 == 0, "a.pdf").otherwise("a.exe"), F.lit(1000)), item(F.lit("sign.png"), F.lit(2000)), item(F.lit("big.pdf"), F.lit(90_000_000)))
    good = F.filter(files, lambda f: F.lower(f["name"]).rlike(r"\.(pdf|docx?|txt|eml)$") & (f["size"] <= 25_000_000))
    return t.events.select("event_id", F.size(good).alias("readable"))


@query("n15_tax_category", "SELECT p_partkey, CASE WHEN contains(lower(p_type), 'steel') THEN 'materials' WHEN contains(lower(p_type), 'brass') THEN 'fittings' WHEN p_size > 25 THEN 'large' ELSE '' END AS category FROM part")
def tax_category(t):
    kind = F.lower("p_type")
    return t.part.select("p_partkey", F.when(kind.rlike("steel"), "materials").when(kind.rlike("brass"), "fittings").when(F.col("p_size") > 25, "large").otherwise("").alias("category"))


@query("n16_warranty_search", "SELECT l_orderkey, l_linenumber, l_partkey, date_diff('day', DATE '1998-06-01', CAST(CAST(l_shipdate AS DATE) + to_months(36) AS DATE)) AS days_left FROM lineitem JOIN part ON p_partkey = l_partkey WHERE contains(lower(p_name), 'a') AND l_returnflag = 'N' AND l_quantity >= 49")
def warranty_search(t):
    lines = t.lineitem.where("l_returnflag = 'N' and l_quantity >= 49").select("l_orderkey", "l_linenumber", "l_partkey", F.to_date("l_shipdate").alias("d"))
    parts = t.part.where(tx.fold(F.col("p_name")).contains("a")).select(F.col("p_partkey").alias("l_partkey"))
    return lines.join(parts, "l_partkey").select("l_orderkey", "l_linenumber", "l_partkey", F.datediff(F.add_months("d", 36), F.lit("1998-06-01").cast("date")).cast("bigint").alias("days_left"))


@query("n17_series_ids", "SELECT o_orderkey, min(o_orderkey) OVER (PARTITION BY o_custkey, o_orderpriority) AS series FROM orders")
def series_ids(t):
    w = Window.partitionBy("o_custkey", "o_orderpriority")
    return t.orders.select("o_orderkey", F.min("o_orderkey").over(w).alias("series"))


def _versions(t):
    c = t.conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("x")).select("conv_id", F.transform("x", lambda x: x["text"]).alias("old"))
    return c.withColumn("new", F.concat(F.slice("old", 2, 1000), F.array(F.lit("added line"))))


@query("n18_line_changes")
def line_changes(t):
    return compare.line_changes(_versions(t), "conv_id", "old", "new")


@query("n19_word_changes")
def word_changes(t):
    rows = t.conversations.select("conv_id", "turn", F.split("text", " ").alias("old"), F.split(F.regexp_replace("text", " the ", " a "), " ").alias("new"))
    keyed = rows.select((F.col("conv_id") * 1000 + F.col("turn")).alias("line"), "old", "new")
    return compare.line_changes(keyed, "line", "old", "new", " ")


@query("n21_minutes_deadlines", "SELECT conv_id, turn, 'user ' || (turn % 3) AS owner, CAST(DATE '2024-03-01' + to_days(CAST(turn AS INT)) AS DATE) AS day FROM conversations WHERE turn % 2 = 1")
def minutes_deadlines(t):
    items = t.conversations.select("conv_id", F.array(F.struct("turn", F.concat(F.lit("user "), (F.col("turn") % 3).cast("string")).alias("owner"), F.when(F.col("turn") % 2 == 1, F.date_add(F.lit("2024-03-01").cast("date"), F.col("turn").cast("int"))).alias("day"))).alias("items"))
    return items.select("conv_id", F.explode("items").alias("i")).where("i.day is not null").select("conv_id", "i.turn", "i.owner", "i.day")


@query("n22_parcel_warranties", "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) + to_months(36) AS DATE) AS until FROM orders JOIN (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_linestatus = 'F') ON l_orderkey = o_orderkey")
def parcel_warranties(t):
    delivered = t.lineitem.where("l_linestatus = 'F'").select(F.col("l_orderkey").alias("o_orderkey"))
    return t.orders.join(delivered, "o_orderkey", "left_semi").select("o_orderkey", F.add_months(F.to_date("o_orderdate"), 36).alias("until"))


@query("n23_merchants_in_text", "SELECT doc_id, m AS merchant FROM documents, (SELECT unnest(['idiot', 'clown', 'trash']) AS m) WHERE contains(lower(text), m)")
def merchants_in_text(t):
    names = t.documents.sparkSession.createDataFrame([("idiot",), ("clown",), ("trash",)], "merchant string")  # a dimension of three rows
    return t.documents.join(F.broadcast(names), F.lower("text").contains(F.col("merchant"))).select("doc_id", "merchant")


@query("n12_hint_check", "SELECT conv_id, turn, turn % 3 <> 0 AS literal FROM conversations")
def hint_check(t):
    hint = F.when(F.col("turn") % 3 != 0, F.substring("text", 5, 20)).otherwise("never said in any text")
    return t.conversations.select("conv_id", "turn", F.col("text").contains(hint).alias("literal"))


@query("nx_paper_facts")
def paper_facts(t):
    """Amounts, references and periods of every order's paper, by all labels."""
    return facts.facts_of(_paper(t), "o_orderkey", "text")
