"""Money, identifiers and arithmetic (inventory section J)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import identifiers as ids
from ..functions import money
from ..functions import text as tx
from ..functions import vectors
from .registry import query


@query(
    "j1_parsed_amount",
    "SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 5 = 4 THEN NULL WHEN o_orderkey % 5 = 3 THEN -round(o_totalprice, 2) ELSE round(o_totalprice, 2) END AS DOUBLE) AS amount FROM orders",
)
def parsed_amount(t):
    plain = F.format_number("o_totalprice", 2)
    spanish = F.translate(plain, ",.", ".,")
    kind = F.col("o_orderkey") % 5
    raw = F.when(kind == 0, F.concat(plain, F.lit(" USD"))).when(kind == 1, F.concat(spanish, F.lit(" €"))).when(kind == 2, F.concat(F.lit("€ "), spanish)).when(kind == 3, F.concat(F.lit("("), plain, F.lit(")"))).otherwise("n/a")
    return t.orders.select("o_orderkey", money.parse_amount(raw).cast("double").alias("amount"))


@query("j2_to_cents", "SELECT o_orderkey, CAST(round(CAST(o_totalprice AS DECIMAL(18, 6)) * 100, 0) AS BIGINT) AS cents FROM orders")
def to_cents(t):
    return t.orders.select("o_orderkey", money.to_cents(F.col("o_totalprice")).alias("cents"))


@query("j3_price_counts", r"SELECT doc_id, CAST(len(regexp_extract_all(text, '[€$]\s?\d[\d.,]*|\d[\d.,]*\s?[€$]')) AS BIGINT) AS prices FROM documents")
def price_counts(t):
    return t.documents.select("doc_id", F.regexp_count("text", F.lit(r"[€$]\s?\d[\d.,]*|\d[\d.,]*\s?[€$]")).cast("bigint").alias("prices"))


@query("j4_formatted_money", "SELECT o_orderkey, translate(format('{:,.2f}', o_totalprice), ',.', '.,') || ' €' AS shown FROM orders WHERE abs(o_totalprice * 1000 % 10 - 5) > 0.01")
def formatted_money(t):
    return t.orders.select("o_orderkey", money.format_money(F.col("o_totalprice"), "es").alias("shown"))


@query("j5_currency_of", "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'EUR' WHEN 1 THEN 'USD' WHEN 2 THEN 'GBP' ELSE '' END AS currency FROM customer")
def currency_of(t):
    kind = F.col("c_custkey") % 4
    return t.customer.select("c_custkey", money.currency_of(F.when(kind == 0, "Euros").when(kind == 1, "US$").when(kind == 2, "£").otherwise("shells")).alias("currency"))


@query(
    "j6_luhn",
    """WITH d AS (SELECT c_custkey, '4000000' || lpad(CAST(c_custkey * 37 AS VARCHAR), 9, '0') AS s FROM customer), x AS (SELECT c_custkey, s, list_transform(range(1, 17), lambda i: CAST(s[17 - i] AS INT) * CASE WHEN i % 2 = 0 THEN 2 ELSE 1 END) AS v FROM d)
    SELECT c_custkey, list_sum(list_transform(v, lambda a: CASE WHEN a > 9 THEN a - 9 ELSE a END)) % 10 = 0 AS ok FROM x""",
)
def luhn(t):
    return t.customer.select("c_custkey", ids.luhn_ok(F.concat(F.lit("4000 000"), F.lpad((F.col("c_custkey") * 37).cast("string"), 9, "0"))).alias("ok"))


@query(
    "j7_iban",
    "SELECT c_custkey, c_custkey % 2 = 0 AS ok FROM customer",
)
def iban(t):
    key = F.col("c_custkey")
    check = (98 - (key * 1_000_000 + 142_800) % 97).cast("int")
    check = F.when(key % 2 == 0, check).otherwise(check % 97 + 1 + F.when(check == 97, 1).otherwise(0))
    text = F.concat(F.lit("ES"), F.lpad(check.cast("string"), 2, "0"), F.lit(" "), F.lpad(key.cast("string"), 20, "0"))
    return t.customer.select("c_custkey", ids.iban_ok(text).alias("ok"))


@query("j8_tax_ids", "SELECT c_custkey, c_custkey % 3 <> 2 AS dni, c_custkey % 3 <> 2 AS nif FROM customer")
def tax_ids(t):
    number = F.pmod(F.col("c_custkey") % 90_000_000 * 7919, F.lit(90_000_000)) + 10_000_000  # of eight digits, whatever the key
    letter = lambda k: F.substring(F.lit(ids.DNI_LETTERS), ((number + k) % 23 + 1).cast("int"), F.lit(1))
    text = F.concat(number.cast("string"), F.lit("-"), letter(F.when(F.col("c_custkey") % 3 == 2, 5).otherwise(0)))
    return t.customer.select("c_custkey", ids.dni_ok(text).alias("dni"), ids.nif_ok(text).alias("nif"))


@query(
    "j9_ean",
    """WITH d AS (SELECT p_partkey, lpad(CAST(p_partkey * 101 + 400000000000 AS VARCHAR), 13, '0') AS s FROM part) SELECT p_partkey, (10 - list_sum(list_transform(range(1, 13), lambda i: CAST(s[i] AS INT) * CASE WHEN i % 2 = 0 THEN 3 ELSE 1 END)) % 10) % 10 = CAST(s[13] AS INT) AS ok FROM d""",
)
def ean(t):
    return t.part.select("p_partkey", ids.ean_ok(F.lpad((F.col("p_partkey") * 101 + 400_000_000_000).cast("string"), 13, "0")).alias("ok"))


@query(
    "j9_isbn",
    """WITH d AS (SELECT p_partkey, lpad(CAST(p_partkey * 1009 AS VARCHAR), 10, '0') AS s FROM part) SELECT p_partkey, list_sum(list_transform(range(1, 11), lambda i: CAST(s[i] AS INT) * (11 - i))) % 11 = 0 AS ok FROM d""",
)
def isbn(t):
    return t.part.select("p_partkey", ids.isbn_ok(F.lpad((F.col("p_partkey") * 1009).cast("string"), 10, "0")).alias("ok"))


@query(
    "j10_cosine",
    "SELECT a.vec_id, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) AS dot, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1",
)
def cosine(t):
    after = t.embeddings.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    j = t.embeddings.select("vec_id", "embedding").join(after, "vec_id")
    return j.select("vec_id", F.round(vectors.dot(F.col("embedding"), F.col("other")), 5).alias("dot"), F.round(vectors.cosine(F.col("embedding"), F.col("other")), 5).alias("cosine"))


@query("j11_packed_vectors", "SELECT vec_id, CAST(64 * 4 AS BIGINT) AS n_bytes, round(list_sum(embedding::DOUBLE[]), 4) AS total FROM embeddings")
def packed_vectors(t):
    from ..operators.packing import pack, unpack

    packed = pack(t.embeddings.select("vec_id", "embedding"), "vec_id", "embedding")
    back = unpack(packed, "vec_id", "embedding")
    return back.select("vec_id", F.col("n_bytes"), F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


@query("j12_token_cost", "SELECT doc_id, CAST(ceil(n_chars / 4.0) AS BIGINT) AS text_tokens, CAST(least(ceil(sqrt(n_chars) / 14.0), 64) * 16 AS BIGINT) AS image_tokens FROM documents")
def token_cost(t):
    return t.documents.select("doc_id", F.ceil(F.col("n_chars") / 4.0).cast("bigint").alias("text_tokens"), (F.least(F.ceil(F.sqrt("n_chars") / 14.0), F.lit(64)) * 16).cast("bigint").alias("image_tokens"))


@query("j13_frame_difference", "SELECT a.vec_id, round(list_sum(list_transform(range(1, 65), lambda i: abs(a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE))) / 64, 5) AS diff FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def frame_difference(t):
    after = t.embeddings.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    j = t.embeddings.select("vec_id", "embedding").join(after, "vec_id")
    gap = F.zip_with("embedding", "other", lambda x, y: F.abs(x.cast("double") - y.cast("double")))
    return j.select("vec_id", F.round(F.aggregate(gap, F.lit(0.0), lambda a, x: a + x) / F.size(gap), 5).alias("diff"))


@query("j14_severity", "SELECT o_orderkey, CASE WHEN d < 0 THEN 'high' WHEN d <= 3 THEN 'high' WHEN d <= 14 THEN 'medium' ELSE 'low' END AS severity FROM (SELECT o_orderkey, date_diff('day', DATE '1997-06-01', CAST(o_orderdate AS DATE)) AS d FROM orders)")
def severity(t):
    d = F.datediff(F.to_date("o_orderdate"), F.lit("1997-06-01").cast("date"))
    return t.orders.select("o_orderkey", F.when(d <= 3, "high").when(d <= 14, "medium").otherwise("low").alias("severity"))


@query("j15_useful_chars", r"SELECT doc_id, CAST(length(regexp_replace(text, '[^\p{L}\p{N}]', '', 'g')) AS BIGINT) AS useful FROM documents")
def useful_chars(t):
    return t.documents.select("doc_id", tx.useful_chars(F.col("text")).cast("bigint").alias("useful"))


@query("j16_edit_distance", "SELECT p_partkey, CAST(levenshtein(p_name, p_type) AS BIGINT) AS distance FROM part")
def edit_distance(t):
    return t.part.select("p_partkey", F.levenshtein("p_name", "p_type").cast("bigint").alias("distance"))


@query("r4_waveform_peaks", "SELECT label, CAST(floor((vec_id) * 10 / (SELECT count(*) FROM embeddings)) AS BIGINT) AS bucket, round(max(abs(embedding[1]::DOUBLE)), 5) AS peak FROM embeddings GROUP BY ALL")
def waveform_peaks(t):
    n = t.embeddings.agg(F.count("*").alias("n"))
    rows = t.embeddings.crossJoin(F.broadcast(n)).select("label", F.floor(F.col("vec_id") * 10 / F.col("n")).alias("bucket"), F.abs(F.get("embedding", F.lit(0)).cast("double")).alias("v"))
    return rows.groupBy("label", "bucket").agg(F.round(F.max("v"), 5).alias("peak"))


@query("r5_ulid_time", "SELECT event_id, epoch_us(ts) // 1000 AS ms FROM events")
def ulid_time(t):
    from ..functions.ulid import encode_time, time_of

    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    return t.events.select("event_id", time_of(F.concat(encode_time(ms), F.lit("ABCDEFGHJKMNPQRS"))).alias("ms"))
