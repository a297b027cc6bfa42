"""Files of office formats, articles, absorption, evidence and ages (inventory
sections A, I, M, N and R)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import times
from ..operators import chunking, extraction, html
from ..sources import files, readers, writers
from .extraction import _paper
from .registry import query

#: DuckDB: the lines of a turn that are not empty, trimmed.
_LINES = "list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '')"
#: The same with white space inside a line as one space, as a page shows it.
_SHOWN = r"list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '')"


def _written(t, kinds: list[str]):
    """Every turn as a file whose kind goes round ``kinds``, its title the role."""
    c = t.conversations
    n = F.col("conv_id") + F.col("turn")
    kind = F.element_at(F.array(*map(F.lit, kinds)), (n % len(kinds) + 1).cast("int"))
    path = F.concat_ws("/", F.col("conv_id").cast("string"), F.concat(F.col("turn").cast("string"), F.lit("."), kind))
    return writers.written(c, path, kind, F.col("role"), F.col("text"))


def _turn(df):
    part = lambda i: F.regexp_extract("path", r"^(\d+)/(\d+)\.", i).cast("bigint")
    return df.withColumns({"conv_id": part(1), "turn": part(2)})


@query("a7_plain_units", "SELECT conv_id, turn, 'text' AS unit_kind, CAST(1 AS BIGINT) AS number, md5(text) AS text FROM conversations")
def plain_units(t):
    read = readers.units(_written(t, ["txt", "code"]))
    return _turn(read).select("conv_id", "turn", "unit_kind", "number", F.md5("text").alias("text"))


@query(
    "a10_epub_chapters",
    r"""SELECT conv_id, turn, CAST(i AS BIGINT) AS number, role || ' ' || i AS title, md5(rtrim(role || ' ' || i || chr(10) || regexp_replace(trim(line), '\s+', ' ', 'g'), chr(10))) AS text
    FROM (SELECT conv_id, turn, role, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM conversations)""",
)
def epub_chapters(t):
    return _turn(readers.units(_written(t, ["epub"]))).select("conv_id", "turn", "number", "title", F.md5("text").alias("text"))


@query(
    "a11_office_units",
    f"""SELECT conv_id, turn, ['section', 'slide', 'sheet', 'section', 'text', 'text'][n + 1] AS unit_kind, [role, role, 'Sheet 1', role, '', role][n + 1] AS title, md5(CASE WHEN n IN (0, 3) THEN array_to_string({_LINES}, chr(10))
        WHEN n = 1 THEN array_to_string(list_concat([role], {_LINES}), chr(10))
        WHEN n = 2 THEN array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: i || ' | ' || x), chr(10))
        WHEN n = 4 THEN trim(text, ' ' || chr(10))
        ELSE 'From: a@example.org' || chr(10) || 'To: b@example.org' || chr(10) || 'Subject: ' || role || chr(10) || chr(10) || trim(text, ' ' || chr(10)) END) AS text
    FROM (SELECT *, (conv_id + turn) % 6 AS n FROM conversations)""",
)
def office_units(t):
    read = readers.units(_written(t, ["docx", "pptx", "xlsx", "odt", "rtf", "eml"]))
    return _turn(read).select("conv_id", "turn", "unit_kind", "title", F.md5("text").alias("text"))


@query(
    "a12_any_file",
    f"""SELECT conv_id, turn, ['txt', 'html', 'docx', 'rtf', 'image', 'txt', 'ole'][n + 1] AS kind, CASE WHEN n IN (0, 1, 2, 3) THEN 1 ELSE 0 END AS n_units, n = 4 AS needs_ocr, n > 3 AS noted,
        md5(CASE n WHEN 0 THEN text WHEN 1 THEN array_to_string({_SHOWN}, chr(10)) WHEN 2 THEN array_to_string({_LINES}, chr(10)) WHEN 3 THEN trim(text, ' ' || chr(10)) ELSE '' END) AS text
    FROM (SELECT *, (conv_id + turn) % 7 AS n FROM conversations)""",
)
def any_file(t):
    """Kinds told by bytes: text, pages under a wrong name, office files, pictures, empty and legacy files."""
    made = _written(t, ["txt", "html", "docx", "rtf", "image", "none", "ole"])
    head = {"image": "89504E470D0A1A0A", "ole": "D0CF11E0A1B11AE1", "none": ""}
    content = F.col("content")
    for kind, hexed in head.items():
        content = F.when(F.col("kind") == kind, F.unhex(F.lit(hexed))).otherwise(content)
    path = F.regexp_replace("path", r"\.html$", ".txt")
    read = readers.read_any(made.select(path.alias("path"), content.alias("content")))
    return _turn(read).select("conv_id", "turn", "kind", "n_units", "needs_ocr", F.col("note").isNotNull().alias("noted"), F.md5("text").alias("text"))


@query(
    "m7_absorbed",
    """WITH lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
    spans AS (SELECT doc_id, length(line) AS n, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i) - length(line) - 1 AS a FROM lines),
    heads AS (SELECT doc_id, a, a + n AS b, n >= 60 OR row_number() OVER (PARTITION BY doc_id ORDER BY a) = 1 AS head FROM spans WHERE n > 0),
    numbered AS (SELECT *, sum(CAST(head AS INT)) OVER (PARTITION BY doc_id ORDER BY a) AS g FROM heads),
    joined AS (SELECT doc_id, g, min(a) AS a, max(b) AS b FROM numbered GROUP BY doc_id, g),
    first AS (SELECT *, max(CAST(g = 1 AND b - a < 60 AS INT)) OVER (PARTITION BY doc_id) AS short FROM joined)
    SELECT doc_id, CAST(greatest(g - short, 1) AS BIGINT) AS number, CAST(min(a) AS BIGINT) AS start, CAST(max(b) AS BIGINT) AS stop FROM first GROUP BY ALL""",
)
def absorbed(t):
    return chunking.absorbed(t.documents, "doc_id", "text", 60)


@query("m14_article", f"SELECT conv_id, turn, role AS title, md5(array_to_string(list_concat([role], {_SHOWN}), chr(10))) AS text FROM conversations")
def article(t):
    pages = _written(t, ["html"]).select("path", F.col("content").cast("string").alias("html"))
    return _turn(html.readable(pages, "path", "html")).select("conv_id", "turn", "title", F.md5("text").alias("text"))


@query(
    "n5_evidence",
    """SELECT o_orderkey, day, 2 AS page, ['Fecha de emisión: ', 'Fecha de efecto: ', 'Notificado el ', 'Purchased '][o_orderkey % 5 + 1] || strftime(day, '%d/%m/%Y') AS evidence
    FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders) WHERE o_orderkey % 5 < 4
    UNION ALL SELECT o_orderkey, day, 2, CASE o_orderkey % 5 WHEN 0 THEN 'Fecha límite: ' ELSE 'Válido hasta, finaliza: ' END || strftime(day, '%d/%m/%Y')
    FROM (SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) + to_days(CASE o_orderkey % 5 WHEN 0 THEN 20 ELSE 365 END) AS DATE) AS day FROM orders) WHERE o_orderkey % 5 < 2""",
)
def evidence(t):
    """The paperwork as the second page of a file."""
    pages = _paper(t).withColumn("text", F.concat(F.lit("İzmir, portada\n\f"), "text"))
    return extraction.dates_with_evidence(pages, "o_orderkey", "text").select("o_orderkey", "day", "page", "evidence")


@query(
    "i8_since",
    """SELECT event_id, CASE event_id % 8 WHEN 0 THEN ts - INTERVAL 3 DAY WHEN 1 THEN ts - INTERVAL 90 MINUTE WHEN 2 THEN date_trunc('day', ts) WHEN 3 THEN date_trunc('week', ts) WHEN 4 THEN date_trunc('second', ts)
        WHEN 5 THEN ts - INTERVAL 1 HOUR WHEN 6 THEN date_trunc('second', ts) - INTERVAL 2 HOUR END AS since FROM events""",
)
def since(t):
    now = F.col("ts").cast("timestamp_ntz")
    iso = F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss")
    n = F.col("event_id") % 8
    phrase = F.when(n == 0, "hace 3 días").when(n == 1, "1,5 hours ago").when(n == 2, "Hoy").when(n == 3, "esta  semana").when(n == 4, iso).when(n == 5, "la última hora").when(n == 6, F.concat(iso, F.lit("+02:00"))).otherwise("some day")
    return t.events.select("event_id", times.since(phrase, now).alias("since"))


@query("r33_stored_files", "SELECT sha256(text) AS sha, substr(sha256(text), 1, 2) || '/' || sha256(text) || '.txt' AS path, max(strlen(text)) AS bytes, count(*) AS refs FROM conversations GROUP BY 1")
def stored_files(t):
    """Contents by their hash, each stored once however often it is put."""
    return files.stored(t.conversations.select(F.encode("text", "UTF-8").alias("content")), "content", "txt")
