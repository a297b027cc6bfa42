"""Message stores, written indexes and near-duplicate texts at scale (inventory sections A, F, G, L)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import statements, tables
from ..functions import text as tx
from ..operators import dense_index, layout, minhash, ordering, phrases, prefixes, subtrees
from ..sources import messages, pdf
from ..storage import materialise, scratch
from .registry import query


@query(
    "a17_paged_listing",
    """WITH p AS (SELECT doc_id, lang, (row_number() OVER (ORDER BY doc_id) - 1) // 50 AS page FROM documents)
    SELECT doc_id, lang, page, CASE WHEN page < (SELECT max(page) FROM p) THEN max(doc_id) OVER (PARTITION BY page) END AS next_cursor FROM p""",
)
def paged_listing(t):
    return ordering.paged(t.documents.select("doc_id", "lang"), "doc_id", 50).select("doc_id", "lang", "page", "next_cursor")


@query("a25_new_messages", "SELECT conv_id, turn, role, sha256(text) AS hash, CASE WHEN conv_id <= (SELECT max(conv_id) // 2 FROM conversations) THEN 1 ELSE 2 END AS run FROM conversations")
def new_messages(t):
    """Two runs of a stream over the store, the second from the first one's offset."""
    path, spark = t.path("conversations"), t.spark
    half = messages.Store(path, "conv_id").last_id() // 2
    checkpoint, into = scratch(spark, "messages_offsets"), scratch(spark, "messages")
    for run, until in ((1, half), (2, "")):
        messages.new_messages(spark, path, "conv_id", checkpoint, into, {"run": F.lit(run)}, until=until)
    return spark.read.parquet(into).select("conv_id", "turn", "role", F.sha2("text", 256).alias("hash"), "run")


@query("a25_messages_between", "SELECT conv_id, turn, role, sha256(text) AS hash FROM conversations WHERE conv_id > (SELECT max(conv_id) // 3 FROM conversations) AND conv_id <= (SELECT max(conv_id) // 2 FROM conversations)")
def messages_between(t):
    path = t.path("conversations")
    last = messages.Store(path, "conv_id").last_id()
    return messages.read(t.spark, path, "conv_id", after=last // 3, until=last // 2).select("conv_id", "turn", "role", F.sha2("text", 256).alias("hash"))


def _columns():
    """Five columns of a document, by name."""
    return {"title": F.substring_index("text", "\n", 1), "ending": F.substring_index("text", "\n", -1), "body": F.col("text"), "lang": F.col("lang"), "source": F.col("source")}


_WORDS = r"regexp_extract_all(translate(lower({}), 'áàâäãåéèêëíìîïóòôöõúùûüçñýÿ', 'aaaaaaeeeeiiiiooooouuuucnyy'), '[\p{{L}}\p{{N}}]+')"


@query(
    "l17_phrase_index",
    f"""WITH p AS (SELECT item_id, n, list_slice({_WORDS.format("text")}, 1, n) AS w FROM benchmark, (VALUES (1), (2), (3)) v(n)),
    d AS (SELECT doc_id, unnest(['title', 'ending', 'body', 'lang', 'source']) AS field, unnest([string_split(text, chr(10))[1], string_split(text, chr(10))[-1], text, lang, source]) AS x FROM documents),
    t AS (SELECT doc_id, field, {_WORDS.format("x")} AS w FROM d),
    o AS (SELECT doc_id, field, w, unnest(range(1, len(w) + 1)) AS pos FROM t),
    h AS (SELECT item_id, n, doc_id, field, pos - 1 AS pos FROM o JOIN p ON p.w[1] = o.w[pos] AND list_slice(o.w, pos, pos + len(p.w) - 1) = p.w)
    SELECT item_id, CAST(n AS INTEGER) AS n, doc_id, field, count(*) AS hits, CAST(min(pos) AS INTEGER) AS first FROM h GROUP BY ALL""",
)
def phrase_index(t):
    """The first one, two and three words of each benchmark item, in all five columns."""
    index = phrases.write_index(t.documents, "doc_id", _columns())
    words = tx.tokens(F.col("text"))
    asked = t.benchmark.select("item_id", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("n"), words.alias("w")).where(F.size("w") > 0)
    asked = asked.select(F.struct("item_id", "n").alias("phrase_id"), F.array_join(F.slice("w", F.lit(1), F.col("n")), " ").alias("phrase"))
    hits = phrases.search(t.spark, index, asked)
    return hits.select("phrase_id.item_id", "phrase_id.n", F.col("key").alias("doc_id"), "field", F.size("starts").cast("bigint").alias("hits"), F.col("starts")[0].alias("first"))


@query("g8_near_duplicate_texts")
def near_duplicate_texts(t):
    return minhash.near_duplicates(t.documents)


@query("g8_near_duplicate_words")
def near_duplicate_words(t):
    """By words alone, as long texts want it."""
    return minhash.near_duplicates(t.documents, kinds=("words",))


@query("l8_index_search")
def index_search(t):
    """The ten nearest rows of every vector whose id is divisible by 50, by the index."""
    index = dense_index.build(t.embeddings, "vec_id", "embedding")
    asked = t.embeddings.where("vec_id % 50 = 0")
    return dense_index.search(t.spark, index, asked, "vec_id", "embedding", 10).select("query_id", "rank", F.col("key").alias("vec_id"), F.round("score", 6).alias("score"))


@query("px_chunk_text_function")
def chunk_text_function(t):
    """The chunks of ``m8_chunk_text``, from SQL."""
    tables.register(t.spark)
    return t.spark.sql("SELECT * FROM chunk_text(TABLE(SELECT doc_id, text FROM {docs}))", docs=t.documents)


@query("px_chunk_units_function")
def chunk_units_function(t):
    """The chunks of ``m5_chunk_units``, from SQL."""
    tables.register(t.spark)
    units = t.conversations.select("conv_id", "turn", F.lit("section").alias("kind"), F.concat("role", F.lit(" "), F.col("turn").cast("string")).alias("title"), "text")
    return t.spark.sql("SELECT * FROM chunk_units(TABLE(SELECT * FROM {units}) PARTITION BY conv_id ORDER BY turn)", units=units)


@query("px_cues_function", "SELECT conv_id, count(*) AS cues, CAST(max(turn * 2.5 + 2) AS DOUBLE) AS last_end FROM conversations GROUP BY conv_id")
def cues_function(t):
    from ..sources import sinks
    from .sources import _cues

    tables.register(t.spark)
    text = sinks.srt(_cues(t), "conv_id", "turn", "s", "e", "text").select("conv_id", "text")
    return t.spark.sql("SELECT conv_id, count(*) AS cues, max(stop) AS last_end FROM cues(TABLE(SELECT * FROM {text})) GROUP BY conv_id", text=text)


@query(
    "b17_bound_values",
    """SELECT user_id, count(*) AS n, round(sum(value), 2) AS total FROM events WHERE event_type = 'purchase' AND value >= 20 AND event_type <> 'it''s; --' GROUP BY user_id""",
)
def bound_values(t):
    script = """-- the day's; purchases
    SELECT user_id, count(*) AS n, round(sum(value), 2) AS total /* by ; user */
    FROM {events} WHERE event_type = :kind AND value >= :least AND event_type <> :never GROUP BY user_id;"""
    return statements.ask(t.spark, script, {"kind": "purchase", "least": 20, "never": "it's; --"}, events=t.events)


@query(
    "c16_terms_of_prefixes",
    r"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS term FROM documents),
    p AS (SELECT DISTINCT unnest(list_filter(regexp_extract_all(lower(text), '[a-z]+'), lambda x: length(x) BETWEEN 3 AND 6)) AS prefix FROM benchmark)
    SELECT prefix, count(DISTINCT term) AS terms, count(DISTINCT doc_id) AS documents, count(*) AS occurrences FROM w JOIN p ON starts_with(term, prefix) GROUP BY prefix""",
)
def terms_of_prefixes(t):
    """The words of three to six letters of the benchmark as prefixes of the documents' words."""
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))
    asked = t.benchmark.select(F.explode(words).alias("term")).where(F.length("term").between(3, 6))
    met = prefixes.beginning_with(t.documents.select(F.explode(words).alias("term")), "term", asked, "term")
    counts = prefixes.counted(t.documents, words, asked, "term").withColumnRenamed("rows", "documents")
    return counts.join(met.groupBy("prefix").agg(F.count("*").alias("terms")), "prefix").select("prefix", "terms", "documents", "occurrences")


@query("g13_shared_parts")
def shared_parts(t):
    return subtrees.shared_parts(t.pages, "page_id", "html")


_LINES = "WITH d AS (SELECT doc_id, generate_subscripts(x, 1) AS i, unnest(x) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)), l AS (SELECT doc_id, i, CAST((i - 1) // 48 + 1 AS INTEGER) AS page, line FROM d WHERE trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> '')"


def _pdf_lines(t):
    """The documents as PDF files, read back as lines. The files are kept, so that the
    Python workers of writing and reading do not stand beside each other."""
    files = materialise(pdf.write_files(t.documents, "doc_id", "text"), "pdf_files")
    return layout.lines(pdf.runs(files, "doc_id", "content").drop("note"), "doc_id")


@query("a28_pdf_lines", _LINES + " SELECT doc_id, page, row_number() OVER (PARTITION BY doc_id, page ORDER BY i) AS line, line AS text FROM l")
def pdf_lines(t):
    return _pdf_lines(t).select("doc_id", "page", "line", "text")


@query("a13_pdf_pages", _LINES + " SELECT doc_id, page, count(*) AS lines, sha256(string_agg(line, chr(10) ORDER BY i)) AS hash FROM l GROUP BY ALL")
def pdf_pages(t):
    grouped = _pdf_lines(t).groupBy("doc_id", "page").agg(F.count("*").alias("lines"), F.array_sort(F.collect_list(F.struct("line", "text"))).alias("l"))
    return grouped.select("doc_id", "page", "lines", F.sha2(F.array_join(F.transform("l", lambda x: x["text"]), "\n"), 256).alias("hash"))


@query("a28_pdf_paragraphs")
def pdf_paragraphs(t):
    return layout.paragraphs(_pdf_lines(t), "doc_id")


@query("a13_pdf_outline")
def pdf_outline(t):
    return layout.outline(_pdf_lines(t), "doc_id")
