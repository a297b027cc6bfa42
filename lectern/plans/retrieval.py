"""Retrieval (inventory section L)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import retrieval as rt
from .registry import query

_FOLD = f"translate(lower(text), '{tx.ACCENTED}', '{tx.PLAIN}')"
_STOP = ", ".join(f"'{w}'" for w in tx.STOPWORDS)
TERMS = ["idiot", "clown", "attention", "ension"]
_LIST = ", ".join(f"'{x}'" for x in TERMS)


def _bm25_sql(having: str = "") -> str:
    return rf"""WITH w AS (SELECT doc_id, regexp_extract_all({_FOLD}, '[\p{{L}}\p{{N}}]+') AS w, source AS sec FROM documents),
    d AS (SELECT doc_id, len(w) + len(regexp_extract_all(lower(sec), '[\p{{L}}\p{{N}}]+')) AS len, w, regexp_extract_all(lower(sec), '[\p{{L}}\p{{N}}]+') AS s FROM w),
    st AS (SELECT count(*) AS n_docs, avg(len) AS avg_len FROM d),
    tf AS (SELECT doc_id, len, q, len(list_filter(w, lambda x: x = q)) + 0.5 * len(list_filter(s, lambda x: x = q)) AS f FROM d, (SELECT unnest([{_LIST}]) AS q)),
    df AS (SELECT q, count(*) FILTER (f > 0) AS n FROM tf GROUP BY q),
    sc AS (SELECT doc_id, count(*) AS hits, sum(CASE WHEN ln((n_docs - n + 0.5) / (n + 0.5)) > 0 THEN ln((n_docs - n + 0.5) / (n + 0.5)) ELSE 0.000001 END * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len / avg_len))) AS score
      FROM tf JOIN df USING (q), st WHERE f > 0 GROUP BY doc_id {having})"""


@query("l1_tokens", rf"SELECT doc_id, CAST(len(w) AS BIGINT) AS tokens, CAST(len(list_distinct(w)) AS BIGINT) AS terms FROM (SELECT doc_id, regexp_extract_all({_FOLD}, '[\p{{L}}\p{{N}}]+') AS w FROM documents)")
def tokens(t):
    w = tx.tokens(F.col("text"))
    return t.documents.select("doc_id", F.size(w).cast("bigint").alias("tokens"), F.size(F.array_distinct(w)).cast("bigint").alias("terms"))


@query("l2_content_words", rf"SELECT doc_id, CAST(len(list_filter(regexp_extract_all({_FOLD}, '[\p{{L}}\p{{N}}]+'), lambda x: x NOT IN ({_STOP}))) AS BIGINT) AS words FROM documents")
def content_words(t):
    return t.documents.select("doc_id", F.size(tx.content_tokens(F.col("text"))).cast("bigint").alias("words"))


@query(
    "l3_stems",
    rf"""SELECT stem, count(*) AS n FROM (SELECT CASE WHEN length(x) > 5 AND suffix(x, 'es') THEN left(x, length(x) - 2) WHEN length(x) > 4 AND suffix(x, 's') THEN left(x, length(x) - 1) ELSE x END AS stem
    FROM (SELECT unnest(regexp_extract_all({_FOLD}, '[\p{{L}}\p{{N}}]+')) AS x FROM documents)) GROUP BY stem""",
)
def stems(t):
    words = t.documents.select(F.explode(tx.tokens(F.col("text"))).alias("x"))
    return words.groupBy(tx.stem(F.col("x")).alias("stem")).agg(F.count("*").alias("n"))


@query(
    "l4_query_terms",
    rf"""WITH w AS (SELECT doc_id, unnest(x) AS term, generate_subscripts(x, 1) AS i FROM (SELECT doc_id, regexp_extract_all({_FOLD}, '[\p{{L}}\p{{N}}]+') AS x FROM documents)),
    k AS (SELECT doc_id, term, min(i) AS i FROM w WHERE term NOT IN ({", ".join(f"'{x}'" for x in tx.STOPWORDS)}) GROUP BY ALL)
    SELECT doc_id, term, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) AS INTEGER) AS place FROM k QUALIFY place <= 12""",
)
def query_terms(t):
    """Each document as a query: its first twelve different content words."""
    terms = F.slice(F.array_distinct(tx.content_tokens(F.col("text"))), 1, 12)
    return t.documents.select("doc_id", F.posexplode(terms).alias("at", "term")).select("doc_id", "term", (F.col("at") + 1).alias("place"))


@query("l5_match_ladder", _bm25_sql(f"HAVING count(*) = {len(TERMS)}") + "SELECT doc_id, 2 AS rung FROM sc WHERE false UNION ALL " + rf"SELECT DISTINCT doc_id, 2 AS rung FROM tf WHERE f > 0")
def match_ladder(t):
    return rt.ladder(t.documents, "doc_id", {"text": 1.0, "source": 0.5}, TERMS).select("doc_id", "rung")


@query("l6_bm25_topk", _bm25_sql() + "SELECT doc_id, round(score, 4) AS score, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM sc QUALIFY rank <= 10")
def bm25_topk(t):
    hits = rt.bm25(t.documents, "doc_id", {"text": 1.0, "source": 0.5}, TERMS)
    return rt.top(hits, "doc_id", 10).select("doc_id", F.round("score", 4).alias("score"), "rank")


@query("l6_indexed_search", _bm25_sql() + "SELECT doc_id, round(score, 4) AS score, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM sc QUALIFY rank <= 10")
def indexed_search(t):
    spark, columns = t.documents.sparkSession, {"text": 1.0, "source": 0.5}
    hits = rt.searched(spark, rt.search_index(t.documents, "doc_id", columns), "doc_id", TERMS)
    return rt.top(hits, "doc_id", 10).select("doc_id", F.round("score", 4).alias("score"), "rank")


@query("l6_postings", rf"SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all({_FOLD}, '[\p{{L}}\p{{N}}]+')) AS term FROM documents) GROUP BY ALL")
def postings(t):
    return rt.postings(t.documents, "doc_id", {"text": 1.0}).select("doc_id", "term", F.col("wtf").cast("bigint").alias("tf"))


@query(
    "l7_bm25_rescore",
    rf"""WITH c AS (SELECT doc_id, regexp_extract_all({_FOLD}, '[\p{{L}}\p{{N}}]+') AS w FROM documents WHERE lang = 'en' AND n_chars > 1500), st AS (SELECT count(*) AS n_docs, avg(len(w)) AS avg_len FROM c),
    tf AS (SELECT doc_id, len(w) AS len, q, len(list_filter(w, lambda x: x = q))::DOUBLE AS f FROM c, (SELECT unnest([{_LIST}]) AS q)), df AS (SELECT q, count(*) FILTER (f > 0) AS n FROM tf GROUP BY q)
    SELECT doc_id, round(sum(greatest(0.1, ln(1 + (n_docs - n + 0.5) / (n + 0.5))) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len / avg_len))), 4) AS score FROM tf JOIN df USING (q), st WHERE f > 0 GROUP BY doc_id""",
)
def bm25_rescore(t):
    rows = t.documents.where("lang = 'en' and n_chars > 1500")
    return rt.rescore(rows, "doc_id", {"text": 1.0}, "text", TERMS).select("doc_id", F.round("score", 4).alias("score"))


@query(
    "l8_dense_search",
    """WITH q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 11), s AS (SELECT vec_id, list_dot_product(embedding::DOUBLE[], v) AS score FROM embeddings, q WHERE vec_id <> 11 AND label <> 3)
    SELECT vec_id, round(score, 4) AS score, row_number() OVER (ORDER BY score DESC, vec_id) AS rank FROM s WHERE score >= 0.1 QUALIFY rank <= 20""",
)
def dense_search(t):
    rows = t.embeddings.where("vec_id <> 11 and label <> 3")
    hits = rt.dense(rows, "vec_id", "embedding", t.embeddings.where("vec_id = 11"), 0.1)
    return rt.top(hits, "vec_id", 20).select("vec_id", F.round("score", 4).alias("score"), "rank")


@query(
    "l9_rank_fusion",
    """WITH a AS (SELECT vec_id, row_number() OVER (ORDER BY embedding[1] DESC, vec_id) AS rank FROM embeddings QUALIFY rank <= 40), b AS (SELECT vec_id, row_number() OVER (ORDER BY embedding[2] DESC, vec_id) AS rank FROM embeddings QUALIFY rank <= 40)
    SELECT vec_id, round(sum(s), 6) AS score FROM (SELECT vec_id, 1.0 / (60 + rank) AS s FROM a UNION ALL SELECT vec_id, 1.25 / (60 + rank) FROM b) GROUP BY vec_id""",
)
def rank_fusion(t):
    leg = lambda i: rt.top(t.embeddings.select("vec_id", F.get("embedding", F.lit(i)).alias("score")), "vec_id", 40)
    return rt.fuse([(leg(0), 1.0), (leg(1), 1.25)], "vec_id").select("vec_id", F.round("score", 6).alias("score"))


@query(
    "l10_hybrid_search",
    _bm25_sql()
    + """, lex AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM sc QUALIFY rank <= 30),
    q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 5), den AS (SELECT vec_id AS doc_id, row_number() OVER (ORDER BY list_dot_product(embedding::DOUBLE[], v) DESC, vec_id) AS rank FROM embeddings, q WHERE vec_id <> 5 QUALIFY rank <= 30),
    f AS (SELECT doc_id, sum(1.0 / (60 + rank)) AS score FROM (SELECT * FROM lex UNION ALL SELECT * FROM den) GROUP BY doc_id)
    SELECT doc_id, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM f QUALIFY rank <= 15""",
)
def hybrid_search(t):
    lexical = rt.top(rt.bm25(t.documents, "doc_id", {"text": 1.0, "source": 0.5}, TERMS), "doc_id", 30)
    vectors = t.embeddings.withColumnRenamed("vec_id", "doc_id")
    near = rt.top(rt.dense(vectors.where("doc_id <> 5"), "doc_id", "embedding", vectors.where("doc_id = 5")), "doc_id", 30)
    fused = rt.top(rt.fuse([(lexical, 1.0), (near, 1.0)], "doc_id"), "doc_id", 15)
    return fused.select("doc_id", F.round("score", 6).alias("score"), "rank")


@query(
    "l11_similar",
    """WITH q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 42), s AS (SELECT vec_id, label, list_dot_product(embedding::DOUBLE[], v) AS score FROM embeddings, q WHERE vec_id <> 42)
    SELECT label, min(vec_id) FILTER (k = 1) AS vec_id, round(max(score), 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS k FROM s) GROUP BY label""",
)
def similar(t):
    hits = rt.dense(t.embeddings.where("vec_id <> 42"), "vec_id", "embedding", t.embeddings.where("vec_id = 42")).join(t.embeddings.select("vec_id", "label"), "vec_id")
    return rt.best_per_group(hits, ["label"], "vec_id").select("label", "vec_id", F.round("score", 4).alias("score"))


@query(
    "l12_question_legs",
    """WITH h AS (SELECT conv_id, turn, length(text) AS score FROM conversations WHERE role = 'user'), b AS (SELECT conv_id, max(score) AS score FROM h GROUP BY conv_id), r AS (SELECT conv_id, row_number() OVER (ORDER BY score DESC, conv_id) AS rank FROM b)
    SELECT conv_id, round(1.25 / (60 + rank), 6) AS score FROM r WHERE rank <= 20""",
)
def question_legs(t):
    best = t.conversations.where("role = 'user'").groupBy("conv_id").agg(F.max(F.length("text")).alias("score"))
    return rt.fuse([(rt.top(best, "conv_id", 20), 1.25)], "conv_id").select("conv_id", F.round("score", 6).alias("score"))


@query("l13_highlight", "SELECT doc_id, md5(regexp_replace(text, '(?i)\\b(idiot|clown)\\b', '<mark>\\1</mark>', 'g')) AS marked FROM documents WHERE regexp_matches(text, '(?i)\\b(idiot|clown)\\b')")
def highlight(t):
    rows = t.documents.where(F.col("text").rlike(r"(?i)\b(idiot|clown)\b"))
    return rows.select("doc_id", F.md5(F.regexp_replace("text", r"(?i)\b(idiot|clown)\b", "<mark>$1</mark>")).alias("marked"))


@query(
    "l14_hydrated_hits",
    _bm25_sql() + """SELECT doc_id, source, 'Document ' || doc_id || ', ' || source AS citation FROM (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM sc QUALIFY rank <= 10) JOIN documents USING (doc_id)""",
)
def hydrated_hits(t):
    from ..functions.citations import cite

    hits = rt.top(rt.bm25(t.documents, "doc_id", {"text": 1.0, "source": 0.5}, TERMS), "doc_id", 10).select("doc_id")
    rows = t.documents.select("doc_id", "source").join(F.broadcast(hits), "doc_id")  # ten rows
    return rows.select("doc_id", "source", cite(F.lit("txt"), F.concat(F.lit("Document "), F.col("doc_id").cast("string")), section=F.col("source")).alias("citation"))


@query("l15_reranked", _bm25_sql() + "SELECT doc_id, row_number() OVER (ORDER BY n_chars, doc_id) AS place FROM (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM sc QUALIFY rank <= 10) JOIN documents USING (doc_id)")
def reranked(t):
    hits = rt.top(rt.bm25(t.documents, "doc_id", {"text": 1.0, "source": 0.5}, TERMS), "doc_id", 10)
    rows = t.documents.select("doc_id", "n_chars").join(F.broadcast(hits.select("doc_id")), "doc_id")
    return rows.select("doc_id", F.row_number().over(Window.orderBy("n_chars", "doc_id")).cast("bigint").alias("place"))  # ten rows


@query(
    "l16_filtered_page_search",
    rf"""WITH c AS (SELECT doc_id, source, regexp_extract_all({_FOLD}, '[\p{{L}}\p{{N}}]+') AS w FROM documents WHERE lang = 'en') SELECT doc_id, source, CAST(len(list_filter(w, lambda x: x = 'idiot')) AS BIGINT) AS hits FROM c WHERE list_contains(w, 'idiot') AND source IN ('src1', 'src5', 'src9', 'src12')""",
)
def filtered_page_search(t):
    rows = t.documents.where("lang = 'en'").where(F.col("source").isin("src1", "src5", "src9", "src12"))
    hits = F.size(F.filter(tx.tokens(F.col("text")), lambda x: x == "idiot")).cast("bigint")
    return rows.select("doc_id", "source", hits.alias("hits")).where("hits > 0")


@query("l17_phrase_search", f"SELECT doc_id FROM documents WHERE contains({_FOLD}, 'of the ') UNION SELECT conv_id FROM conversations WHERE contains({_FOLD}, 'of the ')")
def phrase_search(t):
    own = t.documents.where(tx.fold(F.col("text")).contains("of the ")).select("doc_id")
    spoken = t.conversations.where(tx.fold(F.col("text")).contains("of the ")).select(F.col("conv_id").alias("doc_id"))
    return own.unionByName(spoken).distinct()


@query(
    "l18_lines_with_context",
    f"""SELECT conv_id, turn, before, after FROM (SELECT conv_id, turn, text, lag(turn) OVER w AS before, lead(turn) OVER w AS after FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE contains({_FOLD}, 'the')""",
)
def lines_with_context(t):
    w = Window.partitionBy("conv_id").orderBy("turn")
    lines = t.conversations.withColumns({"before": F.lag("turn").over(w), "after": F.lead("turn").over(w)})
    return lines.where(tx.fold(F.col("text")).contains("the")).select("conv_id", "turn", "before", "after")


@query("l19_federated_search", "SELECT 'library' AS module, doc_id AS id FROM documents WHERE contains(text, 'idiot') UNION ALL SELECT 'links', page_id FROM pages WHERE contains(html, 'idiot') UNION ALL SELECT 'chats', conv_id * 1000 + turn FROM conversations WHERE contains(text, 'the')")
def federated_search(t):
    part = lambda df, key, text, word, name: df.where(F.col(text).contains(word)).select(F.lit(name).alias("module"), key.alias("id"))
    a = part(t.documents, F.col("doc_id"), "text", "idiot", "library")
    b = part(t.pages, F.col("page_id"), "html", "idiot", "links")
    return a.unionByName(b).unionByName(part(t.conversations, F.col("conv_id") * 1000 + F.col("turn"), "text", "the", "chats"))


@query("l20_quote_check", "SELECT conv_id, turn, turn % 2 = 0 AND length(text) >= 12 AS supported FROM conversations")
def quote_check(t):
    quote = F.when(F.col("turn") % 2 == 0, F.substring("text", 1, 12)).otherwise(F.concat(F.substring("text", 1, 12), F.lit("~absent~")))
    return t.conversations.select("conv_id", "turn", (F.col("text").contains(quote) & (F.length(quote) >= 12)).alias("supported"))


@query(
    "l21_context_window",
    f"""WITH h AS (SELECT conv_id, turn FROM conversations WHERE contains({_FOLD}, 'idiot') OR turn = 0), c AS (SELECT DISTINCT c.conv_id, c.turn, length(c.text) AS n FROM conversations c JOIN h ON c.conv_id = h.conv_id AND c.turn BETWEEN h.turn - 3 AND h.turn + 3)
    SELECT conv_id, turn FROM (SELECT conv_id, turn, sum(n) OVER (PARTITION BY conv_id ORDER BY turn) AS used FROM c) WHERE used <= 1500""",
)
def context_window(t):
    from ..operators.merging import within_budget

    c = t.conversations
    hits = c.where(tx.fold(F.col("text")).contains("idiot") | (F.col("turn") == 0)).select("conv_id", F.explode(F.sequence(F.col("turn") - 3, F.col("turn") + 3)).alias("turn")).distinct()
    near = c.select("conv_id", "turn", F.length("text").alias("n")).join(hits, ["conv_id", "turn"])
    return within_budget(near, ["conv_id"], [F.asc("turn")], "n", 1500).select("conv_id", "turn")


@query("l22_text_find", r"SELECT doc_id, CAST(strpos(trim(regexp_replace(lower(text), '[ \t\n\r\f\v]+', ' ', 'g')), 'of the') AS BIGINT) AS at FROM documents")
def text_find(t):
    return t.documents.select("doc_id", F.instr(tx.squeeze(F.lower("text")), "of the").cast("bigint").alias("at"))


@query("l23_paragraph_pages", "SELECT doc_id, place - 1 AS place, sha256(p) AS version FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS p, generate_subscripts(string_split(text, chr(10)), 1) AS place FROM documents)")
def paragraph_pages(t):
    rows = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("place", "p"))
    return rows.select("doc_id", F.col("place").cast("bigint").alias("place"), F.sha2("p", 256).alias("version"))
