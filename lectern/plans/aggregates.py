"""Aggregations (inventory section D)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import grouping
from .registry import query

_HOST = r"regexp_extract(url, '^https?://([^/?#]+)', 1)"


@query(
    "d1_library_counts",
    """SELECT source, count(*) AS documents, count(*) FILTER (n_chars < 200) AS short, CAST(sum(n_chars) AS BIGINT) AS chars, max(n_chars) AS longest FROM documents GROUP BY source""",
)
def library_counts(t):
    return t.documents.groupBy("source").agg(F.count("*").alias("documents"), F.count_if(F.col("n_chars") < 200).alias("short"), F.sum("n_chars").alias("chars"), F.max("n_chars").alias("longest"))


@query(
    "d2_conditional_counters",
    """SELECT count(*) AS lines, count(*) FILTER (l_returnflag = 'R') AS returned, count(*) FILTER (l_linestatus = 'O') AS open, count(*) FILTER (l_discount > 0.05) AS discounted,
    count(*) FILTER (l_quantity >= 40) AS large, count(DISTINCT l_suppkey) AS suppliers, count(*) FILTER (l_shipdate >= TIMESTAMP '1997-01-01') AS late,
    count(*) FILTER (l_tax = 0) AS untaxed, count(*) FILTER (l_linenumber = 1) AS firsts FROM lineitem""",
)
def conditional_counters(t):
    c = F.count_if
    return t.lineitem.agg(
        F.count("*").alias("lines"),
        c(F.col("l_returnflag") == "R").alias("returned"),
        c(F.col("l_linestatus") == "O").alias("open"),
        c(F.col("l_discount") > 0.05).alias("discounted"),
        c(F.col("l_quantity") >= 40).alias("large"),
        F.count_distinct("l_suppkey").alias("suppliers"),
        c(F.col("l_shipdate") >= F.lit("1997-01-01").cast("timestamp_ntz")).alias("late"),
        c(F.col("l_tax") == 0).alias("untaxed"),
        c(F.col("l_linenumber") == 1).alias("firsts"),
    )


@query("d3_link_stats", """SELECT count(*) AS total, count(*) - count(quality) AS unread, CAST(sum(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS BIGINT) AS read, CAST(sum(CASE WHEN quality = 0 THEN 1 ELSE 0 END) AS BIGINT) AS archived, CAST(sum(toxic) AS BIGINT) AS flagged FROM documents LEFT JOIN labels USING (doc_id)""")
def link_stats(t):
    j = t.documents.select("doc_id").join(t.labels, "doc_id", "left")
    return j.agg(F.count("*").alias("total"), F.count_if(F.col("quality").isNull()).alias("unread"), F.count_if(F.col("quality") == 1).alias("read"), F.count_if(F.col("quality") == 0).alias("archived"), F.sum("toxic").alias("flagged"))


@query(
    "d4_tag_facets",
    """SELECT tag, count(*) AS n FROM (SELECT unnest([lang, source, CASE WHEN n_chars > 2000 THEN 'long' ELSE '' END]) AS tag FROM documents) WHERE tag <> '' GROUP BY tag""",
)
def tag_facets(t):
    tags = F.array("lang", "source", F.when(F.col("n_chars") > 2000, "long").otherwise(""))
    return grouping.facet(t.documents, F.explode(tags), "tag")


@query("d5_site_facets", f"SELECT site, count(*) AS n FROM (SELECT regexp_replace({_HOST}, '^www\\.', '') AS site FROM pages) WHERE site <> '' GROUP BY site")
def site_facets(t):
    from ..functions.urls import site_of

    return grouping.facet(t.pages, site_of(F.col("url")), "site")


@query(
    "d6_digest_by_site",
    f"""SELECT site, count(*) AS n, string_agg(CAST(page_id AS VARCHAR), ',' ORDER BY page_id) FILTER (k <= 3) AS items
    FROM (SELECT site, page_id, row_number() OVER (PARTITION BY site ORDER BY page_id) AS k FROM (SELECT page_id, regexp_replace({_HOST}, '^www\\.', '') AS site FROM pages)) GROUP BY site""",
)
def digest_by_site(t):
    from ..functions.urls import site_of

    rows = t.pages.select(site_of(F.col("url")).alias("site"), "page_id")
    return grouping.digest(rows, "site", F.col("page_id"), 3).select("site", "n", F.array_join(F.transform("items", lambda x: x.cast("string")), ",").alias("items"))


@query("d7_watch_stats", """SELECT user_id, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS errors, CAST(sum(CASE WHEN value > 50 THEN 1 ELSE 0 END) AS BIGINT) AS high, count(*) AS total FROM events GROUP BY user_id""")
def watch_stats(t):
    return t.events.groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("errors"), F.count_if(F.col("value") > 50).alias("high"), F.count("*").alias("total"))


@query(
    "d8_state_pivot",
    """SELECT lang, count(*) FILTER (quality = 1) AS ok, count(*) FILTER (quality = 0) AS empty, count(*) FILTER (quality IS NULL) AS pending FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang""",
)
def state_pivot(t):
    j = t.documents.select("doc_id", "lang").join(t.labels, "doc_id", "left")
    state = F.coalesce(F.when(F.col("quality") == 1, "ok").when(F.col("quality") == 0, "empty"), F.lit("pending"))
    wide = j.withColumn("state", state).groupBy("lang").pivot("state", ["ok", "empty", "pending"]).count()
    return wide.select("lang", *[F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in ("ok", "empty", "pending")])


@query(
    "d9_series_summary",
    """SELECT o_custkey, count(*) AS n, min_by(o_totalprice, (o_orderdate, o_orderkey)) AS first_amount, max_by(o_totalprice, (o_orderdate, o_orderkey)) AS latest_amount,
    round((max_by(o_totalprice, (o_orderdate, o_orderkey)) - min_by(o_totalprice, (o_orderdate, o_orderkey))) / min_by(o_totalprice, (o_orderdate, o_orderkey)) * 100, 1) AS pct FROM orders GROUP BY o_custkey""",
)
def series_summary(t):
    return grouping.series_summary(t.orders, "o_custkey", ["o_orderdate", "o_orderkey"], "o_totalprice")


@query(
    "d10_due_buckets",
    """SELECT bucket, count(*) AS n, round(sum(o_totalprice), 2) AS amount FROM (SELECT o_totalprice, CASE WHEN d < 0 THEN 'overdue' WHEN d <= 7 THEN 'week' WHEN d <= 31 THEN 'month' ELSE 'later' END AS bucket
      FROM (SELECT o_totalprice, date_diff('day', DATE '1997-06-01', CAST(o_orderdate AS DATE)) AS d FROM orders)) GROUP BY bucket""",
)
def due_buckets(t):
    bucket = grouping.due_bucket(F.datediff(F.to_date("o_orderdate"), F.lit("1997-06-01").cast("date")))
    return t.orders.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("amount"))


@query(
    "d11_year_pack",
    """SELECT p_brand, year(l_shipdate) AS year, count(*) AS n, bool_or(l_returnflag = 'R') AS has_return, NOT bool_or(l_linestatus = 'F') AS missing_final
    FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL""",
)
def year_pack(t):
    j = t.lineitem.select("l_partkey", "l_shipdate", "l_returnflag", "l_linestatus").join(t.part.select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    g = j.groupBy("p_brand", F.year("l_shipdate").cast("bigint").alias("year"))
    return g.agg(F.count("*").alias("n"), F.bool_or(F.col("l_returnflag") == "R").alias("has_return"), (~F.bool_or(F.col("l_linestatus") == "F")).alias("missing_final"))


@query(
    "d12_method_counts",
    """SELECT conv_id, CAST(len(list_filter(list(role), lambda r: r = 'user')) AS BIGINT) AS users, CAST(len(list_filter(list(role), lambda r: r = 'assistant')) AS BIGINT) AS assistants FROM conversations GROUP BY conv_id""",
)
def method_counts(t):
    return t.conversations.groupBy("conv_id").agg(F.count_if(F.col("role") == "user").alias("users"), F.count_if(F.col("role") == "assistant").alias("assistants"))


@query(
    "d13_repeated_lines",
    """WITH l AS (SELECT DISTINCT source, doc_id, regexp_replace(lower(trim(unnest(string_split(text, chr(10))))), '[0-9]+', '#', 'g') AS line FROM documents),
    u AS (SELECT source, count(DISTINCT doc_id) AS units FROM l WHERE length(line) > 0 GROUP BY source)
    SELECT source, line, count(*) AS n FROM l JOIN u USING (source) WHERE length(line) > 0 AND length(line) <= 160 GROUP BY source, line, units HAVING count(*) >= greatest(3, ceil(units * 0.1))""",
)
def repeated_lines(t):
    from ..functions.text import line_key

    lines = t.documents.select("source", "doc_id", F.explode(F.split("text", "\n")).alias("line")).select("source", "doc_id", line_key(F.col("line")).alias("line")).where("length(line) > 0")
    found = grouping.repeated_values(lines, "source", "doc_id", "line", part=0.1)
    return found.where("length(line) <= 160").select("source", "line", "n")


@query(
    "d14_form_totals",
    """SELECT l_orderkey, round(sum(l_quantity), 2) AS total, round(avg(l_quantity), 4) AS mean, min(l_quantity) AS least, max(l_quantity) AS most, round(product(1 - l_discount), 6) AS kept FROM lineitem GROUP BY l_orderkey""",
)
def form_totals(t):
    g = t.lineitem.groupBy("l_orderkey")
    return g.agg(F.round(F.sum("l_quantity"), 2).alias("total"), F.round(F.avg("l_quantity"), 4).alias("mean"), F.min("l_quantity").alias("least"), F.max("l_quantity").alias("most"), F.round(F.product(1 - F.col("l_discount")), 6).alias("kept"))


@query("d15_space_share", """SELECT source, CAST(sum(n_chars) AS DOUBLE) AS total, round(sum(n_chars) / sum(sum(n_chars)) OVER (), 4) AS share FROM documents GROUP BY source""")
def space_share(t):
    return grouping.share(t.documents, "source", "n_chars").withColumn("total", F.col("total").cast("double"))


@query("d16_counts_by_kind", "SELECT event_type AS kind, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY event_type")
def counts_by_kind(t):
    return t.events.groupBy(F.col("event_type").alias("kind")).agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))


@query(
    "d17_decimal_mark_vote",
    r"""WITH v AS (SELECT doc_id % 7 AS col, CASE WHEN doc_id % 3 = 0 THEN replace(CAST(n_chars AS VARCHAR) || ',50', ',', '.') ELSE CAST(n_chars AS VARCHAR) || ',50' END AS x FROM documents)
    SELECT col, CASE WHEN count(*) FILTER (regexp_matches(x, ',\d{1,2}$')) >= count(*) FILTER (regexp_matches(x, '\.\d{1,2}$')) THEN ',' ELSE '.' END AS mark FROM v GROUP BY col""",
)
def decimal_mark_vote(t):
    from ..functions.money import decimal_mark

    x = F.concat(F.col("n_chars").cast("string"), F.when(F.col("doc_id") % 3 == 0, ".50").otherwise(",50"))
    return t.documents.select((F.col("doc_id") % 7).alias("col"), x.alias("x")).groupBy("col").agg(decimal_mark(F.col("x")).alias("mark"))


@query(
    "d18_character_error_rate",
    """WITH p AS (SELECT conv_id, turn, text AS truth, replace(replace(text, 'e', 'c'), 'th', 'h') AS seen FROM conversations)
    SELECT conv_id, round(CAST(sum(levenshtein(truth, seen)) AS DOUBLE) / sum(length(truth)), 4) AS cer, count(*) FILTER (length(trim(seen)) = 0) AS empty, count(*) AS pages FROM p GROUP BY conv_id""",
)
def character_error_rate(t):
    p = t.conversations.select("conv_id", F.col("text").alias("truth"), F.replace(F.replace(F.col("text"), F.lit("e"), F.lit("c")), F.lit("th"), F.lit("h")).alias("seen"))
    wrong = F.sum(F.levenshtein("truth", "seen")) / F.sum(F.length("truth"))
    return p.groupBy("conv_id").agg(F.round(wrong, 4).alias("cer"), F.count_if(F.length(F.trim("seen")) == 0).alias("empty"), F.count("*").alias("pages"))


@query(
    "d19_recall_at_one",
    """WITH s AS (SELECT q.vec_id AS q, q.label AS want, e.label AS got, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_dot_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) DESC, e.vec_id) AS k
      FROM embeddings q JOIN embeddings e ON q.vec_id % 50 = 0 AND e.vec_id <> q.vec_id)
    SELECT count(*) AS queries, round(avg(CASE WHEN want = got THEN 1.0 ELSE 0.0 END), 4) AS recall FROM s WHERE k = 1""",
)
def recall_at_one(t):
    from ..operators.retrieval import top_k_of_queries

    best = top_k_of_queries(t.embeddings.where("vec_id % 50 = 0"), t.embeddings, "vec_id", "embedding", 1)
    labels = t.embeddings.select(F.col("vec_id").alias("id"), "label")
    j = best.join(labels.withColumnsRenamed({"id": "query", "label": "want"}), "query").join(labels.withColumnsRenamed({"id": "found", "label": "got"}), "found")
    return j.agg(F.count("*").alias("queries"), F.round(F.avg((F.col("want") == F.col("got")).cast("double")), 4).alias("recall"))


@query(
    "d20_tag_affinity",
    """WITH r AS (SELECT source, count(*) FILTER (quality = 1) AS n FROM documents JOIN labels USING (doc_id) GROUP BY source)
    SELECT doc_id, CAST(least(20, 4 * coalesce(n, 0)) AS BIGINT) AS affinity FROM documents LEFT JOIN r USING (source)""",
)
def tag_affinity(t):
    d = t.documents.select("doc_id", "source")
    read = d.join(t.labels, "doc_id").groupBy("source").agg(F.count_if(F.col("quality") == 1).alias("n"))
    return d.join(read, "source", "left").select("doc_id", F.least(F.lit(20), 4 * F.coalesce("n", F.lit(0))).cast("bigint").alias("affinity"))


@query(
    "d21_largest_remainder",
    """WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey, 1000 * l_quantity / sum(l_quantity) OVER (PARTITION BY l_orderkey) AS x, 1000 * l_quantity AS a, sum(l_quantity) OVER (PARTITION BY l_orderkey) AS w FROM lineitem),
    f AS (SELECT *, floor(x) AS fl, row_number() OVER (PARTITION BY l_orderkey ORDER BY a - floor(x) * w DESC, l_linenumber, l_partkey) AS k, 1000 - sum(floor(x)) OVER (PARTITION BY l_orderkey) AS rest FROM p)
    SELECT l_orderkey, l_linenumber, l_partkey, CAST(fl + CASE WHEN k <= rest THEN 1 ELSE 0 END AS BIGINT) AS share FROM f""",
)
def largest_remainder(t):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    return grouping.largest_remainder(rows, "l_orderkey", ["l_linenumber", "l_partkey"], "l_quantity", F.lit(1000)).select("l_orderkey", "l_linenumber", "l_partkey", "share")


@query("dx_cube", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube(t):
    return t.lineitem.cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("dx_rollup", "SELECT year(o_orderdate) AS y, o_orderstatus, count(*) AS n FROM orders GROUP BY ROLLUP (y, o_orderstatus)")
def rollup(t):
    return t.orders.withColumn("y", F.year("o_orderdate").cast("bigint")).rollup("y", "o_orderstatus").agg(F.count("*").alias("n"))
