"""URLs (inventory section H, first part)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import urls
from .registry import query

_PARTS = r"""WITH u AS (SELECT page_id, url, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host,
  regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), '/+$', '') AS path, regexp_extract(url, '\?([^#]*)', 1) AS query FROM pages),
q AS (SELECT page_id, list_sort(list_filter(string_split(query, '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_|mc_|_hs|vero_|trk)') AND split_part(x, '=', 1) NOT IN ('fbclid', 'gclid', 'spm', 'eid', 'ser', 'snr', 'refid'))) AS kept FROM u)
"""


@query("h1_normalized_url", _PARTS + "SELECT page_id, scheme || '://' || host || path || CASE WHEN len(kept) > 0 THEN '?' || list_aggregate(kept, 'string_agg', '&') ELSE '' END AS canonical FROM u JOIN q USING (page_id)")
def normalized_url(t):
    return t.pages.select("page_id", urls.normalize(F.col("url")).alias("canonical"))


@query("h2_url_key", _PARTS + r"SELECT page_id, regexp_replace(host, '^www\.', '') || path || CASE WHEN len(kept) > 0 THEN '?' || list_aggregate(kept, 'string_agg', '&') ELSE '' END AS key FROM u JOIN q USING (page_id)")
def url_key(t):
    return t.pages.select("page_id", urls.url_key(F.col("url")).alias("key"))


@query("h3_split_url", r"""SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS path, regexp_extract(url, '\?([^#]*)', 1) AS query, regexp_extract(url, '#(.*)$', 1) AS fragment FROM pages""")
def split_url(t):
    u = F.col("url")
    return t.pages.select("page_id", urls.scheme(u).alias("scheme"), urls.host_of(u).alias("host"), urls.part(u, urls.PATH).alias("path"), urls.part(u, urls.QUERY).alias("query"), urls.part(u, urls.FRAGMENT).alias("fragment"))


@query("h4_unwrapped_redirect", "SELECT page_id, url FROM pages")
def unwrapped_redirect(t):
    once = F.concat(F.lit("https://t.example/c?id=1&url="), F.url_encode("url"))
    twice = F.concat(F.lit("https://r.example/redirect?q="), F.url_encode(once))
    wrapped = F.when(F.col("page_id") % 3 == 0, twice).when(F.col("page_id") % 3 == 1, once).otherwise(F.col("url"))
    return t.pages.select("page_id", urls.unwrap_redirect(wrapped).alias("url"))


@query(
    "h5_cleaned_url",
    r"""WITH u AS (SELECT page_id, url, list_filter(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_|mc_|_hs|vero_|trk)')) AS kept FROM pages)
    SELECT page_id, regexp_extract(url, '^([^?#]*)', 1) || CASE WHEN len(kept) > 0 THEN '?' || list_aggregate(kept, 'string_agg', '&') ELSE '' END AS clean FROM u""",
)
def cleaned_url(t):
    return t.pages.select("page_id", urls.clean(F.col("url")).alias("clean"))


@query(
    "h6_tracking_params",
    r"""SELECT name, count(*) AS n, bool_or(regexp_matches(name, '^(utm_|mc_|_hs|vero_|trk)')) AS tracks FROM (SELECT split_part(unnest(string_split(regexp_extract(url, '\?([^#]*)', 1), '&')), '=', 1) AS name FROM pages) WHERE name <> '' GROUP BY name""",
)
def tracking_params(t):
    names = t.pages.select(F.explode(F.split(urls.part(F.col("url"), urls.QUERY), "&")).alias("x")).select(F.split_part("x", F.lit("="), F.lit(1)).alias("name")).where("name <> ''")
    return names.groupBy("name").agg(F.count("*").alias("n"), F.bool_or(urls.is_tracking(F.col("name"))).alias("tracks"))


@query("h7_registrable_domain", r"SELECT page_id, list_aggregate(string_split(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1), '.')[-2:], 'string_agg', '.') AS domain FROM pages")
def registrable_domain(t):
    return t.pages.select("page_id", urls.registrable_domain(F.col("url")).alias("domain"))


@query("h8_site_of", r"SELECT page_id, regexp_replace(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1), '^www\.', '') AS site FROM pages")
def site_of(t):
    return t.pages.select("page_id", urls.site_of(F.col("url")).alias("site"))


@query("r9_media_key", r"SELECT page_id, coalesce(nullif(regexp_extract(url, '/([a-z]{2})/([0-9]+)', 1), '') || ':' || regexp_extract(url, '/([a-z]{2})/([0-9]+)', 2), '') AS key FROM pages")
def media_key(t):
    lang, number = F.regexp_extract("url", "/([a-z]{2})/([0-9]+)", 1), F.regexp_extract("url", "/([a-z]{2})/([0-9]+)", 2)
    return t.pages.select("page_id", F.when(lang != "", F.concat(lang, F.lit(":"), number)).otherwise("").alias("key"))
