"""URL and naming queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import rules as R
from ..functions import urls as U
from ..functions.core import position_in
from ..operators import links as L
from ..sources import adapters as A
from . import sqltext as S


def _urls(spark, sf):
    """Every URL the tables hold: page addresses, navigation targets, captured routes."""
    pages = A.table(spark, sf, "pages").select(F.col("page_id").alias("id"), "url")
    moves = A.actions(spark, sf).filter("to_url is not null").select(
        (F.col("id") + 1000000000).alias("id"), F.col("to_url").alias("url"))
    routes = A.captures(spark, sf).select((F.col("seq") + 2000000000).alias("id"), "url")
    return pages.unionByName(moves).unionByName(routes)


_URLS = (S.view("actions", A.ACTIONS, "events") + ", " + S.view("captures", A.CAPTURES, "events")
         + ", urls AS (SELECT page_id AS id, url FROM pages UNION ALL SELECT id + 1000000000, to_url FROM actions"
         " WHERE to_url IS NOT NULL UNION ALL SELECT seq + 2000000000, url FROM captures)")


def _per_url(**columns):
    return lambda spark, sf: _urls(spark, sf).select(
        "id", *[make(F.col("url")).alias(name) for name, make in columns.items()])


def _per_url_sql(**columns):
    body = ", ".join(f"{text} AS {name}" for name, text in columns.items())
    return f"WITH {_URLS} SELECT id, {body} FROM urls"


def s01(spark, sf):
    return U.with_url_parts(A.table(spark, sf, "pages")).select(
        F.col("page_id").alias("seq"), "url", "host", "pathname", F.length("html").alias("html_chars"))


def u02(spark, sf):
    pairs = _urls(spark, sf).select("id", F.explode(U.query_pairs(U.search(F.col("url")))).alias("p"))
    return pairs.groupBy(F.col("p.name").alias("name")).agg(F.count(F.lit(1)).alias("n")).withColumn(
        "tracking", U.is_tracking(F.col("name")))


def u03(spark, sf):
    path = U.pathname(F.col("url"))
    urls = _urls(spark, sf).select("url").unionByName(A.asset_responses(spark, sf).select("url")).unionByName(
        A.calls(spark, sf).select("url"))
    return urls.groupBy(F.regexp_extract(path, r"(\.[A-Za-z0-9]+)$", 1).alias("ext")).agg(
        F.count_if(U.is_crawl_asset(path)).alias("crawl_assets"),
        F.count_if(U.is_call_asset(path)).alias("call_assets"), F.count(F.lit(1)).alias("n"))


def u04(spark, sf):
    url = F.col("url")
    hosts = _urls(spark, sf).select("url").unionByName(A.calls(spark, sf).select("url"))
    base = F.lit("site.example.com")
    return hosts.groupBy(U.hostname(url).alias("host")).agg(F.count(F.lit(1)).alias("n")).select(
        "host", "n", (F.col("host") == base).alias("same_host"),
        U.same_site(F.col("host"), F.lit("example.com")).alias("same_site"),
        (F.col("host") != base).alias("external"))


def u10(spark, sf):
    return L.plan_paths(A.captures(spark, sf)).select("seq", "category", "index", "path")


def u11(spark, sf):
    return L.mint_pagination(_urls(spark, sf).withColumnRenamed("id", "seq"))


def u12(spark, sf):
    target = F.lit("http://localhost:3000/start")
    return _urls(spark, sf).select("id", U.rebase(F.col("url"), target).alias("rebased"),
                                   U.rebase(U.pathname(F.col("url")), target).alias("rebased_path"))


def u13(spark, sf):
    calls = A.calls(spark, sf)
    mixed = F.when(F.col("seq") % 2 == 0, F.col("url")).otherwise(F.col("pathname"))
    return calls.select("seq", U.pathname_or(mixed).alias("route"))


def u14(spark, sf):
    return A.calls(spark, sf).select("seq", U.redact_url(F.col("url")).alias("safe_url"))


def u15(spark, sf):
    url = F.col("url")
    entry = F.when(F.col("seq") % 2 == 0, url).otherwise(U.pathname(url))
    return L.resolve_page_list(A.captures(spark, sf).select(entry.alias("entry"), "seq"),
                               "https://site.example.com/home")


def u08(spark, sf):
    return A.table(spark, sf, "documents").select(
        "doc_id", U.sanitize_segment(F.substring_index("text", "\n", 1)).alias("segment"))


QUERIES = {
    "s01_pages": s01,
    "u01_normalize_url": _per_url(canonical=U.normalize_url),
    "u02_tracking_params": u02,
    "u03_asset_extensions": u03,
    "u04_origins": u04,
    "u05_page_slug": _per_url(slug=U.page_slug),
    "u06_category": _per_url(category=U.page_category),
    "u07_site_name": _per_url(site=U.site_name),
    "u08_sanitize_segment": u08,
    "u09_file_slug": _per_url(slug=U.file_slug),
    "u10_output_paths": u10,
    "u11_pagination": u11,
    "u12_rebase": u12,
    "u13_pathname": u13,
    "u14_redact_url": u14,
    "u15_page_list": u15,
}

_CALLS = S.view("calls", A.CALLS, "events")
_NEXT = ("CASE WHEN regexp_matches(url, '[?&]page=') THEN regexp_replace(url, '([?&]page=)[0-9]+', '\\1' || "
         "CAST(CAST(regexp_extract(url, '[?&]page=([0-9]+)', 1) AS BIGINT) + 1 AS STRING)) WHEN contains(url, '?') "
         "THEN regexp_replace(url, '#.*$', '') || '&page=2' ELSE regexp_replace(url, '#.*$', '') || '?page=2' END")
_MIXED = "CASE WHEN seq % 2 = 0 THEN 'https://' || host || pathname || '?' || qs ELSE pathname END"
_GENERIC = S.quoted(R.GENERIC_HOST_LABELS)

ORACLES = {
    "s01_pages": f"SELECT page_id AS seq, url, {S.host('url')} AS host, {S.path('url')} AS pathname, "
                 "length(html) AS html_chars FROM pages",
    "u01_normalize_url": _per_url_sql(canonical=S.normal("url")),
    "u02_tracking_params": f"WITH {_URLS}, pairs AS (SELECT unnest(string_split(regexp_extract(url, "
                           "'\\?([^#]*)', 1), '&')) AS p FROM urls), named AS (SELECT regexp_extract(p, '^[^=]*') AS name"
                           " FROM pairs WHERE p <> '') SELECT name, count(*) AS n, starts_with(lower(name), 'utm_') OR "
                           f"lower(name) IN ({S.quoted(R.TRACKING_PARAMS)}) AS tracking FROM named GROUP BY name",
    "u03_asset_extensions": f"WITH {_URLS}, {_CALLS}, {S.view('assets', A.ASSET_RESPONSES, 'part')}, everything AS "
                            "(SELECT url FROM urls UNION ALL SELECT url FROM assets UNION ALL SELECT 'https://' || host ||"
                            f" pathname FROM calls), p AS (SELECT {S.path('url')} AS path FROM everything) SELECT "
                            "regexp_extract(path, '(\\.[A-Za-z0-9]+)$', 1) AS ext, count(*) FILTER (regexp_matches(path, "
                            f"'{R.CRAWL_ASSET_EXT}')) AS crawl_assets, count(*) FILTER (regexp_matches(path, "
                            f"'{R.CALL_ASSET_EXT}')) AS call_assets, count(*) AS n FROM p GROUP BY 1",
    "u04_origins": f"WITH {_URLS}, {_CALLS}, h AS (SELECT {S.host('url')} AS host FROM urls UNION ALL SELECT host FROM"
                   " calls) SELECT host, count(*) AS n, host = 'site.example.com' AS same_host, host = 'example.com' OR"
                   " ends_with(host, '.example.com') AS same_site, host <> 'site.example.com' AS external FROM h GROUP BY host",
    "u05_page_slug": _per_url_sql(slug=S.page_slug("url")),
    "u06_category": _per_url_sql(category=S.category("url")),
    "u07_site_name": f"WITH {_URLS}, l AS (SELECT id, string_split({S.host('url')}, '.') AS labels FROM urls), k AS ("
                     f"SELECT id, labels, list_filter(generate_series(1, len(labels)), lambda i: i = len(labels) OR NOT "
                     f"(labels[i] IN ({_GENERIC})))[1] AS i FROM l) SELECT id, {S.sanitize('labels[i]')} AS site FROM k",
    "u08_sanitize_segment": f"SELECT doc_id, {S.sanitize('string_split(text, chr(10))[1]')} AS segment FROM documents",
    "u09_file_slug": _per_url_sql(slug=S.file_slug("url")),
    "u10_output_paths": f"WITH {S.view('captures', A.CAPTURES, 'events')}, n AS (SELECT seq, url, coalesce(category, "
                        "'pages') AS category, row_number() OVER (PARTITION BY coalesce(category, 'pages') ORDER BY seq) "
                        f"AS index FROM captures) SELECT seq, category, index, 'web/screenshots/' || {S.sanitize('category')}"
                        f" || '/' || printf('%02d', index) || '-' || {S.file_slug('url')} || '.png' AS path FROM n",
    "u11_pagination": f"WITH {_URLS}, n AS (SELECT id, url, {S.normal('url')} AS own, {_NEXT} AS nxt FROM urls WHERE NOT "
                      f"{S.crawl_asset(S.path('url'))}), m AS (SELECT id, own, {S.normal('nxt')} AS url FROM n) SELECT url,"
                      f" min(id) AS seq FROM m WHERE url <> own AND url NOT IN (SELECT {S.normal('url')} FROM urls)"
                      " GROUP BY url",
    "u12_rebase": f"WITH {_URLS} SELECT id, 'http://localhost:3000' || {S.path('url')} || {S.search('url')} AS rebased, "
                  f"'http://localhost:3000' || {S.path('url')} AS rebased_path FROM urls",
    "u13_pathname": f"WITH {_CALLS}, m AS (SELECT seq, {_MIXED} AS raw FROM calls) SELECT seq, CASE WHEN contains(raw, "
                    f"'://') THEN {S.path('raw')} ELSE raw END AS route FROM m",
    "u14_redact_url": f"WITH {_CALLS} SELECT seq, 'https://' || host || pathname || '?' || regexp_replace(qs, "
                      "'api_key=[^&]*', 'api_key=%5BREDACTED%5D') AS safe_url FROM calls",
    "u15_page_list": f"WITH {S.view('captures', A.CAPTURES, 'events')}, u AS (SELECT url, min(seq) AS seq FROM captures"
                     f" GROUP BY url) SELECT url, {S.page_slug('url')} AS label, 'pages' AS category,"
                     " seq FROM u",
}
