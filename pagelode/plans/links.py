"""Link graph and discovery queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import urls as U
from ..operators import links as L
from ..sources import adapters as A
from . import sqltext as S

PROFILES = [("hub", r"(^|\.)hub\.example\.org$"), ("mobile", r"^m\."), ("com", r"\.com$")]


def _links(spark, sf):
    return L.crawl_links(A.table(spark, sf, "pages"))


def _graph(spark, sf):
    """Pages and link texts as a two-sided graph, so a search has several levels."""
    found = L.anchors(A.table(spark, sf, "pages"))
    out = found.select(F.concat(F.lit("p:"), "page_id").alias("src"),
                       F.concat(F.lit("h:"), "href").alias("dst"), "pos")
    back = found.select(F.concat(F.lit("h:"), "href").alias("src"),
                        F.concat(F.lit("p:"), "page_id").alias("dst"), F.col("page_id").alias("pos"))
    return out.unionByName(back).distinct()


_GRAPH = (S.ANCHORS + ", graph AS (SELECT 'p:' || page_id AS src, 'h:' || href AS dst, pos FROM anchors UNION SELECT "
          "'h:' || href, 'p:' || page_id, page_id FROM anchors)")


def g01(spark, sf):
    return _links(spark, sf).select("page_id", "pos", "href", "target")


def g02(spark, sf):
    """Search from the page with the smallest id, two levels more than its own links."""
    graph = _graph(spark, sf)
    starts = A.table(spark, sf, "pages").agg(F.min("page_id").alias("seq")).select(
        F.concat(F.lit("p:"), "seq").alias("node"), "seq")
    return L.breadth_first(graph, starts, 3).select(
        "node", "depth", F.array_join(F.col("trail").cast("array<string>"), "/").alias("trail"))


def g02_budget(spark, sf):
    graph = _graph(spark, sf)
    starts = A.table(spark, sf, "pages").agg(F.min("page_id").alias("seq")).select(
        F.concat(F.lit("p:"), "seq").alias("node"), "seq")
    return L.breadth_first(graph, starts, 2, 25).select("node", "depth")


def g03(spark, sf):
    """All pages as seeds over the graph of link texts and their first letters."""
    found = L.anchors(A.table(spark, sf, "pages"))
    first = found.select(F.concat(F.lit("p:"), "page_id").alias("src"), F.col("href").alias("dst"), "pos")
    letters = found.select(F.col("href").alias("src"), F.concat(F.lit("/"), F.substring("href", 2, 1), F.lit("/"),
                           F.substring("href", 3, 1)).alias("dst"), F.length("href").alias("pos")).distinct()
    seeds = A.table(spark, sf, "pages").select(
        F.concat(F.lit("p:"), "page_id").alias("node"), F.col("page_id").alias("seq"),
        U.page_category(F.col("url")).alias("category"))
    return L.expand_seeds(first.unionByName(letters), seeds, 2, 2).select("node", "category", "depth")


def g04(spark, sf):
    pages = A.table(spark, sf, "pages")
    existing = pages.filter(U.is_web_url(F.col("url"))).select("url", F.col("page_id").alias("seq"))
    sitemap = _links(spark, sf).select(F.col("target").alias("url"),
                                       (F.col("page_id") * 100 + F.col("pos")).alias("seq"))
    return L.merge_seeds(existing, sitemap)


def g05(spark, sf):
    sections = A.table(spark, sf, "pages").select(
        "page_id", U.page_category(F.col("url")).alias("section"), F.col("url").alias("index_url"),
        F.when(F.col("page_id") % 2 == 0, F.lit("^/[a-m]")).otherwise(F.lit("^/[^aeiou]")).alias("pattern"))
    return L.section_pages(_links(spark, sf), sections)


def g06(spark, sf):
    actions = A.actions(spark, sf)
    planned = actions.filter("outcome = 'modal'").select(
        F.concat(F.lit("https://site.example.com/go/"), F.col("id") % 9, F.lit("?a=1&b=2")).alias("url")).distinct()
    return L.promote_navigations(actions, planned, "site.example.com")


def g07(spark, sf):
    pages = A.table(spark, sf, "pages")
    return pages.select("page_id", L.pick_profile(U.hostname(F.col("url")), PROFILES).alias("profile"))


def _site_maps(spark, sf):
    """Robots files and site maps a site of each page would have."""
    pages = A.table(spark, sf, "pages")
    robots = pages.select(F.col("page_id").alias("site_id"), F.col("url").alias("base_url"), F.lit(
        "User-agent: *\r\nSitemap: /map-b.xml\nAllow: /ok\nDisallow: /no*\nDisallow: /\nDisallow: /pic.png\n"
        "  disallow : /Wide\nSitemap: https://elsewhere.example.org/map.xml\nAllow: /end$").alias("text"))
    root = U.origin(F.col("url"))
    maps = pages.select(F.col("page_id").alias("site_id"), F.explode(F.array(
        F.struct(F.concat(root, F.lit("/sitemap.xml")).alias("url"), F.concat(
            F.lit("<sitemapindex><sitemap><loc> "), root, F.lit("/map-a.xml </loc></sitemap><sitemap><loc>"
                  "https://elsewhere.example.org/m.xml</loc></sitemap></sitemapindex>")).alias("xml")),
        F.struct(F.concat(root, F.lit("/map-a.xml")).alias("url"), F.concat(
            F.lit("<urlset><url><loc>"), "url", F.lit("</loc></url><url><loc>/ok</loc></url></urlset>")).alias("xml")),
        F.struct(F.concat(root, F.lit("/map-b.xml")).alias("url"), F.concat(
            F.lit("<urlset><LOC>"), root, F.lit("/x/"), F.col("page_id"), F.lit("/</LOC><loc>/a.css</loc></urlset>"))
            .alias("xml")))).alias("m")).select("site_id", "m.*")
    return robots, maps


def s06(spark, sf):
    return L.sitemap_urls(*_site_maps(spark, sf))


QUERIES = {
    "g01_links": g01,
    "g01_top_linked": lambda spark, sf: L.top_linked(_links(spark, sf)),
    "g02_breadth_first": g02,
    "g02_page_budget": g02_budget,
    "g03_expand_seeds": g03,
    "g04_merge_seeds": g04,
    "g05_section_pages": g05,
    "g06_promote_navigations": g06,
    "g07_pick_profile": g07,
    "s06_sitemap_urls": s06,
}

_BFS = (f"WITH RECURSIVE {_GRAPH}, walk AS (SELECT 'p:' || min(page_id) AS node, 0 AS depth, [min(page_id)] AS trail "
        "FROM pages UNION ALL SELECT g.dst, w.depth + 1, list_append(w.trail, g.pos) FROM walk w JOIN graph g ON "
        "g.src = w.node WHERE w.depth < {depth}), best AS (SELECT node, min(depth) AS depth FROM walk GROUP BY node), "
        "firsts AS (SELECT w.node, w.depth, min(w.trail) AS trail FROM walk w JOIN best b ON w.node = b.node AND "
        "w.depth = b.depth GROUP BY 1, 2)")

_EXISTING = f"(SELECT {S.normal('url')} FROM pages)"

ORACLES = {
    "g01_links": f"WITH {S.LINKS} SELECT page_id, pos, href, target FROM links",
    "g01_top_linked": f"WITH {S.LINKS} SELECT target, count(*) AS in_links FROM links GROUP BY target ORDER BY in_links "
                      "DESC, target LIMIT 20",
    "g02_breadth_first": _BFS.replace("{depth}", "3") + " SELECT node, depth, array_to_string(trail, '/') AS trail"
                         " FROM firsts",
    "g02_page_budget": _BFS.replace("{depth}", "2") + " SELECT node, depth FROM firsts ORDER BY depth, trail LIMIT 25",
    "g04_merge_seeds": f"WITH {S.LINKS}, known AS (SELECT DISTINCT {S.normal('url')} AS url FROM pages), seeded AS ("
                       "SELECT target AS url, min(page_id * 100 + pos) AS seq, 0 AS source FROM links WHERE target NOT IN"
                       " (SELECT url FROM known) GROUP BY target), bases AS (SELECT url, "
                       "page_id AS seq, 1 AS source FROM pages UNION ALL SELECT url, seq, 2 FROM seeded), nx AS ("
                       "SELECT source, seq, " + S.normal("url") + " AS own, CASE WHEN regexp_matches(url, '[?&]page=') THEN "
                       "regexp_replace(url, '([?&]page=)[0-9]+', '\\1' || CAST(CAST(regexp_extract(url, "
                       "'[?&]page=([0-9]+)', 1) AS BIGINT) + 1 AS STRING)) WHEN contains(url, '?') THEN "
                       "regexp_replace(url, '#.*$', '') || '&page=2' ELSE regexp_replace(url, '#.*$', '') || '?page=2' END"
                       f" AS nxt FROM bases WHERE NOT {S.crawl_asset(S.path('url'))}), minted AS (SELECT url, "
                       "min([source, seq]) AS k FROM (SELECT source, seq, own, " + S.normal("nxt") + " AS url FROM nx) "
                       "WHERE url <> own GROUP BY url), fresh AS (SELECT url, k[2] AS seq, k[1] AS"
                       " source FROM minted WHERE url NOT IN (SELECT url FROM known) AND url NOT IN (SELECT url FROM seeded)"
                       "), ranked AS (SELECT url, row_number() OVER (ORDER BY source, seq, url) AS rank FROM (SELECT * FROM "
                       "seeded UNION ALL SELECT * FROM fresh)) SELECT url, " + S.page_slug("url") + " AS label, "
                       + S.category("url") + " AS category, rank FROM ranked",
    "g05_section_pages": f"WITH {S.LINKS}, hits AS (SELECT {S.category('url')} AS section, url AS index_url, pos, target, "
                         f"{S.path('target')} AS p FROM links WHERE regexp_replace({S.path('target')}, '/$', '') <> "
                         f"regexp_replace({S.path('url')}, '/$', '') AND CASE WHEN page_id % 2 = 0 THEN regexp_matches("
                         f"{S.path('target')}, '^/[a-m]') ELSE regexp_matches({S.path('target')}, '^/[^aeiou]') END) SELECT "
                         "section, index_url, min_by(target, pos) AS page_url, " + S.origin("min_by(target, pos)") +
                         " || '/' || coalesce(list_filter(string_split(min_by(p, pos), '/'), lambda s: s <> '')[1], '') AS"
                         " owner_url FROM hits GROUP BY 1, 2",
    "g06_promote_navigations": f"WITH {S.view('actions', A.ACTIONS, 'events')}, planned AS (SELECT DISTINCT 'https://"
                               "site.example.com/go/' || (id % 9) || '?a=1&b=2' AS url FROM actions WHERE outcome = 'modal'"
                               f"), n AS (SELECT {S.normal('to_url')} AS url, min(seq) AS seq FROM actions WHERE outcome = "
                               f"'navigation' AND {S.host('to_url')} = 'site.example.com' AND NOT "
                               f"{S.crawl_asset(S.path('to_url'))} GROUP BY 1), r AS (SELECT url, row_number() OVER (ORDER "
                               "BY seq) AS rank FROM n WHERE url NOT IN (SELECT url FROM planned)) SELECT url, "
                               + S.file_slug("url") + " AS label, 'explored' AS category, rank FROM r",
    "g07_pick_profile": f"SELECT page_id, CASE WHEN regexp_matches({S.host('url')}, '(^|\\.)hub\\.example\\.org$') THEN "
                        f"'hub' WHEN starts_with({S.host('url')}, 'm.') THEN 'mobile' WHEN ends_with({S.host('url')}, "
                        "'.com') THEN 'com' ELSE 'generic' END AS profile FROM pages",
    "s06_sitemap_urls": f"WITH o AS (SELECT page_id AS site_id, url, {S.origin('url')} AS root FROM pages), c AS (SELECT "
                        "site_id, root || '/ok' AS url, 1 AS k FROM o UNION ALL SELECT site_id, root || '/Wide', 2 FROM o "
                        f"UNION ALL SELECT site_id, {S.normal('url')}, 3 FROM o WHERE NOT {S.crawl_asset(S.path('url'))} "
                        "UNION ALL SELECT site_id, root || '/x/' || site_id, 4 FROM o), f AS (SELECT site_id, url, min(k) AS"
                        " k FROM c GROUP BY 1, 2) SELECT site_id, url, row_number() OVER (PARTITION BY site_id ORDER BY k) AS"
                        " rank FROM f",
}
