"""QC task, check and verdict queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import urls as U
from ..operators import actions as X
from ..operators import dom as D
from ..operators import tasks as T
from ..operators import verify as V
from ..sources import adapters as A
from . import domsql as M
from . import sqltext as S
from .interaction import ACT



def flat(df):
    """Task rows with nested parts as text, for comparison."""
    cols = {
        "api": F.array_join("api", ";"), "pre": F.array_join(F.transform("pre", lambda p: F.concat_ws("/", F.coalesce(p["role"], F.lit("-")), p["name"], p["action"])), ";"),
        "data": F.array_join(F.transform("data", lambda d: F.concat_ws("@", d["text"], d["source"])), ";")}
    return df.withColumns({c: v for c, v in cols.items() if c in df.columns})


def _features(spark, sf):
    return X.features(A.actions(spark, sf))


def v01(spark, sf):
    return flat(T.feature_tasks(_features(spark, sf))).select("ord", "title", "page", "page_url", "role", "name", "action", "outcome", "detail", "api", "pre")


def v02(spark, sf):
    return flat(T.route_tasks(X.nav_edges(A.actions(spark, sf)), _features(spark, sf))).select("ord", "title", "page_url", "detail")


_BODY = ("CASE o_orderkey % 5 WHEN 0 THEN '{\"data\":[\"x\",{\"zeta\":\"Zed ' || CAST(o_custkey AS STRING) || '\",\"name\":\" N' || CAST(o_orderkey AS STRING) || '\",\"url\":\"https://a\",\"n\":5}]}' WHEN 1 THEN "
         "'{\"title\":\"T' || CAST(o_custkey AS STRING) || '\",\"id\":\"true\",\"day\":\"2024-01-01T00:00\"}' WHEN 2 THEN '[{\"a\":\"---\"}]' WHEN 3 THEN '[1,{\"slug\":\"s' || CAST(o_orderkey AS STRING) || '\"}]' ELSE "
         "'\"text\"' END")


def _bodies(spark, sf):
    return A.dealt(spark, sf, "orders", "o_orderkey").selectExpr("o_orderkey AS seq", "'https://api.example.com/o/' || CAST(o_custkey AS STRING) AS url", "'/o/{o}' AS template",
                                                   _BODY + " AS response", "'f' || CAST(o_orderkey AS STRING) || '.json' AS file")


def v03(spark, sf):
    return flat(T.fixture_data_tasks(_bodies(spark, sf))).select("ord", "title", "page", "page_url", "name", "detail", "data")


def _entities(spark, sf):
    """Customers as entities with text fields."""
    entry = lambda k, v: F.struct(F.lit(k).alias("key"), v.alias("value"))
    c = A.table(spark, sf, "customer")
    return c.select(F.lit("model").alias("type"), F.concat(F.lit("own/"), "c_custkey").alias("id"), F.when(F.col("c_custkey") % 4 != 0, F.concat(
        F.lit("https://site.example.com/e/"), "c_custkey")).alias("url"), F.col("c_custkey").alias("seq"),
        F.array(entry("segment", F.col("c_mktsegment")), entry("author", F.concat(F.lit("a"), "c_nationkey")), entry("name", F.col("c_name")),
                entry("gone", F.lit("null")), entry("x", F.lit("-"))).alias("entries"))


def v04(spark, sf):
    return flat(T.entity_data_tasks(_entities(spark, sf))).select("ord", "title", "page", "name", "data")


def _listing(spark, sf):
    rows = A.listing_rows(spark, sf)
    return rows.select(F.expr("seq div 10").alias("listing_seq"), F.concat(F.lit("p"), F.expr("seq div 10")).alias("page"), F.concat(
        F.lit("https://hub.example.com/l/"), F.expr("seq div 30")).alias("page_url"), (F.col("seq") % 10).alias("row_no"), "fields")


def _targets(spark, sf):
    return A.listing_rows(spark, sf).select(F.concat(F.lit("https://hub.example.com/l/"), F.expr("seq div 7"), F.lit("?q=1")).alias("url"), F.concat(
        F.lit("L"), "seq").alias("label"), "seq")


def v06(spark, sf):
    return T.coverage_tasks(_targets(spark, sf), _listing(spark, sf)).select("ord", "title", "page", "page_url", "detail")


def v07(spark, sf):
    texts = A.snippets(spark, sf).select("text").unionByName(A.table(spark, sf, "part").select(F.col("p_name").alias("text"))).unionByName(
        A.table(spark, sf, "conversations").select("text"))
    return texts.groupBy(F.length("text").alias("chars")).agg(F.count_if(T.is_salient(F.col("text"))).alias("salient"), F.count(F.lit(1)).alias("n"))


def v08(spark, sf):
    return _entities(spark, sf).select("seq", F.array_join(F.transform(T.salient_pairs(F.col("entries")), lambda p: F.concat_ws("=", p["key"], p["value"])), ";").alias("pairs"))


def v09(spark, sf):
    tasks = T.with_values(T.feature_tasks(_features(spark, sf)), A.actions(spark, sf))
    return tasks.select("ord", "page", "name", "action", "value")


def v10(spark, sf):
    f = _features(spark, sf)
    tasks = T.all_tasks(T.feature_tasks(f), T.route_tasks(X.nav_edges(A.actions(spark, sf)), f), T.fixture_data_tasks(_bodies(spark, sf)),
                        T.entity_data_tasks(_entities(spark, sf)), T.listing_data_tasks(_listing(spark, sf)), T.coverage_tasks(_targets(spark, sf), _listing(spark, sf)))
    return tasks.select("task_id", "number", "grp", "ord", "title")


def v11(spark, sf):
    """Link texts of a page must show on the page itself, its page-after-next on none."""
    from ..operators.links import anchors
    pages = A.table(spark, sf, "pages")
    wanted = anchors(pages).select(F.col("page_id").alias("task_id"), U.rebase(F.col("url"), F.concat(F.lit("http://c"), "page_id", F.lit(".test"))).alias("url"), F.col("pos").alias("ord"),
                                   F.when(F.col("page_id") % 3 == 0, F.lower(F.substring("href", 2, 99))).otherwise(F.concat(F.substring("href", 2, 99), F.lit("s"))).alias("text"))
    texts = pages.select(U.rebase(F.col("url"), F.concat(F.lit("http://c"), "page_id", F.lit(".test"))).alias("url"), D.visible_text(F.col("html")).alias("text"))
    return T.data_fidelity(wanted, texts)


def v12(spark, sf):
    elements = D.dom_nodes(A.table(spark, sf, "pages"), with_text=False)
    wanted = A.table(spark, sf, "pages").select(F.col("page_id").alias("task_id"), "url", (F.col("page_id") % 3 + 6).alias("min_rows"))
    return T.row_gate(wanted, elements)


def v13(spark, sf):
    tasks = T.feature_tasks(_features(spark, sf)).select(F.col("ord").alias("task_id"), "page", "role", "name", "outcome", "api")
    log = A.actions(spark, sf).filter("outcome <> 'skipped' and id % 4 <> 1").select(
        "page", F.when(F.col("id") % 3 == 0, "button").when(F.col("id") % 3 == 1, "link").alias("role"), F.col("label").alias("name"), (-F.col("seq")).alias("seq"), "outcome",
        F.transform("network", lambda c: U.pathname(F.regexp_extract(c, r"^\S+ (.*)$", 1))).alias("paths"), (F.col("id") % 2 == 0).alias("changed"))
    return T.check_outcomes(tasks, log)


def _pairs(spark, sf):
    return A.table(spark, sf, "embeddings").select(F.col("vec_id").alias("golden"), (F.col("vec_id") + 1).alias("actual"))


def v15(spark, sf):
    return V.pixel_scores(A.pixels(spark, sf), _pairs(spark, sf)).select("golden", "actual", "total", "differing")


def _routes(spark, sf):
    """Routes with a pixel and a tree signal, some absent."""
    return A.table(spark, sf, "supplier").selectExpr(
        "'/r/' || CAST(s_suppkey AS STRING) AS route", "CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE (s_suppkey % 64) / 64.0D END AS pixel_score",
        "CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE (s_suppkey % 32) / 32.0D END AS tree_score", "CASE WHEN s_suppkey % 15 = 0 THEN 'failed' END AS note")


def _scored(spark, sf):
    return V.route_scores(_routes(spark, sf))


def v14(spark, sf):
    return _scored(spark, sf).select("route", F.round("score", 6).alias("score"))


def v17(spark, sf):
    results = A.actions(spark, sf).select((F.col("outcome") != "error").alias("pass"))
    return V.verdict(_scored(spark, sf), results, 0.2)


def v18(spark, sf):
    acts = A.actions(spark, sf).filter("outcome = 'modal'")
    feats = acts.select("id", F.concat(F.substring_index("label", " ", 1), F.lit("-"), F.substring("page", 2, 9)).alias("page"), F.concat(
        F.lit("https://site.example.com/click/"), F.substring("page", 2, 9)).alias("page_url"))
    return V.route_artifacts(A.captures(spark, sf), feats)


def v19(spark, sf):
    routes = A.calls(spark, sf).select(F.regexp_replace("pathname", "^(/[^/]*/[^/]*/?[0-9]?).*$", "$1").alias("route")).distinct()
    return V.attach_fixtures(A.calls(spark, sf).select(F.col("seq").alias("file"), F.col("pathname").alias("path")), routes)


def v20(spark, sf):
    files = A.captures(spark, sf).filter("screenshot is not null").select(F.concat(F.regexp_replace("screenshot", r"[0-9]+\.png$", ""), (F.col("seq") % 50).cast("string"), F.when(
        F.col("seq") % 3 == 0, "@tablet").when(F.col("seq") % 3 == 1, "@desktop-dark").otherwise(""), F.lit(".png")).alias("file"))
    return V.screenshot_variants(files)


QUERIES = {
    "v01_feature_tasks": v01, "v02_route_tasks": v02, "v03_fixture_data_tasks": v03, "v04_entity_data_tasks": v04,
    "v05_listing_data_tasks": lambda spark, sf: flat(T.listing_data_tasks(_listing(spark, sf))).select("ord", "title", "page", "name", "detail", "data"),
    "v06_coverage_tasks": v06, "v07_salient_values": v07, "v08_salient_pairs": v08, "v09_task_values": v09, "v10_all_tasks": v10, "v11_data_fidelity": v11,
    "v12_row_gate": v12, "v13_outcome_check": v13, "v14_route_scores": v14, "v15_pixel_scores": v15,
    "v16_worst_routes": lambda spark, sf: V.worst_routes(_scored(spark, sf)).select("route", F.round("score", 6).alias("score")),
    "v17_verdict": v17, "v18_route_artifacts": v18, "v19_fixture_routes": v19, "v20_screenshot_variants": v20,
}

_FEAT = (ACT + ", g AS (SELECT *, list_filter(string_split(path_text, '|'), lambda s: s <> '') AS steps, regexp_extract_all(network_text, '[A-Z]+ \\S+') AS net FROM actions WHERE outcome IN ('modal', 'dom-change', 'download')), f AS (SELECT page, label, "
         "kind, outcome, min(seq) AS seq, arg_min(struct_pack(steps := steps, page_url := page_url, action := action, download_file := download_file), [len(steps), seq]) AS f, arg_min(net, seq) AS net FROM g GROUP BY 1, 2, 3, 4), h AS (SELECT *, "
         "list_transform(net, lambda c: regexp_extract(c, '^(\\S+)', 1) || ' ' || regexp_extract(c, '//[^/]+(/.*)$', 1)) AS a2 FROM f), tk AS (SELECT seq AS ord, outcome || ': \"' || label || '\" on ' || page AS title, page, f.page_url AS page_url, CASE kind WHEN "
         "'searchbox' THEN 'textbox' WHEN 'pointer' THEN NULL ELSE kind END AS role, label AS name, f.action AS action, outcome, CASE WHEN a2[1] = a2[2] THEN [a2[1]] ELSE a2 END AS apis, f, label FROM h), ft AS (SELECT *, CASE outcome WHEN 'modal' THEN 'a dialog/modal "
         "opens' WHEN 'download' THEN 'downloads ' || f.download_file ELSE 'the view updates (fires ' || array_to_string(apis, ', ') || ')' END AS detail FROM tk)")
_EDGES = "e AS (SELECT page, label, to_url, min(seq) AS seq FROM actions WHERE outcome = 'navigation' GROUP BY 1, 2, 3)"
_V03 = (f"b AS (SELECT o_orderkey AS seq, o_custkey, o_orderkey, o_orderkey % 5 AS k FROM orders), d3 AS (SELECT seq, '/o/' || o_custkey AS page, 'https://api.example.com/o/' || o_custkey AS page_url, CASE k WHEN 0 THEN 'N' || o_orderkey WHEN 1 THEN 'T' || "
        "o_custkey ELSE 's' || o_orderkey END AS name, CASE k WHEN 0 THEN 'N' || o_orderkey || '@fixture:f' || o_orderkey || '.json#[1].name;Zed ' || o_custkey || '@fixture:f' || o_orderkey || '.json#[1].zeta' WHEN 1 THEN 'T' || o_custkey || '@fixture:f' || o_orderkey || "
        "'.json#title' ELSE 's' || o_orderkey || '@fixture:f' || o_orderkey || '.json#[1].slug' END AS data FROM b WHERE k IN (0, 1, 3))")
_V04 = ("d4 AS (SELECT c_custkey AS ord, 'data: model \"own/' || c_custkey || '\" renders on /e/' || c_custkey AS title, '/e/' || c_custkey AS page, c_name AS name, c_name || '@entity:model/own/' || c_custkey || '#name;a' || c_nationkey || '@entity:model/own/' || "
        "c_custkey || '#author;' || c_mktsegment || '@entity:model/own/' || c_custkey || '#segment' AS data FROM customer WHERE c_custkey % 4 <> 0)")
_V05 = ("lr AS (" + A.select_sql(A.LISTING_ROWS, "customer") + "), ls AS (SELECT seq // 10 AS ls, seq % 10 AS row_no, title FROM lr), l5 AS (SELECT ls, list(title ORDER BY row_no) AS vs FROM ls GROUP BY ls), d5 AS (SELECT ls AS ord, "
        "'data: listing rows render on /l/' || (ls // 3) AS title, '/l/' || (ls // 3) AS page, vs[1] AS name, len(vs) || ' captured listing rows render' AS detail, array_to_string(list_transform(vs, lambda v, i: v || '@listing:p' || ls || '#row' || (i - 1)), ';') AS data FROM l5)")
_V06 = ("cn AS (SELECT route, max(n) AS rows FROM (SELECT '/l/' || (seq // 30) AS route, seq // 10 AS ls, count(*) AS n FROM lr GROUP BY 1, 2) GROUP BY 1), tg AS (SELECT '/l/' || (seq // 7) AS route, min(seq) AS seq FROM lr GROUP BY 1), d6 AS (SELECT tg.seq AS ord, "
        "'coverage: ' || tg.route || ' renders' || coalesce(' >= ' || rows || ' row(s)', '') AS title, 'L' || tg.seq AS page, 'https://hub.example.com' || tg.route || '?q=1' AS page_url, coalesce('route renders with >= ' || rows || ' row(s) (captured listing count)', 'route renders "
        "without error') AS detail FROM tg LEFT JOIN cn ON cn.route = tg.route)")
_ROUTES = ("r AS (SELECT '/r/' || s_suppkey AS route, CASE WHEN s_suppkey % 5 <> 0 THEN (s_suppkey % 64) / 64.0 END AS px, CASE WHEN s_suppkey % 3 <> 0 THEN (s_suppkey % 32) / 32.0 END AS tr, CASE WHEN s_suppkey % 15 = 0 THEN 'failed' END AS note FROM supplier), sc AS (SELECT *, CASE WHEN "
           "px IS NOT NULL AND tr IS NOT NULL THEN (px * 2 + tr) / 3 ELSE coalesce(px, tr, 0.0) END AS score FROM r)")

ORACLES = {
    "v01_feature_tasks": f"WITH {_FEAT} SELECT ord, title, page, page_url, role, name, action, outcome, detail, array_to_string(apis, ';') AS api, array_to_string(list_transform(f.steps, lambda s: 'menuitem/' || s || '/click'), ';') AS pre FROM ft",
    "v02_route_tasks": f"WITH {_FEAT}, {_EDGES}, st AS (SELECT page, arg_min(page_url, ord) AS u FROM ft GROUP BY 1) SELECT e.seq AS ord, 'navigation: \"' || label || '\" on ' || e.page AS title, coalesce(u, {S.origin('to_url')}) AS page_url, 'navigates to ' || "
        "to_url AS detail FROM e LEFT JOIN st ON st.page = e.page",
    "v03_fixture_data_tasks": f"WITH {_V03} SELECT seq AS ord, 'data: real values render on ' || page AS title, page, page_url, name, 'real data from f' || seq || '.json renders (not a placeholder/mock)' AS detail, data FROM d3",
    "v04_entity_data_tasks": f"WITH {_V04} SELECT * FROM d4",
    "v05_listing_data_tasks": f"WITH {_V05} SELECT * FROM d5",
    "v06_coverage_tasks": f"WITH {_V05}, {_V06} SELECT * FROM d6",
    "v07_salient_values": f"WITH {S.view('s', A.SNIPPETS, 'events')}, t AS (SELECT text FROM s UNION ALL SELECT p_name FROM part UNION ALL SELECT text FROM conversations) SELECT length(text) AS chars, count(*) FILTER (length(text) BETWEEN 2 AND 80 AND NOT "
        "regexp_matches(text, '(?i)^https?://') AND NOT regexp_matches(text, '^\\d{4}-\\d{2}-\\d{2}T') AND lower(text) NOT IN ('true', 'false', 'null', 'undefined') AND regexp_matches(text, '[A-Za-z0-9]')) AS salient, count(*) AS n FROM t GROUP BY 1",
    "v08_salient_pairs": "SELECT c_custkey AS seq, 'name=' || c_name || ';author=a' || c_nationkey || ';segment=' || c_mktsegment AS pairs FROM customer",
    "v09_task_values": f"WITH {_FEAT}, vals AS (SELECT page, label AS name, arg_max(value, seq) AS v FROM actions WHERE action IN ('fill', 'select') AND value <> '' GROUP BY 1, 2) SELECT ord, ft.page, ft.name, action, CASE WHEN action IN ('fill', 'select') THEN v END AS value FROM ft LEFT JOIN vals ON "
        "vals.page = ft.page AND vals.name = ft.name",
    "v10_all_tasks": f"WITH {_FEAT}, {_EDGES}, {_V03}, {_V04}, {_V05}, {_V06}, u AS (SELECT 1 AS grp, ord, title FROM ft UNION ALL SELECT 2, seq, 'navigation: \"' || label || '\" on ' || page FROM e UNION ALL SELECT 3, seq, 'data: real values render on ' || page FROM d3 UNION ALL SELECT 4, ord, title FROM d4 UNION ALL "
        "SELECT 5, ord, title FROM d5 UNION ALL SELECT 6, ord, title FROM d6), n AS (SELECT *, row_number() OVER (ORDER BY grp, ord, title) AS number FROM u) SELECT 'QC-' || CASE WHEN number < 1000 THEN printf('%03d', number) ELSE CAST(number AS STRING) END AS task_id, number, grp, ord, title FROM n",
    "v11_data_fidelity": f"WITH {S.ANCHORS}, t AS (SELECT page_id, lower(" + M.collapse(M._ENT.format("regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<!--.*?-->', ' ', 'g'), '(?is)<script\\b[^>]*>.*?</script\\s*>', ' ', 'g'), '(?is)<style\\b[^>]*>.*?</style\\s*>', ' ', 'g'), "
        "'(?is)<title\\b[^>]*>.*?</title\\s*>', ' ', 'g'), '<[^>]*>', ' ', 'g')")) + ") AS txt FROM pages), w AS (SELECT page_id AS task_id, pos, CASE WHEN page_id % 3 = 0 THEN lower(substr(href, 2)) ELSE substr(href, 2) || 's' END AS x FROM anchors) SELECT task_id, bool_and(contains(txt, lower(trim(x)))) AS pass, arg_min(x, pos) "
        "FILTER (NOT contains(txt, lower(trim(x)))) AS missing FROM w JOIN t ON t.page_id = w.task_id GROUP BY task_id",
    "v12_row_gate": "WITH c AS (SELECT page_id, url, len(regexp_extract_all(html, '(?i)<(li|article|tr)[\\s>]')) AS n FROM pages), g AS (SELECT url, CAST(sum(n) AS BIGINT) AS rows FROM c GROUP BY url) SELECT page_id AS task_id, c.url, page_id % 3 + 6 AS min_rows, rows, rows >= page_id % 3 + 6 AS pass FROM c JOIN g ON g.url = c.url",
    "v13_outcome_check": f"WITH {_FEAT}, lg AS (SELECT page, CASE id % 3 WHEN 0 THEN 'button' WHEN 1 THEN 'link' END AS c_role, label AS name, -seq AS c_seq, outcome AS c_outcome, list_transform(regexp_extract_all(network_text, '[A-Z]+ \\S+'), lambda c: regexp_extract(c, '//[^/]+(/.*)$', 1)) AS paths, id % 2 = 0 AS changed FROM actions WHERE outcome <> 'skipped' AND "
        "id % 4 <> 1), j AS (SELECT ft.ord AS task_id, ft.outcome, ft.apis, lg.*, CASE WHEN ft.role = c_role THEN 0 WHEN c_role IS NULL THEN 1 WHEN c_role = 'button' THEN 2 ELSE 3 END AS tier FROM ft LEFT JOIN lg ON lg.page = ft.page AND lg.name = ft.name), b AS (SELECT * FROM j QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY tier, c_seq) = 1), x AS "
        "(SELECT *, list_has_any(list_transform(apis, lambda a: regexp_extract(a, '^\\S+ (.*)$', 1)), paths) AS hit FROM b), y AS (SELECT *, CASE WHEN c_seq IS NULL THEN false WHEN outcome = 'dom-change' THEN hit OR changed ELSE c_outcome = outcome END AS pass FROM x) SELECT task_id, pass, CASE WHEN c_seq IS NULL THEN 'control not found' WHEN pass AND outcome = 'dom-change' "
        "AND hit THEN 'expected API fired' WHEN pass AND outcome = 'dom-change' THEN 'view updated' WHEN pass THEN 'outcome matches' ELSE 'expected outcome missing' END AS reason FROM y",
    "v14_route_scores": f"WITH {_ROUTES} SELECT route, round(score, 6) AS score FROM sc",
    "v15_pixel_scores": "WITH p AS (SELECT vec_id AS img, unnest(generate_series(0, 63)) AS i, unnest(embedding) AS e FROM embeddings), g AS (SELECT img, i % 8 AS x, i // 8 AS y, CAST(least(greatest(floor((CAST(e AS DOUBLE) + 1) * 127.5), 0), 255) AS INT) AS g FROM p), k AS (SELECT * FROM g WHERE img % 2 = 0 OR y < 7) SELECT a.img AS golden, b.img AS actual, count(*) AS total, count(*) "
        "FILTER (0.5053 * (a.g - b.g) * (a.g - b.g) * 1.0 > 352.15) AS differing FROM k a JOIN k b ON b.img = a.img + 1 AND a.x = b.x AND a.y = b.y GROUP BY 1, 2",
    "v16_worst_routes": f"WITH {_ROUTES} SELECT route, round(score, 6) AS score FROM sc ORDER BY sc.score, route LIMIT 10",
    "v17_verdict": f"WITH {_ROUTES}, {ACT}, v AS (SELECT avg(px) AS visual, avg(tr) AS structural, count(*) FILTER (CASE WHEN px IS NOT NULL OR tr IS NOT NULL THEN score < 0.2 ELSE note IS NOT NULL END) AS failing_routes FROM sc), f AS (SELECT count(*) FILTER (outcome <> 'error') AS passed, count(*) AS total FROM actions), o AS (SELECT *, (visual * 2 + structural + passed / total) / 4 AS "
        "overall FROM v, f) SELECT floor(overall * 10000 + 0.5) / 10000.0 AS score, floor(visual * 10000 + 0.5) / 10000.0 AS visual, floor(structural * 10000 + 0.5) / 10000.0 AS structural, passed, total, failing_routes, overall >= 0.2 AND failing_routes = 0 AS pass FROM o",
    "v18_route_artifacts": f"WITH {ACT}, {S.view('captures', A.CAPTURES, 'events')}, ff AS (SELECT id, regexp_extract(label, '^\\S+') || '-' || substr(page, 2) AS label, '/click/' || substr(page, 2) AS route FROM actions WHERE outcome = 'modal'), s AS (SELECT seq, {S.path('url')} AS route, label, category, screenshot FROM captures WHERE ok AND screenshot IS NOT NULL), h AS (SELECT s.seq, ff.id FROM s JOIN ff ON ff.label = s.label UNION "
        "SELECT s.seq, ff.id FROM s JOIN ff ON ff.route = s.route), c AS (SELECT seq, count(*) AS n, min(id) AS m FROM h GROUP BY 1) SELECT s.seq, route, label, category, screenshot, replace(screenshot, '.png', '.html') AS dom, replace(screenshot, '.png', '.normalized.html') AS normalized_dom, replace(screenshot, '.png', '.aria.yaml') AS tree, coalesce(n, 0) AS behaviors, m AS first_behavior FROM s LEFT JOIN c ON c.seq = s.seq",
    "v19_fixture_routes": f"WITH {S.view('calls', A.CALLS, 'events')}, rt AS (SELECT DISTINCT regexp_replace(pathname, '^(/[^/]*/[^/]*/?[0-9]?).*$', '\\1') AS route FROM calls), p AS (SELECT DISTINCT pathname AS path FROM calls), b AS (SELECT path, arg_max(route, length(route)) AS route FROM p JOIN rt ON starts_with(path, route) AND route <> '/' GROUP BY 1) SELECT seq AS file, pathname AS path, route FROM calls LEFT JOIN b ON b.path = pathname",
    "v20_screenshot_variants": f"WITH {S.view('captures', A.CAPTURES, 'events')}, f AS (SELECT regexp_replace(screenshot, '[0-9]+\\.png$', '') || (seq % 50) AS base, CASE seq % 3 WHEN 0 THEN 'tablet' WHEN 1 THEN 'desktop-dark' END AS variant FROM captures WHERE screenshot IS NOT NULL) SELECT base, bool_or(variant IS NULL) AS has_base, coalesce(string_agg(DISTINCT variant, ',' ORDER BY variant), '') AS variants FROM f GROUP BY base",
}
