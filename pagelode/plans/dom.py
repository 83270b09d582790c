"""Element-table queries: markup, page quality, groups, controls, surfaces."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import rules as R
from ..operators import controls as C
from ..operators import dom as D
from ..sources import adapters as A
from . import domsql as M
from . import sqltext as S


def nodes(spark, sf, **options):
    return D.dom_nodes(A.all_pages(spark, sf), **options)


def stored(spark, sf, **options):
    """The element table, walked once, for plans that read it more than once."""
    return D.stored_nodes(A.all_pages(spark, sf), **options)


def e01(spark, sf):
    return nodes(spark, sf).select("page_id", "pos", "tag", "depth", "parent_pos", "end_pos", "landmark", "in_menu",
                                   F.md5("text").alias("text_digest"), F.size("attrs").alias("attr_count"))


def e02(spark, sf):
    text = D.visible_text(F.col("html"))
    return A.all_pages(spark, sf).select("page_id", F.length(text).alias("chars"), F.md5(text).alias("digest"))


def e04(spark, sf):
    rows = D.listing_rows(stored(spark, sf))
    return rows.select("page_id", "row_no", "href", F.array_join(F.transform(
        F.array_sort(F.map_entries("fields")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("fields"))


def e05(spark, sf):
    return D.main_content(stored(spark, sf)).select("page_id", "selector", "pos", "score", F.length("text").alias("chars"))


def e11_icons(spark, sf):
    manifests = A.table(spark, sf, "customer").select(
        F.concat(F.lit("https://shop.example.com/c/"), "c_custkey", F.lit("/m.webmanifest")).alias("url"),
        F.concat(F.lit('{"icons":[{"src":"/i/'), "c_custkey", F.lit('.png"},{"sizes":"1x1"},{"src":"rel.svg"}]}')).alias("json"))
    return C.manifest_icons(manifests)


def e21(spark, sf):
    return C.control_fields(C.controls(nodes(spark, sf))).drop("url")


def e23(spark, sf):
    after = C.item_counts(stored(spark, sf, with_text=False))
    shorter = A.all_pages(spark, sf).withColumn("html", F.regexp_replace("html", "(?s)<nav>.*?</nav>|<a .*?</a>", ""))
    return C.item_growth(C.item_counts(D.stored_nodes(shorter, with_text=False)), after)


QUERIES = {
    "e01_dom_nodes": e01,
    "e02_visible_text": e02,
    "e03_dominant_groups": lambda spark, sf: D.dominant_groups(stored(spark, sf, with_text=False)),
    "e04_listing_rows": e04,
    "e05_main_content": e05,
    "e11_head_assets": lambda spark, sf: C.head_assets(nodes(spark, sf, with_text=False)),
    "e11_manifest_icons": e11_icons,
    "e16_surfaces": lambda spark, sf: C.surfaces(stored(spark, sf, with_text=False)),
    "e17_custom_elements": lambda spark, sf: C.custom_elements(nodes(spark, sf, with_text=False)),
    "e18_representatives": lambda spark, sf: C.representatives(nodes(spark, sf, with_text=False)),
    "e21_controls": e21,
    "e21_option_labels": lambda spark, sf: C.option_labels(stored(spark, sf)),
    "e22_selectors": lambda spark, sf: C.control_selectors(nodes(spark, sf, with_text=False)),
    "e22_containers": lambda spark, sf: D.container_selectors(nodes(spark, sf, with_text=False)),
    "e23_item_growth": e23,
    "i04_state_signature": lambda spark, sf: C.state_signatures(nodes(spark, sf)),
    "i05_transient_state": lambda spark, sf: C.transient_states(nodes(spark, sf, with_text=False)),
    "q01_challenge_pages": lambda spark, sf: D.challenge_pages(A.all_pages(spark, sf), nodes(spark, sf, with_text=False)),
    "q02_auth_state": lambda spark, sf: D.auth_states(nodes(spark, sf, with_text=False)),
}

DOM = "WITH " + M.dom()
_SIG = (f"tag || '|' || coalesce({M.a('role')}, '') || '|' || array_to_string(list_sort({M.CLASSES}), '.')")
_GROUPS = (f", groups AS (SELECT page_id, parent_pos, {_SIG} AS signature, count(*) AS items, min(pos) AS first_pos FROM elp WHERE parent_pos IS NOT "
           "NULL GROUP BY 1, 2, 3 HAVING count(*) >= 4), best AS (SELECT g.page_id, g.parent_pos, g.signature, g.items FROM (SELECT *, row_number() "
           "OVER (PARTITION BY page_id ORDER BY items DESC, parent_pos, first_pos) AS rn FROM groups WHERE (page_id, parent_pos) IN (SELECT (page_id, "
           f"pos) FROM el WHERE tag IN ({S.quoted(R.LISTING_PARENT_TAGS)}) OR {M.ROLE} IN ('list', 'grid', 'feed'))) g WHERE rn = 1)")
_KIND = (f"CASE WHEN {M.ROLE} IN ('link', 'button', 'tab', 'menuitem') THEN {M.ROLE} WHEN tag = 'a' THEN 'link' WHEN tag IN ('button', 'select', "
         f"'textarea') THEN tag WHEN tag = 'input' AND {M.a('type')} = 'search' THEN 'searchbox' WHEN tag = 'input' THEN 'input' ELSE 'pointer' END")
_IS_CONTROL = (f"(tag IN ('button', 'select', 'textarea') OR (tag = 'a' AND {M.a('href')} IS NOT NULL) OR {M.ROLE} IN ('button', 'tab', 'menuitem', "
               f"'link') OR (tag = 'input' AND coalesce({M.a('type')}, '') <> 'hidden'))")
def _abs(ref: str) -> str:
    return f"CASE WHEN {ref} <> '' THEN {S.resolve('url', ref)} END"


_HAS = lambda c: f"list_contains({M.CLASSES}, '{c}')"
_LOWCLASS = f"lower({M.CLASS})"

_CONTENT_TIER = (
    f"CASE WHEN {M.a('id')} = 'readme' THEN 0 WHEN {M.a('data-target')} = 'readme' THEN 1 WHEN {_HAS('markdown-body')} THEN 2 WHEN {_HAS('markdown')} "
    f"THEN 3 WHEN {_HAS('prose')} AND list_contains(anc_tags, 'article') THEN 4 WHEN contains({_LOWCLASS}, 'prose') THEN 5 WHEN contains({_LOWCLASS}, "
    f"'markdown') THEN 6 WHEN tag = 'article' THEN 7 WHEN {_HAS('model-card')} THEN 9 WHEN {_HAS('dataset-card')} THEN 10 END")

ORACLES = {
    "e01_dom_nodes": DOM + " SELECT page_id, pos, tag, depth, parent_pos, end_pos, landmark, in_menu, md5(text) AS text_digest, "
        "len(regexp_extract_all(regexp_replace(raw, '^<[A-Za-z0-9-]+', ''), '([^\\s\"''<>/=]+)(?:\\s*=\\s*(?:\"[^\"]*\"|[^\\s\"''=<>`]+))?')) AS "
        "attr_count FROM elp",
    "e02_visible_text": f"WITH pg AS ({A.ALL_PAGES_SQL}), c AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, "
        "'(?is)<!--.*?-->', ' ', 'g'), '(?is)<script\\b[^>]*>.*?</script\\s*>', ' ', 'g'), '(?is)<style\\b[^>]*>.*?</style\\s*>', ' ', 'g'), "
        "'(?is)<title\\b[^>]*>.*?</title\\s*>', ' ', 'g') AS h FROM pg), t AS (SELECT page_id, " + M.collapse(M._ENT.format(
            "regexp_replace(h, '<[^>]*>', ' ', 'g')")) + " AS t FROM c) SELECT page_id, length(t) AS chars, md5(t) AS digest FROM t",
    "e03_dominant_groups": DOM + _GROUPS + " SELECT * FROM best",
    "e04_listing_rows": DOM + _GROUPS + f", items AS (SELECT e.page_id, e.url, e.pos, e.end_pos, e.raw, e.text, row_number() OVER (PARTITION BY e.page_id "
        f"ORDER BY e.pos) AS row_no FROM (SELECT *, {_SIG} AS sig FROM elp) e JOIN best b ON b.page_id = e.page_id AND b.parent_pos = e.parent_pos AND "
        f"b.signature = e.sig), m AS (SELECT i.page_id, i.url, i.row_no, i.raw AS item_raw, i.text AS item_text, arg_min({M.a('href').replace('raw', 'd.raw')}, d.pos) "
        "FILTER (d.tag = 'a') AS h, arg_min(d.text, d.pos) FILTER (d.tag = 'a') AS lt, arg_min(d.text, d.pos) FILTER (d.tag IN ('h1', 'h2', 'h3', "
        f"'h4', 'h5', 'h6')) AS title, arg_min({M.a('datetime').replace('raw', 'd.raw')}, d.pos) FILTER (d.tag = 'time') AS date, arg_min(d.text, d.pos) FILTER (contains("
        "d.raw, 'author')) AS author FROM items i JOIN el d ON d.page_id = i.page_id AND d.pos >= i.pos AND d.pos < i.end_pos "
        f"GROUP BY ALL), f AS (SELECT page_id, row_no, {_abs('h')} AS href, item_text, list_filter(list_sort([CASE WHEN title <> '' THEN 'title=' || title END, CASE WHEN lt <> '' AND "
        f"lt IS DISTINCT FROM title THEN 'link=' || lt END, CASE WHEN date <> '' THEN 'date=' || date END, CASE WHEN author <> '' THEN 'author=' || author END, CASE "
        f"WHEN {M.a('data-id').replace('raw', 'item_raw')} <> '' THEN 'id=' || {M.a('data-id').replace('raw', 'item_raw')} END]), lambda x: x IS NOT NULL) AS fs FROM m), k AS (SELECT *, CASE WHEN len(fs) = 0 AND item_text "
        "<> '' THEN 'text=' || item_text ELSE array_to_string(fs, ';') END AS fields FROM f) SELECT page_id, row_no, " + S.origin("href") + " || " + S.path("href") + " || " + S.search("href") + " AS href, fields FROM k WHERE "
        "(fields <> '' OR href IS NOT NULL) AND page_id IN (SELECT page_id FROM k WHERE fields <> '' OR href IS NOT NULL GROUP BY page_id HAVING count(*) >= 4)",
    "e05_main_content": DOM + f", r AS (SELECT page_id, pos, end_pos, text, {_CONTENT_TIER} AS tier FROM el WHERE length(text) >= 120), s AS (SELECT r.page_id, "
        "r.pos, r.tier, r.text, r.end_pos, length(any_value(r.text)) + 200 * count(x.pos) AS score FROM r LEFT JOIN (SELECT page_id, pos FROM el WHERE tag IN "
        f"({S.quoted(R.CONTENT_STRUCTURE_TAGS)})) x ON x.page_id = r.page_id AND x.pos > r.pos AND x.pos < r.end_pos WHERE r.tier IS NOT NULL GROUP BY r.page_id, r.pos, r.tier, r.text, r.end_pos), n AS "
        "(SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY tier, score DESC, pos) AS rn FROM s) SELECT page_id, "
        f"([{S.quoted(R.CONTENT_SELECTORS)}])[tier + 1] AS selector, pos, score, length(text) AS chars FROM n WHERE rn = 1",
    "e11_head_assets": DOM + f", k AS (SELECT page_id, url, pos, CASE WHEN tag = 'link' AND contains({M.a('rel')}, 'icon') THEN 'icon' WHEN tag = 'meta' AND "
        f"{M.a('property')} = 'og:image' THEN 'image' WHEN tag = 'link' AND {M.a('rel')} = 'manifest' THEN 'manifest' END AS kind, CASE WHEN tag = 'meta' THEN "
        f"{M.a('content')} ELSE {M.a('href')} END AS ref FROM el) SELECT page_id, pos, kind, {_abs('ref')} AS asset_url, contains(ref, '.webmanifest') AS "
        "is_manifest FROM k WHERE kind IS NOT NULL AND ref <> ''",
    "e11_manifest_icons": "SELECT 'https://shop.example.com/c/' || c_custkey || '/m.webmanifest' AS url, x.pos, CASE x.pos WHEN 0 THEN "
        "'https://shop.example.com/i/' || c_custkey || '.png' ELSE 'https://shop.example.com/c/' || c_custkey || '/rel.svg' END AS icon_url FROM customer, "
        "(VALUES (0), (2)) AS x(pos)",
    "e16_surfaces": DOM + ", s AS (SELECT e.page_id, e.url, e.pos, e.tag, e.raw, (SELECT arg_min(" + M.a("src") + ", pos) FROM el x WHERE x.page_id = e.page_id AND "
        "x.pos > e.pos AND x.pos < e.end_pos AND x.tag = 'source') AS inner_src, EXISTS (SELECT 1 FROM el x WHERE x.page_id = e.page_id AND x.pos > e.pos AND "
        "x.pos < e.end_pos AND x.tag = 'animate') AS moves, EXISTS (SELECT 1 FROM el x WHERE x.page_id = e.page_id AND x.tag = 'script' AND contains(x.raw, "
        "'chart.js')) AS lib FROM el e WHERE e.tag IN ('canvas', 'video', 'audio', 'svg', 'iframe')), r AS (SELECT page_id, url, pos, CASE tag WHEN 'canvas' "
        f"THEN 0 WHEN 'svg' THEN 2 WHEN 'iframe' THEN 3 ELSE 1 END AS g, CASE tag WHEN 'svg' THEN 'svg-animated' ELSE tag END AS kind, CASE WHEN tag IN ('video', "
        f"'audio', 'iframe') THEN coalesce(nullif({M.a('src')}, ''), inner_src) END AS ref, CASE WHEN tag = 'video' THEN {M.a('poster')} END AS pref, CASE WHEN tag "
        f"= 'canvas' AND lib THEN 'chart.js' END AS chart_lib FROM s WHERE tag <> 'svg' OR moves), o AS (SELECT *, {_abs('ref')} AS src FROM r) SELECT page_id, "
        "row_number() OVER (PARTITION BY page_id ORDER BY g, pos) AS surface_no, kind, src, " + _abs("pref") + f" AS poster, chart_lib, CASE WHEN src IS NOT NULL THEN "
        f"{S.origin('src')} <> {S.origin('url')} WHEN kind = 'iframe' THEN false END AS cross_origin FROM o",
    "e17_custom_elements": DOM + ", d AS (SELECT page_id, tag, min(pos) AS pos FROM el WHERE contains(tag, '-') GROUP BY 1, 2) SELECT page_id, row_number() OVER "
        "(PARTITION BY page_id ORDER BY pos) AS tag_no, tag FROM d",
    "e18_representatives": DOM + f", g AS (SELECT page_id, pos, raw, tag, unnest(list_filter([CASE WHEN tag = 'button' THEN '0button' END, CASE WHEN tag = 'a' AND "
        f"{M.a('href')} IS NOT NULL THEN '1link' END, CASE WHEN {M.ROLE} = 'button' THEN '2button' END, CASE WHEN {M.ROLE} = 'tab' THEN '3tab' END, CASE WHEN "
        f"{M.ROLE} = 'menuitem' THEN '4menuitem' END, CASE WHEN tag = 'input' AND coalesce({M.a('type')}, 'text') <> 'hidden' THEN '5input:' || coalesce("
        f"{M.a('type')}, 'text') END, CASE WHEN tag = 'select' THEN '6select' END, CASE WHEN tag = 'textarea' THEN '7textarea' END], lambda x: x IS NOT NULL)) AS gr "
        f"FROM el), c AS (SELECT page_id, pos, CAST(left(gr, 1) AS INT) AS gn, substr(gr, 2) AS role, substr(gr, 2) || '|' || tag || '|' || CASE tag WHEN 'input' THEN "
        f"coalesce({M.a('type')}, 'text') WHEN 'button' THEN coalesce({M.a('type')}, 'submit') WHEN 'select' THEN 'select-one' WHEN 'textarea' THEN 'textarea' ELSE '' END || '|' || "
        f"array_to_string(list_sort({M.CLASSES}), '.') AS sig, {M.a('disabled')} IS NOT NULL AS disabled FROM g), n AS (SELECT *, row_number() OVER (PARTITION BY page_id, sig, disabled ORDER "
        "BY gn, pos) AS rn FROM c), f AS (SELECT page_id, sig, role, gn, pos, disabled, CASE WHEN disabled AND rn = 1 THEN 'off' ELSE 'on' END AS slot FROM n), u AS (SELECT *, "
        "row_number() OVER (PARTITION BY page_id, sig, slot ORDER BY gn, pos) AS k FROM f), v AS (SELECT page_id, sig, role, gn, pos, disabled FROM u WHERE k = 1) SELECT page_id, row_number() "
        "OVER (PARTITION BY page_id ORDER BY role, gn, pos) AS rank, role, sig, pos, disabled FROM v",
    "e21_controls": DOM + f", c0 AS (SELECT *, left(coalesce(nullif({M.collapse(M.a('aria-label'))}, ''), nullif(text, ''), nullif({M.collapse(M.a('title'))}, ''), nullif("
        f"{M.collapse(M.a('alt'))}, ''), nullif({M.collapse(M.a('placeholder'))}, ''), nullif({M.collapse(M.a('value'))}, ''), ''), 80) AS name, {_KIND} AS kind, tag = 'a' AND {M.a('href')} IS NOT "
        f"NULL AS is_link, tag IN ('select', 'textarea') OR (tag = 'input' AND coalesce({M.a('type')}, 'text') <> 'checkbox') OR (tag = 'input' AND {_KIND} = 'input') AS is_field FROM elp WHERE {_IS_CONTROL} AND {M.a('disabled')} IS NULL), c1 AS "
        f"(SELECT *, CASE WHEN name <> '' THEN name WHEN is_field THEN coalesce(nullif({M.a('name')}, ''), {M.a('placeholder')}, '') ELSE '' END AS label, coalesce(landmark, 'other') AS region "
        f"FROM c0 WHERE name <> '' OR is_link OR (is_field AND coalesce(nullif({M.a('name')}, ''), {M.a('placeholder')}, '') <> '')), c2 AS (SELECT *, row_number() OVER (PARTITION BY page_id, region, kind, "
        "trim(regexp_replace(regexp_replace(lower(label), '[0-9]', '#', 'g'), '\\s+', ' ', 'g')), tag, anc_tags[-1], anc_tags[-2] ORDER BY pos) AS dup FROM c1) SELECT page_id, pos, label, kind, region, "
        f"coalesce({M.a('aria-haspopup')}, '') = 'menu' OR {M.a('aria-expanded')} IS NOT NULL AS opens_menu, in_menu, CASE WHEN is_field THEN CASE tag WHEN 'input' THEN coalesce({M.a('type')}, "
        f"'text') WHEN 'textarea' THEN 'textarea' END END AS input_type, CASE WHEN is_field THEN {M.a('required')} IS NOT NULL END AS required, CAST(NULL AS VARCHAR) AS pattern, CASE WHEN is_field THEN "
        f"{M.a('placeholder')} END AS placeholder, CASE WHEN is_link AND {S.host(S.resolve('url', M.a('href')))} = {S.host('url')} THEN {S.origin('url')} || CASE WHEN starts_with({M.a('href')}, '#') THEN {S.path('url')} || {M.a('href')} "
        f"ELSE {S.path(S.resolve('url', M.a('href')))} || {S.search(S.resolve('url', M.a('href')))} END END AS same_site_href FROM c2 WHERE dup = 1",
    "e21_option_labels": DOM + ", o AS (SELECT x.page_id, w.pos AS owner_pos, x.pos, x.text FROM el x JOIN el w ON w.page_id = x.page_id AND x.pos > w.pos AND x.pos < w.end_pos AND w.tag = 'select' WHERE x.tag = "
        "'option' AND x.text <> '') SELECT page_id, owner_pos, row_number() OVER (PARTITION BY page_id, owner_pos ORDER BY pos) AS option_no, text AS label FROM o QUALIFY option_no <= 30",
    "e22_selectors": DOM + f", n AS (SELECT page_id, pos, i, tag, anc_i, row_number() OVER (PARTITION BY page_id, parent_pos, tag ORDER BY pos) AS nth, {M.a('id')} AS ident, {_IS_CONTROL} AS wanted, [{M.a('data-testid')}, "
        f"{M.a('data-test')}, {M.a('data-cy')}] AS t FROM elp), nm AS (SELECT page_id, pos, 0 AS rank, '#' || ident AS css FROM n WHERE regexp_matches(ident, '^[A-Za-z][A-Za-z0-9_-]*$') UNION ALL SELECT page_id, pos, k, '[' || "
        "(['data-testid', 'data-test', 'data-cy'])[k] || '=\"' || replace(replace(t[k], chr(92), chr(92) || chr(92)), '\"', chr(92) || '\"') || '\"]' FROM n, (VALUES (1), (2), (3)) x(k) WHERE t[k] <> ''), ow AS (SELECT page_id, pos, "
        "arg_min(css, rank) AS named, min(css) FILTER (rank = 0) AS anchor FROM (SELECT *, count(*) OVER (PARTITION BY page_id, css) AS c FROM nm) WHERE c = 1 GROUP BY 1, 2), st AS (SELECT n.*, tag || ':nth-of-type(' || nth || "
        "')' AS step, named, anchor FROM n LEFT JOIN ow USING (page_id, pos) WHERE tag <> 'html'), sp AS (SELECT page_id, pos, a.k AS k, a.i AS i FROM (SELECT page_id, pos, unnest(list_transform(list_append(anc_i, i), lambda x, j: "
        "{'k': len(anc_i) + 1 - j, 'i': x})) AS a FROM st)), up AS (SELECT sp.page_id, sp.pos, list({'s': x.step, 'a': x.anchor, 'b': x.tag = 'body'} ORDER BY sp.k) AS u FROM sp JOIN st x ON x.page_id = sp.page_id AND x.i = sp.i GROUP "
        "BY 1, 2), hd AS (SELECT page_id, pos, l, array_to_string(list_transform(u[1:l], lambda x: x.s), '>') AS h FROM (SELECT *, unnest(range(1, len(u) + 1)) AS l FROM up)), sh AS (SELECT page_id, pos, min(l) AS shortest FROM (SELECT *, "
        "count(*) OVER (PARTITION BY page_id, h) AS c FROM hd) WHERE c = 1 GROUP BY 1, 2), fn AS (SELECT st.page_id, st.pos, st.tag, named, u, list_filter(range(2, len(u) + 1), lambda l: u[l].a IS NOT NULL)[1] AS anchored, least(shortest, "
        "list_filter(range(2, len(u) + 1), lambda l: u[l].a IS NOT NULL)[1], coalesce(list_filter(range(1, len(u) + 1), lambda l: u[l].b)[1], len(u))) AS ends FROM st JOIN up USING (page_id, pos) LEFT JOIN sh USING (page_id, pos) WHERE "
        "wanted) SELECT page_id, pos, tag, coalesce(named, array_to_string(list_reverse(list_transform(u[1:ends], lambda x, l: CASE WHEN l = anchored THEN x.a ELSE x.s END)), '>')) AS selector FROM fn",
    "e22_containers": DOM + _GROUPS + f", mt AS (SELECT page_id, unnest(list_concat(list_filter([CASE WHEN regexp_matches({M.a('id')}, '^[A-Za-z][A-Za-z0-9_-]*$') THEN '#' || {M.a('id')} END, CASE WHEN {M.a('role')} <> '' THEN tag || '[role=\"' || "
        f"{M.a('role')} || '\"]' END], lambda x: x IS NOT NULL), list_transform(list_distinct({M.CLASSES}), lambda c: tag || '.' || c))) AS css FROM el), ct AS (SELECT page_id, css, count(*) AS n FROM mt GROUP BY 1, 2), pa AS (SELECT e.page_id, e.pos, "
        f"e.tag, unnest([{{'r': 0, 'm': 1, 'css': '#' || {M.a('id')}}}, {{'r': 1, 'm': 1, 'css': tag || '[role=\"' || {M.a('role')} || '\"]'}}, {{'r': 2, 'm': 3, 'css': tag || '.' || {M.CLASSES}[1]}}]) AS c FROM el e JOIN best b ON b.page_id = "
        "e.page_id AND b.parent_pos = e.pos) SELECT pa.page_id, pa.pos, coalesce(arg_min(ct.css, pa.c.r) FILTER (ct.n <= pa.c.m), any_value(pa.tag)) AS selector FROM pa LEFT JOIN ct ON ct.page_id = pa.page_id AND ct.css = pa.c.css GROUP BY 1, 2",
    "e23_item_growth": f"WITH pg AS ({A.ALL_PAGES_SQL}), c AS (SELECT page_id, html, regexp_replace(html, '(?s)<nav>.*?</nav>|<a .*?</a>', '', 'g') AS cut FROM pg), v AS (SELECT page_id, [html, cut] AS hs FROM c), "
        f"t AS (SELECT page_id, generate_subscripts(hs, 1) AS side, regexp_extract_all({M._CLEAN.replace('html', 'unnest(hs)')}, '<[A-Za-z][^>]*>') AS tags FROM v), r AS (SELECT page_id, side, unnest(tags) AS raw FROM t), g AS (SELECT "
        f"page_id, side, lower(regexp_extract(raw, '^<([A-Za-z0-9-]+)', 1)) AS tag, raw FROM r), n AS (SELECT page_id, side, max(c) AS n FROM (SELECT page_id, side, tag || coalesce({M.CLASSES}[1], '') AS k, count(*) AS c FROM g WHERE tag IN "
        f"('li', 'article') OR contains({_LOWCLASS}, 'card') OR contains({_LOWCLASS}, 'item') GROUP BY 1, 2, 3) GROUP BY 1, 2), l AS (SELECT page_id, side, count(*) FILTER (tag = 'a' AND contains(raw, 'href')) AS links FROM g GROUP BY 1, "
        "2), i AS (SELECT l.page_id, l.side, greatest(links, coalesce(n, 0)) AS items FROM l LEFT JOIN n USING (page_id, side)) SELECT a.page_id, b.items AS before, a.items AS after, a.items > b.items + 2 AS grew FROM i a JOIN i b ON "
        "a.page_id = b.page_id AND a.side = 1 AND b.side = 2",
    "i04_state_signature": DOM + f" SELECT page_id, any_value({S.path('url')}) || '|' || count(*) || '|' || count(*) FILTER ({M.ROLE} = 'dialog' OR {_HAS('modal')}) || '|' || CAST(floor(coalesce(max(length(text)) FILTER (tag = 'body'), 0) / "
        f"200.0 + 0.5) AS BIGINT) || '|' || count(*) FILTER ({M.ROLE} IN ('menuitem', 'option', 'menu', 'listbox')) || '|' || count(*) FILTER ({M.a('aria-expanded')} = 'true') || '|' || count(*) AS signature FROM el GROUP "
        "BY page_id",
    "i05_transient_state": DOM + f" SELECT page_id, CASE WHEN bool_or(contains({_LOWCLASS}, 'skeleton') OR contains({_LOWCLASS}, 'loading')) THEN 'loading' WHEN bool_or({M.ROLE} = 'alert' OR contains({_LOWCLASS}, 'error')) THEN 'error' WHEN "
        f"bool_or(contains({_LOWCLASS}, 'empty')) THEN 'empty' WHEN bool_or({M.ROLE} = 'status' OR contains({_LOWCLASS}, 'toast')) THEN 'success' END AS state FROM el GROUP BY page_id",
    "q01_challenge_pages": DOM + ", c AS (SELECT page_id, url, regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<!--.*?-->', ' ', 'g'), '(?is)<script\\b[^>]*>.*?</script\\s*>', ' ', 'g'), '(?is)<style\\b[^>]*>.*?"
        "</style\\s*>', ' ', 'g'), '(?is)<title\\b[^>]*>.*?</title\\s*>', ' ', 'g') AS h FROM pg), t AS (SELECT page_id, url, left(" + M.collapse(M._ENT.format("regexp_replace(h, '<[^>]*>', ' ', 'g')")) + ", 4000) AS t FROM c), n AS (SELECT "
        f"page_id, count(*) AS elements, bool_or(tag = 'iframe' AND contains(raw, 'challenges.cloudflare.com')) AS cf FROM el GROUP BY page_id) SELECT t.page_id, url, CASE WHEN cf OR regexp_matches(t, '{S.b(R.CHALLENGE_TEXT['cloudflare'])}') "
        f"THEN 'cloudflare' WHEN regexp_matches(t, '{S.b(R.CHALLENGE_TEXT['captcha'])}') THEN 'captcha' WHEN regexp_matches(t, '{S.b(R.CHALLENGE_TEXT['compat'])}') THEN 'compat' WHEN regexp_matches(t, '{S.b(R.CHALLENGE_TEXT['access'])}') OR "
        f"regexp_matches(t, '{S.b(R.CHALLENGE_TEXT['shell'])}') THEN 'access' WHEN elements < 60 AND length(regexp_replace(t, '\\s', '', 'g')) < 200 THEN 'thin' END AS kind, elements FROM t JOIN n USING (page_id)",
    "q02_auth_state": DOM + f" SELECT page_id, url, CASE WHEN regexp_matches(url, '/login(\\b|/|$)') THEN 'anonymous' WHEN bool_or(contains(coalesce({M.a('href')}, ''), 'logout') OR (tag IN ('button', 'a') AND contains(lower(coalesce("
        f"{M.a('aria-label')}, '')), 'account'))) THEN 'authed' WHEN bool_or(tag = 'input' AND {M.a('type')} = 'password') THEN 'anonymous' ELSE 'unknown' END AS auth_state FROM el GROUP BY page_id, url",
}
