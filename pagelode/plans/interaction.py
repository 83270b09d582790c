"""Interaction-log queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import rules as R
from ..operators import actions as X
from ..sources import adapters as A
from . import sqltext as S
from .calls import _FIX, _flat_fixtures

_WORDS = ("CASE event_id % 9 WHEN 0 THEN 'Log out' WHEN 1 THEN 'Delete account' WHEN 2 THEN 'Delete row' WHEN 3 THEN 'Post it' WHEN 4 THEN 'Postal code' WHEN 5 THEN "
          "'Search now' WHEN 6 THEN 'Pay' WHEN 7 THEN 'Payload' ELSE 'Öffnen go' END")
_RISK = ["event_id AS seq", _WORDS + " AS label", "event_id % 7 = 0 AS external_link", "event_id % 2 = 0 AS aggressive"]
_STATES = ["event_id AS action_id", "phase", "'https://x.example.com/' || CASE WHEN phase = 'after' AND event_id % 5 = 0 THEN 'b' ELSE 'a' END AS url",
           "CASE WHEN phase = 'after' AND event_id % 7 = 0 THEN 2 ELSE 1 END AS downloads", "CASE WHEN phase = 'after' AND event_id % 3 = 0 THEN 1 ELSE CASE WHEN event_id % 6 = 0 THEN 1 ELSE 0 END END AS modals",
           "CASE WHEN phase = 'after' AND event_id % 4 = 0 THEN 's2' ELSE 's1' END AS signature", "phase = 'after' AND event_id % 11 = 0 AS feedback",
           "CASE WHEN phase = 'after' AND event_type = 'error' THEN 'boom' END AS error"]


def i01(spark, sf):
    rows = A.table(spark, sf, "events").selectExpr(*_RISK)
    return rows.select("seq", X.click_risk(F.col("label"), F.col("external_link"), F.col("aggressive")).alias("reason"))


def i02(spark, sf):
    rows = A.table(spark, sf, "events").selectExpr(*_RISK)
    return rows.select("seq", X.may_submit(F.col("label"), F.col("aggressive")).alias("allowed"))


def i03(spark, sf):
    rows = A.table(spark, sf, "events").withColumn("phase", F.explode(F.array(F.lit("before"), F.lit("after")))).selectExpr(*_STATES)
    return X.outcomes(rows)


def i08_features(spark, sf):
    return X.features(A.actions(spark, sf)).select("page", "label", "kind", "outcome", "seq", F.size("path").alias("steps"), "selector")


def _controls(spark, sf, even):
    rows = A.actions(spark, sf).filter(F.col("outcome") != "skipped").select(
        "page", F.concat("selector", F.when(F.lit(even) & (F.col("id") % 3 == 0), "x").otherwise("")).alias("selector"), "label",
        (F.col("kind") == "menuitem").alias("in_menu"), (F.col("id") % 5 == 0).alias("opens_menu"), "seq")
    return rows.filter(F.col("label").rlike("[02468]$" if even else "[13579]$"))


def i11(spark, sf):
    found = A.actions(spark, sf).filter("download_file is not null").select(
        "seq", F.concat(F.lit("https://site.example.com/d/"), F.col("id") % 30).alias("url"), F.when(F.col("id") % 4 == 0, F.lit("")).otherwise(
            F.col("download_file")).alias("suggested"), (F.col("bytes") * 100).alias("bytes"))
    return X.download_manifest(found).select("seq", "url", "file", "bytes")


def i12(spark, sf):
    return A.actions(spark, sf).select("seq", F.array_join(X.distinct_network(F.col("network")), " | ").alias("network"))


QUERIES = {
    "i01_click_risk": i01,
    "i02_may_submit": i02,
    "i03_outcomes": i03,
    "i06_page_totals": lambda spark, sf: X.page_totals(A.actions(spark, sf)),
    "i07_top_behaviors": lambda spark, sf: X.top_behaviors(A.actions(spark, sf)).drop("network"),
    "i08_nav_edges": lambda spark, sf: X.nav_edges(A.actions(spark, sf)),
    "i08_features": i08_features,
    "i08_feature_calls": lambda spark, sf: X.feature_calls(X.features(A.actions(spark, sf)), _flat_fixtures(spark, sf)),
    "i09_delta_controls": lambda spark, sf: X.delta_controls(_controls(spark, sf, True), _controls(spark, sf, False)),
    "i10_action_budget": lambda spark, sf: X.within_budget(A.actions(spark, sf), 3000, 15).select("seq", "page", "outcome"),
    "i11_download_manifest": i11,
    "i12_distinct_network": i12,
}

ACT = S.view("actions", A.ACTIONS, "events")
_CONTROLS = (ACT + ", c AS (SELECT page, selector, label, kind = 'menuitem' AS in_menu, id % 5 = 0 AS opens_menu, seq, id FROM actions WHERE outcome <> 'skipped'), child AS (SELECT page, selector || CASE WHEN id % 3 = "
             "0 THEN 'x' ELSE '' END AS selector, label, in_menu, opens_menu, seq FROM c WHERE regexp_matches(label, '[02468]$')), parent AS (SELECT * FROM c WHERE regexp_matches(label, '[13579]$'))")

ORACLES = {
    "i01_click_risk": f"WITH r AS ({A.select_sql(_RISK, 'events')}) SELECT seq, CASE WHEN external_link THEN 'external-link' WHEN regexp_matches(label, '{S.b(R.HARD_DENY)}') THEN 'hard-deny (logout/payment/account)' WHEN NOT "
        f"aggressive AND regexp_matches(label, '{S.b(R.DESTRUCTIVE)}') THEN 'destructive (safe mode)' END AS reason FROM r",
    "i02_may_submit": f"WITH r AS ({A.select_sql(_RISK, 'events')}) SELECT seq, CASE WHEN aggressive THEN NOT regexp_matches(label, '{S.b(R.HARD_DENY)}') ELSE regexp_matches(label, '{S.b(R.SEARCH_FORM)}') END AS allowed FROM r",
    "i03_outcomes": f"WITH s AS ({A.select_sql(_STATES, '(SELECT * FROM events, (VALUES (' + chr(39) + 'before' + chr(39) + '), (' + chr(39) + 'after' + chr(39) + ')) p(phase))')}) SELECT a.action_id, CASE WHEN a.error IS NOT NULL THEN 'error' WHEN "
        "a.downloads > b.downloads THEN 'download' WHEN a.url <> b.url THEN 'navigation' WHEN b.modals = 0 AND a.modals > 0 THEN 'modal' WHEN a.signature <> b.signature OR a.feedback THEN 'dom-change' ELSE 'noop' END AS outcome FROM s a JOIN s b ON "
        "a.action_id = b.action_id AND a.phase = 'after' AND b.phase = 'before'",
    "i06_page_totals": f"WITH {ACT} SELECT page, count(*) AS actions, count(*) FILTER (outcome NOT IN ('noop', 'skipped')) AS meaningful, count(*) FILTER (outcome = 'skipped') AS skipped, count(*) FILTER (outcome = 'noop') AS noop, count(*) FILTER "
        "(outcome = 'download') AS downloads, count(*) FILTER (outcome = 'navigation') AS navigations FROM actions GROUP BY ROLLUP (page)",
    "i07_top_behaviors": f"WITH {ACT}, r AS (SELECT *, CASE outcome WHEN 'download' THEN 0 WHEN 'navigation' THEN 1 WHEN 'modal' THEN 2 WHEN 'dom-change' THEN 3 END AS o FROM actions), d AS (SELECT page, outcome, label, to_url, download_file, min([o, seq]) AS p, "
        "arg_min(screenshot, seq) AS screenshot FROM r WHERE o IS NOT NULL GROUP BY 1, 2, 3, 4, 5) SELECT page, row_number() OVER (PARTITION BY page ORDER BY p) AS rank, outcome, label, to_url, download_file, screenshot FROM d"
        .replace("arg_min(screenshot, seq)", "arg_min_null(screenshot, seq)"),
    "i08_nav_edges": f"WITH {ACT} SELECT page, label, to_url, min(seq) AS seq FROM actions WHERE outcome = 'navigation' AND to_url IS NOT NULL GROUP BY 1, 2, 3",
    "i08_features": f"WITH {ACT}, f AS (SELECT *, len(list_filter(string_split(path_text, '|'), lambda s: s <> '')) AS steps FROM actions WHERE outcome IN ('modal', 'dom-change', 'download')) SELECT page, label, kind, outcome, min(seq) AS seq, min(steps) AS "
        "steps, arg_min(selector, [steps, seq]) AS selector FROM f GROUP BY 1, 2, 3, 4",
    "i08_feature_calls": _FIX + f", {ACT}, ft AS (SELECT page, label, kind, outcome, arg_min(network_text, seq) AS n FROM actions WHERE outcome IN ('modal', 'dom-change', 'download') GROUP BY 1, 2, 3, 4), cl AS (SELECT DISTINCT page, label, kind, outcome, "
        "regexp_extract(c, '^(\\S+)', 1) AS method, regexp_extract(c, 'https?://[^/]+(/\\S*)', 1) AS path FROM (SELECT *, unnest(regexp_extract_all(n, '[A-Z]+ \\S+')) AS c FROM ft)), tp AS (SELECT DISTINCT method, template, '^' || "
        "regexp_replace(template, '\\{[^}]+\\}', '[^/]+', 'g') || '$' AS re FROM fixtures), dp AS (SELECT DISTINCT method, path FROM cl), mt AS (SELECT dp.method, dp.path, arg_min(template, [regexp_replace(template, '[^{]', '', 'g'), template]) AS template "
        "FROM dp JOIN tp ON tp.method = dp.method AND regexp_matches(dp.path, tp.re) GROUP BY 1, 2) SELECT page, label, kind, outcome, cl.method, cl.path, mt.template FROM cl LEFT JOIN mt ON mt.method = cl.method AND mt.path = cl.path",
    "i09_delta_controls": f"WITH {_CONTROLS} SELECT page, selector, label, in_menu, opens_menu, seq, CASE WHEN in_menu THEN 0 WHEN opens_menu THEN 1 ELSE 2 END AS tier FROM child WHERE in_menu OR NOT EXISTS (SELECT 1 FROM parent p WHERE p.page = child.page AND "
        "p.selector = child.selector)",
    "i10_action_budget": f"WITH {ACT}, p AS (SELECT * FROM actions WHERE outcome <> 'skipped' QUALIFY row_number() OVER (PARTITION BY page ORDER BY seq) <= 15), k AS (SELECT * FROM p ORDER BY seq LIMIT 3000) SELECT seq, page, outcome FROM k UNION ALL SELECT seq, "
        "page, outcome FROM actions WHERE outcome = 'skipped'",
    "i11_download_manifest": f"WITH {ACT}, d AS (SELECT seq, 'https://site.example.com/d/' || (id % 30) AS url, CASE WHEN id % 4 = 0 THEN 'download' ELSE download_file END AS raw, bytes * 100 AS bytes FROM actions WHERE download_file IS NOT NULL), e AS (SELECT *, "
        "regexp_extract(raw, '(\\.[^.]*)$', 1) AS ext FROM d) SELECT seq, url, bytes, 'web/downloads/' || " + S.sanitize("regexp_replace(raw, '\\.[^.]*$', '')") + " || '-' || sha1(url || '|' || raw) || lower(ext) AS file FROM e",
    "i12_distinct_network": f"WITH {ACT}, n AS (SELECT seq, regexp_extract_all(network_text, '[A-Z]+ \\S+') AS l FROM actions) SELECT seq, CASE WHEN l[1] = l[2] THEN l[1] ELSE array_to_string(l, ' | ') END AS network FROM n",
}
