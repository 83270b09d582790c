"""Queries over several captures of a site: the digest ledger, drift, and what is masked before comparing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import rules as R
from ..functions import redact as Y
from ..functions import urls as U
from ..operators import calls as C
from ..operators import dom as D
from ..operators import drift as V
from ..operators import json_tables as J
from ..operators import ledger as L
from ..operators import styles as T
from ..operators import trees as Z
from ..session import staging_path
from ..sources import adapters as A
from . import calls as Q
from . import domsql as M
from . import redaction as X
from . import sqltext as S
from . import styles as P

RUNS = (0, 1, 2)


def ledger_changes(spark, sf) -> DataFrame:
    """The ledger over three captures, each compared with what was known before it."""
    folder = staging_path(spark, "ledger")
    return reduce(DataFrame.unionByName, [L.advance(spark, folder, L.snapshot(A.captured(spark, sf, run))) for run in RUNS])


def capture_pairs(spark, sf) -> list[V.Pair]:
    """Routes, page trees, style tokens and endpoints of two captures."""
    def routes(run):
        return A.captured(spark, sf, run).select(U.normalize_url(F.col("url")).alias("route"), F.regexp_extract(
            "html", "(?is)<title>(.*?)</title>", 1).alias("title"), F.sha2(Y.stabilize_html(F.col("html")), 256).alias("digest"))

    def trees(run):
        # A page's route is found before it is walked, so pages are walked once and elements are not joined.
        pages = A.captured(spark, sf, run).withColumn("url", U.normalize_url(F.col("url")))
        return Z.nodes_from_dom(D.dom_nodes(pages), "url").select(F.col("url").alias("route"), "role", Y.stabilize_text(F.col("name")).alias("name"))

    def tokens(left_out):
        values = T.token_values(A.style_rows(spark, sf).filter(F.col("page_id") % 10 != left_out))
        return values.groupBy("category", "value").agg(F.count("*").alias("uses"))

    def endpoints(left_out):
        return Q.api(spark, sf).filter(F.col("seq") % 10 != left_out).groupBy("host", "method", "pathname").agg(
            F.count("*").alias("samples"), F.array_join(F.array_sort(F.collect_set("status")), ", ").alias("statuses"))

    return [V.Pair("routes", routes(0), routes(2), ["route"], ["title", "digest"]),
            V.Pair("trees", trees(0), trees(2), ["route"], ["role", "name"]),
            V.Pair("tokens", tokens(3), tokens(4), ["category", "value"], ["uses"]),
            V.Pair("endpoints", endpoints(3), endpoints(4), ["host", "method", "pathname"], ["samples", "statuses"])]


def f06_pages(spark, sf):
    html = Y.stabilize_html(F.col("html"))
    return A.captured(spark, sf, 1).select("page_id", F.md5(html).alias("digest"), (html != Y.normalize_html(F.col("html"))).alias("masked"))


QUERIES = {
    "f01_ledger_changes": ledger_changes,
    "f02_drift_cells": lambda spark, sf: V.drift(capture_pairs(spark, sf)),
    "f02_drift_summary": lambda spark, sf: V.drift_summary(V.drift(capture_pairs(spark, sf))),
    "f06_stable_pages": f06_pages,
    "f06_stable_leaves": lambda spark, sf: J.stable_counts(A.counted_docs(spark, sf), ["seq"]),
    "f01_ledger_rollup": lambda spark, sf: L.rollup(ledger_changes(spark, sf)),
}


def _normal(e: str, rules) -> str:
    for pattern, mark in rules:
        e = f"regexp_replace({e}, '{pattern}', '{mark}', 'g')"
    return e


_TEXT = M.collapse(M._ENT.format(
    "regexp_replace(" + _normal("html", [(f"(?is)<{t}\\b[^>]*>.*?</{t}\\s*>", " ") for t in ("script", "style", "noscript", "template",
                                                                                        "title")]) + ", '<[^>]*>', ' ', 'g')"))
_TEXT = _TEXT.replace("regexp_replace(html, ", "regexp_replace(regexp_replace(html, '(?is)<!--.*?-->', ' ', 'g'), ", 1)


def _taken(run: int) -> str:
    """CTE ``s<run>``: route, artifact, digest, bytes."""
    return (f"p{run} AS (SELECT {S.normal('url')} AS route, page_id, {_normal('html', X._BLANK + X._NORMAL)} AS dom, "
            f"{_normal(_TEXT, X._NORMAL)} AS text FROM ({A.captured_sql(run)})), f{run} AS (SELECT route, arg_min([dom, text], page_id) AS c FROM "
            f"p{run} WHERE route IS NOT NULL GROUP BY route), s{run} AS (SELECT route, ['dom', 'text'][i] AS artifact, sha256(c[i]) AS digest, "
            f"octet_length(encode(c[i]))::BIGINT AS bytes FROM f{run}, (VALUES (1), (2)) AS x(i))")


def _compared(before: str, after: str, number: int) -> str:
    """CTEs up to ``d<number>``: the comparison of two snapshots."""
    return (f"j{number} AS (SELECT coalesce(b.route, a.route) AS route, coalesce(b.artifact, a.artifact) AS artifact, b.digest, a.digest AS previous, "
            f"coalesce(b.bytes, a.bytes) AS bytes, CASE WHEN a.digest IS NULL THEN 'new' WHEN b.digest IS NULL THEN 'removed' WHEN a.digest = b.digest "
            f"THEN 'unchanged' ELSE 'changed' END AS status FROM {after} b FULL JOIN {before} a ON a.route = b.route AND a.artifact = b.artifact), "
            f"n{number} AS (SELECT route, status, coalesce(digest, previous) AS content, row_number() OVER (PARTITION BY coalesce(digest, previous), status "
            f"ORDER BY md5(route)) AS nth FROM j{number} WHERE artifact = 'dom' AND status IN ('new', 'removed')), m{number} AS (SELECT x.route, x.status, "
            f"y.route AS peer FROM n{number} x JOIN n{number} y ON x.content = y.content AND x.nth = y.nth AND x.status <> y.status), d{number} AS (SELECT "
            f"j.route, j.artifact, CASE WHEN m.peer IS NULL THEN j.status WHEN j.status = 'new' THEN 'moved' ELSE 'moved_away' END AS status, j.digest, "
            f"j.previous, m.peer, j.bytes, {number} AS version FROM j{number} j LEFT JOIN m{number} m ON m.route = j.route AND m.status = j.status)")


_CHANGES = ("WITH " + ", ".join(_taken(r) for r in RUNS) + ", none AS (SELECT * FROM s0 WHERE false), " + ", ".join(
    _compared(*pair, n) for n, pair in enumerate([("none", "s0"), ("s0", "s1"), ("s1", "s2")], 1)) +
    ", changes AS (SELECT * FROM d1 UNION ALL SELECT * FROM d2 UNION ALL SELECT * FROM d3) ")

_COUNTS = [(S.b(p), m.replace("$1", "\\1")) for p, m in R.VOLATILE_COUNTS]
_LATER = 100_000_000


def _stable_html(e: str) -> str:
    tokens = f"regexp_extract_all({_normal(e, X._BLANK + X._NORMAL)}, '<[^>]*>|[^<]+|<')"
    return f"array_to_string(list_transform({tokens}, lambda t: CASE WHEN starts_with(t, '<') THEN t ELSE {_normal('t', X._NORMAL + _COUNTS)} END), '')"


def _row(*parts: str) -> str:
    return " || chr(1) || ".join(f"coalesce(translate(CAST({p} AS VARCHAR), chr(1) || chr(2), ''), chr(2))" for p in parts)


_BOTH = f"SELECT * FROM ({A.captured_sql(0)}) UNION ALL SELECT page_id + {_LATER}, url, html FROM ({A.captured_sql(2)})"
_WHEN = f"CASE WHEN {{}} < {_LATER} THEN 'before' ELSE 'after' END"
_USES = ("u AS (SELECT 'before' AS side, category, value, count(*) AS n FROM v WHERE page_id % 10 <> 3 GROUP BY 2, 3 UNION ALL SELECT 'after', category, value, "
         f"count(*) FROM v WHERE page_id % 10 <> 4 GROUP BY 2, 3), w AS (SELECT * FROM u WHERE value NOT IN ({S.quoted(R.TOKEN_NOISE)}))")
_VALUES = P._TALLY.split(", tot AS")[0].replace("SELECT 'colors' AS category", "SELECT page_id, 'colors' AS category").replace(
    "UNION ALL SELECT ", "UNION ALL SELECT page_id, ")
_POINTS = " UNION ALL ".join(
    f"SELECT '{side}' AS side, host, method, pathname, count(*) AS n, string_agg(DISTINCT CAST(status AS VARCHAR), ', ' ORDER BY CAST(status AS VARCHAR)) AS st "
    f"FROM api WHERE seq % 10 <> {out} GROUP BY 2, 3, 4" for side, out in (("before", 3), ("after", 4)))
_DRIFT = ("WITH " + M.dom(_BOTH) + f", {_VALUES}, {_USES}, {Q._API}, points AS ({_POINTS}), ax AS (SELECT page_id, url, CASE tag WHEN 'a' THEN 'link' WHEN 'li' THEN 'listitem' "
          "WHEN 'h1' THEN 'heading' WHEN 'nav' THEN 'navigation' WHEN 'article' THEN 'article' ELSE 'paragraph' END AS role, text AS name FROM el WHERE tag IN ('a', "
          f"'li', 'h1', 'nav', 'article', 'p')), rw AS (SELECT 'routes' AS dataset, ['title', 'digest'] AS fields, {_row(S.normal('url'))} AS key, "
          + _row("regexp_extract(html, '(?is)<title>(.*?)</title>', 1)", f"sha256({_stable_html('html')})") + f" AS row, {_WHEN.format('page_id')} AS side FROM pg UNION ALL "
          f"SELECT 'trees', ['role', 'name'], {_row(S.normal('url'))}, {_row('role', _normal('name', X._NORMAL + _COUNTS))}, {_WHEN.format('page_id')} FROM ax UNION ALL "
          f"SELECT 'tokens', ['uses'], {_row('category', 'value')}, {_row('n')}, side FROM w UNION ALL SELECT 'endpoints', ['samples', 'statuses'], "
          f"{_row('host', 'method', 'pathname')}, {_row('n', 'st')}, side FROM points), lf AS (SELECT dataset, key, row, any_value(fields) AS fields, sum(CASE side WHEN 'before' "
          "THEN 1 ELSE -1 END)::BIGINT AS more FROM rw GROUP BY 1, 2, 3), si AS (SELECT dataset, key, row, fields, CASE WHEN more > 0 THEN 'before' ELSE 'after' END AS side, "
          "unnest(range(1, abs(more) + 1)) AS copy FROM lf WHERE more <> 0), nu AS (SELECT *, row_number() OVER (PARTITION BY dataset, key, side ORDER BY md5(row) || "
          "lpad(copy::VARCHAR, 12, '0')) AS nth FROM si), bo AS (SELECT coalesce(b.dataset, a.dataset) AS dataset, coalesce(b.key, a.key) AS key, coalesce(b.nth, a.nth) AS nth, "
          "coalesce(b.fields, a.fields) AS fields, string_split(b.row, chr(1)) AS before, string_split(a.row, chr(1)) AS after FROM (SELECT * FROM nu WHERE side = 'before') b FULL "
          "JOIN (SELECT * FROM nu WHERE side = 'after') a ON a.dataset = b.dataset AND a.key = b.key AND a.nth = b.nth), ce AS (SELECT dataset, array_to_string(list_transform("
          "string_split(key, chr(1)), lambda k: CASE WHEN k = chr(2) THEN '' ELSE k END), ' | ') AS entity, nth, CASE WHEN before IS NULL THEN 'added' WHEN after IS NULL THEN 'removed' "
          "ELSE 'changed' END AS change, fields[i] AS field, nullif(before[i], chr(2)) AS before, nullif(after[i], chr(2)) AS after FROM (SELECT *, unnest(range(1, len(fields) + 1)) "
          "AS i FROM bo)), cells AS (SELECT * FROM ce WHERE change <> 'changed' OR before IS DISTINCT FROM after)")
_LEAF = ("WITH " + S.view("d", A.COUNTED_DOCS, "events") + ", e AS (SELECT seq, unnest([{'p': '$.id', 'v': json ->> '$.id'}, {'p': '$.downloads', 'v': '0'}, {'p': '$.stats.likes', 'v': '0'}, "
         "{'p': '$.stats.comment_count', 'v': '0'}, {'p': '$.stats.total', 'v': json ->> '$.stats.total'}, {'p': '$.size', 'v': json ->> '$.size'}, {'p': '$.seen', 'v': json ->> '$.seen'}, "
         f"{{'p': '$.ref', 'v': json ->> '$.ref'}}, {{'p': '$.updatedAt', 'v': '{R.FIXED_DATE}'}}]) AS x FROM d) SELECT seq, x.p AS path, CASE WHEN x.p IN ('$.seen', '$.ref') THEN "
         f"{_normal('x.v', X._NORMAL + _COUNTS)} ELSE x.v END AS value FROM e")

ORACLES = {
    "f02_drift_cells": _DRIFT + " SELECT * FROM cells",
    "f02_drift_summary": _DRIFT + " SELECT dataset, change, count(DISTINCT entity) AS entities, count(DISTINCT (entity, nth)) AS rows, count(*) AS cells FROM cells GROUP BY 1, 2",
    "f06_stable_pages": f"WITH p AS ({A.captured_sql(1)}), s AS (SELECT page_id, {_stable_html('html')} AS s, {_normal('html', X._BLANK + X._NORMAL)} AS n FROM p) SELECT "
                        "page_id, md5(s) AS digest, s <> n AS masked FROM s",
    "f06_stable_leaves": _LEAF,
    "f01_ledger_changes": _CHANGES + "SELECT * FROM changes",
    "f01_ledger_rollup": _CHANGES + "SELECT version, artifact, status, count(*) AS routes, sum(bytes)::BIGINT AS bytes FROM changes GROUP BY ALL",
}
