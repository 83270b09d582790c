"""Report, sink and reader queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import rules as R
from ..functions.core import spread
from ..operators import calls as C
from ..operators import styles as T
from ..operators import tasks as TK
from ..operators import verify as V
from ..session import shared_folder
from ..sinks import reports as K
from ..sources import adapters as A
from ..sources.readers import read_bundle, read_har, read_trees
from . import sqltext as S
from .calls import _API, _TEMPLATE, ORACLES as CALL_SQL, _flat_fixtures, api, templated
from .interaction import ACT
from .styles import _TALLY, ORACLES as STYLE_SQL, _samples
from .tasks import ORACLES as TASK_SQL, _FEAT, _features, v18

#: Files that one task writes, where each row is a file.
TASK_FILES = 250


def _folder(spark, name):
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _joined_map(column):
    return F.array_join(F.transform(F.array_sort(F.map_entries(column)), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ";")


def k01(spark, sf):
    log = K.redacted_log(api(spark, sf))
    return log.select("seq", "method", "url", "status", _joined_map("req_headers").alias("req_headers"), "post_text", "resp_text", "resp_size")


def s02(spark, sf):
    """A log written as HAR documents and read back."""
    path = _folder(spark, "har")
    K.har_entries(K.redacted_log(api(spark, sf))).select(F.concat(F.lit('{"log":{"version":"1.2","entries":['), "entry", F.lit("]}}")).alias("value")).write.text(path)
    return read_har(spark, path, multiline=False).select("method", "host", "pathname", "status", F.size("query").alias("params"), F.size("req_headers").alias("headers")).groupBy(
        "method", "host", "pathname", "status", "params", "headers").agg(F.count(F.lit(1)).alias("n"))


_SAVED_TREE = ("CASE WHEN s_suppkey % 2 = 0 THEN '{\"tree\":{\"role\":\"RootWebArea\",\"name\":\"x\",\"children\":[{\"role\":\"heading\",\"name\":\" ' || s_name || ' \",\"children\":"
               "[{\"role\":\"link\",\"name\":\"L' || CAST(s_nationkey AS STRING) || '\"}]},{\"role\":\"button\",\"name\":true}]}}' ELSE '- navigation \"Main\":' || chr(10) || '  - link \"S' || "
               "CAST(s_suppkey AS STRING) || '\":' || chr(10) || '    - /url: /x' || chr(10) || '- text: plain' END")


def s02_bodies(spark, sf):
    """Bodies of a log written as HAR documents, half of them in base64, and read back."""
    path = _folder(spark, "har")
    entries = K.har_entries(K.redacted_log(api(spark, sf)), F.col("seq") % 2 == 0)
    entries.select(F.concat(F.lit('{"log":{"version":"1.2","entries":['), "entry", F.lit("]}}")).alias("value")).write.text(path)
    return read_har(spark, path, multiline=False).select("method", "url", F.md5("request_body").alias("request"), F.md5("response_body").alias("response"))


def s07(spark, sf):
    """Trees saved one per file, as JSON and as snapshot text, and loaded again."""
    path = _folder(spark, "trees")
    trees = A.table(spark, sf, "supplier").selectExpr("s_suppkey AS tree", _SAVED_TREE + " AS value")
    # A file is slow and its row small: dealt by size, one task would write them all, and the driver would move them one by one.
    spread(trees, "tree", task_rows=TASK_FILES).write.option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy("tree").text(path)
    nodes = read_trees(spark, path)
    return nodes.select(F.regexp_extract("tree_id", "tree=([0-9]+)/", 1).cast("long").alias("tree_id"), "pos", "role", "name", "depth")


def s08(spark, sf):
    """Targets of a bundle, written in parts, of which the first per URL counts."""
    path = _folder(spark, "targets")
    rows = A.captures(spark, sf).select("url", "label", "category", "seq")
    rows.repartitionByRange(4, "seq").sortWithinPartitions("seq").write.json(path)
    return read_bundle(spark, path, "url string, label string, category string, seq long", "url")


def k03(spark, sf):
    """API documents written per host and read back: operations found in the text."""
    calls = templated(spark, sf)
    lines = K.openapi_lines(C.operations(calls), C.operation_query_params(calls), C.operation_responses(calls))
    path = _folder(spark, "openapi")
    K.write_lines(lines, path, ["part", "template"], "host")
    back = spark.read.text(path)
    return back.groupBy("host").agg(F.sum(F.size(F.regexp_extract_all("value", F.lit('"summary":"'), F.lit(0)))).alias("operations"),
                                    F.count_if(F.col("value").startswith('{"openapi"')).alias("heads"))


def k04(spark, sf):
    path = _folder(spark, "fixtures")
    K.write_fixtures(_flat_fixtures(spark, sf), path)
    return spark.read.schema("method string, template string, samples long, host string").json(path).groupBy("host", "method", "template").agg(
        F.count(F.lit(1)).alias("variants"), F.sum("samples").alias("samples"))


def _tokens(spark, sf):
    return T.ranked_tokens(T.token_values(A.style_rows(spark, sf)))


def k06(spark, sf):
    kept = T.page_samples(_samples(spark, sf))
    return K.typography_lines(T.font_families(kept), T.type_scale(kept), T.text_colors(kept)).select("section", "line")


def k07_tasks(spark, sf):
    return K.task_lines(TK.all_tasks(TK.feature_tasks(_features(spark, sf)))).drop("task_id")


def _pages(spark, sf, late):
    named = A.captures(spark, sf).filter((F.col("seq") % 3 == 0) == late).withColumn("category", F.coalesce("category", F.lit("pages")))
    from ..operators.links import plan_paths
    return plan_paths(named).select("category", F.col("index"), F.concat("label", F.lit(".png")).alias("name"))


def k09_pages(spark, sf):
    return V.append_pages(_pages(spark, sf, False), _pages(spark, sf, True)).select("category", "index", "name", "added", "file")


def k09_fixtures(spark, sf):
    rows = A.calls(spark, sf).select(F.concat("pathname", F.lit(".json")).alias("file"), "seq")
    half = lambda late: rows.filter((F.col("seq") % 2 == 0) == late).groupBy("file").agg(F.max("seq").alias("seq"))
    return V.append_fixtures(half(False), half(True))


QUERIES = {
    "k01_redacted_log": k01,
    "k02_catalog_lines": lambda spark, sf: K.catalog_lines(C.endpoint_catalog(api(spark, sf))),
    "k03_openapi_documents": k03,
    "k04_fixture_files": k04,
    "k05_token_report": lambda spark, sf: K.token_lines(_tokens(spark, sf)),
    "k06_typography_report": k06,
    "k07_interaction_report": lambda spark, sf: K.interaction_lines(A.actions(spark, sf)),
    "k07_task_checklist": k07_tasks,
    "k08_css_tokens": lambda spark, sf: K.css_token_lines(_tokens(spark, sf)),
    "k08_bundle_index": lambda spark, sf: K.bundle_index(v18(spark, sf)),
    "k09_append_pages": k09_pages,
    "k09_append_fixtures": k09_fixtures,
    "s02_har_round_trip": s02,
    "s02_har_bodies": s02_bodies,
    "s07_saved_trees": s07,
    "s08_bundle_targets": s08,
}

_CAP = S.view("captures", A.CAPTURES, "events")
_SECTIONS = "(VALUES " + ", ".join(f"({i}, '{c}', '{t[0]}')" for i, (c, t) in enumerate(R.TOKEN_CATEGORIES.items())) + ") s(section, category, title)"
_NUMBERED = ("(SELECT coalesce(category, 'pages') AS category, row_number() OVER (PARTITION BY coalesce(category, 'pages') ORDER BY seq) AS index, label || '.png' AS name FROM captures "
             "WHERE (seq % 3 = 0) = {0})")

ORACLES = {
    "k01_redacted_log": f"WITH {_API} SELECT seq, method, 'https://' || host || pathname || '?' || regexp_replace(qs, 'api_key=[^&]*', 'api_key=%5BREDACTED%5D') AS url, status, "
        "'authorization=[REDACTED];content-type=application/json;x-trace=b' || user_id AS req_headers, CASE WHEN json_valid(request_body) THEN replace(request_body, '\": ', '\":') END AS post_text, "
        "coalesce(replace(regexp_replace(response_body, '\"token\":\"[^\"]*\"', '\"token\":\"[REDACTED]\"'), '\": ', '\":'), '') AS resp_text, strlen(coalesce(replace(regexp_replace(response_body, "
        "'\"token\":\"[^\"]*\"', '\"token\":\"[REDACTED]\"'), '\": ', '\":'), '')) AS resp_size FROM api",
    "k02_catalog_lines": "WITH cat AS (" + CALL_SQL["c09_endpoint_catalog"] + "), l AS (SELECT host, method, pathname, list_filter(['### ' || method || ' ' || pathname, '- Status: ' || statuses, '- Response "
        "content-type: ' || content_types, '- Query params: ' || query_keys, CASE WHEN operations <> '' THEN '- GraphQL operations: ' || operations END, CASE WHEN streaming THEN '- Streaming: yes (SSE/chunked "
        "— transcript captured in fixtures)' END, CASE WHEN samples > 1 THEN '- Samples: ' || samples || ' captured call(s)' END, CASE WHEN request_sample IS NOT NULL THEN 'Request body sample:' END, "
        "request_sample, CASE WHEN response_sample IS NOT NULL THEN 'Response body sample:' END, response_sample], lambda x: x IS NOT NULL) AS ls FROM cat) SELECT host, method, pathname, "
        "generate_subscripts(ls, 1) - 1 AS line_no, unnest(ls) AS line FROM l",
    "k03_openapi_documents": f"WITH {_API}, {_TEMPLATE} SELECT host, count(DISTINCT method || ' ' || template) AS operations, 1 AS heads FROM t GROUP BY host",
    "k04_fixture_files": "WITH f AS (" + CALL_SQL["c15_fixtures"] + ") SELECT host, method, template, count(*) AS variants, CAST(sum(samples) AS BIGINT) AS samples FROM f GROUP BY 1, 2, 3",
    "k05_token_report": f"WITH {_TALLY} SELECT section, 0 AS rank, '## ' || title AS line FROM {_SECTIONS} UNION ALL SELECT section, coalesce(rank, 1), coalesce('- ' || value || ' (' || n || ' uses)', '_none "
        f"captured_') FROM {_SECTIONS} LEFT JOIN ranked ON ranked.category = s.category",
    "k06_typography_report": "WITH fam AS (" + STYLE_SQL["e14_font_families"] + "), sca AS (" + STYLE_SQL["e15_type_scale"] + "), col AS (" + STYLE_SQL["e14_text_colors"] + ") SELECT 1 AS section, '- ' || family || ' "
        "(' || n || ' uses)' || CASE WHEN is_body THEN ' (body)' ELSE '' END || CASE WHEN is_mono THEN ' (mono)' ELSE '' END AS line FROM fam UNION ALL SELECT 2, '| ' || concat_ws(' | ', role, size, weight, "
        "line_height, spacing) || ' |' FROM sca UNION ALL SELECT 3, '- ' || color || ' (' || n || ' uses)' FROM col",
    "k07_interaction_report": f"WITH {ACT} SELECT page, CASE WHEN outcome = 'skipped' THEN 1 ELSE 0 END AS part, seq, CASE WHEN outcome = 'skipped' THEN '- ' || label || ' (' || kind || ')' ELSE '| ' || concat_ws(' | ', "
        "label, kind, outcome, CASE outcome WHEN 'navigation' THEN '→ ' || to_url WHEN 'download' THEN '⬇ ' || download_file WHEN 'modal' THEN 'modal opened' WHEN 'dom-change' THEN 'DOM updated' ELSE outcome END || "
        "coalesce(' · screenshot: `' || screenshot || '`', '')) || ' |' END AS line FROM actions WHERE outcome <> 'noop'",
    "k07_task_checklist": f"WITH {_FEAT}, n AS (SELECT *, row_number() OVER (ORDER BY ord, title) AS number FROM ft), l AS (SELECT number, ['## QC-' || CASE WHEN number < 1000 THEN printf('%03d', number) ELSE CAST(number AS "
        "STRING) END || ' ' || title, 'Expected: ' || detail || ' · API: ' || array_to_string(apis, ', ')] AS ls FROM n) SELECT number, generate_subscripts(ls, 1) - 1 AS line_no, unnest(ls) AS line FROM l",
    "k08_css_tokens": f"WITH {_TALLY} SELECT category, rank, '  --' || CASE category " + " ".join(f"WHEN '{c}' THEN '{t[2]}'" for c, t in R.TOKEN_CATEGORIES.items()) + " END || '-' || rank || ': ' || value || ';' AS line FROM ranked",
    "k08_bundle_index": "WITH a AS (" + TASK_SQL["v18_route_artifacts"] + ") SELECT route, min(seq) AS seq, '| `' || route || '` | ' || arg_min(label, seq) || ' | `' || arg_min(screenshot, seq) || '` | `' || arg_min(dom, seq) || '` | "
        "' || CASE WHEN arg_min(behaviors, seq) > 0 THEN CAST(arg_min(behaviors, seq) AS STRING) ELSE '—' END || ' |' AS line FROM a GROUP BY route",
    "k09_append_pages": f"WITH {_CAP}, old AS {_NUMBERED.format('false')}, new AS {_NUMBERED.format('true')}, u AS (SELECT *, false AS added FROM old UNION ALL SELECT category, index + coalesce((SELECT max(index) FROM old WHERE "
        "old.category = new.category), 0), name, true FROM new) SELECT *, category || '/' || printf('%02d', index) || '-' || name AS file FROM u",
    "k09_append_fixtures": f"WITH {S.view('calls', A.CALLS, 'events')} SELECT pathname || '.json' AS file, coalesce(max(seq) FILTER (seq % 2 = 0), max(seq)) AS seq FROM calls GROUP BY 1",
    "s02_har_bodies": f"WITH {_API} SELECT method, url, CASE WHEN json_valid(request_body) THEN md5(replace(request_body, ': ', ':')) END AS request, md5(coalesce(replace("
        "response_body, ': ', ':'), '')) AS response FROM api",
    "s07_saved_trees": "SELECT s_suppkey AS tree_id, v.pos, v.role, CASE WHEN s_suppkey % 2 = 0 THEN CASE v.pos WHEN 0 THEN s_name WHEN 1 THEN 'L' || s_nationkey ELSE 'true' END ELSE CASE v.pos WHEN 0 "
        "THEN 'Main' WHEN 1 THEN 'S' || s_suppkey ELSE '' END END AS name, v.depth FROM supplier, (VALUES (0, 0, 'heading', 0), (0, 1, 'link', 1), (0, 2, 'button', 0), (1, 0, 'navigation', 0), (1, 1, 'link', "
        "1), (1, 2, 'text', 0)) v(odd, pos, role, depth) WHERE v.odd = s_suppkey % 2",
    "s08_bundle_targets": f"WITH {_CAP} SELECT url, arg_min(label, seq) AS label, nullif(arg_min(coalesce(category, '-'), seq), '-') AS category, min(seq) AS seq FROM captures GROUP BY url",
    "s02_har_round_trip": f"WITH {_API} SELECT method, host, pathname, status, CASE WHEN seq % 4 = 0 THEN 4 ELSE 2 END + CASE WHEN seq % 7 = 0 THEN 1 ELSE 0 END AS params, 3 AS headers, count(*) AS n FROM api GROUP BY ALL",
}
