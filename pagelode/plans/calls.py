"""Network-call queries: filters, JSON schemas, catalogs, fixtures, routes, state."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import rules as R
from ..functions.hashing import fnv1a
from ..operators import calls as C
from ..operators import json_tables as J
from ..operators import streams_batch as B
from ..sources import adapters as A
from . import sqltext as S


def api(spark, sf):
    """API calls, masked as soon as they are known to be such."""
    return C.masked_calls(C.api_calls(A.calls(spark, sf, dealt_rows=True)))


def templated(spark, sf):
    return C.with_templates(api(spark, sf))


_CALLS = S.view("calls", A.CALLS, "events")
_JSON_MIME = "(regexp_matches(coalesce(resp_mime, ''), '" + R.JSON_MIME + "') OR contains(pathname, 'graphql'))"
_MASKS = ("regexp_replace(qs, 'api_key=[^&]*', 'api_key=[REDACTED]') AS qs, regexp_replace(req_header_lines, 'Authorization: [^' || chr(10) || ']*', "
          "'Authorization: [REDACTED]') AS req_header_lines, regexp_replace(resp_header_lines, 'Set-Cookie: [^' || chr(10) || ']*', 'Set-Cookie: [REDACTED]') AS "
          "resp_header_lines, regexp_replace(response_body, '\"token\":\"[^\"]*\"', '\"token\":\"[REDACTED]\"') AS response_body")
_API = (_CALLS + f", api AS (SELECT * REPLACE ({_MASKS}), 'https://' || host || pathname || '?' || replace(replace(regexp_replace(qs, 'api_key=[^&]*', "
        "'api_key=[REDACTED]'), '[', '%5B'), ']', '%5D') AS url FROM calls WHERE (resource_type <> "
        f"'document' OR {_JSON_MIME}) AND resource_type NOT IN ({S.quoted(R.ASSET_RESOURCE_TYPES)}) AND NOT regexp_matches("
        f"pathname, '{R.CALL_ASSET_EXT}') AND (resource_type IN ('xhr', 'fetch') OR {_JSON_MIME}) AND status > 0)")

# Template by definition: compare every pair of paths of a host place by place.
_TEMPLATE = (
    "paths AS (SELECT DISTINCT host, pathname, list_filter(string_split(pathname, '/'), lambda s: s <> '') AS segs FROM api), "
    "spots AS (SELECT *, unnest(generate_series(1, len(segs))) AS i FROM paths), flags AS (SELECT s.host, s.pathname, s.segs, s.i, "
    "s.segs[s.i] AS seg, regexp_matches(s.segs[s.i], '^[0-9]+$') OR regexp_matches(s.segs[s.i], '(?i)^[0-9a-f]{12,}$') OR "
    "((regexp_matches(s.segs[s.i], '[0-9]') OR length(s.segs[s.i]) >= 16) AND EXISTS (SELECT 1 FROM paths o WHERE o.host = s.host "
    "AND len(o.segs) = len(s.segs) AND o.segs[s.i] <> s.segs[s.i] AND list_where(o.segs, list_transform(o.segs, lambda x, j: "
    "j <> s.i)) = list_where(s.segs, list_transform(s.segs, lambda x, j: j <> s.i)))) AS p FROM spots s), bases AS (SELECT *, "
    "coalesce((SELECT max_by(CASE WHEN length(f.seg) > 1 AND ends_with(f.seg, 's') THEN left(f.seg, -1) ELSE f.seg END, f.i) FROM "
    "flags f WHERE f.host = flags.host AND f.pathname = flags.pathname AND f.i < flags.i AND NOT f.p), 'id') AS base FROM flags), "
    "templates AS (SELECT host, pathname, '/' || string_agg(CASE WHEN p THEN '{' || base || '}' ELSE seg END, '/' ORDER BY i) AS "
    "template, coalesce(string_agg(base, ',' ORDER BY i) FILTER (p), '') AS params FROM bases GROUP BY 1, 2), t AS (SELECT api.*, "
    "template, params FROM api JOIN templates USING (host, pathname))")

_OP = ("CASE WHEN contains(pathname, 'graphql') THEN coalesce(nullif(request_body ->> '$.operationName', ''), nullif("
       "regexp_extract(request_body ->> '$.query', '\\b(query|mutation|subscription)\\s+([A-Za-z0-9_]+)', 2), '')) END")
_SAFE_OP = f"CASE WHEN json_valid(request_body) THEN {_OP} END"
_SIG = (f"array_to_string(list_transform(list_sort(list_distinct(list_filter(list_transform(string_split(qs, '&'), lambda p: "
        f"regexp_extract(p, '^[^=]*')), lambda n: NOT regexp_matches(n, '{R.VOLATILE_QUERY}')))), lambda n: n || '=' || "
        "array_to_string(list_sort(list_transform(list_filter(string_split(qs, '&'), lambda p: starts_with(p, n || '=')), lambda p: "
        "substr(p, length(n) + 2))), ',')), '&')")


def _fnv_sql(e: str) -> str:
    codes = f"list_transform(string_split({e}, ''), lambda c: CAST(ord(c) AS BIGINT))"
    return (f"CASE WHEN {e} = '' THEN '811c9dc5' ELSE format('{{:08x}}', list_reduce({codes}, lambda h, c: (xor(h, c) * 16777619)"
            " & 4294967295, CAST(2166136261 AS BIGINT))) END")


def _canon_sql(e: str) -> str:
    """Flat objects: members in key order."""
    return (f"CASE WHEN json_valid({e}) THEN '{{' || array_to_string(list_transform(list_sort(json_keys({e})), lambda k: '\"' || k || "
            f"'\":' || CAST(json_extract({e}, '$.' || k) AS VARCHAR)), ',') || '}}' END")


_HASHED = (f"hashed AS (SELECT *, {_SAFE_OP} AS op, {_SIG} AS query_sig, coalesce({_canon_sql('request_body')}, '\"' || "
           "request_body || '\"') AS canon FROM t), keyed AS (SELECT *, CASE WHEN canon IS NULL OR op IS NOT NULL THEN '' ELSE "
           f"{_fnv_sql('canon')} END AS body_hash FROM hashed)")
_FIX = (f"WITH {_API}, {_TEMPLATE}, {_HASHED}, fixtures AS (SELECT host, method, template, status, query_sig, body_hash, op, "
        "count(*) AS samples, min(seq) AS seq, min_by(struct_pack(response_body := response_body, resp_mime := resp_mime, "
        "resp_header_lines := resp_header_lines), seq) AS f FROM keyed GROUP BY ALL)")


def c02(spark, sf):
    calls = A.calls(spark, sf)
    heads = calls.select("seq", F.explode(C.header_map(F.col("req_headers"))).alias("name", "value"))
    query = calls.select("seq", F.explode(C.query_map(F.col("query"))).alias("name", "values")).select(
        "seq", "name", F.array_join("values", ",").alias("value"))
    return heads.unionByName(query)


def c03(spark, sf):
    parsed = api(spark, sf)
    kind = lambda c: J.kind_of(C.parse_body(F.col(c)))
    return parsed.select("seq", kind("request_body").alias("request_kind"), kind("response_body").alias("response_kind"),
                         F.coalesce("resp_mime", F.lit("none")).alias("content_type"))


def c04(spark, sf):
    return J.json_leaves(A.json_docs(spark, sf), ["seq"]).select("seq", "path", "kind", "value")


def c05(spark, sf):
    return J.infer_schema(A.json_docs(spark, sf), ["seq"])


def c06(spark, sf):
    return J.merge_schemas(A.json_docs(spark, sf), ["endpoint"])


def c08(spark, sf):
    return api(spark, sf).filter(F.col("pathname").rlike(R.GRAPHQL)).select(
        "seq", C.graphql_operation(F.col("request_body")).alias("op"))


def c11(spark, sf):
    return api(spark, sf).select("seq", C.query_signature(F.col("query")).alias("signature"))


def c12(spark, sf):
    calls = api(spark, sf)
    return calls.select("seq", J.canonical_json(F.col("request_body")).alias("request"),
                        J.canonical_json(F.col("response_body")).alias("response"))


def c13(spark, sf):
    return A.table(spark, sf, "conversations").select("conv_id", "turn", fnv1a(F.col("text")).alias("hash"))


def c14(spark, sf):
    op = F.when(F.col("url").rlike(R.GRAPHQL), C.graphql_operation(F.col("request_body")))
    return api(spark, sf).select("seq", C.body_hash(F.col("request_body"), op).alias("hash"))


def _flat_fixtures(spark, sf):
    return C.fixtures(templated(spark, sf))


def c15(spark, sf):
    fx = _flat_fixtures(spark, sf)
    return fx.select("host", "method", "template", "status", "query_sig", "body_hash", "op", "samples", "seq", "response",
                     "content_type", "is_stream", F.array_join(F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(
                         e["key"], F.lit("="), e["value"])), ";").alias("headers"))


_DATED = ("SELECT seq, '{\"createdAt\":\"2024-05-06T07:08:09Z\",\"name\":\"2024-05-06T07:08:09Z\",\"log\":[{\"updated_at\":\"' || "
          "CASE WHEN seq % 2 = 0 THEN '2024-01-02T03:04:05.678Z' ELSE 'yesterday' END || '\"}],\"n\":' || CAST(seq AS STRING) || '}' "
          "AS json FROM calls")


def c16(spark, sf):
    docs = A.calls(spark, sf, dealt_rows=True).selectExpr("seq", _DATED[len("SELECT seq, "):-len(" FROM calls")])
    return J.stable_leaves(docs, ["seq"])


def c17(spark, sf):
    return C.crud_role(_flat_fixtures(spark, sf)).groupBy("method", "template", "op", "is_stream", "resource", "crud").agg(
        F.count(F.lit(1)).alias("variants"))


def c18(spark, sf):
    return C.routes(_flat_fixtures(spark, sf)).select(
        "seq", "method", "template", "resource", "crud", F.array_join(F.transform(F.array_sort(F.map_entries("match_query")),
            lambda e: F.concat(e["key"], F.lit(":"), e["value"])), "|").alias("match_query"))


def c19(spark, sf):
    calls = A.calls(spark, sf)
    op = F.when(F.col("url").rlike(R.GRAPHQL), C.graphql_operation(F.col("request_body")))
    tag = F.when(F.col("seq") % 8 == 0, F.lit("&tag=a,b&z=1")).otherwise(F.lit(""))
    asks = calls.withColumn("op", op).select(
        F.col("seq").alias("request_id"), "method", "pathname", "op",
        C.body_hash(F.col("request_body"), F.col("op")).alias("body_hash"),
        F.when(F.col("seq") % 6 == 5, F.lit("")).otherwise(
            F.concat(F.lit("page="), F.col("seq") * 7 % 6, tag)).alias("query_sig"))
    return C.best_routes(asks, _flat_fixtures(spark, sf).withColumn("route_seq", F.col("seq")))


def c20_lookup(spark, sf):
    records = A.table(spark, sf, "supplier").select(
        F.concat(F.lit("band"), F.floor(F.col("s_acctbal") / 100).cast("long")).alias("resource"),
        F.col("s_suppkey").cast("string").alias("id"))
    asks = records.select("resource", F.concat("id", F.when(F.col("id") % 2 == 0, "x").otherwise("")).alias("id"))
    return C.record_lookup(records, asks)


_ENVELOPE = ("CASE o_orderkey % 6 WHEN 0 THEN '{\"total\":2,\"data\":[{\"slug\":\"s' || CAST(o_orderkey AS STRING) || '\"},{\"v\":1}]}'"
             " WHEN 1 THEN '[{\"id\":' || CAST(o_orderkey AS STRING) || '},{\"_id\":\"q\"},{\"key\":\"k\",\"uuid\":\"u\"}]'"
             " WHEN 2 THEN '{\"results\":[],\"nodes\":[{\"id\":1}]}' WHEN 3 THEN '{\"name\":\"' || o_orderstatus || '\",\"n\":1}'"
             " WHEN 4 THEN '\"text\"' ELSE '{\"nodes\":[{\"name\":\"n' || CAST(o_custkey AS STRING) || '\"}]}' END")


def _envelopes(spark, sf):
    return A.table(spark, sf, "orders").selectExpr("o_orderkey AS seq", _ENVELOPE + " AS response")


def c21(spark, sf):
    return C.record_rows(_envelopes(spark, sf)).select("seq", "wrapped", "pos", F.to_json("record").alias("record"))


def c22(spark, sf):
    return C.hydrate(_envelopes(spark, sf)).select("seq", "record_id", "record")


def c23(spark, sf):
    return C.path_templates(api(spark, sf)).select("host", "pathname", "template", F.array_join("params", ",").alias("params"))


def s03(spark, sf):
    return C.attach_bodies(A.calls(spark, sf), A.bodies(spark, sf)).select(
        "seq", F.col("side.request_body").alias("request_body"), F.col("side.response_body").alias("response_body"))


def _streams(spark, sf):
    texts = A.table(spark, sf, "conversations").selectExpr(*A.FRAMES)
    return texts.select(F.concat("conv_id", F.lit("/"), "turn").alias("stream_key"), "content_type",
                        F.concat(F.lit(" data: one\r\n\n"), F.regexp_replace("text", r"\. ", ".\n\n"), F.lit("\n\n  ")).alias("text"))


def s05(spark, sf):
    log = A.table(spark, sf, "conversations").select(
        F.concat(F.lit("wss://live.example.com/"), "conv_id").alias("socket"), (F.col("conv_id") * 1000 + F.col("turn")).alias("seq"),
        F.when(F.col("role") == "user", "send").otherwise("recv").alias("direction"), F.col("text").alias("payload"),
        (F.col("turn") % 3 == 2).alias("is_binary"))
    return B.socket_frames(log)


def s09(spark, sf):
    return B.stylesheet_budget(A.css_texts(spark, sf), 20000).select("seq", "url", F.octet_length("css").alias("bytes"))


QUERIES = {
    "c01_api_calls": lambda spark, sf: api(spark, sf).select("seq", "method", "host", "pathname", "status", "resource_type"),
    "c02_header_and_query_maps": c02,
    "c03_parse_bodies": c03,
    "c04_json_leaves": c04,
    "c05_infer_schema": c05,
    "c06_merge_schemas": c06,
    "c07_operations": lambda spark, sf: C.operations(templated(spark, sf)),
    "c07_query_params": lambda spark, sf: C.operation_query_params(templated(spark, sf)),
    "c07_responses": lambda spark, sf: C.operation_responses(templated(spark, sf)),
    "c07_examples": lambda spark, sf: C.operation_examples(templated(spark, sf)),
    "c08_graphql_operation": c08,
    "c09_endpoint_catalog": lambda spark, sf: C.endpoint_catalog(api(spark, sf)),
    "c10_api_summary": lambda spark, sf: C.api_summary(templated(spark, sf)),
    "c11_query_signature": c11,
    "c12_canonical_json": c12,
    "c13_stable_hash": c13,
    "c14_body_hash": c14,
    "c15_fixtures": c15,
    "c16_stable_bodies": c16,
    "c17_crud_roles": c17,
    "c18_routes": c18,
    "c19_best_route": c19,
    "c20_resource_state": lambda spark, sf: C.fold_state(A.crud_log(spark, sf)),
    "c20_record_lookup": c20_lookup,
    "c21_unwrap_records": c21,
    "c22_hydrate_collection": c22,
    "c23_path_templates": c23,
    "s03_body_sidecar": s03,
    "s04_stream_frames": lambda spark, sf: B.split_frames(_streams(spark, sf)),
    "s05_socket_frames": s05,
    "s09_stylesheet_budget": s09,
}

_NODES = (S.view("docs", A.JSON_DOCS, "conversations") + ", n AS (SELECT docs.endpoint, docs.seq, t.fullkey AS path, regexp_replace("
          "t.fullkey, '\\[[0-9]+\\]', '[]', 'g') AS shape, CASE WHEN t.type IN ('OBJECT', 'ARRAY', 'NULL', 'BOOLEAN') THEN "
          "lower(t.type) WHEN t.type = 'VARCHAR' THEN 'string' WHEN t.type = 'DOUBLE' AND CAST(t.atom AS DOUBLE) <> floor(CAST("
          "t.atom AS DOUBLE)) THEN 'number' ELSE 'integer' END AS kind, CASE WHEN t.type = 'NULL' THEN NULL WHEN t.type = 'VARCHAR' "
          "THEN t.atom ->> '$' ELSE CAST(t.atom AS VARCHAR) END AS value FROM docs, json_tree(docs.json) t)")
_TYPES = ("array_to_string(list_filter(list_sort(list_distinct(list(kind))), lambda k: NOT (k = 'integer' AND "
          "list_contains(list(kind), 'number'))), '|')")
_TYPED = ("(SELECT {keys}, shape, array_to_string(list_filter(ks, lambda k: NOT (k = 'integer' AND list_contains(ks, 'number'))), "
          "'|') AS types, c, o FROM (SELECT {keys}, shape, list_sort(list_distinct(list(kind))) AS ks, count(*) AS c, count(*) "
          "FILTER (kind = 'object') AS o FROM n GROUP BY {keys}, shape))")

ORACLES = {
    "c01_api_calls": f"WITH {_API} SELECT seq, method, host, pathname, status, resource_type FROM api",
    "c02_header_and_query_maps": f"WITH {_CALLS}, l AS (SELECT seq, unnest(string_split(req_header_lines, chr(10))) AS line, "
        "generate_subscripts(string_split(req_header_lines, chr(10)), 1) AS i FROM calls), q AS (SELECT seq, unnest(string_split(qs, "
        "'&')) AS line, generate_subscripts(string_split(qs, '&'), 1) AS i FROM calls) SELECT seq, lower(regexp_extract(line, "
        "'^[^:]*')) AS name, max_by(regexp_extract(line, ': (.*)$', 1), i) AS value FROM l GROUP BY 1, 2 UNION ALL SELECT seq, "
        "regexp_extract(line, '^[^=]*'), string_agg(regexp_extract(line, '=(.*)$', 1), ',' ORDER BY i) FROM q GROUP BY 1, 2",
    "c03_parse_bodies": f"WITH {_API} SELECT seq, CASE WHEN json_valid(request_body) THEN lower(json_type(request_body)) END AS "
        "request_kind, CASE WHEN json_valid(response_body) THEN lower(json_type(response_body)) END AS response_kind, "
        "coalesce(resp_mime, 'none') AS content_type FROM api",
    "c04_json_leaves": f"WITH {_NODES} SELECT seq, path, kind, value FROM n WHERE kind NOT IN ('object', 'array')",
    "c05_infer_schema": f"WITH {_NODES} SELECT seq, shape, types FROM {_TYPED.format(keys='seq')}",
    "c06_merge_schemas": f"WITH {_NODES}, s AS {_TYPED.format(keys='endpoint')} SELECT s.endpoint, s.shape, s.types, NOT ends_with("
        "s.shape, '[]') AND s.c = coalesce(p.o, -1) AS required FROM s LEFT JOIN s p ON p.endpoint = s.endpoint AND s.shape <> '$' "
        "AND p.shape = regexp_replace(s.shape, '(\\[\\]|\\.[^.\\[]*)$', '')",
    "c07_operations": f"WITH {_API}, {_TEMPLATE}, o AS (SELECT *, {_SAFE_OP} AS op FROM t) SELECT host, method, template, params, "
        "count(*) AS samples, coalesce(string_agg(DISTINCT op, ',' ORDER BY op), '') AS graphql_operations, count(*) FILTER "
        "(json_valid(request_body)) AS request_bodies FROM o GROUP BY ALL",
    "c07_query_params": f"WITH {_API}, {_TEMPLATE}, q AS (SELECT host, method, template, seq, unnest(string_split(qs, '&')) AS p FROM "
        "t), n AS (SELECT host, method, template, seq, regexp_extract(p, '^[^=]*') AS name, count(*) AS c FROM q GROUP BY ALL) "
        "SELECT host, method, template, name, CASE WHEN min_by(c, seq) > 1 THEN 'array' ELSE 'string' END AS type FROM n GROUP BY ALL",
    "c07_responses": f"WITH {_API}, {_TEMPLATE} SELECT host, method, template, status, count(*) AS samples, min_by(response_body, seq) "
        "FILTER (json_valid(response_body)) AS example, CASE status WHEN 200 THEN 'OK' WHEN 201 THEN 'Created' WHEN 500 THEN "
        "'Internal Server Error' ELSE '' END AS description FROM t GROUP BY host, method, template, status",
    "c07_examples": f"WITH {_API}, {_TEMPLATE}, d AS (SELECT host, method, template, status, response_body AS value, min(seq) AS seq "
        "FROM t WHERE json_valid(response_body) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY host, method, "
        "template, status ORDER BY seq) AS sample FROM d) SELECT host, method, template, status, sample, value FROM r",
    "c08_graphql_operation": f"WITH {_API} SELECT seq, {_SAFE_OP} AS op FROM api WHERE contains(pathname, 'graphql')",
    "c09_endpoint_catalog": f"WITH {_API}, q AS (SELECT host, method, pathname, string_agg(DISTINCT k, ', ' ORDER BY k) AS query_keys "
        "FROM (SELECT host, method, pathname, regexp_extract(unnest(string_split(qs, '&')), '^[^=]*') AS k FROM api) GROUP BY 1, 2, 3), "
        "o AS (SELECT *, CASE WHEN contains(pathname, 'graphql') AND json_valid(request_body) THEN nullif(request_body ->> "
        "'$.operationName', '') END AS op FROM api), g AS (SELECT host, method, pathname, count(*) AS samples, "
        "string_agg(DISTINCT CAST(status AS STRING), ', ' ORDER BY CAST(status AS STRING)) AS statuses, string_agg(DISTINCT "
        "resp_mime, ', ' ORDER BY resp_mime) AS content_types, coalesce(string_agg(DISTINCT op, ', ' ORDER BY op), '') AS operations, "
        "bool_or(contains(resp_mime, 'event-stream')) AS streaming, min_by(request_body, seq) FILTER (json_valid(request_body)) AS "
        "request_sample, min_by(response_body, seq) FILTER (json_valid(response_body)) AS response_sample FROM o GROUP BY 1, 2, 3) "
        "SELECT g.*, q.query_keys FROM g JOIN q USING (host, method, pathname)",
    "c10_api_summary": f"WITH {_API}, {_TEMPLATE}, o AS (SELECT host, method, template, count(*) AS n FROM t GROUP BY 1, 2, 3) SELECT "
        "host, count(DISTINCT host) AS hosts, count(*) AS operations, CAST(sum(n) AS BIGINT) AS calls FROM o GROUP BY ROLLUP (host)",
    "c11_query_signature": f"WITH {_API} SELECT seq, {_SIG} AS signature FROM api",
    "c12_canonical_json": f"WITH {_API} SELECT seq, {_canon_sql('request_body')} AS request, {_canon_sql('response_body')} AS response "
        "FROM api",
    "c13_stable_hash": f"SELECT conv_id, turn, {_fnv_sql('text')} AS hash FROM conversations",
    "c14_body_hash": f"WITH {_API}, t AS (SELECT * FROM api), {_HASHED} SELECT seq, body_hash AS hash FROM keyed",
    "c15_fixtures": _FIX + " SELECT host, method, template, status, query_sig, body_hash, op, samples, seq, f.response_body AS response,"
        " f.resp_mime AS content_type, contains(f.resp_mime, 'event-stream') AS is_stream, 'content-type=application/json;"
        "x-ratelimit-remaining=' || regexp_extract(f.resp_header_lines, 'Remaining: ([0-9]+)', 1) AS headers FROM fixtures",
    "c16_stable_bodies": f"WITH {_CALLS}, d AS ({_DATED}) SELECT seq, x.path, x.value FROM d, (VALUES ('$.createdAt', "
        "'2024-01-01T00:00:00.000Z'), ('$.name', '2024-05-06T07:08:09Z'), ('$.log[0].updated_at', NULL), ('$.n', NULL)) AS x(path, value) "
        "WHERE x.value IS NOT NULL UNION ALL SELECT seq, '$.log[0].updated_at', CASE WHEN seq % 2 = 0 THEN '2024-01-01T00:00:00.000Z' "
        "ELSE 'yesterday' END FROM calls UNION ALL SELECT seq, '$.n', CAST(seq AS STRING) FROM calls",
    "c17_crud_roles": _FIX + ", r AS (SELECT method, template, op, contains(f.resp_mime, 'event-stream') AS is_stream, CASE WHEN op IS "
        "NOT NULL OR contains(f.resp_mime, 'event-stream') THEN NULL WHEN method = 'GET' AND ends_with(template, '}') THEN 'get' WHEN "
        "method = 'GET' THEN 'list' WHEN method = 'POST' AND NOT ends_with(template, '}') THEN 'create' WHEN method = 'PUT' AND "
        "ends_with(template, '}') THEN 'update' END AS crud FROM fixtures) SELECT method, template, op, is_stream, crud, CASE WHEN crud "
        "IS NOT NULL THEN regexp_extract(regexp_replace(template, '(/\\{[^}]+\\})+$', ''), '([^/]+)$', 1) END AS resource, count(*) AS "
        "variants FROM r GROUP BY ALL",
    "c18_routes": _FIX + ", r AS (SELECT *, CASE WHEN op IS NOT NULL OR contains(f.resp_mime, 'event-stream') THEN NULL WHEN method = "
        "'GET' AND ends_with(template, '}') THEN 'get' WHEN method = 'GET' THEN 'list' WHEN method = 'POST' AND NOT ends_with(template,"
        " '}') THEN 'create' WHEN method = 'PUT' AND ends_with(template, '}') THEN 'update' END AS crud FROM fixtures) SELECT seq, "
        "method, template, CASE WHEN crud IS NOT NULL THEN regexp_extract(regexp_replace(template, '(/\\{[^}]+\\})+$', ''), "
        "'([^/]+)$', 1) END AS resource, crud, replace(replace(query_sig, '=', ':'), '&', '|') AS match_query FROM r",
    "c19_best_route": _FIX + f", ask0 AS (SELECT seq AS request_id, method, pathname, {_SAFE_OP} AS op, coalesce("
        f"{_canon_sql('request_body')}, '\"' || request_body || '\"') AS canon, CASE WHEN seq % 6 = 5 THEN '' ELSE 'page=' || (seq * 7 %"
        " 6) || CASE WHEN seq % 8 = 0 THEN '&tag=a,b&z=1' ELSE '' END END AS sig FROM calls), asks AS MATERIALIZED (SELECT *, CASE WHEN canon IS "
        f"NULL OR op IS NOT NULL THEN '' ELSE {_fnv_sql('canon')} END AS bh FROM ask0), rx AS MATERIALIZED (SELECT method, template, seq AS "
        "route_seq, op, body_hash, query_sig, '^' || regexp_replace(template, '\\{[^}]+\\}', '[^/]+', 'g') || '$' AS re FROM fixtures), "
        "cand AS MATERIALIZED (SELECT a.request_id, tp.template FROM (SELECT DISTINCT request_id, method, pathname FROM asks) a JOIN (SELECT "
        "DISTINCT method, template, re FROM rx) tp ON a.method = tp.method AND regexp_matches(a.pathname, tp.re)), scored AS (SELECT "
        "a.request_id, r.template, r.route_seq, 1 + CASE WHEN r.op = a.op THEN 100 ELSE 0 END + CASE WHEN r.body_hash <> '' AND "
        "r.body_hash = a.bh THEN 50 ELSE 0 END + CASE WHEN r.query_sig <> '' AND r.query_sig = a.sig THEN 25 WHEN r.query_sig <> '' AND "
        "a.sig <> '' AND contains(a.sig, r.query_sig) THEN 5 WHEN r.query_sig = '' AND a.sig = '' THEN 2 ELSE 0 END AS score FROM asks a "
        "JOIN cand c ON c.request_id = a.request_id JOIN rx r ON r.method = a.method AND r.template = c.template) SELECT request_id, "
        "arg_max(template, CAST(score AS BIGINT) * 1000000000 - route_seq) AS template, arg_max(route_seq, CAST(score AS BIGINT) * 1000000000 - route_seq) AS route_seq, max(score) AS score "
        "FROM scored GROUP BY request_id",
    "c20_resource_state": f"WITH log AS ({A.CRUD_SQL}), base AS (SELECT resource, id, max(seq) AS b FROM log WHERE op <> 'merge' GROUP BY "
        "1, 2), laid AS (SELECT log.* FROM log LEFT JOIN base USING (resource, id) WHERE op <> 'delete' AND seq >= coalesce(b, seq)), f AS "
        "(SELECT resource, laid.id, seq, e.key AS field, CAST(e.value AS VARCHAR) AS value FROM laid, json_each(laid.body) e UNION ALL SELECT "
        "resource, id, seq, 'id', '\"' || id || '\"' FROM laid WHERE op = 'create') SELECT resource, id, field, max_by(value, seq) AS "
        "value FROM f GROUP BY 1, 2, 3",
    "c20_record_lookup": "WITH r AS (SELECT 'band' || CAST(floor(s_acctbal / 100) AS BIGINT) AS resource, CAST(s_suppkey AS STRING) AS id "
        "FROM supplier), a AS (SELECT resource, id || CASE WHEN CAST(id AS BIGINT) % 2 = 0 THEN 'x' ELSE '' END AS id FROM r) SELECT "
        "a.resource, a.id, CASE WHEN EXISTS (SELECT 1 FROM r WHERE r.resource = a.resource AND r.id = a.id) THEN a.id WHEN (SELECT "
        "count(*) FROM r WHERE r.resource = a.resource) = 1 THEN (SELECT min(id) FROM r WHERE r.resource = a.resource) END AS found_id "
        "FROM a",
    "c21_unwrap_records": f"WITH d AS (SELECT o_orderkey AS seq, {_ENVELOPE} AS response FROM orders), x AS (SELECT seq, response, CASE "
        "WHEN json_type(response) = 'ARRAY' THEN CAST(response AS JSON) ELSE coalesce(json_extract(response, '$.data'), json_extract("
        "response, '$.results'), json_extract(response, '$.nodes')) END AS arr FROM d) SELECT seq, true AS wrapped, CAST(e.key AS BIGINT) "
        "AS pos, CAST(e.value AS VARCHAR) AS record FROM x, json_each(x.arr) e WHERE arr IS NOT NULL UNION ALL SELECT seq, false, 0, "
        f"{_canon_sql('response')} FROM x WHERE arr IS NULL AND json_type(response) = 'OBJECT'",
    "c22_hydrate_collection": f"WITH d AS (SELECT o_orderkey AS seq, {_ENVELOPE} AS response FROM orders), x AS (SELECT seq, response, "
        "CASE WHEN json_type(response) = 'ARRAY' THEN CAST(response AS JSON) ELSE coalesce(json_extract(response, '$.data'), "
        "json_extract(response, '$.results'), json_extract(response, '$.nodes')) END AS arr FROM d), r AS (SELECT seq, CAST(e.key AS "
        "BIGINT) AS pos, e.value AS j FROM x, json_each(x.arr) e WHERE arr IS NOT NULL UNION ALL SELECT seq, 0, CAST(response AS JSON) "
        "FROM x WHERE arr IS NULL AND json_type(response) = 'OBJECT') SELECT seq, coalesce(j ->> '$.id', j ->> '$._id', j ->> '$.slug', "
        "j ->> '$.name', j ->> '$.key', j ->> '$.uuid', CAST(pos + 1 AS STRING)) AS record_id, " + _canon_sql("j") + " AS record FROM r",
    "c23_path_templates": f"WITH {_API}, {_TEMPLATE} SELECT host, pathname, template, params FROM templates",
    "s03_body_sidecar": f"WITH {_CALLS}, b0 AS ({A.select_sql(A.BODIES, 'calls')}), b1 AS (SELECT * FROM b0 UNION ALL SELECT method, url, "
        "seq + 1000000000, response_type, request_type, request_body, '{\"late\":1}' FROM b0 WHERE seq % 4 = 0), b2 AS (SELECT method || "
        "' ' || regexp_replace(url, '#.*$', '') AS k, seq, request_body, CASE WHEN response_type LIKE '%json%' OR contains(url, "
        "'graphql') THEN response_body END AS response_body FROM b1), b3 AS (SELECT k, min_by(struct_pack(q := request_body, r := "
        "response_body), seq) AS b FROM b2 WHERE request_body IS NOT NULL OR response_body IS NOT NULL GROUP BY k) SELECT seq, b.q AS "
        "request_body, b.r AS response_body FROM calls LEFT JOIN b3 ON k = method || ' https://' || host || pathname || '?' || qs",
    "s04_stream_frames": f"WITH x AS ({A.select_sql(A.FRAMES, 'conversations')}), s AS (SELECT conv_id || '/' || turn AS stream_key, "
        "content_type, ' data: one' || chr(13) || chr(10) || chr(10) || replace(text, '. ', '.' || chr(10) || chr(10)) || chr(10) || "
        "chr(10) || '  ' AS text FROM x), f AS (SELECT stream_key, list_filter(list_transform(CASE WHEN content_type LIKE "
        "'%event-stream' THEN regexp_split_to_array(text, '\\n\\n+') ELSE regexp_split_to_array(text, '\\r?\\n') END, lambda v: "
        "regexp_replace(v, '^\\s+|\\s+$', '', 'g')), lambda v: v <> '') AS fs FROM s) SELECT stream_key, unnest(fs) AS frame, "
        "generate_subscripts(fs, 1) - 1 AS pos FROM f",
    "s05_socket_frames": "WITH l AS (SELECT 'wss://live.example.com/' || conv_id AS socket, conv_id * 1000 + turn AS seq, CASE role WHEN "
        "'user' THEN 'send' ELSE 'recv' END || ': ' || CASE WHEN turn % 3 = 2 THEN '[binary]' ELSE text END AS frame FROM "
        "conversations), k AS (SELECT socket FROM l GROUP BY socket), n AS (SELECT *, row_number() OVER "
        "(PARTITION BY socket ORDER BY seq) AS frame_no FROM l WHERE socket IN (SELECT socket FROM k)) SELECT socket, frame_no, frame FROM "
        "n",
    "s09_stylesheet_budget": f"WITH {S.view('css', A.CSS_TEXTS, 'part')}, a AS (SELECT list(struct_pack(q := seq, n := strlen(css)) ORDER "
        "BY seq) AS l FROM css), k AS (SELECT unnest(list_reduce(l, lambda acc, x: CASE WHEN acc.used + x.n <= 20000 THEN struct_pack(used "
        ":= acc.used + x.n, ids := list_append(acc.ids, x.q)) ELSE acc END, struct_pack(used := CAST(0 AS BIGINT), ids := CAST([] AS "
        "BIGINT[]))).ids) AS seq FROM a) SELECT seq, url, strlen(css) AS bytes FROM css WHERE seq IN (SELECT seq FROM k)",
}
