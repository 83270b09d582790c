"""Redaction and normalisation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import rules as R
from ..functions import redact as X
from ..functions.core import spread
from ..operators import json_tables as J
from ..sources import adapters as A
from . import sqltext as S


def _texts(spark, sf):
    """Documents, pages and short texts that hold every shape."""
    docs = A.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    pages = A.table(spark, sf, "pages").select((F.col("page_id") + 1000000000).alias("id"),
                                               F.col("html").alias("text"))
    return spread(docs.unionByName(pages).unionByName(A.snippets(spark, sf).select(
        (F.col("seq") + 2000000000).alias("id"), "text")), "id")


_TEXTS = (S.view("snippets", A.SNIPPETS, "events") + ", texts AS (SELECT doc_id AS id, text FROM documents UNION ALL "
          "SELECT page_id + 1000000000, html FROM pages UNION ALL SELECT seq + 2000000000, text FROM snippets)")


def _rewritten(fn):
    def run(spark, sf):
        out = _texts(spark, sf).withColumn("out", fn(F.col("text")))
        return out.select("id", F.md5("out").alias("digest"), (F.col("out") != F.col("text")).alias("changed"))
    return run


def _rewritten_sql(steps):
    """Apply (pattern, replacement) pairs one after the other."""
    e = "text"
    for pattern, mark in steps:
        e = f"regexp_replace({e}, '{pattern}', '{mark}', 'g')"
    return f"WITH {_TEXTS}, o AS (SELECT id, text, {e} AS out FROM texts) SELECT id, md5(out) AS digest, out <> text AS changed FROM o"


def r01(spark, sf):
    names = A.calls(spark, sf).select(F.explode(F.concat("query", "req_headers", "resp_headers")).alias("p"))
    return names.groupBy(F.col("p.name").alias("name")).agg(F.count(F.lit(1)).alias("n")).withColumn(
        "sensitive", X.is_sensitive_name(F.col("name")))


def r02(spark, sf):
    from ..operators.calls import header_map
    masked = A.calls(spark, sf).select("seq", X.redact_map(header_map(F.col("req_headers"))).alias("h"))
    return masked.select("seq", F.explode("h").alias("name", "value"))


def r03(spark, sf):
    from ..operators.calls import query_map
    masked = A.calls(spark, sf).select("seq", X.redact_multimap(query_map(F.col("query"))).alias("q"))
    return masked.select("seq", F.explode("q").alias("name", "values")).select(
        "seq", "name", F.array_join("values", ",").alias("value"))


def _json_calls(spark, sf):
    """Flat call bodies and nested chat documents."""
    flat = A.calls(spark, sf).filter("response_body is not null").select("seq", F.col("response_body").alias("json"))
    deep = A.json_docs(spark, sf).select((F.col("seq") + 5000000000).alias("seq"), "json")
    secret = A.snippets(spark, sf).filter("not contains(text, '\"')").select(
        (F.col("seq") + 7000000000).alias("seq"), F.concat(F.lit('{"deep":[{"note":"'), "text", F.lit('"}]}')).alias("json"))
    return flat.unionByName(deep).unionByName(secret)


_JSON = (S.view("calls", A.CALLS, "events") + ", " + S.view("docs", A.JSON_DOCS, "conversations") + ", " +
         S.view("snippets", A.SNIPPETS, "events") + ", j AS (SELECT seq, response_body AS json FROM calls WHERE "
         "response_body IS NOT NULL UNION ALL SELECT seq + 5000000000, json FROM docs UNION ALL SELECT seq + 7000000000, "
         "'{\"deep\":[{\"note\":\"' || text || '\"}]}' FROM snippets WHERE NOT contains(text, '\"')), t AS (SELECT j.seq, "
         "n.fullkey AS path, n.key, n.type, n.atom, n.json AS node FROM j, json_tree(j.json) n)")
# Text of a leaf as JSON prints it.
_ATOM = "CASE WHEN type = 'NULL' THEN NULL WHEN type = 'VARCHAR' THEN atom ->> '$' ELSE CAST(atom AS VARCHAR) END"
_SENS = R.SENSITIVE_NAME


def r04(spark, sf):
    return J.redacted_leaves(_json_calls(spark, sf), ["seq"])


def r06(spark, sf):
    return J.redacted_leaves(_json_calls(spark, sf), ["seq"], value_shapes=True)


def r11(spark, sf):
    return A.actions(spark, sf).groupBy("label").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "label_key", X.label_key(F.col("label")))


QUERIES = {
    "r01_sensitive_names": r01,
    "r02_redact_headers": r02,
    "r03_redact_query": r03,
    "r04_redact_json_keys": r04,
    "r05_redact_secrets": _rewritten(X.redact_secrets),
    "r05_redact_secrets_emails": _rewritten(lambda c: X.redact_secrets(c, emails=True)),
    "r06_redact_json_values": r06,
    "r07_scrub_html": _rewritten(X.scrub_html),
    "r08_normalize_text": _rewritten(X.normalize_text),
    "r09_normalize_html": _rewritten(X.normalize_html),
    "r11_label_key": r11,
}

_CALLS = S.view("calls", A.CALLS, "events")


def _secrets(e: str, emails: bool = False) -> str:
    """Same rules without look-around: find long runs first, then test what they hold."""
    mark = "[REDACTED]"
    s = f"regexp_replace({e}, '{S.b(R.SECRET_JWT)}', '{mark}', 'g')"
    s = f"regexp_replace({s}, '\\b((?i:Bearer|token))\\s+[A-Za-z0-9._~+/=-]{{12,}}', '\\1 {mark}', 'g')"
    s = f"regexp_replace({s}, '{S.b(R.SECRET_PREFIXED)}', '{mark}', 'g')"
    hexes = ("list_filter(regexp_extract_all({0}, '(?i)\\b[0-9a-f]{{40,}}\\b'), lambda h: regexp_matches(h, '(?i)[a-f]')"
             " AND regexp_matches(h, '[0-9]'))")
    blobs = ("list_filter(regexp_extract_all({0}, '\\b[A-Za-z0-9+/_-]{{40,}}={{0,2}}\\b'), lambda h: regexp_matches(h, '[A-Z]')"
             " AND regexp_matches(h, '[a-z]') AND regexp_matches(h, '[0-9]'))")
    for finder in (hexes, blobs):
        s = (f"(SELECT list_reduce({finder.format('q.s')}, lambda a, h: replace(a, h, '{mark}'), q.s) FROM (SELECT {s} AS s) q)")
    if emails:
        s = f"regexp_replace({s}, '{S.b(R.SECRET_EMAIL)}', '{mark}', 'g')"
    return f"CASE WHEN length({e}) < 12 THEN {e} ELSE {s} END"


def _secrets_sql(emails: bool) -> str:
    return (f"WITH {_TEXTS}, o AS (SELECT id, text, {_secrets('text', emails)} AS out FROM texts) SELECT id, md5(out) "
            "AS digest, out <> text AS changed FROM o")


_NORMAL = [(S.b(p), m) for p, m in R.VOLATILE_TEXT]
_BLANK = []
for _name in R.VOLATILE_ATTRS:
    _BLANK += [(f'(?i)(\\b{_name}\\s*=\\s*)"[^"\'\']*"', '\\1""'), (f"(?i)(\\b{_name}\\s*=\\s*)''[^\"'']*''", "\\1''''")]

_MASKED = (f"m AS (SELECT *, regexp_matches(coalesce(key, ''), '{_SENS}') AS hit FROM t), h AS (SELECT seq, path FROM m WHERE "
           "hit)")
_LEAVES = ("SELECT m.seq, m.path, {value} AS value FROM m WHERE m.type NOT IN ('OBJECT', 'ARRAY') AND NOT hit AND NOT EXISTS "
           "(SELECT 1 FROM h WHERE h.seq = m.seq AND (starts_with(m.path, h.path || '.') OR starts_with(m.path, h.path || '[')))"
           " UNION ALL SELECT seq, path, '[REDACTED]' FROM h")

ORACLES = {
    "r01_sensitive_names": f"WITH {_CALLS}, p AS (SELECT unnest(list_transform(string_split(qs, '&'), lambda s: "
                           "regexp_extract(s, '^[^=]*'))) AS name FROM calls UNION ALL SELECT regexp_extract(unnest("
                           "string_split(req_header_lines || chr(10) || resp_header_lines, chr(10))), '^[^:]*') FROM calls) "
                           f"SELECT name, count(*) AS n, lower(name) IN ({S.quoted(R.SENSITIVE_HEADERS)}) OR regexp_matches("
                           f"name, '{_SENS}') AS sensitive FROM p GROUP BY name",
    "r02_redact_headers": f"WITH {_CALLS}, l AS (SELECT seq, unnest(string_split(req_header_lines, chr(10))) AS line, "
                          "generate_subscripts(string_split(req_header_lines, chr(10)), 1) AS i FROM calls), h AS (SELECT seq,"
                          " lower(regexp_extract(line, '^[^:]*')) AS name, max_by(regexp_extract(line, ': (.*)$', 1), i) AS v"
                          " FROM l GROUP BY 1, 2) SELECT seq, name, CASE WHEN regexp_matches(name, "
                          f"'{_SENS}') OR name IN ({S.quoted(R.SENSITIVE_HEADERS)}) THEN '[REDACTED]' ELSE v END AS value FROM h",
    "r03_redact_query": f"WITH {_CALLS}, l AS (SELECT seq, unnest(string_split(qs, '&')) AS line, generate_subscripts("
                        "string_split(qs, '&'), 1) AS i FROM calls), q AS (SELECT seq, regexp_extract(line, '^[^=]*') AS name,"
                        " string_agg(regexp_extract(line, '=(.*)$', 1), ',' ORDER BY i) AS v FROM l GROUP BY 1, 2) SELECT seq,"
                        f" name, CASE WHEN regexp_matches(name, '{_SENS}') THEN '[REDACTED]' ELSE v END AS value FROM q",
    "r04_redact_json_keys": f"WITH {_JSON}, {_MASKED} " + _LEAVES.replace("{value}", _ATOM),
    "r05_redact_secrets": _secrets_sql(False),
    "r05_redact_secrets_emails": _secrets_sql(True),
    "r06_redact_json_values": f"WITH {_JSON}, {_MASKED}, lv AS (SELECT m.seq, m.path, m.type, {_ATOM} AS a FROM m WHERE m.type "
                              "NOT IN ('OBJECT', 'ARRAY') AND NOT hit AND NOT EXISTS (SELECT 1 FROM h WHERE h.seq = m.seq AND "
                              "(starts_with(m.path, h.path || '.') OR starts_with(m.path, h.path || '[')))) SELECT seq, path, "
                              f"CASE WHEN type = 'VARCHAR' THEN {_secrets('a')} ELSE a END AS value FROM lv UNION ALL SELECT "
                              "seq, path, '[REDACTED]' FROM h",
    "r07_scrub_html": _rewritten_sql([(S.b(p), m.replace("$1", "\\1").replace("$2", "\\2")) for p, m in R.HTML_SECRETS]),
    "r08_normalize_text": _rewritten_sql(_NORMAL),
    "r09_normalize_html": _rewritten_sql(_BLANK + _NORMAL),
    "r11_label_key": f"WITH {S.view('actions', A.ACTIONS, 'events')} SELECT label, count(*) AS n, trim(regexp_replace("
                     "regexp_replace(lower(label), '[0-9]', '#', 'g'), '\\s+', ' ', 'g')) AS label_key FROM actions GROUP BY label",
}
