"""Entity graph queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import rules as R
from ..operators import entities as E
from ..operators import owners as O
from ..sources import adapters as A
from . import sqltext as S


def _records(spark, sf):
    return E.document_records(A.entity_docs(spark, sf))


def e06(spark, sf):
    paths = A.entity_docs(spark, sf).select("path").unionByName(A.calls(spark, sf).select(F.col("pathname").alias("path"))).distinct()
    return paths.select("path", E.path_entity(F.col("path")).alias("e")).select("path", "e.type", "e.id")


def _listing(spark, sf):
    return E.listing_records(A.listing_rows(spark, sf))


def f07(spark, sf):
    docs = E.document_records(A.entity_docs(spark, sf).select("path", "seq", "url", "json").unionByName(A.owner_docs(spark, sf)))
    return O.evidenced_owners(docs, _listing(spark, sf))


QUERIES = {
    "f07_evidenced_owners": f07,
    "e06_path_entity": e06,
    "e07_entities": lambda spark, sf: E.entities(_records(spark, sf)),
    "e07_entity_fields": lambda spark, sf: E.entity_fields(_records(spark, sf)),
    "e07_listing_entities": lambda spark, sf: E.entities(_listing(spark, sf)),
    "e08_relation_edges": lambda spark, sf: E.relation_edges(_records(spark, sf)),
    "e08_listing_edges": lambda spark, sf: E.relation_edges(_listing(spark, sf)),
}

_DOCS = f"docs AS ({A.select_sql(A.ENTITY_DOCS, A.ENTITY_DOCS_SQL)})"
_REC = (_DOCS + ", rec AS (SELECT CASE o % 4 WHEN 0 THEN 'model' WHEN 1 THEN 'dataset' ELSE 'space' END AS type, coalesce(json ->> '$.id', regexp_extract(path, "
        "'([^/]+)$', 1)) AS id, url, seq, json FROM (SELECT *, seq AS o FROM docs) WHERE o % 4 <> 3 AND (o % 5 <> 0 OR o % 10 = 0))")
_EDGE = (_REC + ", links AS (SELECT type, id, seq, 'author' AS rel, 'user' AS dt, coalesce(nullif(json ->> '$.author.login', ''), CASE WHEN json_type(json, '$.author') = "
         "'VARCHAR' THEN nullif(json ->> '$.author', '') END, json ->> '$.owner') AS di, seq % 7 = 0 AS obj FROM rec UNION ALL SELECT type, id, seq, 'in-org', 'org', json ->> '$.org', false "
         "FROM rec UNION ALL SELECT type, id, seq, 'uses-dataset', 'dataset', unnest(json_extract_string(json, ['$.datasets[0]', '$.datasets[1]'])), false FROM rec WHERE seq % 10 <> 0 UNION ALL "
         "SELECT type, id, seq, 'author', 'user', split_part(id, '/', 1), false FROM rec WHERE contains(id, '/'))")
_TYPES = "map {" + ", ".join(f"'{k}': '{v}'" for k, v in R.ENTITY_TYPES.items()) + "}"
_LIST = ("l AS (" + A.select_sql(A.LISTING_ROWS, "customer") + "), r AS (SELECT 'model' AS type, CASE WHEN href IS NULL THEN title WHEN contains(href, '/datasets/') THEN "
         "regexp_extract(href, 'datasets/(.*)$', 1) WHEN starts_with(href, '/') THEN substr(href, 2) ELSE regexp_extract(href, 'com/(.*)$', 1) END AS id, href AS url, seq, row_no, "
         "author FROM l)")

_OWNERS = (f"WITH {_EDGE}, {_LIST}, o AS (" + A.select_sql(A.OWNER_ROWS, "customer WHERE c_custkey % 3 <> 0 OR c_nationkey < 12") + "), ids AS (SELECT type, id FROM rec UNION SELECT 'model', id FROM o "
           "WHERE kind = 'models'), ca AS (SELECT DISTINCT type, id, string_split(id, '/')[-2] AS owner FROM ids WHERE contains(id, '/') AND split_part(id, '/', 1) <> 'docs'), ev AS (SELECT lower(di) AS "
           "name, 'named' AS kind, type || '/' || id AS source, seq FROM links WHERE di IS NOT NULL AND (rel = 'in-org' OR (rel = 'author' AND di IS DISTINCT FROM split_part(id, '/', 1))) UNION ALL SELECT lower(author), "
           "'named', 'model/' || id, seq FROM r UNION ALL SELECT lower(author), 'named', 'model/' || id, seq FROM o WHERE kind = 'models' AND author IS NOT NULL UNION ALL SELECT id, 'record', 'user/' || id, seq FROM o WHERE kind = "
           "'users'), ps AS (SELECT name, kind, source, min(seq) AS seq FROM ev GROUP BY 1, 2, 3), fo AS (SELECT name, count(*) FILTER (kind = 'named') AS sources, count(*) FILTER (kind = 'record') AS records, arg_min(source, "
           "{'a': seq, 'b': source}) AS first_source FROM ps GROUP BY 1), jo AS (SELECT ca.*, coalesce(sources, 0) AS sources, coalesce(records, 0) AS records, first_source FROM ca LEFT JOIN fo ON name = lower(owner)), sc AS "
           "(SELECT *, CASE WHEN records > 0 THEN 3 ELSE 0 END + sources AS p FROM jo) ")

ORACLES = {
    "f07_evidenced_owners": _OWNERS + "SELECT type, id, owner, sources, records, floor(p / (p + 1.0) * 1000 + 0.5) / 1000.0 AS score, first_source, p > 0 AS linked FROM sc",
    "e06_path_entity": f"WITH {_DOCS}, {S.view('calls', A.CALLS, 'events')}, p AS (SELECT path FROM docs UNION SELECT pathname FROM calls), s AS (SELECT path, list_filter(string_split(path, '/'), "
        f"lambda x: x <> '' AND x <> 'api') AS g, {_TYPES} AS m FROM p), k AS (SELECT path, g, m, list_filter(generate_series(1, len(g)), lambda i: m[lower(g[i])] IS NOT NULL)[1] AS i FROM s) SELECT path, m[lower(g[i])] "
        "AS type, CASE WHEN m[lower(g[i + 1])] IS NULL THEN g[i + 1] END AS id FROM k",
    "e07_entities": f"WITH {_EDGE}, a AS (SELECT type, id, url, seq FROM rec UNION ALL SELECT dt, di, NULL, seq FROM links) SELECT type, id, arg_min(url, seq) FILTER (url IS NOT NULL) AS url FROM a GROUP BY 1, 2",
    "e07_entity_fields": f"WITH {_EDGE}, f AS (SELECT type, id, seq * 2 AS turn, e.key AS field, CAST(e.value AS VARCHAR) AS value FROM rec, json_each(rec.json) e WHERE e.type NOT IN ('OBJECT', 'NULL') UNION ALL SELECT dt, di, seq * 2 + 1, 'login', '\"' || di || '\"' FROM links "
        "WHERE obj) SELECT type, id, field, max_by(value, turn) AS value FROM f GROUP BY 1, 2, 3".replace("SELECT type, id, seq * 2 AS turn", "SELECT rec.type, rec.id, seq * 2 AS turn"),
    "e07_listing_entities": f"WITH {_LIST}, a AS (SELECT type, id, url, seq FROM r UNION ALL SELECT 'user', author, NULL, seq FROM r UNION ALL SELECT 'user', split_part(id, '/', 1), NULL, seq FROM r WHERE contains(id, '/')) SELECT type, id, arg_min(url, seq) FILTER (url IS NOT "
        "NULL) AS url FROM a GROUP BY 1, 2",
    "e08_relation_edges": f"WITH {_EDGE} SELECT DISTINCT type || '/' || id AS src, dt || '/' || di AS dst, rel FROM links",
    "e08_listing_edges": f"WITH {_LIST} SELECT 'model/' || id AS src, 'user/' || author AS dst, 'author' AS rel FROM r UNION SELECT 'model/' || id, 'user/' || split_part(id, '/', 1), 'author' FROM r WHERE contains(id, '/')",
}
