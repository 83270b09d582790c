"""Accessibility-tree queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from .. import rules as R
from ..operators import dom as D
from ..operators import trees as X
from ..sources import adapters as A
from . import domsql as M
from . import sqltext as S


def page_nodes(spark, sf):
    return X.nodes_from_dom(D.stored_nodes(A.table(spark, sf, "pages")))


def page_pairs(spark, sf):
    """Each page with the next one."""
    return A.table(spark, sf, "pages").select(F.col("page_id").alias("expected_id"), (F.col("page_id") + 1).alias("actual_id"))


_TREE = ("'{\"tree\":{\"role\":\"RootWebArea\",\"name\":\"x\",\"children\":[{\"role\":\"heading\",\"name\":\" ' || c_name || ' \",\"children\":[{\"role\":\"\",\"children\":[{\"role\":\"link\",\"name\":' || "
         "CAST(c_nationkey AS STRING) || '},{\"role\":\"/url\",\"name\":\"u\"}]},{\"role\":\"text\"}]},{\"name\":\"norole\"},{\"role\":\"button\",\"name\":true}' || CASE WHEN c_custkey % 3 = 0 THEN "
         "',{\"role\":\"img\",\"name\":null}' ELSE '' END || ']}}'")


def x01(spark, sf):
    return X.tree_json_nodes(A.table(spark, sf, "customer").selectExpr("c_custkey AS tree_id", _TREE + " AS json"))


def x06(spark, sf):
    scores = X.tree_scores(page_nodes(spark, sf), page_pairs(spark, sf))
    return X.gate(scores, 0.05).select("expected_id", "actual_id", "pass").join(
        X.gate(scores, 0.05, exact=True).select("expected_id", "actual_id", F.col("pass").alias("exact_pass")), ["expected_id", "actual_id"])


def r10(spark, sf):
    texts = A.snippets(spark, sf).select(F.col("seq").alias("tree_id"), F.lit(0).alias("pos"), F.lit("text").alias("role"), F.col("text").alias("name"), F.lit(0).alias("depth"))
    return X.normalize_names(texts).select("tree_id", "role", "name")


QUERIES = {
    "x01_tree_json": x01,
    "x02_tree_text": lambda spark, sf: X.tree_text_nodes(A.tree_texts(spark, sf)),
    "x03_tree_parents": lambda spark, sf: X.with_parents(X.tree_text_nodes(A.tree_texts(spark, sf))).select("tree_id", "pos", "parent_pos"),
    "x04_tree_scores": lambda spark, sf: X.tree_scores(page_nodes(spark, sf), page_pairs(spark, sf)),
    "x05_tree_surplus": lambda spark, sf: X.tree_surplus(page_nodes(spark, sf), page_pairs(spark, sf)),
    "x06_tree_gate": x06,
    "r10_normalize_names": r10,
}

_YAML = ("y AS (" + A.select_sql(A.TREE_TEXTS, "conversations") + "), ln AS (SELECT tree_id, unnest(regexp_split_to_array(yaml, '\\r?\\n')) AS line, generate_subscripts(regexp_split_to_array(yaml, "
         "'\\r?\\n'), 1) AS i FROM y), pr AS (SELECT tree_id, i, regexp_extract(line, '^([ \\t]*)', 1) AS ind, trim(regexp_replace(trim(line, ' ' || chr(9)), '^-', '')) AS body FROM ln WHERE trim(line, ' ' || "
         "chr(9)) NOT IN ('', '-', '---', '...')), nd AS (SELECT tree_id, i, trim(regexp_extract(body, '^([^\":\\[]*)', 1)) AS role, regexp_replace(regexp_extract(body, '^[^\"]*\"((?:[^\"\\\\]|\\\\.)*)', 1), "
         "'\\\\(.)', '\\1', 'g') AS name, (length(ind) + length(replace(ind, ' ', ''))) // 2 AS depth FROM pr), fl AS (SELECT tree_id, row_number() OVER (PARTITION BY tree_id ORDER BY i) - 1 AS pos, role, name, depth "
         "FROM nd WHERE role <> '' AND NOT starts_with(role, '/'))")
_AX = ("WITH " + M.dom("SELECT page_id, url, html FROM pages") + ", ax AS (SELECT page_id AS tree_id, pos, CASE tag WHEN 'a' THEN 'link' WHEN 'li' THEN 'listitem' WHEN 'h1' THEN 'heading' WHEN 'nav' THEN "
       "'navigation' WHEN 'article' THEN 'article' ELSE 'paragraph' END AS role, text AS name FROM el WHERE tag IN ('a', 'li', 'h1', 'nav', 'article', 'p')), ct AS (SELECT tree_id, role, name, count(*) AS n FROM "
       "ax GROUP BY 1, 2, 3), sz AS (SELECT tree_id, CAST(sum(n) AS BIGINT) AS n FROM ct GROUP BY 1), pairs AS (SELECT page_id AS e, page_id + 1 AS a FROM pages), sh AS (SELECT p.e, p.a, CAST(sum(least(l.n, r.n)) AS "
       "BIGINT) AS shared FROM pairs p JOIN ct l ON l.tree_id = p.e JOIN ct r ON r.tree_id = p.a AND r.role = l.role AND r.name = l.name GROUP BY 1, 2), sc AS (SELECT p.e AS expected_id, p.a AS actual_id, coalesce(x.n, 0) AS "
       "expected_nodes, coalesce(y.n, 0) AS actual_nodes, coalesce(shared, 0) AS shared, CASE WHEN coalesce(x.n, 0) + coalesce(y.n, 0) = 0 THEN 1.0 ELSE floor(coalesce(shared, 0) * 2.0 / (coalesce(x.n, 0) + coalesce(y.n, "
       "0)) * 1000 + 0.5) / 1000.0 END AS score FROM pairs p LEFT JOIN sz x ON x.tree_id = p.e LEFT JOIN sz y ON y.tree_id = p.a LEFT JOIN sh ON sh.e = p.e AND sh.a = p.a)")
_SIDE = ("SELECT p.e AS expected_id, p.a AS actual_id, '{side}' AS side, x.pos, x.role, x.name, row_number() OVER (PARTITION BY p.e, p.a, x.role, x.name ORDER BY x.pos) AS k, l.n - coalesce(r.n, 0) AS quota FROM pairs p JOIN ax x "
         "ON x.tree_id = p.{own} JOIN ct l ON l.tree_id = p.{own} AND l.role = x.role AND l.name = x.name LEFT JOIN ct r ON r.tree_id = p.{other} AND r.role = x.role AND r.name = x.name")

ORACLES = {
    "x01_tree_json": "SELECT c_custkey AS tree_id, v.pos, v.role, CASE v.pos WHEN 0 THEN c_name WHEN 1 THEN CAST(c_nationkey AS STRING) WHEN 3 THEN 'true' ELSE '' END AS name, v.depth FROM customer, (VALUES (0, 'heading', 0), (1, "
        "'link', 1), (2, 'text', 1), (3, 'button', 0), (4, 'img', 0)) v(pos, role, depth) WHERE v.pos < 4 OR c_custkey % 3 = 0",
    "x02_tree_text": f"WITH {_YAML} SELECT * FROM fl",
    "x03_tree_parents": f"WITH {_YAML} SELECT tree_id, pos, (SELECT max(o.pos) FROM fl o WHERE o.tree_id = fl.tree_id AND o.pos < fl.pos AND o.depth < fl.depth) AS parent_pos FROM fl",
    "x04_tree_scores": _AX + " SELECT * FROM sc",
    "x05_tree_surplus": _AX + ", s AS (" + _SIDE.format(side="removed", own="e", other="a") + " UNION ALL " + _SIDE.format(side="added", own="a", other="e") + "), k AS (SELECT expected_id, actual_id, side, pos, role, name, row_number() OVER "
        "(PARTITION BY expected_id, actual_id, side ORDER BY pos) AS item_no FROM s WHERE k <= quota) SELECT * FROM k",
    "x06_tree_gate": _AX + " SELECT expected_id, actual_id, score >= 0.05 AS pass, score = 1 AS exact_pass FROM sc",
    "r10_normalize_names": f"WITH {S.view('s', A.SNIPPETS, 'events')} SELECT seq AS tree_id, 'text' AS role, " + reduce(
        lambda e, r: f"regexp_replace({e}, '{S.b(r[0])}', '{r[1]}', 'g')", R.VOLATILE_TEXT, "text") + " AS name FROM s",
}
