"""Queries over the structure of many pages: templates, components, capture quality."""

from __future__ import annotations

from .. import rules as R
from ..operators import components as K
from ..operators import dom as D
from ..operators import quality as Q
from ..operators import templates as T
from ..session import stage
from ..sources import adapters as A
from . import domsql as M
from . import sqltext as S
from .dom import DOM, _SIG, nodes
from .history import _COUNTS, _TEXT, _normal
from .redaction import _NORMAL

#: Levels of markup that the checking SQL unrolls; deeper test pages would differ.
LEVELS = 20


def f03(spark, sf):
    return T.template_clusters(T.skeletons(nodes(spark, sf, with_text=False)))


def f04_pages(spark, sf):
    forms = stage(K.page_forms(A.all_pages(spark, sf)), "component-forms")
    return K.form_pages(forms, K.inventory(forms))


def f05(spark, sf):
    pages = A.captured(spark, sf, 1)
    return Q.capture_quality(pages, D.dom_nodes(pages, with_text=False))


QUERIES = {
    "f05_capture_quality": f05,
    "f05_soft_404": lambda spark, sf: Q.soft_404(A.captured(spark, sf, 1)),
    "f03_template_pages": f03,
    "f03_templates": lambda spark, sf: T.templates(f03(spark, sf)),
    "f04_components": lambda spark, sf: K.inventory(K.page_forms(A.all_pages(spark, sf))),
    "f04_component_pages": f04_pages,
}

_SKELETONS = DOM + (
    f", sh AS (SELECT DISTINCT page_id, url, array_to_string(list_append(anc_tags[-3:], tag || CASE WHEN {M.ROLE} <> '' THEN '@' || {M.ROLE} ELSE '' "
    "END), '>') AS s FROM el), sk AS (SELECT page_id, min(url) AS url, list_sort(list(s)) AS l FROM sh GROUP BY page_id), st AS (SELECT l, "
    "min(page_id) AS set_id FROM sk GROUP BY l), ln AS (SELECT a.set_id AS a, b.set_id AS b FROM st a JOIN st b ON a.set_id <> b.set_id AND 100 * "
    "len(list_intersect(a.l, b.l)) >= 80 * (len(a.l) + len(b.l) - len(list_intersect(a.l, b.l)))), reach AS (SELECT set_id AS a, set_id AS b FROM "
    "st UNION SELECT r.a, ln.b FROM reach r JOIN ln ON ln.a = r.b), lab AS (SELECT a AS set_id, min(b) AS template_id FROM reach GROUP BY a), "
    "cl AS (SELECT page_id, url, template_id, len(l) AS shingles FROM sk JOIN st USING (l) JOIN lab USING (set_id))")


def _levels() -> str:
    """CTE ``tree``: hashes of all subtrees, unrolled from the deepest level."""
    out = f", sg AS MATERIALIZED (SELECT page_id, pos, parent_pos, depth, tag, {_SIG} AS sig FROM elp)"
    for d in range(LEVELS, -1, -1):
        below = (f"h{d + 1}" if d < LEVELS else "(SELECT NULL::BIGINT AS page_id, NULL::BIGINT AS parent_pos, ''::VARCHAR AS h, ''::VARCHAR AS fam, "
                 "0::BIGINT AS size WHERE false)")
        out += (f", h{d} AS MATERIALIZED (SELECT s.page_id, s.pos, s.parent_pos, s.sig, md5(s.sig || '(' || array_to_string(list_sort(coalesce(list(DISTINCT c.h) "
                "FILTER (c.h IS NOT NULL), [])), ',') || ')') AS h, md5(s.tag || '(' || array_to_string(list_sort(coalesce(list(DISTINCT c.fam) FILTER (c.fam IS "
                "NOT NULL), [])), ',') || ')') AS fam, 1 + coalesce(list_sum(list_transform(list(DISTINCT {'h': c.h, 'n': c.size}) FILTER (c.h IS NOT NULL), "
                f"lambda x: x.n)), 0)::BIGINT AS size FROM sg s LEFT JOIN {below} c ON c.page_id = s.page_id AND c.parent_pos = s.pos WHERE s.depth = {d} "
                "GROUP BY s.page_id, s.pos, s.parent_pos, s.sig, s.tag)")
    return out + ", tree AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT * FROM h{d}" for d in range(LEVELS + 1)) + ")"


_INVENTORY = DOM + _levels() + (
    ", oc AS (SELECT t.*, p.h AS up FROM tree t LEFT JOIN tree p ON p.page_id = t.page_id AND p.pos = t.parent_pos WHERE t.size >= 3), fm AS (SELECT h "
    "AS component, any_value(fam) AS family, any_value(sig) AS signature, any_value(size) AS size, count(DISTINCT page_id) AS pages, count(*) AS instances, "
    "min({'a': page_id, 'b': pos}) AS f, count(up) = count(*) AND min(up) = max(up) AS part FROM oc GROUP BY h), iv AS (SELECT component, family, "
    "count(*) OVER (PARTITION BY family) AS variants, signature, size, pages, instances, f.a AS page_id, f.b AS pos FROM fm WHERE pages >= 2 AND NOT part)")

_QUALITY = ("WITH " + M.dom(A.captured_sql(1)) + f", tx AS (SELECT page_id, url, {S.host('url')} AS host, {M.collapse("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")} AS title, "
            f"{_normal(_TEXT, _NORMAL + _COUNTS)} AS text FROM pg), cp AS (SELECT *, count(*) OVER (PARTITION BY host, text) AS copies, count(*) OVER (PARTITION BY host) AS host_pages, "
            "length(regexp_replace(text, '\\s', '', 'g')) AS chars FROM tx), bd AS (SELECT page_id, count(*) AS elements, bool_or(coalesce(landmark = 'main', false)) AS has_main FROM el GROUP BY "
            f"page_id), fi AS (SELECT cp.*, coalesce(elements, 0) AS elements, list_filter([CASE WHEN chars < {R.BLANK_CHARS} THEN 'blank' END, CASE WHEN coalesce(elements, 0) < "
            f"{R.THIN_ELEMENTS} AND chars < {R.THIN_CHARS} THEN 'thin' END, CASE WHEN NOT coalesce(has_main, false) THEN 'no_landmark' END, CASE WHEN regexp_matches(title, "
            f"'{S.b(R.NOT_FOUND_TEXT)}') OR (length(text) < {R.THIN_CHARS} AND regexp_matches(text, '{S.b(R.NOT_FOUND_TEXT)}')) THEN 'not_found' END, CASE WHEN copies >= "
            f"{Q.STOCK_PAGES} AND copies >= {Q.STOCK_SHARE} * host_pages THEN 'copy' END], lambda x: x IS NOT NULL) AS f FROM cp LEFT JOIN bd USING (page_id)), weights AS (SELECT map {{"
            + ", ".join(f"'{k}': {round(100 * v)}" for k, v in Q.FINDINGS.items()) + "} AS w)")

ORACLES = {
    "f05_capture_quality": _QUALITY + " SELECT page_id, url, chars, elements, copies, host_pages, greatest(100 - coalesce(list_sum(list_transform(f, lambda x: w[x])), 0), 0) / 100.0 AS score, "
                                      "array_to_string(f, ', ') AS findings FROM fi, weights",
    "f03_template_pages": _SKELETONS + " SELECT * FROM cl",
    "f03_templates": _SKELETONS + " SELECT template_id, count(*) AS pages, arg_min(url, page_id) AS url, min(shingles) AS least, max(shingles) AS most "
                                  "FROM cl GROUP BY template_id",
    "f04_components": _INVENTORY + " SELECT * FROM iv",
    "f04_component_pages": _INVENTORY + " SELECT h AS component, page_id, count(*) AS instances FROM tree WHERE h IN (SELECT component FROM iv) GROUP BY "
                                        "h, page_id",
}
