"""Checking SQL for element tables: a recursive walk over the tag tokens of every page."""

from __future__ import annotations

from ..operators.dom import _BREAKS, _CLOSES
from .. import rules as R
from ..sources import adapters as A
from . import sqltext as S


def _list(names) -> str:
    return "[" + S.quoted(names) + "]"


def _last(stack: str, tags: str) -> str:
    return (f"coalesce(list_max(list_filter(generate_series(1, len({stack})), lambda k: list_contains({tags}, {stack}[k].tag))), 0)")


def _cut(stack: str, tags: str, stops: str) -> str:
    return f"CASE WHEN {_last(stack, tags)} > {_last(stack, stops)} THEN {stack}[1:{_last(stack, tags)} - 1] ELSE {stack} END"


def a(name: str) -> str:
    """Attribute text, NULL when the tag has no such attribute."""
    value = f"(?i)\\s{name}\\s*=\\s*(?:\"([^\"]*)\"|([^\\s\"''=<>`]+))"
    return (f"CASE WHEN regexp_matches(raw, '(?i)\\s{name}(\\s|=|>|/)') THEN regexp_extract(raw, '{value}', 1) || "
            f"regexp_extract(raw, '{value}', 2) END")


ROLE = f"lower(coalesce({a('role')}, ''))"
CLASS = f"coalesce({a('class')}, '')"
CLASSES = f"list_filter(string_split({CLASS}, ' '), lambda c: c <> '')"
_MARK = (f"CASE WHEN tag = 'header' OR {ROLE} = 'banner' THEN 'header' WHEN tag = 'footer' OR {ROLE} = 'contentinfo' THEN 'footer' WHEN "
         f"tag = 'nav' OR {ROLE} = 'navigation' THEN 'nav' WHEN tag = 'aside' OR {ROLE} = 'complementary' THEN 'aside' WHEN tag = 'main' OR "
         f"{ROLE} = 'main' THEN 'main' END")
_MENU = (f"coalesce({ROLE} IN ('menu', 'listbox', 'dialog') OR {a('aria-modal')} = 'true' OR {a('aria-expanded')} = 'true', false)")
_CLEAN = ("regexp_replace(regexp_replace(regexp_replace(html, '(?is)<!--.*?-->', '', 'g'), '(?is)(<script\\b[^>]*>).*?(</script\\s*>)', "
          "'\\1\\2', 'g'), '(?is)(<style\\b[^>]*>).*?(</style\\s*>)', '\\1\\2', 'g')")
_ENT = ("replace(replace(replace(replace(replace(replace({0}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', ' '), "
        "'&amp;', '&')")
_BASE = "stack"
for _starts, _closes, _stops in _CLOSES:
    _BASE = f"CASE WHEN tag IN ({S.quoted(_starts)}) THEN {_cut('stack', _list(_closes), _list(_stops))} ELSE {_BASE} END"
_TYPE = "STRUCT(i BIGINT, tag VARCHAR, lm VARCHAR, menu BOOLEAN)[]"


def collapse(e: str) -> str:
    return f"trim(regexp_replace({e}, '\\s+', ' ', 'g'))"


def dom(source: str = A.ALL_PAGES_SQL) -> str:
    """CTEs up to ``el``: page_id, url, pos, raw, tag, depth, anc, landmark, in_menu, end_pos, text."""
    return (
        f"RECURSIVE pg AS ({source}), tk AS (SELECT page_id, url, list_filter(regexp_extract_all({_CLEAN}, '<[^>]*>|[^<]+|<'), lambda t: NOT "
        "starts_with(t, '<') OR regexp_matches(t, '^</?[A-Za-z]')) AS l FROM pg), tok0 AS (SELECT page_id, url, generate_subscripts(l, 1) AS i, "
        "unnest(l) AS raw FROM tk), tok1 AS (SELECT *, CASE WHEN starts_with(raw, '<') THEN lower(regexp_extract(raw, "
        "'^</?([A-Za-z][A-Za-z0-9:-]*)', 1)) ELSE '' END AS tag, starts_with(raw, '</') AS fin FROM tok0), tok AS MATERIALIZED (SELECT *, CASE WHEN tag = '' "
        f"THEN {_ENT.format('raw')} WHEN tag IN ({S.quoted(_BREAKS)}) THEN ' ' ELSE '' END AS txt, tag IN ({S.quoted(R.VOID_TAGS)}) OR "
        f"ends_with(raw, '/>') AS single, {_MARK} AS mark, {_MENU} AS menu FROM tok1), walk AS (SELECT page_id, 0::BIGINT AS i, CAST([] AS "
        f"{_TYPE}) AS stack, CAST([] AS {_TYPE}) AS base FROM pg UNION ALL SELECT page_id, i, CASE WHEN tag = '' THEN stack WHEN fin THEN "
        f"{_cut('stack', '[tag]', '[]')} WHEN single THEN base ELSE list_append(base, struct_pack(i := i, tag := tag, lm := coalesce(mark, "
        "base[-1].lm), menu := menu OR coalesce(base[-1].menu, false))) END, base FROM (SELECT k.*, w.stack, " + _BASE.replace("stack", "w.stack").replace("tag IN", "k.tag IN") +
        " AS base FROM walk w JOIN tok k ON k.page_id = w.page_id AND k.i = w.i + 1) x), started AS MATERIALIZED (SELECT t.page_id, t.url, t.i, t.raw, t.tag, "
        "t.single, t.mark, w.base, row_number() OVER (PARTITION BY t.page_id ORDER BY t.i) - 1 AS pos FROM tok t JOIN walk w ON w.page_id = "
        "t.page_id AND w.i = t.i WHERE t.tag <> '' AND NOT t.fin), gone AS (SELECT s.page_id, s.i, CASE WHEN any_value(s.single) THEN s.i ELSE "
        "coalesce(min(w.i) FILTER (NOT list_contains(list_transform(w.stack, lambda q: q.i), s.i)), 1000000000) END AS e FROM started s LEFT JOIN "
        "walk w ON w.page_id = s.page_id AND w.i > s.i GROUP BY 1, 2), inner_text AS (SELECT g.page_id, g.i, g.e, " +
        collapse("coalesce(string_agg(k.txt, '' ORDER BY k.i), '')") + " AS text, count(k.i) FILTER (k.tag <> '' AND NOT k.fin) AS below FROM gone g LEFT "
        "JOIN tok k ON k.page_id = g.page_id AND k.i > g.i AND k.i < g.e GROUP BY 1, 2, 3), el AS MATERIALIZED (SELECT s.page_id, s.url, s.pos, s.raw, s.tag, "
        "len(s.base) AS depth, list_transform(s.base, lambda q: q.i) AS anc_i, list_transform(s.base, lambda q: q.tag) AS anc_tags, coalesce(s.mark, s.base[-1].lm) AS landmark, "
        "coalesce(s.base[-1].menu, false) AS in_menu, s.pos + 1 + t.below AS end_pos, t.text, s.i FROM started s JOIN inner_text t ON t.page_id = "
        "s.page_id AND t.i = s.i), elp AS (SELECT e.*, p.pos AS parent_pos FROM el e LEFT JOIN el p ON p.page_id = e.page_id AND p.i = e.anc_i[-1])")
