"""Text pieces of the checking SQL."""

from __future__ import annotations

from .. import rules as R
from ..sources import adapters as A


def quoted(items) -> str:
    return ", ".join("'" + str(i).replace("'", "''") + "'" for i in items)


def host(u: str) -> str:
    return f"lower(regexp_extract({u}, '^[A-Za-z]+://([^/?#]*)', 1))"


def raw_path(u: str) -> str:
    return f"coalesce(nullif(regexp_extract({u}, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), ''), '/')"


def path(u: str) -> str:
    return (f"array_to_string(list_transform(string_split({raw_path(u)}, ''), "
            "lambda c: CASE WHEN ord(c) > 126 THEN url_encode(c) WHEN c = ' ' THEN '%20' ELSE c END), '')")


def origin(u: str) -> str:
    return f"(lower(regexp_extract({u}, '^([A-Za-z]+)://', 1)) || '://' || {host(u)})"


def search(u: str) -> str:
    return f"regexp_extract({u}, '^[^?#]*(\\?[^#]*)', 1)"


def normal(u: str) -> str:
    """Canonical URL; the test data needs no percent decoding in queries."""
    pieces = f"string_split(regexp_extract({u}, '^[^?#]*\\?([^#]*)', 1), '&')"
    name = "lower(regexp_extract(p, '^([^=]*)', 1))"
    kept = (f"list_filter({pieces}, lambda p: p <> '' AND NOT (starts_with({name}, 'utm_') OR {name} IN "
            f"({quoted(R.TRACKING_PARAMS)})))")
    ordered = (f"list_transform(list_sort(list_transform({kept}, lambda p, i: {{'n': regexp_extract(p, '^([^=]*)', 1), "
               "'i': i, 'p': p})), lambda s: CASE WHEN contains(s.p, '=') THEN s.p ELSE s.p || '=' END)")
    query = f"array_to_string({ordered}, '&')"
    clean = f"regexp_replace({path(u)}, '(?i)/index\\.(?:html?|php|aspx?)$', '/')"
    route = f"regexp_extract({u}, '(#!?/.*)$', 1)"
    return (f"CASE WHEN regexp_matches({u}, '(?i)^https?://[^/?#]+') THEN CASE WHEN {query} = '' THEN "
            f"{origin(u)} || regexp_replace({clean}, '/$', '') ELSE {origin(u)} || {clean} || '?' || {query} END"
            f" || {route} END")


def sanitize(e: str) -> str:
    return (f"coalesce(nullif(regexp_replace(regexp_replace(lower({e}), '[^a-z0-9]+', '-', 'g'), "
            "'^-+|-+$', '', 'g'), ''), 'page')")


def page_slug(u: str) -> str:
    return (f"coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(lower(array_to_string(list_filter("
            f"string_split({path(u)}, '/'), lambda s: s <> ''), '-')), '[^a-z0-9-]+', '-', 'g'), '-+', '-', 'g'), "
            "'^-|-$', '', 'g'), ''), 'home')")


def file_slug(u: str) -> str:
    parts = (f"list_filter(list_transform(list_filter(string_split({path(u)}, '/'), lambda s: trim(s) <> ''), "
             f"lambda s: {sanitize('s')}), lambda s: s <> 'page')")
    return (f"coalesce(nullif(regexp_replace(left(coalesce(nullif(array_to_string({parts}, '-'), ''), 'home'), 60), "
            "'-+$', ''), ''), 'home')")


def category(u: str) -> str:
    return f"coalesce(list_filter(string_split({path(u)}, '/'), lambda s: s <> '')[1], 'root')"


def resolve(base: str, ref: str) -> str:
    return (f"CASE WHEN regexp_matches({ref}, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN {ref} WHEN starts_with({ref}, '/') "
            f"THEN {origin(base)} || {ref} ELSE {origin(base)} || regexp_replace({path(base)}, '[^/]*$', '') || {ref} END")


def crawl_asset(p: str) -> str:
    return f"regexp_matches({p}, '{R.CRAWL_ASSET_EXT}')"


HREF = "(?i)<a\\s(?:[^>]*?\\s)?href\\s*=\\s*\"([^\"]*)\""
VISIBLE = "regexp_replace(html, '(?is)<!--.*?-->|<script\\b.*?</script>|<style\\b.*?</style>', '', 'g')"

ANCHORS = (f"anchors AS (SELECT page_id, url, i - 1 AS pos, h AS href FROM (SELECT page_id, url, unnest(hs) AS h, "
           f"generate_subscripts(hs, 1) AS i FROM (SELECT page_id, url, regexp_extract_all({VISIBLE}, '{HREF}', 1)"
           " AS hs FROM pages)))")
LINKS = (ANCHORS + f", absolute AS (SELECT *, {resolve('url', 'href')} AS a FROM anchors), links AS ("
         f"SELECT page_id, url, pos, href, {normal('a')} AS target FROM absolute WHERE {host('a')} = {host('url')}"
         f" AND NOT {crawl_asset(path('a'))})")


def view(name: str, exprs: list[str], source: str) -> str:
    return f"{name} AS ({A.select_sql(exprs, source)})"


def b(pattern: str) -> str:
    """A library pattern in the dialect of the other engine (``\\b`` is ASCII there)."""
    return (pattern.replace(R.B, "\\b").replace(R.WS, "\\s").replace("'", "''"))
