"""URL functions: parse, resolve, normalise, name. All JVM-side expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules as R
from .core import head, let

_URL = r"^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"
_WEB = r"(?i)^https?://[^/?#\s]+"


def is_web_url(url: Column) -> Column:
    return url.rlike(_WEB)


def parsed(url: Column) -> Column:
    """A web URL as struct(scheme, host, path, search, mark); NULL for what is no web URL.

    Each function below parses once and binds the result, so expressions stay
    small however often a part is used.
    """
    def parts(u: Column) -> Column:
        scheme = F.lower(F.regexp_extract(u, _URL, 1))
        authority = F.regexp_replace(F.lower(F.regexp_extract(u, _URL, 2)), "^.*@", "")
        # "https:443" and "http:80" are default ports.
        marked = F.regexp_replace(F.concat(scheme, F.lit("|"), authority), "^(http\\|.*):80$|^(https\\|.*):443$", "$1$2")
        return F.when(u.rlike(_WEB), F.struct(
            scheme.alias("scheme"),
            F.regexp_replace(marked, "^[a-z]+\\|", "").alias("host"),
            let(F.regexp_extract(u, _URL, 3), _clean_path).alias("path"),
            F.regexp_replace(F.regexp_extract(u, _URL, 4), r"^\?$", "").alias("search"),
            F.regexp_extract(u, _URL, 5).alias("mark")))
    return let(url, parts)


def _clean_path(path: Column) -> Column:
    odd = r"[^\x21-\x7e]|[\"<>`{}]"
    dots = r"(^|/)\.\.?(/|$)"
    return F.when(path == "", F.lit("/")).when(
        path.rlike(odd) | path.rlike(dots), let(_drop_dots(path), _encode_path)).otherwise(path)


def _encode_path(path: Column) -> Column:
    """Percent-encode what a browser would encode in a path."""
    odd = r"[^\x21-\x7e]|[\"<>`{}]"
    return F.array_join(F.transform(F.split(path, ""), lambda c: F.when(
        c == " ", F.lit("%20")).when(c.rlike(odd), F.url_encode(c)).otherwise(c)), "")


def _drop_dots(path: Column) -> Column:
    """Resolve ``.`` and ``..`` segments."""
    nothing = F.array().cast("array<string>")

    def fold(names: Column) -> Column:
        return F.aggregate(
            F.transform(names, lambda s, i: F.struct(
                s.alias("s"), (i == F.size(names) - 1).alias("last"))),
            nothing,
            lambda stack, item: F.when(
                item["s"] == "..",
                F.concat(F.slice(stack, 1, F.greatest(F.size(stack) - 1, F.lit(0))),
                         F.when(item["last"], F.array(F.lit(""))).otherwise(nothing)))
            .when(item["s"] == ".", F.when(item["last"], F.concat(stack, F.array(F.lit(""))))
                  .otherwise(stack))
            .otherwise(F.concat(stack, F.array(item["s"]))))
    return F.concat(F.lit("/"), F.array_join(
        let(F.split(F.regexp_replace(path, "^/", ""), "/"), fold), "/"))


def _site(p: Column) -> Column:
    return F.concat(p["scheme"], F.lit("://"), p["host"])


def host(url: Column) -> Column:
    """Lower-case host with a non-default port, NULL for what is no URL."""
    return parsed(url)["host"]


def hostname(url: Column) -> Column:
    return F.regexp_replace(parsed(url)["host"], r":\d+$", "")


def origin(url: Column) -> Column:
    return let(parsed(url), _site)


def pathname(url: Column) -> Column:
    """Path of a URL as a browser reports it, NULL for what is no URL."""
    return parsed(url)["path"]


def pathname_or(url: Column, fallback: Column | None = None) -> Column:
    """Path of a URL, else the raw value (or a given fallback)."""
    return let(url, lambda u: F.coalesce(parsed(u)["path"], u if fallback is None else fallback))


def search(url: Column) -> Column:
    """Query with its question mark, empty when there is none."""
    return F.regexp_replace(F.regexp_extract(url, _URL, 4), r"^\?$", "")


def fragment(url: Column) -> Column:
    return F.regexp_extract(url, _URL, 5)


def query_pairs(query: Column) -> Column:
    """``?a=1&b`` -> ``array<struct<pos,name,value>>``, raw text kept."""
    pieces = F.filter(F.split(F.regexp_replace(query, r"^\?", ""), "&"), lambda p: p != "")
    return F.transform(pieces, lambda p, i: F.struct(
        i.alias("pos"),
        F.regexp_extract(p, "^([^=]*)", 1).alias("name"),
        F.regexp_extract(p, "^[^=]*=(.*)$", 1).alias("value")))


def form_text(raw: Column) -> Column:
    """Decode a query component and encode it again in the form style of browsers."""
    return F.url_encode(F.coalesce(F.try_url_decode(raw), raw))


def is_tracking(name: Column) -> Column:
    """``utm_*`` or a known campaign parameter, in any case."""
    low = F.lower(name)
    return low.startswith("utm_") | low.isin(*R.TRACKING_PARAMS)


def join_pairs(pairs: Column) -> Column:
    """Pairs -> ``?a=1&b=2``, empty for no pairs."""
    body = F.array_join(F.transform(pairs, lambda p: F.concat(
        form_text(p["name"]), F.lit("="), form_text(p["value"]))), "&")
    return F.when(F.size(pairs) > 0, F.concat(F.lit("?"), body)).otherwise(F.lit(""))


def normalize_url(url: Column) -> Column:
    """Canonical URL used as the page key; NULL for what is no web URL."""
    def canonical(p: Column) -> Column:
        kept = F.filter(query_pairs(p["search"]), lambda q: ~is_tracking(q["name"]))
        ordered = F.array_sort(F.transform(kept, lambda q: F.struct(
            q["name"].alias("name"), q["pos"].alias("pos"), q["value"].alias("value"))))
        query = F.when(p["search"] == "", F.lit("")).otherwise(let(ordered, join_pairs))
        path = F.regexp_replace(p["path"], R.INDEX_DOCUMENT, "/")
        route = F.when(p["mark"].rlike("^#!?/"), p["mark"]).otherwise(F.lit(""))
        # One trailing slash goes when the path ends the text before any route mark.
        head = F.regexp_replace(F.concat(_site(p), path, query), "/$", "")
        return F.when(p.isNotNull(), F.concat(head, route))
    return let(parsed(url), canonical)


def resolve(base: Column, href: Column) -> Column:
    """Absolute URL of a link on a page; other schemes come back as they are."""
    def absolute(b: Column) -> Column:
        site, here = _site(b), F.concat(_site(b), b["path"])
        return let(F.regexp_replace(href, R.WS + "+$|^" + R.WS + "+", ""), lambda ref: (
            F.when(ref.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), ref)
            .when(ref.startswith("//"), F.concat(b["scheme"], F.lit(":"), ref))
            .when(ref.startswith("/"), F.concat(site, ref))
            .when(ref.startswith("?"), F.concat(here, ref))
            .when(ref.startswith("#"), F.concat(here, b["search"], ref))
            .when(ref == "", F.concat(here, b["search"]))
            .otherwise(F.concat(F.regexp_replace(here, "[^/]*$", ""), ref))))
    return let(parsed(base), absolute)


def href(url: Column) -> Column:
    """A URL as a browser would print it (host lower-case, path encoded)."""
    return let(url, lambda u: F.coalesce(let(parsed(u), lambda p: F.concat(
        _site(p), p["path"], p["search"], p["mark"])), u))


def is_crawl_asset(path: Column) -> Column:
    return path.rlike(R.CRAWL_ASSET_EXT)


def is_call_asset(path: Column) -> Column:
    return path.rlike(R.CALL_ASSET_EXT)


def same_site(call_host: Column, base_host: Column) -> Column:
    """The base host itself or one of its subdomains."""
    return (call_host == base_host) | call_host.endswith(F.concat(F.lit("."), base_host))


def segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda s: s != "")


def page_slug(url: Column) -> Column:
    """Readable label of a page from its path."""
    text = F.lower(F.array_join(segments(F.coalesce(pathname(url), F.lit("/"))), "-"))
    text = F.regexp_replace(text, "[^a-z0-9-]+", "-")
    text = F.regexp_replace(F.regexp_replace(text, "-+", "-"), "^-|-$", "")
    return F.coalesce(F.nullif(text, F.lit("")), F.lit("home"))


def page_category(url: Column) -> Column:
    """First path segment, ``root`` for top pages."""
    return F.coalesce(F.get(segments(pathname(url)), F.lit(0)), F.lit("root"))


def sanitize_segment(text: Column) -> Column:
    """File-system-safe lower-case text, ``page`` when nothing is left."""
    clean = F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.coalesce(F.nullif(clean, F.lit("")), F.lit("page"))


def _with_scheme(url: Column) -> Column:
    return let(url, lambda u: F.when(u.rlike(r"(?i)^[a-z][a-z0-9+.\-]*://"), u).otherwise(
        F.concat(F.lit("https://"), u)))


def site_name(url: Column) -> Column:
    """Brand label of a host, generic leading labels skipped."""
    def brand(labels: Column) -> Column:
        own = F.filter(labels, lambda s: ~F.lower(s).isin(*R.GENERIC_HOST_LABELS))
        return F.coalesce(F.get(own, F.lit(0)), F.get(labels, F.size(labels) - 1), F.lit(""))
    raw = let(url, lambda u: F.coalesce(hostname(_with_scheme(u)), u))
    labels = F.filter(F.split(raw, r"\."), lambda s: s != "")
    return sanitize_segment(let(labels, brand))


def file_slug(url: Column) -> Column:
    """Short file-name tail of a URL path."""
    path = let(url, lambda u: F.coalesce(pathname(_with_scheme(u)), u))
    parts = F.filter(F.transform(
        F.filter(F.split(path, "/"), lambda s: F.trim(s) != ""), lambda s: sanitize_segment(s)),
        lambda s: s != "page")
    joined = let(F.array_join(parts, "-"), lambda s: F.when(s == "", F.lit("home")).otherwise(s))
    cut = let(joined, lambda s: F.when(F.length(s) > R.SLUG_MAX, F.regexp_replace(
        head(s, R.SLUG_MAX), "-+$", "")).otherwise(s))
    return F.coalesce(F.nullif(cut, F.lit("")), F.lit("home"))


def rebase(url: Column, target: Column) -> Column:
    """A recorded URL, or bare path, on the origin of a target."""
    def moved(u: Column) -> Column:
        bare = F.when(u.startswith("/"), u).otherwise(F.concat(F.lit("/"), u))
        return F.coalesce(let(parsed(u), lambda p: F.concat(p["path"], p["search"])), bare)
    return F.coalesce(F.concat(origin(target), let(url, moved)), target)


def redact_url(url: Column) -> Column:
    """Values of sensitive query parameters become the redaction mark."""
    from .redact import is_sensitive_name

    def marked(pairs: Column) -> Column:
        # The first pair of a sensitive name takes the mark and its repeats go away.
        kept = F.filter(pairs, lambda p: ~p["hit"] | ~F.exists(
            pairs, lambda q: (q["name"] == p["name"]) & (q["pos"] < p["pos"])))
        return F.when(F.exists(pairs, lambda p: p["hit"]), join_pairs(F.transform(
            kept, lambda p: F.struct(p["name"].alias("name"), F.when(p["hit"], F.lit(R.REDACTED)).otherwise(
                p["value"]).alias("value")))))

    def rebuilt(p: Column) -> Column:
        pairs = F.transform(query_pairs(p["search"]), lambda q: F.struct(
            q["pos"].alias("pos"), q["name"].alias("name"), q["value"].alias("value"),
            is_sensitive_name(q["name"]).alias("hit")))
        return F.concat(_site(p), p["path"], F.coalesce(let(pairs, marked), p["search"]), p["mark"])

    return let(url, lambda u: F.coalesce(let(parsed(u), rebuilt), u))


def next_page(url: Column) -> Column:
    """The URL with its paginator bumped, before normalisation."""
    def bumped(first: Column) -> Column:
        number = F.when(F.trim(first["value"]) == "", F.lit(0.0)).otherwise(
            F.trim(first["value"]).try_cast("double"))
        step = F.when(first["name"] == "offset", F.lit(R.OFFSET_STEP)).otherwise(F.lit(1))
        start = F.when(first["name"] == "offset", F.lit(R.OFFSET_STEP)).otherwise(F.lit(2))
        return let(F.coalesce(number + step, start.cast("double")), lambda n: F.when(
            n == F.floor(n), n.cast("long").cast("string")).otherwise(n.cast("string")))

    def changed(pairs: Column) -> Column:
        plain = F.transform(pairs, lambda p: F.struct(p["name"].alias("name"), p["value"].alias("value")))
        first = F.coalesce(*[F.get(F.filter(pairs, lambda p: p["name"] == key), F.lit(0))
                             for key in R.PAGE_PARAMS])
        with_page = F.concat(plain, F.array(F.struct(
            F.lit("page").alias("name"), F.lit("2").alias("value"))))
        return let(first, lambda f: F.when(f.isNull(), with_page).otherwise(F.transform(
            F.filter(pairs, lambda p: (p["name"] != f["name"]) | (p["pos"] == f["pos"])),
            lambda p: F.struct(p["name"].alias("name"), F.when(
                p["pos"] == f["pos"], bumped(f)).otherwise(p["value"]).alias("value")))))

    return let(parsed(url), lambda p: F.concat(
        _site(p), p["path"], let(let(query_pairs(p["search"]), changed), join_pairs), p["mark"]))


def with_url_parts(df: DataFrame, url: str = "url") -> DataFrame:
    """Add host and pathname columns next to a URL column."""
    return df.withColumns({"host": hostname(F.col(url)), "pathname": pathname(F.col(url))})
