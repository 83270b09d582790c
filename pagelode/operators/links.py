"""Link graph: extraction, bounded breadth-first search, seeds and discovery."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules as R
from ..functions import urls as U
from ..functions.core import first_rows, number_rows, once, pad, seq_bucket, rank_all, top_per_group
from ..session import cut_lineage

_ANCHOR = r"(?i)<a\s(?:[^>]*?\s)?href\s*=\s*(?:\"([^\"]*)\"|'([^']*)')"
_HIDDEN = r"(?is)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>"


def anchors(pages: DataFrame) -> DataFrame:
    """Every ``a[href]`` in document order: page_id, url, pos, href."""
    html = F.regexp_replace("html", _HIDDEN, "")
    found = F.arrays_zip(F.regexp_extract_all(html, F.lit(_ANCHOR), F.lit(1)),
                         F.regexp_extract_all(html, F.lit(_ANCHOR), F.lit(2)))
    return pages.select("page_id", "url", F.posexplode(found).alias("pos", "_a")).select(
        "page_id", "url", "pos", F.concat(F.col("_a")["0"], F.col("_a")["1"]).alias("href"))


def crawl_links(pages: DataFrame) -> DataFrame:
    """Same-host page links, resolved and normalised: page_id, url, pos, target."""
    links = once(anchors(pages), absolute=U.resolve(F.col("url"), F.col("href")))
    kept = (
        links.filter(U.is_web_url(F.col("absolute")))
        .filter(U.hostname(F.col("absolute")) == U.hostname(F.col("url")))
        .filter(~U.is_crawl_asset(U.pathname(F.col("absolute"))))
    )
    return once(kept, target=U.normalize_url(F.col("absolute"))).filter(F.col("target").isNotNull()).select(
        "page_id", "url", "pos", "href", "target")


def top_linked(links: DataFrame, n: int = 20) -> DataFrame:
    """Most-linked targets: partial counts on the map side, then a small top-k."""
    return links.groupBy("target").agg(F.count(F.lit(1)).alias("in_links")).orderBy(
        F.desc("in_links"), "target").limit(n)


def breadth_first(edges: DataFrame, starts: DataFrame, max_depth: int,
                  budget: int | None = None) -> DataFrame:
    """Nodes reached from ``starts`` within ``max_depth``, each once.

    ``edges`` is (src, dst, pos), ``starts`` is (node, seq). ``trail`` holds the
    positions along the first path; within a depth, trails sort in queue order,
    so the first parent wins without numbering a whole level. Every level is one
    frontier-edge join, an anti join against what was seen and a checkpoint.
    """
    reached = starts.groupBy("node").agg(F.min("seq").alias("seq")).select(
        "node", F.lit(0).alias("depth"), F.array(F.col("seq").cast("long")).alias("trail"))
    reached = cut_lineage(reached)
    frontier = reached
    for depth in range(1, max_depth + 1):
        found = (
            frontier.join(edges, frontier["node"] == edges["src"])
            .select(F.col("dst").alias("node"),
                    F.concat("trail", F.array(F.col("pos").cast("long"))).alias("trail"))
            .groupBy("node").agg(F.min("trail").alias("trail"))
            .join(reached.select("node"), "node", "left_anti")
            .select("node", F.lit(depth).alias("depth"), "trail")
        )
        frontier = cut_lineage(found)
        if frontier.isEmpty():
            break
        reached = reached.unionByName(frontier)
    if budget is None:
        return reached
    return reached.orderBy("depth", "trail").limit(budget)


def _claim(pairs: DataFrame, per_parent: int) -> DataFrame:
    """First parent wins, a parent takes its first ``per_parent`` new children.

    A child asks the earliest parent that has not turned it down; a parent keeps
    the first children asking; turned-down pairs leave and the rest ask again.
    All children rank parents alike, so this ends in the same assignment as
    serving the parents one after the other.
    """
    # A parent may link a child more than once; only its first link counts.
    open_pairs = pairs.groupBy("node", "parent").agg(
        F.min("trail").alias("trail"), F.first("category").alias("category"))
    open_pairs = cut_lineage(open_pairs)
    while True:
        asking = open_pairs.groupBy("node").agg(
            F.min_by(F.struct("parent", "trail", "category"), F.col("trail")).alias("p")
        ).select("node", "p.*")
        kept = top_per_group(asking, ["parent"], [F.col("trail")], per_parent, "_n").drop("_n")
        kept = cut_lineage(kept)
        refused = cut_lineage(asking.join(kept.select("node"), "node", "left_anti").select(
            "node", "parent"))
        if refused.isEmpty():
            return kept
        open_pairs = cut_lineage(open_pairs.join(refused, ["node", "parent"], "left_anti"))


def expand_seeds(edges: DataFrame, seeds: DataFrame, per_parent: int, max_depth: int,
                 budget: int | None = None) -> DataFrame:
    """Pages reached from many seeds; at most ``per_parent`` new links per page.

    ``seeds`` is (node, seq, category). Seeds are never emitted again and a child
    takes over the category of the parent that queued it.
    """
    frontier = cut_lineage(seeds.select(
        "node", F.array(F.col("seq").cast("long")).alias("trail"), "category"))
    seen = frontier.select("node")
    found = None
    for depth in range(1, max_depth + 1):
        pairs = (
            frontier.withColumnRenamed("node", "parent")
            .join(edges, F.col("parent") == F.col("src"))
            .select(F.col("dst").alias("node"), "parent", "category",
                    F.concat("trail", F.array(F.col("pos").cast("long"))).alias("trail"))
            .join(seen, "node", "left_anti")
        )
        level = _claim(pairs, per_parent).select(
            "node", "trail", "category", F.lit(depth).alias("depth"))
        if level.isEmpty():
            break
        found = level if found is None else found.unionByName(level)
        seen = seen.unionByName(level.select("node"))
        frontier = level
    if found is None:
        found = frontier.withColumn("depth", F.lit(0)).limit(0)
    out = found.select("node", "category", "depth", "trail")
    return out if budget is None else out.orderBy("depth", "trail").limit(budget)


def first_per_url(df: DataFrame, url: str = "url", seq: str = "seq") -> DataFrame:
    """Keep the first row of every URL."""
    others = [c for c in df.columns if c != url]
    return df.groupBy(url).agg(F.min_by(F.struct(*others), F.col(seq)).alias("_r")).select(
        url, "_r.*")


def mint_pagination(urls: DataFrame, cap: int | None = None) -> DataFrame:
    """Next-page URLs of list pages: url (normalised), seq; inputs are left out."""
    pages = urls.filter(U.is_web_url(F.col("url"))).filter(~U.is_crawl_asset(U.pathname(F.col("url"))))
    minted = (
        once(pages, minted=U.normalize_url(U.next_page(F.col("url"))), own=U.normalize_url(F.col("url")))
        .filter("minted is not null and minted <> own")
        .groupBy(F.col("minted").alias("url")).agg(F.min("seq").alias("seq"))
    )
    minted = first_rows(minted, ["seq", "url"], cap)
    known = urls.select(U.normalize_url(F.col("url")).alias("url"))
    return minted.join(known, "url", "left_anti")


def merge_seeds(existing: DataFrame, sitemap: DataFrame, cap: int | None = None) -> DataFrame:
    """Sitemap seeds, then minted pages, not yet known; ``existing`` counts to a cap.

    ``existing`` and ``sitemap`` are (url, seq). Output: url, label, category, rank_source, seq.
    """
    known = existing.select(U.normalize_url(F.col("url")).alias("url")).filter("url is not null")
    seeded = first_rows(
        once(sitemap.select(F.col("url").alias("_given"), "seq"), url=U.normalize_url(F.col("_given"))).filter("url is not null")
        .groupBy("url").agg(F.min("seq").alias("seq")).join(known, "url", "left_anti"),
        ["seq", "url"], cap).withColumn("source", F.lit(0))
    bases = existing.select("url", F.array(F.lit(0), F.col("seq")).alias("seq")).unionByName(
        seeded.select("url", F.array(F.lit(1), F.col("seq")).alias("seq")))
    minted = mint_pagination(bases, cap).select(
        "url", F.col("seq")[1].alias("seq"), (F.col("seq")[0] + 1).alias("source"))
    both = first_rows(seeded.unionByName(minted.join(known, "url", "left_anti")), ["source", "seq", "url"], cap)
    ranked = number_rows(both, [], ["source", "seq", "url"], F.struct("source", seq_bucket()), "rank")
    if cap is not None:
        room = existing.agg(F.greatest(F.lit(cap) - F.count(F.lit(1)), F.lit(0)).alias("room"))
        ranked = ranked.join(room, F.col("rank") <= F.col("room"))
    return ranked.select(
        "url", U.page_slug(F.col("url")).alias("label"),
        U.page_category(F.col("url")).alias("category"), "rank")


def section_pages(links: DataFrame, sections: DataFrame) -> DataFrame:
    """Per section the first link of its index page that matches the pattern.

    ``sections`` is a rules table (section, index_url, pattern); with ``page_id`` a rule is for the links of that page
    only, as pages may share a URL. The index page itself never counts. Links of one place go by the smaller page.
    ``owner_url`` is the page of the first path segment.
    """
    own = "page_id" in sections.columns
    if own:
        sections = sections.withColumnRenamed("page_id", "_index_page")
    place = F.struct("pos", "page_id", "target") if "page_id" in links.columns else F.struct("pos", "target")
    path = U.pathname(F.col("target"))
    index_path = F.regexp_replace(U.pathname(F.col("index_url")), "/$", "")
    hits = (
        links.join(sections, (F.col("url") == F.col("index_url")) & (F.col("page_id").eqNullSafe(F.col("_index_page")) if own else F.lit(True)))
        .withColumn("path", path)
        .filter(F.regexp_replace("path", "/$", "") != index_path)
        .filter(F.expr("path rlike pattern"))
    )
    return hits.groupBy("section", "index_url").agg(
        F.min_by("target", place).alias("page_url")).withColumn("owner_url", F.concat(
            U.origin(F.col("page_url")), F.lit("/"),
            F.coalesce(F.get(U.segments(U.pathname(F.col("page_url"))), F.lit(0)), F.lit(""))))


def promote_navigations(actions: DataFrame, planned: DataFrame, host: str, max_pages: int | None = None) -> DataFrame:
    """Pages only seen through interaction, first seen first, within a page budget if there is one."""
    have = planned.select(U.normalize_url(F.col("url")).alias("url")).filter("url is not null")
    new = first_rows(
        actions.filter("outcome = 'navigation' and to_url is not null")
        .filter(U.hostname(F.col("to_url")) == host)
        .filter(~U.is_crawl_asset(U.pathname(F.col("to_url"))))
        .select(U.normalize_url(F.col("to_url")).alias("url"), "seq")
        .filter("url is not null")
        .groupBy("url").agg(F.min("seq").alias("seq"))
        .join(have, "url", "left_anti"), ["seq"], max_pages)
    ranked = number_rows(new, [], ["seq"], seq_bucket(), "rank")
    if max_pages is not None:
        count = planned.agg(F.count(F.lit(1)).alias("planned"))
        ranked = ranked.join(count, F.col("rank") <= F.lit(max_pages) - F.col("planned"))
    return ranked.select(
        "url", U.file_slug(F.col("url")).alias("label"), F.lit("explored").alias("category"), "rank")


def pick_profile(host: Column, profiles: Sequence[tuple[str, str]], fallback: str = "generic") -> Column:
    """Name of the first profile whose host pattern matches."""
    found = F.lit(fallback)
    for name, pattern in reversed(list(profiles)):
        found = F.when(host.rlike(pattern), F.lit(name)).otherwise(found)
    return found


def plan_paths(targets: DataFrame, mode: str = "web") -> DataFrame:
    """Output path per page, numbered from 1 within its category in input order."""
    named = targets.withColumn("category", F.coalesce("category", F.lit("pages")))
    ranked = number_rows(named, ["category"], ["seq"], seq_bucket(), "index")
    return ranked.withColumn("path", F.concat(
        F.lit(f"{mode}/screenshots/"), U.sanitize_segment(F.col("category")), F.lit("/"),
        pad(F.col("index"), 2), F.lit("-"), U.file_slug(F.col("url")), F.lit(".png")))


def resolve_page_list(entries: DataFrame, base: str, n: int | None = None) -> DataFrame:
    """Explicit page list (entry, seq) against a base URL, first wins, first ``n`` if given."""
    url = F.when(F.col("entry").rlike("(?i)^https?://"), U.href(F.col("entry"))).otherwise(
        U.href(U.resolve(F.lit(base), F.col("entry"))))
    distinct = entries.select(url.alias("url"), "seq").groupBy("url").agg(F.min("seq").alias("seq"))
    return (first_rows(distinct, ["seq"], n)
            .select("url", U.page_slug(F.col("url")).alias("label"), F.lit("pages").alias("category"),
                    "seq"))


def sitemap_urls(robots: DataFrame, sitemaps: DataFrame, cap: int | None = None) -> DataFrame:
    """Page URLs named by robots files and site maps, per site.

    ``robots`` is (site_id, base_url, text), ``sitemaps`` is (site_id, url, xml).
    Path hints come first, then the root map and the maps robots name, each with
    its nested maps one level deep. With ``cap``, a site's first so many URLs.
    """
    lines = robots.select("site_id", "base_url", F.posexplode(F.split("text", r"\r?\n")).alias("line_no", "line"))
    named = F.regexp_extract("line", r"(?i)^\s*sitemap\s*:\s*(\S+)", 1)
    rule = F.regexp_extract("line", r"(?i)^\s*(?:allow|disallow)\s*:\s*(\S+)", 1)
    root = F.concat(U.origin(F.col("base_url")), F.lit("/"))
    hints = (
        lines.filter((named == "") & (rule != "") & (rule != "/") & ~rule.contains("*") & ~rule.contains("$"))
        .select("site_id", "base_url", rule.alias("raw"), F.array(F.lit(0), "line_no").alias("place"))
    )
    declared = (
        robots.select("site_id", "base_url", F.concat(root, F.lit("sitemap.xml")).alias("url"),
                      F.lit(-1).alias("rank"))
        .unionByName(lines.filter(named != "").select(
            "site_id", "base_url", U.href(U.resolve(root, named)).alias("url"), F.col("line_no").alias("rank"))
            .filter(U.hostname(F.col("url")) == U.hostname(F.col("base_url"))))
        .groupBy("site_id", "base_url", "url").agg(F.min("rank").alias("rank"))
    )
    is_index = F.col("xml").rlike(r"(?i)<sitemapindex[\s>]")
    locs = F.transform(F.regexp_extract_all(
        "xml", F.lit(r"(?i)<loc>\s*([^<\s][^<]*?)\s*</loc>"), F.lit(1)), lambda s: F.trim(s))
    nested = (
        declared.join(sitemaps.filter(is_index), ["site_id", "url"])
        .select("site_id", "base_url", "rank", F.posexplode(locs).alias("pos", "loc"))
        .select("site_id", "base_url", "rank", (F.col("pos") + 1).alias("sub"),
                U.href(U.resolve(F.col("base_url"), F.col("loc"))).alias("url"))
        .filter(U.hostname(F.col("url")) == U.hostname(F.col("base_url")))
    )
    fetched = top_per_group(
        declared.withColumn("sub", F.lit(0)).unionByName(nested), ["site_id"],
        [F.col("rank"), F.col("sub")], R.MAX_SITEMAPS, "turn")
    listed = (
        fetched.join(sitemaps.filter(~is_index), ["site_id", "url"])
        .select("site_id", "base_url", "turn", F.posexplode(locs).alias("pos", "raw"))
        .select("site_id", "base_url", "raw", F.array("turn", "pos").alias("place"))
    )
    absolute = U.resolve(F.col("base_url"), F.col("raw"))
    found = (
        hints.unionByName(listed).withColumn("absolute", absolute)
        .filter(U.is_web_url(F.col("absolute")))
        .filter(U.hostname(F.col("absolute")) == U.hostname(F.col("base_url")))
        .filter(~U.is_crawl_asset(U.pathname(F.col("absolute"))))
        .groupBy("site_id", U.normalize_url(F.col("absolute")).alias("url")).agg(F.min("place").alias("place"))
        .filter("url is not null")
    )
    if cap is None:
        return rank_all(found, ["site_id"], ["place"]).drop("place")
    return top_per_group(found, ["site_id"], [F.col("place")], cap, "rank").drop("place")
