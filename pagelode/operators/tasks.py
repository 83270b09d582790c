"""QC tasks from behaviors, data and routes, and their checks against a candidate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules as R
from ..functions import urls as U
from ..functions.core import first_items, first_rows, let, lookup, number_rows, once, pad, position_in, top_per_group
from ..session import stage
from .dom import role

TASK_COLUMNS = ["grp", "ord", "title", "page", "page_url", "role", "name", "action", "outcome", "detail", "api", "pre", "data", "value"]
_PRE = "array<struct<role:string,name:string,action:string>>"
_DATA = "array<struct<text:string,source:string>>"


def _task(df: DataFrame, group: int, **columns: Column) -> DataFrame:
    """Rows with all task columns; what a group does not set stays NULL."""
    kinds = {"ord": "bigint", "api": "array<string>", "pre": _PRE, "data": _DATA}
    filled = {c: columns[c].cast(kinds.get(c, "string")) if c in columns else F.lit(None).cast(kinds.get(c, "string")) for c in TASK_COLUMNS[1:]}
    return df.select(F.lit(group).alias("grp"), *[v.alias(c) for c, v in filled.items()])


def feature_tasks(features: DataFrame) -> DataFrame:
    """One task per feature: locator, expected text, API list, steps before."""
    api = F.array_distinct(F.transform("network", lambda c: F.concat(
        F.upper(F.substring_index(c, " ", 1)), F.lit(" "), U.pathname_or(F.regexp_extract(c, r"^\S+ (.*)$", 1)))))
    rows = features.withColumn("api", api)
    more = F.when(F.size("api") > 3, F.concat(F.lit(" +"), F.size("api") - 3, F.lit(" more"))).otherwise(F.lit(""))
    detail = (
        F.when(F.col("outcome") == "modal", "a dialog/modal opens")
        .when(F.col("outcome") == "download", F.coalesce(F.concat(F.lit("downloads "), "download_file"), F.lit("a file download starts")))
        .when((F.col("outcome") == "dom-change") & (F.size("api") == 0), "the view updates (DOM change)")
        .when(F.col("outcome") == "dom-change", F.concat(F.lit("the view updates (fires "), F.array_join(F.slice("api", 1, 3), ", "), more, F.lit(")")))
        .otherwise("no error (control is reachable and actionable)"))
    pre = F.transform("path", lambda p: F.struct(lookup(F.lower(p["kind"]), R.TASK_ROLES).alias("role"), p["label"].alias("name"), F.lit("click").alias("action")))
    return _task(rows, 1, ord=F.col("seq"), title=F.concat("outcome", F.lit(': "'), "label", F.lit('" on '), "page"), page=F.col("page"),
                 page_url=F.col("page_url"), role=lookup(F.lower("kind"), R.TASK_ROLES), name=F.col("label"), action=F.col("action"),
                 outcome=F.col("outcome"), detail=detail, api=api, pre=pre)


def route_tasks(edges: DataFrame, features: DataFrame) -> DataFrame:
    """Light navigation tasks for the first twenty edges."""
    start = features.groupBy("page").agg(F.min_by("page_url", "seq").alias("from_url"))
    first = first_rows(edges, ["seq"], R.MAX_ROUTE_TASKS).join(start, "page", "left")
    return _task(first, 2, ord=F.col("seq"), title=F.concat(F.lit('navigation: "'), "label", F.lit('" on '), "page"), page=F.col("page"),
                 page_url=F.coalesce("from_url", U.origin(F.col("to_url")), "to_url"), role=F.lit("link"), name=F.col("label"), action=F.lit("click"),
                 outcome=F.lit("navigation"), detail=F.concat(F.lit("navigates to "), "to_url"))


def is_salient(text: Column) -> Column:
    """A value worth expecting on a page."""
    return (F.length(text).between(R.SALIENT_MIN, R.SALIENT_MAX) & ~text.rlike("(?i)^https?://") & ~text.rlike(r"^\d{4}-\d{2}-\d{2}T")
            & ~text.rlike("(?i)^(true|false|null|undefined)$") & text.rlike("(?i)[a-z0-9]"))


def salient_pairs(entries: Column) -> Column:
    """Up to five salient (key, value) pairs of ``array<struct<key,value>>``, preferred keys first."""
    kept = F.filter(F.transform(entries, lambda e, i: F.struct(
        position_in(e["key"], R.SALIENT_KEYS).alias("p"), i.alias("i"), e["key"].alias("key"), F.trim(e["value"]).alias("value"))),
        lambda e: is_salient(e["value"]))
    return F.transform(first_items(F.array_sort(kept), R.MAX_DATA_ASSERTIONS), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value")))


def _text_entries(v: Column, keys: Column) -> Column:
    """String members of a variant object in the given key order."""
    def text(x: Column) -> Column:
        return F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string"))
    return let(F.try_variant_get(v, "$", "map<string,variant>"), lambda members: F.filter(F.transform(keys, lambda k: F.struct(
        k.alias("key"), let(F.try_element_at(members, k), text).alias("value"))), lambda e: e["value"].isNotNull()))


def _quoted(values: Column) -> Column:
    return F.array_join(F.transform(values, lambda x: F.concat(F.lit('"'), x["value"], F.lit('"'))), ", ")


def fixture_data_tasks(fixture: DataFrame) -> DataFrame:
    """Data task per fixture (seq, url, template, response, file) from its first object record."""
    parsed = once(fixture, _v=F.try_parse_json("response"))
    body = F.coalesce(*[F.try_variant_get("_v", f"$.{k}", "variant") for k in R.RECORD_KEYS], "_v")
    opened = once(once(parsed, _b=body), _items=F.try_variant_get("_b", "$", "array<variant>"))
    objects = F.filter(F.transform("_items", lambda x, i: F.struct(i.alias("i"), x.alias("v"))), lambda e: F.schema_of_variant(e["v"]).startswith("OBJECT"))
    record = F.when(F.col("_items").isNotNull(), F.get(objects, F.lit(0))).when(
        F.schema_of_variant("_b").startswith("OBJECT"), F.struct(F.lit(-1).alias("i"), F.col("_b").alias("v")))
    found = once(opened, _r=record).filter("_r is not null")
    keys = F.json_object_keys(F.when(F.col("_r.i") < 0, F.coalesce(*[F.get_json_object("response", f"$.{k}") for k in R.RECORD_KEYS], "response")).otherwise(F.to_json("_r.v")))
    found = once(found, _texts=_text_entries(F.col("_r.v"), keys))
    found = once(found, pairs=salient_pairs(F.col("_texts"))).filter("size(pairs) > 0")
    found = once(found, _route=F.coalesce(U.pathname_or(F.col("url")), "template", F.lit("/")))
    route = F.col("_route")
    source = lambda p: F.concat(F.lit("fixture:"), F.col("file"), F.lit("#"), F.when(F.col("_r.i") >= 0, F.concat(
        F.lit("["), F.col("_r.i"), F.lit("]."))).otherwise(F.lit("")), p["key"])
    return _task(found, 3, ord=F.col("seq"), title=F.concat(F.lit("data: real values render on "), route), page=route, page_url=F.coalesce("url", route),
                 name=F.get("pairs", F.lit(0))["value"], action=F.lit("none"), outcome=F.lit("noop"),
                 detail=F.concat(F.lit("real data from "), "file", F.lit(" renders (not a placeholder/mock)")),
                 data=F.transform("pairs", lambda p: F.struct(p["value"].alias("text"), source(p).alias("source"))))


def entity_data_tasks(entity: DataFrame) -> DataFrame:
    """Data task for the first thirty entities (type, id, url, seq, entries) that have a URL and fields."""
    rich = first_rows(entity.filter("url is not null and size(entries) > 0"), ["seq"], R.MAX_ENTITY_TASKS)
    found = rich.withColumn("pairs", salient_pairs(F.col("entries"))).filter("size(pairs) > 0")
    route = U.pathname_or(F.col("url"))
    return _task(found, 4, ord=F.col("seq"), title=F.concat(F.lit("data: "), "type", F.lit(' "'), "id", F.lit('" renders on '), route), page=route,
                 page_url=F.col("url"), name=F.get("pairs", F.lit(0))["value"], action=F.lit("none"), outcome=F.lit("noop"),
                 detail=F.concat(F.lit("captured "), "type", F.lit(" fields render (not placeholders)")),
                 data=F.transform("pairs", lambda p: F.struct(p["value"].alias("text"), F.concat(
                     F.lit("entity:"), "type", F.lit("/"), "id", F.lit("#"), p["key"]).alias("source"))))


def listing_data_tasks(listing: DataFrame) -> DataFrame:
    """Data task for listings from their rows.

    ``listing`` is (listing_seq, page, page_url, row_no, fields).
    """
    heads = first_rows(listing.groupBy("listing_seq").agg(F.count(F.lit(1)).alias("n")), ["listing_seq"], R.MAX_LISTING_TASKS)
    rows = top_per_group(listing.join(heads.select("listing_seq"), "listing_seq", "left_semi"), ["listing_seq"], [F.col("row_no")], R.MAX_LISTING_TASK_ROWS, "k")
    first = rows.withColumn("value", F.get(salient_pairs(F.map_entries("fields")), F.lit(0))["value"]).filter("value is not null")
    grouped = first.groupBy("listing_seq", "page", "page_url").agg(F.array_sort(F.collect_list(F.struct("k", "value"))).alias("vs"))
    values = first_items(F.array_distinct(F.transform("vs", lambda x: x["value"])), R.MAX_DATA_ASSERTIONS)
    # Named before the task columns, which reuse the name "page".
    grouped = grouped.withColumns({"values": values, "listing_page": F.col("page")})
    route = F.coalesce(U.pathname_or(F.col("page_url")), "page")
    return _task(grouped, 5, ord=F.col("listing_seq"), title=F.concat(F.lit("data: listing rows render on "), route), page=route, page_url=F.col("page_url"),
                 name=F.get("values", F.lit(0)), action=F.lit("none"), outcome=F.lit("noop"),
                 detail=F.concat(F.size("values"), F.lit(" captured listing rows render")),
                 data=F.transform("values", lambda v, i: F.struct(v.alias("text"), F.concat(F.lit("listing:"), "listing_page", F.lit("#row"), i).alias("source"))))


def coverage_tasks(targets: DataFrame, listing: DataFrame) -> DataFrame:
    """One task per distinct route (url, label, seq) with the captured row count."""
    counts = listing.groupBy("listing_seq", "page_url").agg(F.count(F.lit(1)).alias("n")).groupBy(
        U.pathname_or(F.col("page_url")).alias("route")).agg(F.max("n").alias("rows"))
    routes = targets.withColumn("route", U.pathname_or(F.col("url"))).groupBy("route").agg(
        F.min_by(F.struct("url", "label", "seq"), F.col("seq")).alias("t")).select("route", "t.*")
    routes = first_rows(routes, ["seq"], R.MAX_COVERAGE_TASKS)
    found = routes.join(counts, "route", "left")
    some = F.col("rows").isNotNull()
    return _task(found, 6, ord=F.col("seq"), page=F.coalesce("label", "route"), page_url=F.col("url"), name=F.coalesce("label", "route"), action=F.lit("none"),
                 title=F.concat(F.lit("coverage: "), "route", F.lit(" renders"), F.when(some, F.concat(F.lit(" >= "), "rows", F.lit(" row(s)"))).otherwise(F.lit(""))),
                 outcome=F.lit("noop"), detail=F.when(some, F.concat(F.lit("route renders with >= "), "rows", F.lit(" row(s) (captured listing count)"))).otherwise(
                     F.lit("route renders without error")))


def with_values(tasks: DataFrame, features: DataFrame) -> DataFrame:
    """Value to type or select, by page and label, the last recorded one."""
    last = features.filter("action in ('fill', 'select') and value <> ''").groupBy("page", F.col("label").alias("name")).agg(
        F.max_by("value", "seq").alias("_v"))
    typed = F.col("action").isin("fill", "select")
    return tasks.join(last, ["page", "name"], "left").withColumn("value", F.coalesce("value", F.when(typed, F.col("_v")))).select(*TASK_COLUMNS)


def all_tasks(*groups: DataFrame) -> DataFrame:
    """All groups with ids in sequence. The bucket (group, order) spreads a long feature group.

    Numbering reads the tasks twice, so they are made once and written.
    """
    tasks = groups[0]
    for g in groups[1:]:
        tasks = tasks.unionByName(g)
    bucket = F.struct("grp", F.floor(F.col("ord") / 1000000).cast("long").alias("b"))
    return number_rows(stage(tasks, "tasks"), [], ["grp", "ord", "title"], bucket, "number").withColumn("task_id", F.concat(F.lit("QC-"), pad(F.col("number"), 3)))


# --- checks --------------------------------------------------------------------------------------


def data_fidelity(assertions: DataFrame, candidates: DataFrame) -> DataFrame:
    """Expected texts (task_id, url, ord, text) against candidate page texts (url, text).

    A task passes when every text occurs; else the first missing one is reported.
    """
    pages = candidates.select("url", F.lower("text").alias("page_text"))
    checked = assertions.join(pages, "url", "left").withColumn("found", (F.trim("text") == "") | F.coalesce(
        F.contains("page_text", F.lower(F.trim("text"))), F.lit(False)))
    return checked.groupBy("task_id").agg(F.bool_and("found").alias("pass"), F.min_by("text", F.when(~F.col("found"), F.col("ord"))).alias("missing"))


def row_like_counts(elements: DataFrame) -> DataFrame:
    return elements.groupBy("url").agg(F.count_if(F.col("tag").isin(*R.ROW_TAGS) | role().isin(*R.ROW_ROLES)).alias("rows"))


def row_gate(expected: DataFrame, elements: DataFrame) -> DataFrame:
    """Candidate pages must show at least the captured number of rows (task_id, url, min_rows)."""
    got = expected.join(row_like_counts(elements), "url", "left").withColumn("rows", F.coalesce("rows", F.lit(0)))
    return got.select("task_id", "url", "min_rows", "rows", (F.col("rows") >= F.col("min_rows")).alias("pass"))


def check_outcomes(tasks: DataFrame, candidate: DataFrame) -> DataFrame:
    """Feature tasks against a candidate action log.

    A control is found by role and name first, then by name alone. A navigation,
    modal or download must happen again; a view update passes when an expected
    API path was asked or the tree changed. ``candidate`` is (page, role, name,
    seq, outcome, network paths, changed); tasks carry task_id, page, role, name,
    outcome and api. Best match per task is an aggregate over the equi join.
    """
    log = candidate.select("page", "name", F.col("role").alias("c_role"), F.col("seq").alias("c_seq"), F.col("outcome").alias("c_outcome"), "paths", "changed")
    tier = F.when(F.col("role") == F.col("c_role"), 0).when(F.col("c_role").isNull(), 1).when(F.col("c_role") == "button", 2).when(F.col("c_role") == "link", 3)
    # The log is cut to one action per (page, name, role) before it meets the tasks.
    firsts = log.groupBy("page", "name", "c_role").agg(F.min_by(F.struct("c_seq", "c_outcome", "paths", "changed"), F.col("c_seq")).alias("c")).select(
        "page", "name", "c_role", "c.*")
    pairs = tasks.join(firsts, ["page", "name"], "left").withColumn("tier", F.when(F.col("c_seq").isNotNull(), F.coalesce(tier, F.lit(4))))
    best = pairs.groupBy("task_id", "outcome").agg(
        F.min_by(F.struct("c_outcome", "paths", "changed"), F.when(F.col("tier").isNotNull(), F.struct("tier", "c_seq"))).alias("m"),
        F.first("api").alias("api"))
    wanted = F.transform("api", lambda a: F.regexp_extract(a, r"^\S+ (.*)$", 1))
    hit = F.coalesce(F.arrays_overlap(wanted, F.col("m.paths")), F.lit(False))
    ok = (F.when(F.col("m").isNull(), F.lit(False)).when(F.col("outcome").isin("navigation", "modal", "download"), F.col("m.c_outcome") == F.col("outcome"))
          .when(F.col("outcome") == "dom-change", hit | F.coalesce("m.changed", F.lit(False))).otherwise(F.lit(True)))
    reason = (F.when(F.col("m").isNull(), "control not found").when(ok & (F.col("outcome") == "dom-change") & hit, "expected API fired")
              .when(ok & (F.col("outcome") == "dom-change"), "view updated").when(ok, "outcome matches").otherwise("expected outcome missing"))
    return best.select("task_id", ok.alias("pass"), reason.alias("reason"))
