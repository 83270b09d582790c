"""Interaction logs: safety labels, outcomes, totals, behaviors, budgets, downloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules as R
from ..functions import urls as U
from ..functions.core import first_items, lookup, number_rows, seq_bucket, top_per_group


def click_risk(label: Column, external: Column, aggressive: Column) -> Column:
    """Why a control must not be clicked, NULL when it may."""
    text = F.trim(F.coalesce(label, F.lit("")))
    return (F.when(external, "external-link").when(text.rlike(R.HARD_DENY), "hard-deny (logout/payment/account)")
            .when(~aggressive & text.rlike(R.DESTRUCTIVE), "destructive (safe mode)"))


def may_submit(label: Column, aggressive: Column) -> Column:
    """Whether a form may be submitted."""
    return F.when(aggressive, ~label.rlike(R.HARD_DENY)).otherwise(label.rlike(R.SEARCH_FORM))


def outcomes(states: DataFrame) -> DataFrame:
    """Outcome per action from its before and after rows.

    ``states`` is (action_id, phase, url, downloads, modals, signature, feedback, error);
    both rows of an action meet in one aggregate, no self join.
    """
    at = lambda c, phase: F.max(F.when(F.col("phase") == phase, F.col(c)))
    both = states.groupBy("action_id").agg(
        *[at(c, p).alias(f"{c}_{p}") for c in ("url", "downloads", "modals", "signature") for p in ("before", "after")],
        F.bool_or(F.coalesce("feedback", F.lit(False))).alias("feedback"), F.max("error").alias("error"))
    kind = (
        F.when(F.col("error").isNotNull(), "error").when(F.col("downloads_after") > F.col("downloads_before"), "download")
        .when(F.col("url_after") != F.col("url_before"), "navigation")
        .when((F.col("modals_before") == 0) & (F.col("modals_after") > 0), "modal")
        .when((F.col("signature_after") != F.col("signature_before")) | F.col("feedback"), "dom-change").otherwise("noop"))
    return both.select("action_id", kind.alias("outcome"))


def is_meaningful() -> Column:
    return ~F.col("outcome").isin("noop", "skipped")


def page_totals(actions: DataFrame) -> DataFrame:
    """Counts per page and, with page NULL, for the run."""
    return actions.rollup("page").agg(
        F.count(F.lit(1)).alias("actions"), F.count_if(is_meaningful()).alias("meaningful"),
        F.count_if(F.col("outcome") == "skipped").alias("skipped"), F.count_if(F.col("outcome") == "noop").alias("noop"),
        F.count_if(F.col("outcome") == "download").alias("downloads"), F.count_if(F.col("outcome") == "navigation").alias("navigations"))


def top_behaviors(actions: DataFrame) -> DataFrame:
    """Up to eight distinct behaviors per page, the most telling outcomes first."""
    order = lookup(F.col("outcome"), R.OUTCOME_RANK)
    known = actions.withColumn("outcome_rank", order).filter("outcome_rank is not null")
    distinct = known.groupBy("page", "outcome", "label", "to_url", "download_file").agg(
        F.min(F.struct("outcome_rank", "seq")).alias("place"),
        F.min_by("network", "seq").alias("network"), F.min_by("screenshot", "seq").alias("screenshot"))
    return top_per_group(distinct, ["page"], [F.col("place")], R.MAX_BEHAVIORS, "rank").select(
        "page", "rank", "outcome", "label", "to_url", "download_file", "network", "screenshot")


def nav_edges(actions: DataFrame) -> DataFrame:
    """Plain navigations as distinct edges, first seen kept."""
    return actions.filter("outcome = 'navigation' and to_url is not null").groupBy("page", "label", "to_url").agg(F.min("seq").alias("seq"))


def features(actions: DataFrame) -> DataFrame:
    """Other effects as features, one per trigger and outcome, with the shortest way there."""
    rows = actions.filter("outcome in ('modal', 'dom-change', 'download')")
    return rows.groupBy("page", "label", "kind", "outcome").agg(
        F.min("seq").alias("seq"), F.min_by(F.struct("path", "page_url", "selector", "action", "value", "download_file"),
                                            F.struct(F.size("path"), F.col("seq"))).alias("f"),
        F.min_by("network", "seq").alias("network")).select("page", "label", "kind", "outcome", "seq", "f.*", "network")


def feature_calls(feature: DataFrame, fixture: DataFrame) -> DataFrame:
    """API calls of features with the fixture template they match.

    Templates are matched once per distinct (method, path), not once per feature.
    """
    from .calls import path_pattern
    calls = feature.select("page", "label", "kind", "outcome", F.explode(F.array_distinct("network")).alias("call")).select(
        "page", "label", "kind", "outcome", F.upper(F.substring_index("call", " ", 1)).alias("method"),
        U.pathname_or(F.regexp_extract("call", r"^\S+ (.*)$", 1)).alias("path")).distinct()
    head = lambda p: F.coalesce(F.get(U.segments(p), F.lit(0)), F.lit(""))
    templates = fixture.select(F.upper("method").alias("method"), "template").distinct().withColumns({
        "parts": F.size(F.split("template", "/")), "pattern": path_pattern(F.col("template")),
        "head": F.when(head(F.col("template")).rlike(r"^\{"), F.lit("{}")).otherwise(head(F.col("template")))})
    paths = calls.select("method", "path").distinct().withColumn("parts", F.size(F.split("path", "/"))).withColumn(
        "head", F.explode(F.array_distinct(F.array(head(F.col("path")), F.lit("{}")))))
    best = paths.join(templates, ["method", "parts", "head"]).filter(F.expr("path rlike pattern")).groupBy("method", "path").agg(
        F.min(F.struct(F.length(F.regexp_replace("template", r"[^{]", "")).alias("params"), F.col("template"))).alias("t")).select(
        "method", "path", F.col("t.template").alias("template"))
    return calls.join(best, ["method", "path"], "left").select("page", "label", "kind", "outcome", "method", "path", "template")


def delta_controls(child: DataFrame, parent: DataFrame) -> DataFrame:
    """Controls a state revealed: new selectors, and menu entries in any case, in tiers."""
    known = parent.select("page", "selector").distinct().withColumn("known", F.lit(True))
    kept = child.join(known, ["page", "selector"], "left").filter("in_menu or known is null").drop("known")
    return kept.withColumn("tier", F.when(F.col("in_menu"), 0).when(F.col("opens_menu"), 1).otherwise(2))


def within_budget(actions: DataFrame, total: int | None = R.MAX_ACTIONS, per_page: int | None = R.MAX_ACTIONS_PER_PAGE) -> DataFrame:
    """Actions that fit the budgets; skipped ones cost nothing.

    The page budget cuts first and bounds the rows the run-wide numbering sees.
    """
    paid = top_per_group(actions.filter("outcome <> 'skipped'"), ["page"], [F.col("seq")], per_page, "_n").drop("_n")
    ranked = paid if total is None else number_rows(paid, [], ["seq"], seq_bucket(), "_n").filter(F.col("_n") <= total).drop("_n")
    return ranked.unionByName(actions.filter("outcome = 'skipped'"))


def download_manifest(downloads: DataFrame, mode: str = "web") -> DataFrame:
    """Saved downloads (url, suggested, bytes) with their file names; large ones dropped."""
    raw = F.coalesce(F.nullif("suggested", F.lit("")), F.lit("download"))
    ext = F.regexp_extract("raw", r"^.+(\.[^.]*)$", 1)
    stem = F.substring(F.col("raw"), F.lit(1), F.length("raw") - F.length("ext"))
    named = downloads.filter(F.lit(True) if R.MAX_DOWNLOAD_BYTES is None else F.col("bytes") <= R.MAX_DOWNLOAD_BYTES).withColumn("raw", raw).withColumn("ext", ext).withColumn(
        "stem", U.sanitize_segment(stem))
    base = F.when(F.col("stem") == "page", "download").otherwise(F.col("stem"))
    tail = F.when(F.col("ext") != "", F.concat(F.lit("."), U.sanitize_segment(F.substring("ext", 2, 100)))).otherwise(F.lit(""))
    file = F.concat(F.lit(f"{mode}/downloads/"), base, F.lit("-"), F.sha1(F.concat("url", F.lit("|"), "raw")), tail)
    return named.withColumn("file", file).drop("raw", "ext", "stem")


def distinct_network(network: Column) -> Column:
    """Distinct request list of an action in order, first fifty."""
    return first_items(F.array_distinct(network), R.MAX_NETWORK)
