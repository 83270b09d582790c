"""Fidelity verdict: pixels, weighted scores, gate, route artifacts, dataset append."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules as R
from ..functions import urls as U
from ..functions.core import number_rows, pad, seq_bucket


def weighted(parts: list[tuple[Column, float]]) -> Column:
    """Weighted mean of the signals that are present; 0 when none is."""
    total = sum((F.when(v.isNotNull(), v * w).otherwise(0.0) for v, w in parts), F.lit(0.0))
    weight = sum((F.when(v.isNotNull(), F.lit(float(w))).otherwise(0.0) for v, w in parts), F.lit(0.0))
    return F.when(weight > 0, total / weight).otherwise(F.lit(0.0))


def pixel_scores(pixels: DataFrame, pairs: DataFrame, threshold: float = R.PIXEL_THRESHOLD) -> DataFrame:
    """Share of equal pixels in the common top-left part of image pairs (golden, actual).

    ``pixels`` is (img, x, y, r, g, b). Pixels meet by image pair and place; the
    join on the place itself is the common part.
    """
    golden = pairs.join(pixels, pairs["golden"] == pixels["img"]).select("golden", "actual", "x", "y", F.struct("r", "g", "b").alias("p"))
    other = pixels.select(F.col("img").alias("actual"), "x", "y", F.struct("r", "g", "b").alias("q"))
    d = {c: (F.col(f"p.{c}") - F.col(f"q.{c}")).cast("double") for c in "rgb"}
    y = d["r"] * 0.29889531 + d["g"] * 0.58662247 + d["b"] * 0.11448223
    i = d["r"] * 0.59597799 - d["g"] * 0.27417610 - d["b"] * 0.32180189
    q = d["r"] * 0.21147017 - d["g"] * 0.52261711 + d["b"] * 0.31114694
    delta = y * y * 0.5053 + i * i * 0.299 + q * q * 0.1957
    return golden.join(other, ["actual", "x", "y"]).groupBy("golden", "actual").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(delta > R.PIXEL_MAX_DELTA * threshold * threshold).alias("differing")).withColumn(
        "score", 1 - F.col("differing") / F.col("total"))


def route_scores(routes: DataFrame) -> DataFrame:
    """Score per route from its pixel (weight 2) and tree (weight 1) signals."""
    return routes.withColumn("score", weighted([(F.col("pixel_score"), 2), (F.col("tree_score"), 1)]))


def worst_routes(scored: DataFrame, n: int = R.WORST_ROUTES) -> DataFrame:
    """The routes with the lowest scores."""
    return scored.orderBy("score", "route").limit(n)


def verdict(scored: DataFrame, results: DataFrame, threshold: float) -> DataFrame:
    """Overall score and gate: good enough overall and no failing route. One row."""
    measured = F.col("pixel_score").isNotNull() | F.col("tree_score").isNotNull()
    failing = F.when(measured, F.col("score") < threshold).otherwise(F.col("note").isNotNull())
    visual = scored.agg(F.avg("pixel_score").alias("visual"), F.avg("tree_score").alias("structural"), F.count_if(failing).alias("failing_routes"))
    functional = results.agg(F.count_if("pass").alias("passed"), F.count(F.lit(1)).alias("total"))
    rate = F.when(F.col("total") > 0, F.col("passed") / F.col("total"))
    both = visual.join(functional).withColumn("overall", weighted([(F.col("visual"), 2), (F.col("structural"), 1), (rate, 1)]))
    rounded = lambda c: F.floor(F.coalesce(F.col(c), F.lit(0.0)) * 10000 + 0.5) / 10000.0
    return both.select(rounded("overall").alias("score"), rounded("visual").alias("visual"), rounded("structural").alias("structural"), "passed", "total",
                       "failing_routes", ((F.col("overall") >= threshold) & (F.col("failing_routes") == 0)).alias("pass"))


def route_artifacts(captures: DataFrame, features: DataFrame) -> DataFrame:
    """Artifact names of captured routes and their behaviors, by page label or by path.

    ``features`` is (id, page, page_url). The two ways to match are two equi joins,
    so no theta join is needed; ids per route stay rows until counted.
    """
    shots = captures.filter("ok and screenshot is not null").select(
        "seq", "url", "label", "category", U.pathname_or(F.col("url")).alias("route"), "screenshot")
    named = features.select("id", F.col("page").alias("label"))
    placed = features.select("id", U.pathname_or(F.col("page_url")).alias("route"))
    hits = shots.select("seq", "label").join(named, "label").select("seq", "id").unionByName(
        shots.select("seq", "route").join(placed, "route").select("seq", "id")).distinct()
    counted = hits.groupBy("seq").agg(F.count(F.lit(1)).alias("behaviors"), F.min("id").alias("first_behavior"))
    swap = lambda ext: F.regexp_replace("screenshot", r"(?i)\.png$", ext)
    return shots.join(counted, "seq", "left").select(
        "seq", "route", "label", "category", "screenshot", swap(".html").alias("dom"), swap(".normalized.html").alias("normalized_dom"),
        swap(".aria.yaml").alias("tree"), F.coalesce("behaviors", F.lit(0)).alias("behaviors"), "first_behavior")


def attach_fixtures(fixtures: DataFrame, routes: DataFrame) -> DataFrame:
    """The longest route that begins a fixture path (by characters; never ``/``).

    A path is opened into its prefixes of the lengths that routes have, so this is
    an equi join and a maximum instead of comparing all pairs.
    """
    known = routes.filter("route <> '/' and route <> ''").select("route").distinct()
    lengths = known.agg(F.array_sort(F.collect_set(F.length("route"))).alias("lengths"))
    paths = fixtures.select("path").distinct().join(lengths)
    prefixes = paths.select("path", F.explode(F.filter("lengths", lambda n: n <= F.length("path"))).alias("n")).select(
        "path", F.expr("substring(path, 1, n)").alias("route"))
    best = prefixes.join(known, "route").groupBy("path").agg(F.max_by("route", F.length("route")).alias("route"))
    return fixtures.join(best, "path", "left")


def screenshot_variants(files: DataFrame) -> DataFrame:
    """``<base>@<variant>.png`` files under their base file."""
    parts = files.withColumns({"base": F.regexp_replace("file", r"(?i)(@[^/@]*)?\.png$", ""), "variant": F.regexp_extract("file", r"(?i)@([^/@]*)\.png$", 1)})
    return parts.filter(F.col("file").rlike(r"(?i)\.png$")).groupBy("base").agg(
        F.bool_or(F.col("variant") == "").alias("has_base"),
        F.array_join(F.array_sort(F.collect_set(F.nullif("variant", F.lit("")))), ",").alias("variants"))


def append_pages(existing: DataFrame, added: DataFrame) -> DataFrame:
    """New pages numbered on from the last number of their category.

    Both sides are (category, index, name); only the maximum per category is joined.
    """
    last = existing.groupBy("category").agg(F.max("index").alias("last"))
    order = number_rows(added, ["category"], ["index", "name"], seq_bucket("index"), "k")
    moved = order.join(last, "category", "left").select("category", (F.coalesce("last", F.lit(0)) + F.col("k")).alias("index"), "name")
    return existing.select("category", "index", "name", F.lit(False).alias("added")).unionByName(moved.withColumn("added", F.lit(True))).withColumn(
        "file", F.concat("category", F.lit("/"), pad(F.col("index"), 2), F.lit("-"), "name"))


def append_fixtures(existing: DataFrame, added: DataFrame) -> DataFrame:
    """Fixtures with the same file are replaced by the newer ones."""
    return existing.join(added.select("file"), "file", "left_anti").unionByName(added)
