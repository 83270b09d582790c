"""pages of one template, by MinHash of their tag skeletons."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.graph import bucket_links, components
from ..session import stage
from .dom import role

BANDS, ROWS = 12, 4
#: Tags of an element's path in a shingle.
STEPS = 4


def skeletons(nodes: DataFrame) -> DataFrame:
    """The distinct path ends of each page: ``page_id, url, shingles``; a page without elements has none and no row."""
    own = F.concat("tag", F.when(role() != "", F.concat(F.lit("@"), role())).otherwise(""))
    above = F.transform(F.slice("ancestors", -F.least(F.size("ancestors"), F.lit(STEPS - 1)), F.lit(STEPS - 1)), lambda a: a["tag"])
    path = F.when(F.size("ancestors") > 0, F.concat_ws(">", above, own)).otherwise(own)
    return nodes.select("page_id", "url", path.alias("path")).groupBy("page_id").agg(
        F.min("url").alias("url"), F.array_sort(F.collect_set("path")).alias("shingles"))


def template_clusters(pages: DataFrame, percent: int = 80) -> DataFrame:
    """Template of each page: ``page_id, url, template_id, shingles`` (their number), from ``skeletons``.

    Pages link when their skeletons have a Jaccard similarity of ``percent`` or more; a template is what links connect, named by
    its smallest page. Equal skeletons are one set from the start, so one template on all pages costs one row. Different sets
    meet in buckets of MinHash bands; each bucket compares its members with one of them, and those unlike it go into another
    round. Sets that share no band are not compared: at 80 percent a pair is missed with a chance below 0.2 percent, and a
    template only falls apart if all its links are.
    """
    named = pages.withColumn("digest", F.md5(F.array_join("shingles", "\n")))
    sets = stage(named.groupBy("digest").agg(F.min("page_id").alias("set_id"), F.first("shingles").alias("shingles")), "skeletons")
    lowest = sets.select("set_id", F.explode("shingles").alias("s")).groupBy("set_id").agg(
        *[F.min(F.xxhash64(F.lit(i), "s")).alias(f"h{i}") for i in range(BANDS * ROWS)])
    members = lowest.select(F.col("set_id").alias("id"), F.inline(F.array(*[
        F.struct(F.lit(b).alias("band"), F.xxhash64(*[f"h{b * ROWS + r}" for r in range(ROWS)]).alias("key")) for b in range(BANDS)])))

    def alike(pairs: DataFrame) -> DataFrame:
        mine = sets.select(F.col("set_id").alias("a"), "shingles")
        theirs = sets.select(F.col("set_id").alias("b"), F.col("shingles").alias("others"))
        common = F.size(F.array_intersect("shingles", "others"))
        return pairs.join(mine, "a").join(theirs, "b").select(
            "a", "b", (100 * common >= percent * (F.size("shingles") + F.size("others") - common)).alias("alike"))

    labels = components(sets.select(F.col("set_id").alias("id")), bucket_links(members, alike)).withColumnRenamed("id", "set_id")
    of_digest = sets.join(labels, "set_id").select("digest", F.col("label").alias("template_id"))
    return named.join(of_digest, "digest").select("page_id", "url", "template_id", F.size("shingles").alias("shingles"))


def templates(clusters: DataFrame) -> DataFrame:
    """One row per template: ``template_id, pages, url`` of its smallest page, least and most shingles."""
    return clusters.groupBy("template_id").agg(
        F.count("*").alias("pages"), F.min_by("url", "page_id").alias("url"), F.min("shingles").alias("least"),
        F.max("shingles").alias("most"))
