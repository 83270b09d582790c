"""Connected components of large graphs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage


def components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Smallest id reachable from each vertex: ``id, label``, for ``vertices (id)`` and ``edges (a, b)``.

    Each round takes the smallest label among neighbours, then the label of the label (pointer jumping), so the number of
    rounds grows with the logarithm of a chain's length. Labels of a round are a table in the shared folder.
    """
    both = stage(edges.select("a", "b").union(edges.select("b", "a")).filter("a <> b").distinct(), "edges")
    labels = stage(vertices.select("id", F.col("id").alias("label")).distinct(), "labels")
    while True:
        seen = labels.select(F.col("id").alias("b"), F.col("label").alias("seen"))
        near = both.join(seen, "b").groupBy(F.col("a").alias("id")).agg(F.min("seen").alias("near"))
        lowered = labels.join(near, "id", "left").select(
            "id", F.col("label").alias("old"), F.least("label", F.coalesce("near", "label")).alias("label"))
        lowered = stage(lowered, "lowered")
        jump = lowered.select(F.col("id").alias("label"), F.col("label").alias("further"))
        labels = stage(lowered.join(jump, "label").select("id", "old", F.col("further").alias("label")), "labels")
        if labels.filter("old <> label").isEmpty():
            return labels.select("id", "label")


def bucket_links(members: DataFrame, alike: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Links ``a, b`` between members of the same buckets, without all pairs: ``members`` are ``band, key, id``.

    Each bucket compares its members with one of them, drawn by hash and differently in each band, so a bucket of any size
    makes one pair per member. Those unlike it go into another round among themselves, until none is left.
    ``alike`` gets pairs ``a, b`` and returns them with a boolean column ``alike``.
    """
    members, links = stage(members.select("band", "key", "id"), "buckets"), None
    while True:
        middle = members.groupBy("band", "key").agg(F.min_by("id", F.xxhash64("band", "id")).alias("b"))
        pairs = members.withColumnRenamed("id", "a").join(middle, ["band", "key"]).filter("a <> b")
        judged = stage(alike(pairs.select("a", "b").distinct()).select("a", "b", "alike"), "judged")
        found = judged.filter("alike").select("a", "b")
        links = found if links is None else links.union(found)
        members = stage(pairs.join(judged.filter("not alike"), ["a", "b"]).select("band", "key", F.col("a").alias("id")), "buckets")
        if members.isEmpty():
            return links
