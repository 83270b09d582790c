"""owners of entities, accepted on evidence only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import rules as R
from ..functions.bloom import bloom_filter, might_hold
from ..functions.core import round_half_up
from ..session import stage
from .entities import relations

#: Points of a record of the owner itself, and of each source that names it; the score is points / (points + 1).
RECORD_POINTS, NAMED_POINTS = 3, 1


def owner_candidates(records: DataFrame) -> DataFrame:
    """Owners that ids suggest: ``type, id, owner`` for entities of owned types whose id reads ``owner/name``.

    Ids that begin with a section word (docs, blog, tree, ...) are paths of the site and suggest none.
    """
    parts = F.filter(F.split("id", "/"), lambda s: s != "")
    found = records.select("type", "id", parts.alias("parts")).filter(
        F.col("type").isin(*R.OWNED_TYPES) & (F.size("parts") >= 2) & ~F.lower(F.get("parts", F.lit(0))).isin(*R.SECTION_WORDS))
    return found.select("type", "id", F.element_at("parts", -2).alias("owner")).distinct()


def owner_evidence(records: DataFrame) -> DataFrame:
    """What the records say about users and organisations: ``name, kind, source, seq``; names in lower case.

    ``named``: a record names it as author, owner or organisation; ``record``: it has a record of its own. An id alone
    is no evidence.
    """
    named = relations(records, owners_of_ids=False).filter(F.col("dst_type").isin("user", "org")).select(
        F.lower("dst_id").alias("name"), F.lit("named").alias("kind"), F.concat_ws("/", "type", "id").alias("source"), "seq")
    own = records.filter(F.col("type").isin("user", "org")).select(
        F.lower("id").alias("name"), F.lit("record").alias("kind"), F.concat_ws("/", "type", "id").alias("source"), "seq")
    return named.unionByName(own)


def evidenced_owners(records: DataFrame, more: DataFrame | None = None) -> DataFrame:
    """Owners with their evidence: ``type, id, owner, sources, records, score, first_source, linked``.

    ``records`` suggest owners; they and ``more`` (further records, from listings say) are searched for evidence. ``sources``
    counts the different records that name the owner, ``records`` those it has itself, ``first_source`` is the earliest. An
    owner without any is not linked: it is a namespace and no user.

    Evidence about names that no id suggests is dropped by a Bloom filter before it is shuffled, and exactly by the join.
    Sources are counted per name and source, then per name, so a name that most records bear is added up in parts.
    """
    candidates = stage(owner_candidates(records).withColumn("name", F.lower("owner")), "owner-candidates")
    evidence = owner_evidence(records)
    if more is not None:
        evidence = evidence.unionByName(owner_evidence(more))
    wanted = evidence.filter(might_hold(bloom_filter(candidates.select("name"), "name"), F.col("name")))
    per_source = wanted.groupBy("name", "kind", "source").agg(F.min("seq").alias("seq"))
    found = per_source.groupBy("name").agg(
        F.count_if(F.col("kind") == "named").alias("sources"), F.count_if(F.col("kind") == "record").alias("records"),
        F.min(F.struct("seq", "source")).alias("first"))
    points = F.when(F.col("records") > 0, RECORD_POINTS).otherwise(0) + NAMED_POINTS * F.col("sources")
    joined = candidates.join(found, "name", "left").fillna(0, ["sources", "records"])
    return joined.select("type", "id", "owner", "sources", "records", round_half_up(points / (points + 1.0), 3).alias("score"),
                         F.col("first.source").alias("first_source"), (points > 0).alias("linked"))


def evidenced_edges(records: DataFrame, more: DataFrame | None = None) -> DataFrame:
    """``src, dst, rel`` of owners with evidence: what is left of the ownership that ids suggest."""
    return evidenced_owners(records, more).filter("linked").select(
        F.concat_ws("/", "type", "id").alias("src"), F.concat(F.lit("user/"), "owner").alias("dst"), F.lit("author").alias("rel")).distinct()
