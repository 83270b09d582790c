"""a versioned ledger of content digests, kept up by differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import redact as X
from ..functions import urls as U
from ..functions.core import number_rows
from ..session import stage
from .dom import visible_text

#: The artifact by which a page is known again under another route.
IDENTITY = "dom"

_LEDGER = "route string, artifact string, status string, digest string, previous string, peer string, bytes long, version int"


def page_artifacts() -> dict[str, Column]:
    """What is hashed of a page by default, after volatile values are replaced."""
    return {"dom": X.normalize_html(F.col("html")), "text": X.normalize_text(visible_text(F.col("html")))}


def snapshot(pages: DataFrame, artifacts: dict[str, Column] | None = None) -> DataFrame:
    """Digests of one capture: ``route, artifact, digest, bytes``.

    A route is a canonical URL; of pages with the same one, that with the smallest ``page_id`` counts. Contents are hashed
    before anything moves, so the aggregate carries digests only. Pages without a route or html are left out.
    """
    artifacts = artifacts or page_artifacts()
    hashed = pages.filter("html is not null").select(
        U.normalize_url(F.col("url")).alias("route"), "page_id", F.array(*[
            F.struct(F.lit(name).alias("artifact"), F.sha2(content, 256).alias("digest"),
                     F.octet_length(content).cast("long").alias("bytes")) for name, content in artifacts.items()]).alias("made"))
    first = hashed.filter("route is not null").groupBy("route").agg(F.min_by("made", "page_id").alias("made"))
    return first.select("route", F.inline("made"))


def state(ledger: DataFrame, version: int | None = None) -> DataFrame:
    """What the ledger knows at a version: the last row of each route and artifact that is still there."""
    known = ledger if version is None else ledger.filter(F.col("version") <= version)
    last = known.groupBy("route", "artifact").agg(F.max_by(F.struct("digest", "bytes", "status"), "version").alias("last"))
    return last.select("route", "artifact", "last.*").filter(~F.col("status").isin("removed", "moved_away")).drop("status")


def compare(before: DataFrame, after: DataFrame) -> DataFrame:
    """Every route and artifact of either side with a status: ``new, changed, unchanged, removed, moved, moved_away``.

    A route that is gone and one that is new are a move when their pages have the same digest. Many pages may share a digest
    (blank ones, say), so both sides are numbered within a digest, in parts, and joined on the number: each route moves at
    most once and no pairs are formed. ``peer`` is the other route of a move.
    """
    old = before.select("route", "artifact", F.col("digest").alias("previous"), F.col("bytes").alias("old_bytes"))
    sides = after.join(old, ["route", "artifact"], "full").withColumn(
        "status", F.when(F.col("previous").isNull(), "new").when(F.col("digest").isNull(), "removed")
        .when(F.col("digest") == F.col("previous"), "unchanged").otherwise("changed"))
    # Only routes whose identity artifact came or went as a whole can move.
    turned = sides.filter((F.col("artifact") == IDENTITY) & F.col("status").isin("new", "removed")).select(
        "route", "status", F.coalesce("digest", "previous").alias("content"), F.md5("route").alias("place"))
    numbered = number_rows(turned, ["content", "status"], ["place"], F.conv(F.substring("place", 1, 2), 16, 10).cast("int"), "nth")
    came = numbered.filter("status = 'new'").select("content", "nth", F.col("route").alias("to_route"))
    went = numbered.filter("status = 'removed'").select("content", "nth", F.col("route").alias("from_route"))
    moves = came.join(went, ["content", "nth"]).select(F.explode(F.array(
        F.struct(F.col("to_route").alias("route"), F.lit("new").alias("status"), F.col("from_route").alias("peer")),
        F.struct(F.col("from_route").alias("route"), F.lit("removed").alias("status"), F.col("to_route").alias("peer")))).alias("m")
    ).select("m.*")
    marked = sides.join(moves, ["route", "status"], "left")
    status = F.when(F.col("peer").isNull(), F.col("status")).when(F.col("status") == "new", "moved").otherwise("moved_away")
    return marked.select("route", "artifact", status.alias("status"), "digest", "previous", "peer",
                         F.coalesce("bytes", "old_bytes").alias("bytes"))


def read_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """All rows of a ledger; empty before the first version."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not (files.exists(path) and any("version=" in f.getPath().getName() for f in files.listStatus(path))):
        return spark.createDataFrame([], _LEDGER)
    return spark.read.schema(_LEDGER).parquet(folder)


def advance(spark: SparkSession, folder: str, taken: DataFrame) -> DataFrame:
    """Bring the ledger up to a capture and return its comparison with what was known.

    Only rows that differ are written, as ``version=N`` below ``folder`` (a folder that all executors share). A capture that
    differs in nothing writes nothing, so a rerun leaves the ledger as it is. Rows are written in one job, whose files appear
    when it commits; a lost executor or a failed run leaves no part of a version behind.
    """
    ledger = read_ledger(spark, folder)
    last = ledger.agg(F.max("version")).first()[0] or 0
    compared = stage(compare(state(ledger), taken), "compared")
    changed = compared.filter("status <> 'unchanged'")
    if not changed.isEmpty():
        changed.write.mode("overwrite").parquet(f"{folder}/version={last + 1}")
    return compared.withColumn("version", F.lit(last + 1))


def rollup(compared: DataFrame) -> DataFrame:
    """Rows per version, artifact and status, and their bytes."""
    return compared.groupBy("version", "artifact", "status").agg(F.count("*").alias("routes"), F.sum("bytes").alias("bytes"))
