"""Readers of captured files: network logs, saved trees, bundle tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls as U
from ..operators.trees import tree_json_nodes, tree_text_nodes

_PAIRS = "array<struct<name:string,value:string>>"
HAR_SCHEMA = (
    "log struct<entries:array<struct<_resourceType:string,"
    f"request:struct<method:string,url:string,headers:{_PAIRS},queryString:{_PAIRS},postData:struct<mimeType:string,text:string>>,"
    f"response:struct<status:int,headers:{_PAIRS},content:struct<size:bigint,mimeType:string,text:string,encoding:string>>>>>")


def read_har(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """Calls of HAR 1.2 files; what cannot be read gives no rows.

    Whole files are one document each (``multiline``); a log written as one
    document per line is splittable and suits large inputs better.
    """
    docs = spark.read.schema(HAR_SCHEMA).option("mode", "PERMISSIVE").option("multiLine", multiline).json(path)
    docs = docs.withColumn("file", F.col("_metadata.file_path"))
    entries = docs.select("file", F.posexplode("log.entries").alias("pos", "e"))
    url = F.col("e.request.url")
    return entries.filter(U.is_web_url(url)).select(
        "file", "pos", F.coalesce("e.request.method", F.lit("GET")).alias("method"), url.alias("url"), U.host(url).alias("host"),
        U.pathname(url).alias("pathname"), F.coalesce("e.request.queryString", F.array().cast(_PAIRS)).alias("query"),
        F.col("e._resourceType").alias("resource_type"), F.coalesce("e.response.content.mimeType", F.lit("")).alias("resp_mime"),
        F.coalesce("e.response.status", F.lit(0)).alias("status"), F.coalesce("e.request.headers", F.array().cast(_PAIRS)).alias("req_headers"),
        F.coalesce("e.response.headers", F.array().cast(_PAIRS)).alias("resp_headers"),
        F.col("e.request.postData.text").alias("request_body"), _content(F.col("e.response.content")).alias("response_body"))


def _content(content: Column) -> Column:
    """Text of a response; base64 is decoded, what is none stays away."""
    return F.when(F.lower(content["encoding"]) == "base64", F.decode(F.try_to_binary(content["text"], F.lit("base64")), "utf-8")).otherwise(
        content["text"])


def read_trees(spark: SparkSession, path: str) -> DataFrame:
    """Nodes of saved trees: by file name JSON or snapshot text; unknown names try JSON first."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("tree_id"), F.col("value").alias("text"))
    low = F.lower("tree_id")
    as_json = low.endswith(".a11y.json") | (~low.rlike(r"\.ya?ml$") & F.try_parse_json("text").isNotNull())
    return tree_json_nodes(files.filter(as_json).withColumnRenamed("text", "json")).unionByName(
        tree_text_nodes(files.filter(~as_json).withColumnRenamed("text", "yaml")))


def read_bundle(spark: SparkSession, path: str, schema: str, key: str | None = None) -> DataFrame:
    """A bundle table of JSON files; with ``key`` the first row per key, in file and row order."""
    rows = spark.read.schema(schema).json(path)
    if key is None:
        return rows
    placed = rows.withColumn("_at", F.struct(F.col("_metadata.file_path"), F.monotonically_increasing_id()))
    others = [c for c in rows.columns if c != key]
    return placed.groupBy(key).agg(F.min_by(F.struct(*others), F.col("_at")).alias("_r")).select(key, "_r.*")
