"""Reports and documents. Long ones are rows of lines with a sort key, so no document
has to fit into one task; ``write_lines`` stores them in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules as R
from ..functions import urls as U
from ..functions.core import head, lookup
from ..functions.redact import redact_map, redact_multimap
from ..operators import calls as C
from ..operators.json_tables import redact_json


def redacted_log(calls: DataFrame) -> DataFrame:
    """Rows of a redacted network log, one per call."""
    bodies = calls.withColumns({"post_text": redact_json(F.col("request_body")), "resp_text": redact_json(F.col("response_body"))})
    return bodies.select(
        "seq", "host", "method", U.redact_url(F.col("url")).alias("url"), "status", "resp_mime",
        redact_map(C.header_map(F.col("req_headers"))).alias("req_headers"), redact_map(C.header_map(F.col("resp_headers"))).alias("resp_headers"),
        redact_multimap(C.query_map(F.col("query"))).alias("query"), "post_text", F.coalesce("resp_text", F.lit("")).alias("resp_text"),
        F.octet_length(F.coalesce("resp_text", F.lit(""))).alias("resp_size"))


def har_entries(log: DataFrame, encoded: Column | None = None) -> DataFrame:
    """HAR 1.2 entries as JSON text, one per row; response texts where ``encoded`` holds are written in base64."""
    encoded = F.lit(False) if encoded is None else encoded
    text = F.when(encoded, F.base64(F.encode("resp_text", "utf-8"))).otherwise(F.col("resp_text"))
    pairs = lambda m: F.transform(F.map_entries(m), lambda e: F.struct(e["key"].alias("name"), e["value"].alias("value")))
    query = F.flatten(F.transform(F.map_entries("query"), lambda e: F.transform(e["value"], lambda v: F.struct(e["key"].alias("name"), v.alias("value")))))
    none = F.array().cast("array<string>")
    entry = F.struct(
        F.lit("1970-01-01T00:00:00.000Z").alias("startedDateTime"), F.lit(0).alias("time"),
        F.struct(F.col("method"), F.col("url"), F.lit("HTTP/1.1").alias("httpVersion"), none.alias("cookies"), pairs("req_headers").alias("headers"),
                 query.alias("queryString"), F.when(F.col("post_text").isNotNull(), F.struct(F.lit("application/json").alias("mimeType"), F.col("post_text").alias("text"))).alias("postData"),
                 F.lit(-1).alias("headersSize"), F.lit(-1).alias("bodySize")).alias("request"),
        F.struct(F.col("status"), F.lit("").alias("statusText"), F.lit("HTTP/1.1").alias("httpVersion"), none.alias("cookies"), pairs("resp_headers").alias("headers"),
                 F.struct(F.col("resp_size").alias("size"), F.coalesce(F.nullif("resp_mime", F.lit("")), F.lit("application/json")).alias("mimeType"), text.alias("text"),
                          F.when(encoded, F.lit("base64")).alias("encoding")).alias("content"),
                 F.lit("").alias("redirectURL"), F.lit(-1).alias("headersSize"), F.lit(-1).alias("bodySize")).alias("response"),
        F.create_map().cast("map<string,string>").alias("cache"),
        F.struct(F.lit(0).alias("send"), F.lit(0).alias("wait"), F.lit(0).alias("receive")).alias("timings"))
    return log.select("seq", "host", F.to_json(entry).alias("entry"))


def _lines(df: DataFrame, keys: list[str], parts: list[Column]) -> DataFrame:
    """One row per non-NULL line."""
    return df.select(*keys, F.posexplode(F.array_compact(F.array(*parts))).alias("line_no", "line"))


def _if(test: Column, *parts) -> Column:
    return F.when(test, F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts]))


def catalog_lines(catalog: DataFrame) -> DataFrame:
    """Readable endpoint catalog, the lines of each endpoint in order."""
    def sample(column: str) -> Column:
        return _if(F.col(column).isNotNull(), head(F.col(column), R.SAMPLE_CHARS), F.lit("") if R.SAMPLE_CHARS is None else F.when(F.length(column) > R.SAMPLE_CHARS, "… (truncated)").otherwise(""))
    some = lambda c: F.col(c) != ""
    return _lines(catalog, ["host", "method", "pathname"], [
        F.concat(F.lit("### "), "method", F.lit(" "), "pathname"), F.concat(F.lit("- Status: "), F.coalesce(F.nullif("statuses", F.lit("")), F.lit("(none)"))),
        _if(some("content_types"), "- Response content-type: ", F.col("content_types")), _if(some("query_keys"), "- Query params: ", F.col("query_keys")),
        _if(some("operations"), "- GraphQL operations: ", F.col("operations")), _if(F.col("streaming"), "- Streaming: yes (SSE/chunked — transcript captured in fixtures)"),
        _if(F.col("samples") > 1, "- Samples: ", F.col("samples").cast("string"), " captured call(s)"),
        _if(F.col("request_sample").isNotNull(), "Request body sample:"), sample("request_sample"),
        _if(F.col("response_sample").isNotNull(), "Response body sample:"), sample("response_sample")])


def openapi_lines(operations: DataFrame, params: DataFrame, responses: DataFrame) -> DataFrame:
    """An API document per host as ordered fragments that join to one JSON text.

    A host with very many operations spans many rows; only the parts of one
    operation are gathered.
    """
    keys = ["host", "method", "template"]
    query = params.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("name", "type"))).alias("query"))
    status = responses.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(F.col("status").cast("string"), F.struct("description")))).alias("responses"))
    path_params = F.transform(F.filter(F.split("params", ","), lambda p: p != ""), lambda p: F.struct(
        p.alias("name"), F.lit("path").alias("in"), F.lit(True).alias("required"), F.struct(F.lit("string").alias("type")).alias("schema")))
    query_params = F.transform(F.coalesce("query", F.array().cast("array<struct<name:string,type:string>>")), lambda q: F.struct(
        q["name"].alias("name"), F.lit("query").alias("in"), F.lit(False).alias("required"), F.struct(q["type"].alias("type")).alias("schema")))
    op = operations.join(query, keys, "left").join(status, keys, "left").select(
        "host", "template", F.struct(F.lower("method").alias("m"), F.to_json(F.struct(
            F.concat("method", F.lit(" "), "template").alias("summary"), F.concat(path_params, query_params).alias("parameters"), "responses")).alias("json")).alias("op"))
    # Few methods per template.
    item = op.groupBy("host", "template").agg(F.array_sort(F.collect_list("op")).alias("ops"))
    quoted = lambda c: F.substring(F.to_json(F.array(c)), F.lit(2), F.length(F.to_json(F.array(c))) - 2)
    # Lines are sorted by template, so the smallest of a host is its first entry, the only one without a comma before it.
    first = item.groupBy("host").agg(F.min("template").alias("first"))
    comma = F.when(F.col("template") == F.col("first"), "").otherwise(",")
    body = item.join(first, "host").select("host", F.lit(1).alias("part"), "template", F.concat(comma, quoted(F.col("template")), F.lit(":{"), F.array_join(F.transform(
        "ops", lambda o: F.concat(F.lit('"'), o["m"], F.lit('":'), o["json"])), ","), F.lit("}")).alias("line"))
    hosts = item.select("host").distinct()
    head = hosts.select("host", F.lit(0).alias("part"), F.lit("").alias("template"), F.concat(
        F.lit('{"openapi":"3.1.0","info":{"title":"'), "host", F.lit(' (inferred API)","version":"0.0.0"},"servers":[{"url":"https://'), "host", F.lit('"}],"paths":{')).alias("line"))
    tail = hosts.select("host", F.lit(2).alias("part"), F.lit("").alias("template"), F.lit('}}').alias("line"))
    return head.unionByName(body).unionByName(tail)


def token_lines(ranked: DataFrame) -> DataFrame:
    """Design-token report, one line per value; empty sections say so."""
    titles = {c: t[0] for c, t in R.TOKEN_CATEGORIES.items()}
    spark = ranked.sparkSession
    sections = spark.createDataFrame([(i, c, t) for i, (c, t) in enumerate(titles.items())], "section int, category string, title string")
    rows = sections.join(ranked, "category", "left")
    heads = sections.select("section", F.lit(0).alias("rank"), F.concat(F.lit("## "), "title").alias("line"))
    values = rows.select("section", F.coalesce("rank", F.lit(1)).alias("rank"), F.coalesce(F.concat(
        F.lit("- "), "value", F.lit(" ("), "n", F.lit(" uses)")), F.lit("_none captured_")).alias("line"))
    return heads.unionByName(values)


def typography_lines(families: DataFrame, scale: DataFrame, colors: DataFrame) -> DataFrame:
    """Typography report lines: section, order key, line."""
    tags = F.concat(F.when(F.col("is_body"), " (body)").otherwise(""), F.when(F.col("is_mono"), " (mono)").otherwise(""))
    first = families.select(F.lit(1).alias("section"), F.struct((-F.col("n")).alias("k"), F.col("family").alias("t")).alias("place"),
                            F.concat(F.lit("- "), "family", F.lit(" ("), "n", F.lit(" uses)"), tags).alias("line"))
    second = scale.select(F.lit(2).alias("section"), F.struct(F.col("role_order").cast("long").alias("k"), F.col("role").alias("t")).alias("place"), F.concat(
        F.lit("| "), F.concat_ws(" | ", "role", "size", "weight", "line_height", "spacing"), F.lit(" |")).alias("line"))
    third = colors.select(F.lit(3).alias("section"), F.struct((-F.col("n")).alias("k"), F.col("color").alias("t")).alias("place"),
                          F.concat(F.lit("- "), "color", F.lit(" ("), "n", F.lit(" uses)")).alias("line"))
    return first.unionByName(second).unionByName(third)


def _cell(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), r"\|", r"\\|"), r"\r?\n", " "))


def interaction_lines(actions: DataFrame) -> DataFrame:
    """Catalog lines of an interaction log: one table row per meaningful action, one bullet per skipped one."""
    base = (F.when(F.col("outcome") == "navigation", F.concat(F.lit("→ "), F.coalesce("to_url", F.lit("(unknown url)"))))
            .when(F.col("outcome") == "download", F.concat(F.lit("⬇ "), F.coalesce("download_file", F.lit("(file)"))))
            .when(F.col("outcome") == "modal", "modal opened").when(F.col("outcome") == "dom-change", "DOM updated").otherwise(F.col("outcome")))
    shot = F.when(F.col("screenshot").isNotNull(), F.concat(F.lit(" · screenshot: `"), "screenshot", F.lit("`"))).otherwise(F.lit(""))
    table_row = F.concat(F.lit("| "), F.concat_ws(" | ", _cell(F.col("label")), _cell(F.col("kind")), _cell(F.col("outcome")), _cell(F.concat(base, shot))), F.lit(" |"))
    skipped = F.concat(F.lit("- "), "label", F.lit(" ("), "kind", F.lit(")"))
    return actions.filter("outcome <> 'noop'").select("page", F.when(F.col("outcome") == "skipped", 1).otherwise(0).alias("part"), "seq", F.when(
        F.col("outcome") == "skipped", skipped).otherwise(table_row).alias("line"))


def task_lines(tasks: DataFrame) -> DataFrame:
    """Checklist lines of QC tasks."""
    api = F.when(F.size("api") > 0, F.concat(F.lit(" · API: "), F.array_join("api", ", "))).otherwise(F.lit(""))
    data = F.when(F.size("data") > 0, F.concat(F.lit(" · data renders: "), F.array_join(F.transform("data", lambda d: F.concat(
        F.lit('"'), d["text"], F.lit('"'))), ", "))).otherwise(F.lit(""))
    one_line = lambda c: F.trim(F.regexp_replace(c, r"\r?\n", " "))
    return _lines(tasks, ["number", "task_id"], [
        F.concat(F.lit("## "), "task_id", F.lit(" "), one_line(F.col("title"))), F.concat(F.lit("Expected: "), one_line(F.concat("detail", api, data)))])


def css_token_lines(ranked: DataFrame, capped: bool = False) -> DataFrame:
    """Ranked tokens as CSS variables; ``capped`` keeps each category's first few."""
    prefix = lookup(F.col("category"), {c: t[2] for c, t in R.TOKEN_CATEGORIES.items()})
    cap = lookup(F.col("category"), {c: t[3] for c, t in R.TOKEN_CATEGORIES.items()})
    value = F.trim(F.regexp_replace(F.regexp_replace("value", r"\r?\n", " "), ";", " "))
    kept = ranked.filter(F.col("rank") <= cap) if capped else ranked
    return kept.filter(value != "").select("category", "rank", F.concat(
        F.lit("  --"), prefix, F.lit("-"), "rank", F.lit(": "), value, F.lit(";")).alias("line"))


def bundle_index(artifacts: DataFrame) -> DataFrame:
    """One index line per distinct route, the first capture of a route counts."""
    first = artifacts.groupBy("route").agg(F.min_by(F.struct("label", "screenshot", "dom", "behaviors", "seq"), F.col("seq")).alias("r"))
    return first.select("route", F.col("r.seq").alias("seq"), F.concat(
        F.lit("| `"), "route", F.lit("` | "), "r.label", F.lit(" | `"), "r.screenshot", F.lit("` | `"), "r.dom", F.lit("` | "),
        F.when(F.col("r.behaviors") > 0, F.col("r.behaviors").cast("string")).otherwise(F.lit("—")), F.lit(" |")).alias("line"))


def write_lines(lines: DataFrame, path: str, order: list[str], partition: str | None = None) -> None:
    """Store report lines in order: range-partitioned, so file order is line order."""
    keys = ([partition] if partition else []) + order
    ordered = lines.repartitionByRange(*[F.col(k) for k in keys]).sortWithinPartitions(*keys)
    columns = [partition, "line"] if partition else ["line"]
    writer = ordered.select(*columns).write.mode("overwrite")
    (writer.partitionBy(partition) if partition else writer).text(path)


def write_fixtures(fixture: DataFrame, path: str) -> None:
    """Fixtures as JSON lines, split by host; one line per variant."""
    fixture.write.mode("overwrite").partitionBy("host").json(path)
