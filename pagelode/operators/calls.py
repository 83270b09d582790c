"""Network-call analytics: filters, keys, endpoint catalogs, templates, fixtures, routes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import rules as R
from ..functions import urls as U
from ..functions.core import let, lookup, once
from ..functions.hashing import fnv1a
from ..functions.redact import is_sensitive_name, redact_secrets
from ..session import stage
from .json_tables import canonical_json, redact_json

_NO_PAIRS = "map<string,array<string>>"


def header_map(headers: Column) -> Column:
    """``array<struct<name,value>>`` -> lower-case map, the last value of a name wins."""
    def last_wins(pairs: Column) -> Column:
        later = F.transform(pairs, lambda p, i: F.struct(F.lower(p["name"]).alias("k"), p["value"].alias("v"), i.alias("i")))
        return let(later, lambda ps: F.map_from_entries(F.transform(
            F.filter(ps, lambda p: ~F.exists(ps, lambda q: (q["k"] == p["k"]) & (q["i"] > p["i"]))),
            lambda p: F.struct(p["k"], p["v"]))))
    return last_wins(headers)


def query_map(pairs: Column) -> Column:
    """Query pairs -> multimap; repeated names keep all values in order."""
    names = F.array_distinct(F.transform(pairs, lambda p: p["name"]))
    return F.map_from_arrays(names, F.transform(names, lambda n: F.transform(
        F.filter(pairs, lambda p: p["name"] == n), lambda p: p["value"])))


def is_json_call(mime: Column, url: Column) -> Column:
    return F.coalesce(mime, F.lit("")).rlike(R.JSON_MIME) | url.rlike(R.GRAPHQL)


def api_calls(calls: DataFrame, base_host: str | None = None) -> DataFrame:
    """Keep what is an API call; one filter, evaluated before any body is parsed."""
    json_like = is_json_call(F.col("resp_mime"), F.col("url"))
    kind = F.coalesce("resource_type", F.lit(""))
    out = calls.filter(
        U.is_web_url(F.col("url")) & ((kind != "document") | json_like)
        & ~kind.isin(*R.ASSET_RESOURCE_TYPES) & ~U.is_call_asset(F.col("pathname"))
        & (kind.isin("xhr", "fetch") | json_like) & (F.col("status") > 0))
    if base_host is not None:
        out = out.filter(U.same_site(F.col("host"), F.lit(base_host)))
    return out


def _masked_pairs(pairs: Column) -> Column:
    """Name and value pairs with sensitive values marked; a sensitive name that recurs keeps one mark."""
    marked = F.transform(pairs, lambda p, i: F.struct(p["name"].alias("name"), F.when(is_sensitive_name(p["name"]), F.lit(R.REDACTED)).otherwise(
        p["value"]).alias("value"), i.alias("at"), is_sensitive_name(p["name"]).alias("hit")))
    first = F.filter(marked, lambda p: ~p["hit"] | ~F.exists(marked, lambda q: (q["name"] == p["name"]) & (q["at"] < p["at"])))
    return F.transform(first, lambda p: F.struct(p["name"], p["value"]))


def masked_body(body: Column) -> Column:
    """A body without secrets: sensitive names and secret shapes of JSON at any depth, shapes and form fields of other text.

    Bodies that hold neither a sensitive word nor a secret shape stay as they are and never leave the JVM.
    """
    shaped = redact_secrets(body)
    risky = body.rlike(R.SENSITIVE_NAME) | body.rlike("(?i)" + "|".join(R.SENSITIVE_HEADERS)) | (shaped != body)
    plain = F.regexp_replace(shaped, r"(?i)((?:^|&)[^=&]*(?:" + R.SENSITIVE_NAME.removeprefix("(?i)") + r")[^=&]*)=[^&]*", "$1=" + R.REDACTED)
    return F.when(risky, F.coalesce(redact_json(F.when(risky, body)), plain)).otherwise(body)


def masked_calls(calls: DataFrame) -> DataFrame:
    """Calls as every later step may see them: headers, query, URL and bodies without secrets."""
    return calls.withColumns({
        "req_headers": _masked_pairs(F.col("req_headers")), "resp_headers": _masked_pairs(F.col("resp_headers")),
        "query": _masked_pairs(F.col("query")), "url": U.redact_url(F.col("url")),
        "request_body": masked_body(F.col("request_body")), "response_body": masked_body(F.col("response_body"))}).drop("qs")


def body_key(method: Column, url: Column) -> Column:
    return F.concat(F.upper(method), F.lit(" "), F.regexp_replace(url, "#.*$", ""))


def first_bodies(bodies: DataFrame, max_bytes: int | None = R.MAX_BODY_BYTES) -> DataFrame:
    """First body per (method, URL without fragment); foreign bodies and, with a limit, large ones drop out."""
    url = F.col("url")
    fits = lambda c: F.lit(True) if max_bytes is None else F.octet_length(c) <= max_bytes
    keep_response = is_json_call(F.col("response_type"), url) & fits("response_body")
    keep_request = is_json_call(F.col("request_type"), url) & fits("request_body")
    rows = bodies.select(
        body_key(F.col("method"), url).alias("body_key"), "seq",
        F.when(keep_request, F.col("request_body")).alias("request_body"),
        F.when(keep_response, F.col("response_body")).alias("response_body"),
        F.col("request_type"), F.col("response_type"),
    ).filter("request_body is not null or response_body is not null")
    return rows.groupBy("body_key").agg(F.min_by(F.struct(
        "request_body", "response_body", "request_type", "response_type"), F.col("seq")).alias("b")).select("body_key", "b.*")


def attach_bodies(calls: DataFrame, bodies: DataFrame) -> DataFrame:
    """Calls with their side-car bodies, matched on method and URL."""
    side = first_bodies(bodies).select("body_key", F.struct(
        "request_body", "response_body", "request_type", "response_type").alias("side"))
    return calls.withColumn("body_key", body_key(F.col("method"), F.col("url"))).join(side, "body_key", "left")


def parse_body(text: Column, max_bytes: int | None = R.MAX_BODY_BYTES) -> Column:
    """Body as VARIANT, NULL when it is no JSON or larger than a limit."""
    parsed = F.try_parse_json(text)
    return parsed if max_bytes is None else F.when(F.octet_length(text) <= max_bytes, parsed)


def graphql_operation(body: Column) -> Column:
    """``operationName``, else the name behind query, mutation or subscription."""
    def name(v: Column) -> Column:
        text = F.try_variant_get(v, "$.query", "string")
        return F.coalesce(F.nullif(F.try_variant_get(v, "$.operationName", "string"), F.lit("")),
                          F.nullif(F.regexp_extract(text, R.GRAPHQL_OPERATION, 2), F.lit("")))
    return let(F.try_parse_json(body), name)


def query_signature(pairs: Column) -> Column:
    """C11: sorted query without volatile names; values of a name sorted and joined."""
    kept = F.filter(pairs, lambda p: ~p["name"].rlike(R.VOLATILE_QUERY))
    return let(kept, lambda ps: F.array_join(F.transform(
        F.array_sort(F.array_distinct(F.transform(ps, lambda p: p["name"]))),
        lambda n: F.concat(n, F.lit("="), F.array_join(F.array_sort(F.transform(
            F.filter(ps, lambda p: p["name"] == n), lambda p: p["value"])), ","))), "&"))


def body_hash(body: Column, operation: Column) -> Column:
    """C14: hash of the canonical request body; empty without a body or for GraphQL.

    Text that is no JSON counts as a JSON string.
    """
    quoted = F.to_json(F.to_variant_object(F.array(body)))
    plain = F.substring(quoted, F.lit(2), F.length(quoted) - 2)
    return F.when(body.isNull() | operation.isNotNull(), F.lit("")).otherwise(
        fnv1a(F.coalesce(canonical_json(body), plain)))


def is_stream(mime: Column) -> Column:
    return F.coalesce(mime, F.lit("")).rlike(R.STREAM_MIME)


# --- templates ---------------------------------------------------------------------------------


def _is_id(seg: Column) -> Column:
    return seg.rlike(R.SEGMENT_NUMBER) | seg.rlike(R.SEGMENT_UUID) | seg.rlike(R.SEGMENT_HEX)


def path_templates(paths: DataFrame) -> DataFrame:
    """Template of every distinct (host, pathname).

    A segment that is an id by shape becomes a parameter at once. Another segment
    does so when it varies among paths of the host that agree in all other
    places, and looks like an id. "All other places" is one grouping key, so the
    sibling scan is a single aggregation; a hot host spreads over its keys.
    """
    distinct = paths.select("host", "pathname").distinct().withColumn("segs", U.segments(F.col("pathname")))
    spots = distinct.select(
        "host", "pathname", "segs", F.posexplode_outer("segs").alias("i", "seg")).withColumn(
        "by_shape", F.coalesce(_is_id(F.col("seg")), F.lit(False)))
    # Only segments that could become parameters need the sibling test.
    open_spots = spots.filter(~F.col("by_shape") & (F.col("seg").rlike(r"\d") | (F.length("seg") >= R.LONG_SEGMENT)))
    blanked = F.concat_ws("/", F.transform(F.col("segs"), lambda s, j: F.when(
        j == F.col("i"), F.lit("")).otherwise(s)))
    # The smallest and largest value differ exactly when more than one exists.
    keyed = open_spots.select("host", "pathname", "i", "seg", blanked.alias("others"))
    siblings = keyed.groupBy("host", "i", "others").agg(
        F.min("seg").alias("lo"), F.max("seg").alias("hi")).filter("lo <> hi").select("host", "i", "others")
    # Words of the same place also count as siblings, though they never turn into parameters.
    words = spots.filter(~F.col("by_shape") & ~(F.col("seg").rlike(r"\d") | (F.length("seg") >= R.LONG_SEGMENT)))
    ids = spots.filter("by_shape")
    others_of = lambda df: df.select("host", "i", blanked.alias("others")).distinct()
    neighbours = siblings.unionByName(others_of(words)).unionByName(others_of(ids)).distinct()
    varying = keyed.join(neighbours, ["host", "i", "others"], "left_semi").groupBy("host", "pathname").agg(
        F.collect_set("i").alias("varying"))
    joined = distinct.join(varying, ["host", "pathname"], "left")
    flags = F.transform(F.col("segs"), lambda s, i: F.struct(
        s.alias("s"), (_is_id(s) | F.coalesce(F.array_contains(F.col("varying"), i), F.lit(False))).alias("p")))
    # Name: singular of the nearest static segment before; a repeat gets a number.
    named = F.transform(F.col("flags"), lambda x, i: F.struct(
        x["s"].alias("s"), x["p"].alias("p"),
        F.coalesce(let(F.element_at(F.concat(F.array(F.lit("id")), F.transform(F.filter(
            F.slice(F.col("flags"), 1, i), lambda y: ~y["p"]), lambda y: y["s"])), -1), lambda w: F.when(
                (F.length(w) > 1) & w.rlike("(?i)s$"), F.substring(w, F.lit(1), F.length(w) - 1)).otherwise(w)),
            F.lit("id")).alias("base")))
    numbered = F.transform(F.col("named"), lambda x, i: F.struct(
        x["s"].alias("s"), x["p"].alias("p"), F.concat(x["base"], let(F.size(F.filter(
            F.slice(F.col("named"), 1, i), lambda y: y["p"] & (y["base"] == x["base"]))), lambda n: F.when(
                n > 0, (n + 1).cast("string")).otherwise(F.lit("")))).alias("name")))
    return (
        joined.withColumn("flags", flags).withColumn("named", named).withColumn("numbered", numbered)
        .select("host", "pathname",
                F.concat(F.lit("/"), F.array_join(F.transform("numbered", lambda x: F.when(
                    x["p"], F.concat(F.lit("{"), x["name"], F.lit("}"))).otherwise(x["s"])), "/")).alias("template"),
                F.transform(F.filter("numbered", lambda x: x["p"]), lambda x: x["name"]).alias("params"))
    )


def with_templates(calls: DataFrame) -> DataFrame:
    return calls.join(path_templates(calls), ["host", "pathname"])


# --- catalog and contract ----------------------------------------------------------------------------


def endpoint_catalog(calls: DataFrame) -> DataFrame:
    """One row per (host, method, pathname); sets and firsts combine on the map side."""
    op = F.when(F.col("pathname").rlike(R.GRAPHQL), F.nullif(F.try_variant_get(
        F.try_parse_json("request_body"), "$.operationName", "string"), F.lit("")))
    prepared = calls.withColumns({
        "op": op, "names": F.transform("query", lambda p: p["name"]),
        "req_json": F.when(F.try_parse_json("request_body").isNotNull(), F.col("request_body")),
        "resp_json": F.when(F.try_parse_json("response_body").isNotNull(), F.col("response_body"))})
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ", ")
    base = prepared.groupBy("host", "method", "pathname").agg(
        F.count(F.lit(1)).alias("samples"), joined(F.col("status").cast("string")).alias("statuses"),
        joined("resp_mime").alias("content_types"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("names")))), ", ").alias("query_keys"),
        joined("op").alias("operations"), F.bool_or(is_stream(F.col("resp_mime"))).alias("streaming"),
        F.min_by("req_json", F.when(F.col("req_json").isNotNull(), F.col("seq"))).alias("request_sample"),
        F.min_by("resp_json", F.when(F.col("resp_json").isNotNull(), F.col("seq"))).alias("response_sample"))
    return base


def api_summary(calls: DataFrame) -> DataFrame:
    """Calls and distinct operations, per host and in total (host NULL)."""
    operations = calls.groupBy("host", "method", "template").agg(F.count(F.lit(1)).alias("n"))
    return operations.rollup("host").agg(
        F.count_distinct("host").alias("hosts"), F.count(F.lit(1)).alias("operations"),
        F.sum("n").alias("calls"))


def operations(calls: DataFrame) -> DataFrame:
    """Contract row per (host, method, template)."""
    op = F.when(F.col("url").rlike(R.GRAPHQL), graphql_operation(F.col("request_body")))
    grouped = calls.withColumn("op", op).withColumn("method", F.upper("method")).groupBy("host", "method", "template").agg(
        F.first("params").alias("params"), F.count(F.lit(1)).alias("samples"),
        F.array_join(F.array_sort(F.collect_set("op")), ",").alias("graphql_operations"),
        F.count_if(F.try_parse_json("request_body").isNotNull()).alias("request_bodies"))
    return grouped.withColumn("params", F.array_join("params", ","))


def operation_query_params(calls: DataFrame) -> DataFrame:
    """Query parameters of an operation; the first value seen decides the type."""
    pairs = calls.select("host", F.upper("method").alias("method"), "template", "seq",
                         F.explode(query_map(F.col("query"))).alias("name", "values"))
    return pairs.groupBy("host", "method", "template", "name").agg(F.min_by(
        F.when(F.size("values") > 1, "array").otherwise("string"), "seq").alias("type"))


def operation_responses(calls: DataFrame) -> DataFrame:
    """Responses of an operation by status, with the first body as example."""
    body = F.when(F.try_parse_json("response_body").isNotNull(), F.col("response_body"))
    return calls.withColumn("body", body).groupBy("host", F.upper("method").alias("method"), "template", "status").agg(
        F.count(F.lit(1)).alias("samples"),
        F.min_by("body", F.when(F.col("body").isNotNull(), F.col("seq"))).alias("example")).withColumn(
        "description", F.coalesce(lookup(F.col("status").cast("string"), R.STATUS_TEXT), F.lit("")))


def operation_examples(calls: DataFrame, body: str = "response_body") -> DataFrame:
    """Distinct bodies per operation and status, in order."""
    from ..functions.core import rank_all, top_per_group
    keys = ["host", "method", "template", "status"]
    distinct = (calls.withColumn("method", F.upper("method")).filter(F.try_parse_json(body).isNotNull())
                .groupBy(*keys, F.col(body).alias("value")).agg(F.min("seq").alias("seq")))
    ranked = (rank_all(distinct, keys, ["seq"], "sample") if R.MAX_EXAMPLES is None
              else top_per_group(distinct, keys, [F.col("seq")], R.MAX_EXAMPLES, "sample"))
    return ranked.select(*keys, "sample", "value")


# --- fixtures and routes ---------------------------------------------------------------------------------


def kept_headers(headers: Column) -> Column:
    return F.map_filter(headers, lambda k, v: k.rlike(R.KEPT_RESPONSE_HEADER))


def fixtures(calls: DataFrame) -> DataFrame:
    """One row per variant of an endpoint, first response kept, samples counted."""
    op = F.when(F.col("url").rlike(R.GRAPHQL), graphql_operation(F.col("request_body")))
    keyed = calls.withColumn("op", op).withColumns({
        "method": F.upper("method"), "query_sig": query_signature(F.col("query")),
        "body_hash": body_hash(F.col("request_body"), F.col("op"))})
    keys = ["host", "method", "template", "status", "query_sig", "body_hash", "op"]
    # Narrow keys are aggregated by hash; only the winners' bodies are joined, on their sequence number.
    first = keyed.groupBy(*keys).agg(F.count(F.lit(1)).alias("samples"), F.min("seq").alias("seq"))
    kept = calls.select("seq", "url", F.col("response_body").alias("response"), F.col("resp_mime").alias("content_type"), "resp_headers")
    return first.join(kept, "seq").select(*keys, "samples", "seq", "url", "response", "content_type",
                                          kept_headers(header_map(F.col("resp_headers"))).alias("headers"),
                                          is_stream(F.col("content_type")).alias("is_stream"))


def crud_role(fixture: DataFrame) -> DataFrame:
    """C17: resource and role of a fixture; none for GraphQL and streams."""
    segs = U.segments(F.col("template"))
    static = F.filter(segs, lambda s: ~s.rlike(r"^\{[^}]+\}$"))
    detail = F.try_element_at(segs, F.lit(-1)).rlike(r"^\{[^}]+\}$")
    plain = F.col("op").isNull() & ~F.col("is_stream")
    method = F.upper("method")
    role = (F.when((method == "GET") & detail, "get").when(method == "GET", "list")
            .when((method == "POST") & ~detail, "create").when(method.isin("PUT", "PATCH") & detail, "update")
            .when((method == "DELETE") & detail, "delete"))
    resource = F.when(plain, F.try_element_at(static, F.lit(-1)))
    return fixture.withColumn("crud", F.when(resource.isNotNull(), role)).withColumn(
        "resource", F.when(F.col("crud").isNotNull(), resource))


def routes(fixture: DataFrame) -> DataFrame:
    """Fixture -> route row; the query signature becomes a match map again."""
    match = F.when(F.col("query_sig") != "", F.str_to_map(F.col("query_sig"), F.lit("&"), F.lit("=")))
    return crud_role(fixture).withColumn("match_query", match)


def path_pattern(template: Column) -> Column:
    """Regular expression of a template: parameters match one segment."""
    return F.concat(F.lit("^"), F.array_join(F.transform(F.split(template, "/"), lambda s: F.when(
        s.rlike(r"^\{[^}]+\}$"), F.lit("[^/]+")).otherwise(F.regexp_replace(
            s, r"([.*+?^${}()|\[\]\\])", r"\\$1"))), "/"), F.lit("$"))


def best_routes(requests: DataFrame, route: DataFrame) -> DataFrame:
    """Best route per request: operation, body and query add to the score; of equal scores, the first route.

    A request first finds its templates (equi join on method, segment count and first segment, pattern as residual). A route
    is indexed under each combination of the signals it could be found by, the first route per key kept, so a request meets
    at most one route per key and never all variants of a hot endpoint.

    A recorded query that is only part of the asked one adds little and is costly to look for, so exact keys come first.
    Requests whose best score no such part could reach are done. For the rest, recorded queries are indexed by their first
    ``name=``; a part can only begin in a name, so a request looks up the ends of its own names there, and only where one is
    recorded does it cut parts of the recorded lengths and probe them.
    """
    first = lambda path: F.coalesce(F.get(U.segments(path), F.lit(0)), F.lit(""))
    recorded = stage(route.select(
        F.upper("method").alias("method"), "template", "route_seq",
        F.array_distinct(F.array(F.lit("*"), F.coalesce("op", F.lit("*")))).alias("ops"),
        F.array_distinct(F.array(F.lit("*"), F.when(F.col("body_hash") != "", F.col("body_hash")).otherwise(F.lit("*"))))
        .alias("bodies"), "query_sig"), "recorded")
    templates = recorded.select("method", "template").distinct().select(
        "method", "template", F.size(F.split("template", "/")).alias("parts"),
        F.when(first(F.col("template")).rlike(r"^\{"), F.lit("{}")).otherwise(first(F.col("template"))).alias("head"),
        path_pattern(F.col("template")).alias("pattern"))
    asked = requests.withColumn("parts", F.size(F.split("pathname", "/"))).withColumn("head", F.explode(
        F.array_distinct(F.array(first(F.col("pathname")), F.lit("{}")))))
    asked = stage(asked.join(templates, ["method", "parts", "head"]).filter(F.expr("pathname rlike pattern")).select(
        "request_id", "method", "template", "op", "body_hash", "query_sig"), "asked")
    index = stage(recorded.withColumn("op_key", F.explode("ops")).withColumn("body_key", F.explode("bodies"))
                  .withColumn("query_key", F.explode(F.array(F.lit("*"), F.concat(F.lit("="), "query_sig"))))
                  .groupBy("method", "template", "op_key", "body_key", "query_key").agg(F.min("route_seq").alias("route_seq")), "index")

    def probe(key: Column, score: Column | int) -> Column:
        return F.struct(key.alias("k"), (F.lit(score) if isinstance(score, int) else score).alias("s"))

    def hits(probed: DataFrame) -> DataFrame:
        """Best hit of each request, from rows with ``q``: a query key and its score."""
        keys = (probed.withColumn("o", F.explode(F.filter(F.array(probe(F.lit("*"), 0), probe(F.col("op"), R.SCORE_OPERATION)),
                                                          lambda x: x["k"].isNotNull())))
                .withColumn("b", F.explode(F.filter(F.array(probe(F.lit("*"), 0), probe(F.col("body_hash"), R.SCORE_BODY)),
                                                    lambda x: x["k"] != "")))
                .select("request_id", "method", "template", F.col("o.k").alias("op_key"), F.col("b.k").alias("body_key"),
                        F.col("q.k").alias("query_key"),
                        (F.lit(R.SCORE_BASE) + F.col("o.s") + F.col("b.s") + F.col("q.s")).alias("score")))
        found = keys.join(index, ["method", "template", "op_key", "body_key", "query_key"])
        return found.groupBy("request_id").agg(F.max_by(
            F.struct("template", "route_seq", "score"), F.struct(F.col("score"), -F.col("route_seq"))).alias("b"))

    sig = F.col("query_sig")
    exact = stage(hits(asked.withColumn("q", F.explode(F.array(probe(F.lit("*"), 0), probe(F.concat(F.lit("="), sig), F.when(
        sig == "", R.SCORE_GENERIC).otherwise(R.SCORE_QUERY)))))), "exact-routes")
    bound = (F.lit(R.SCORE_BASE + R.SCORE_QUERY_PART) + F.when(F.col("op").isNotNull(), R.SCORE_OPERATION).otherwise(0)
             + F.when(F.col("body_hash") != "", R.SCORE_BODY).otherwise(0))
    open_ = asked.join(exact.select("request_id", F.col("b.score").alias("so_far")), "request_id", "left").filter(
        (sig != "") & (F.coalesce("so_far", F.lit(0)) <= bound))
    starts = recorded.filter(sig != "").select("method", "template", F.regexp_extract("query_sig", "^([^=]*=)", 1).alias("start"),
                                               F.length("query_sig").alias("n")).filter("start <> ''").groupBy(
        "method", "template", "start").agg(F.collect_set("n").alias("lengths"))
    # Where each name of the asked query ends, and every way to begin within it.
    names = F.filter(F.transform(F.sequence(F.lit(1), F.length("query_sig")), lambda i: F.when(F.substring("query_sig", i, F.lit(1)) == "=", i)),
                     lambda i: i.isNotNull())
    head = F.regexp_extract(F.substring(sig, F.lit(1), F.col("at")), r"([^&=]*=)$", 1)
    begun = open_.withColumn("at", F.explode(names)).withColumn("head", head).withColumn(
        "skip", F.explode(F.sequence(F.lit(0), F.length("head") - 1))).select(
        "request_id", "method", "template", "op", "body_hash", "query_sig", (F.col("at") - F.length("head") + F.col("skip") + 1).alias("begin"),
        F.substring("head", F.col("skip") + 1, F.length("head")).alias("start"))
    parts = begun.join(starts, ["method", "template", "start"]).withColumn("n", F.explode("lengths")).filter(
        (F.col("n") < F.length("query_sig")) & (F.col("begin") + F.col("n") - 1 <= F.length("query_sig")))
    inner = hits(parts.withColumn("q", probe(F.concat(F.lit("="), F.substring("query_sig", F.col("begin"), F.col("n"))), R.SCORE_QUERY_PART)))
    best = exact.unionByName(inner).groupBy("request_id").agg(
        F.max_by("b", F.struct(F.col("b.score"), -F.col("b.route_seq"))).alias("b"))
    return best.select("request_id", "b.template", "b.route_seq", "b.score")


# --- resource state ------------------------------------------------------------------------------------------


def opened_log(log: DataFrame) -> DataFrame:
    """Events with the fields of their bodies; a reset deletes."""
    entries = F.expr("map_entries(try_variant_get(try_parse_json(body), '$', 'map<string,variant>'))")
    ops = F.when(F.col("op") == "reset", "delete").otherwise(F.col("op"))
    rows = once(log.withColumn("op", ops), fields=F.transform(entries, lambda e: F.struct(
        e["key"].alias("field"), F.to_json(e["value"]).alias("value"))))
    # A replace without an object keeps the record; a create stores its id.
    return rows.filter("op <> 'replace' or fields is not null").withColumn("fields", F.when(
        (F.col("op") == "create") & ~F.coalesce(F.exists("fields", lambda e: e["field"] == "id"), F.lit(False)),
        F.concat(F.coalesce("fields", F.array().cast("array<struct<field:string,value:string>>")), F.array(F.struct(
            F.lit("id").alias("field"), F.concat(F.lit('"'), "id", F.lit('"')).alias("value"))))).otherwise(F.col("fields")))


def replaced_records(opened: DataFrame) -> DataFrame:
    """Records of which nothing from before the log is left: ``resource, id``."""
    return opened.filter("op <> 'merge'").select("resource", "id").distinct()


def fold_fields(rows: DataFrame) -> DataFrame:
    """``fold_state`` of an opened log with the sequence number of the event that set each field."""
    base = rows.filter("op <> 'merge'").groupBy("resource", "id").agg(F.max("seq").alias("base_seq"))
    laid = rows.filter("op <> 'delete'").join(base, ["resource", "id"], "left").filter(
        "seq >= coalesce(base_seq, seq)")
    field = laid.select("resource", "id", "seq", F.inline("fields"))
    return field.groupBy("resource", "id", "field").agg(F.max_by("value", "seq").alias("value"), F.max("seq").alias("seq"))


def fold_state(log: DataFrame) -> DataFrame:
    """C20: final fields of every record after create, replace, merge and delete.

    Whole-record events set a base; later merges lay single fields over it. Both
    are aggregates per record and field, so order needs no row-by-row loop.
    """
    return fold_fields(opened_log(log)).drop("seq")


def record_lookup(records: DataFrame, asks: DataFrame) -> DataFrame:
    """C20: detail lookup; an unknown id finds the only record of a one-record resource."""
    only = records.groupBy("resource").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("only_id")).filter("n = 1")
    known = records.select("resource", "id", F.col("id").alias("found_id"))
    return asks.join(known, ["resource", "id"], "left").join(only.select("resource", "only_id"), "resource", "left").select(
        "resource", "id", F.coalesce("found_id", "only_id").alias("found_id"))


def record_rows(docs: DataFrame, body: str = "response") -> DataFrame:
    """Rows of a collection body, at top level or under a known envelope key."""
    v = F.try_parse_json(body)
    rows = let(v, lambda x: F.coalesce(
        F.try_variant_get(x, "$", "array<variant>"),
        *[F.try_variant_get(x, f"$.{k}", "array<variant>") for k in R.ENVELOPE_KEYS]))
    single = let(v, lambda x: F.when(F.try_variant_get(x, "$", "map<string,variant>").isNotNull(), F.array(x)))
    opened = docs.withColumn("_rows", rows).withColumn("wrapped", F.col("_rows").isNotNull())
    return opened.select(*docs.columns, "wrapped", F.posexplode(F.coalesce("_rows", single)).alias("pos", "record"))


def hydrate(docs: DataFrame, body: str = "response") -> DataFrame:
    """Collection records with their id: first id-like key, else the place."""
    rows = record_rows(docs, body)
    keys = [F.try_variant_get(F.col("record"), f"$.{k}", "string") for k in R.RECORD_ID_KEYS]
    return rows.withColumn("record_id", F.coalesce(*keys, (F.col("pos") + 1).cast("string"))).withColumn(
        "record", F.to_json("record"))
