"""JSON as tables: node rows, schemas merged over samples, deep redaction."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules as R
from ..functions.core import let, once
from ..functions.redact import is_sensitive_name, redact_secrets, stabilize_text

_NONE = "array<struct<path:string,shape:string,key:string,level:int,open:boolean,masked:boolean,v:variant>>"


def kind_of(v: Column) -> Column:
    """JSON type of a variant; a number without a fraction is an integer."""
    whole = let(F.try_variant_get(v, "$", "double"), lambda number: number == F.floor(number))
    return F.when(v.isNull(), F.lit(None)).when(F.is_variant_null(v), "null").otherwise(let(F.schema_of_variant(v), lambda named: (
        F.when(named.startswith("OBJECT"), "object").when(named.startswith("ARRAY"), "array").when(named == "BOOLEAN", "boolean")
        .when(named == "STRING", "string").when(whole, "integer").otherwise("number"))))


def json_nodes(docs: DataFrame, ids: Sequence[str], source: str = "json",
               depth: int = R.SCHEMA_DEPTH, array_cap: int | None = None,
               stop_at_secrets: bool = False) -> DataFrame:
    """One row per JSON value: ids, path, shape, key, level, kind, value.

    ``shape`` is the path with ``[]`` for array places. A chain of ``depth``
    explodes opens each document once; nothing is shuffled or read twice.
    ``stop_at_secrets`` closes a value with a sensitive key and marks it.
    """
    if depth is None:
        depth = nesting(docs, source) + 1
    nodes = (
        docs.withColumn("v", F.try_parse_json(source)).filter("v is not null")
        .select(*ids, F.lit("$").alias("path"), F.lit("$").alias("shape"),
                F.lit(None).cast("string").alias("key"), F.lit(0).alias("level"),
                F.lit(True).alias("open"), F.lit(False).alias("masked"), "v")
    )
    path, shape, level = F.col("path"), F.col("shape"), F.col("level")
    for _ in range(depth - 1):
        items = F.expr("try_variant_get(v, '$', 'array<variant>')")
        if array_cap is not None:
            items = F.slice(items, 1, array_cap)
        members = F.map_entries(F.expr("try_variant_get(v, '$', 'map<string,variant>')"))

        def child(step: Column, flat: Column, key: Column, value: Column) -> Column:
            secret = is_sensitive_name(key) if stop_at_secrets else F.lit(False)
            secret = F.coalesce(secret, F.lit(False))
            return F.struct(F.concat(path, step).alias("path"), F.concat(shape, flat).alias("shape"),
                            key.alias("key"), (level + 1).alias("level"), (~secret).alias("open"),
                            secret.alias("masked"), value.alias("v"))

        # A list or object is opened once; most values are neither.
        of_items = let(items, lambda xs: F.transform(xs, lambda x, i: child(
            F.concat(F.lit("["), i.cast("string"), F.lit("]")), F.lit("[]"), F.lit(None).cast("string"), x)))
        of_members = let(members, lambda es: F.transform(es, lambda e: child(
            F.concat(F.lit("."), e["key"]), F.concat(F.lit("."), e["key"]), e["key"], e["value"])))
        inner = F.coalesce(F.when(F.col("open"), F.coalesce(of_items, of_members)), F.array().cast(_NONE))
        own = F.array(F.struct("path", "shape", "key", "level", F.lit(False).alias("open"), "masked", "v"))
        nodes = nodes.select(*ids, F.explode(F.concat(own, inner)).alias("n")).select(*ids, "n.*")
    nodes = once(nodes, kind=F.when(F.col("masked"), "masked").otherwise(kind_of(F.col("v"))))
    kind = F.col("kind")
    text = F.when(F.col("masked"), F.lit(R.REDACTED)).when(
        ~kind.isin("object", "array"), F.expr("try_variant_get(v, '$', 'string')"))
    return nodes.select(*ids, "path", "shape", "key", "level", "kind", text.alias("value"), "v")


def nesting(docs: DataFrame, source: str) -> int:
    """How deep the documents nest at most: brackets outside strings, counted in one pass."""
    outside = F.regexp_replace(F.col(source), r'"(?:[^"\\]|\\.)*+"', "")
    brackets = F.regexp_extract_all(outside, F.lit(r"[\[{]+|[\]}]+"), F.lit(0))
    depths = F.aggregate(brackets, F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")), lambda a, b: let(
        F.when(b.rlike(r"^[\[{]"), a["now"] + F.length(b)).otherwise(a["now"] - F.length(b)),
        lambda n: F.struct(n.alias("now"), F.greatest(a["most"], n).alias("most"))), lambda a: a["most"])
    return docs.filter(F.try_parse_json(source).isNotNull()).agg(F.max(depths)).first()[0] or 0


def json_leaves(docs: DataFrame, ids: Sequence[str], source: str = "json",
                depth: int | None = R.SCHEMA_DEPTH, **options) -> DataFrame:
    return json_nodes(docs, ids, source, depth, **options).filter("kind not in ('object', 'array')")


def redacted_leaves(docs: DataFrame, ids: Sequence[str], source: str = "json",
                    value_shapes: bool = False) -> DataFrame:
    """R04 and, with ``value_shapes``, R06: leaves with secret values marked."""
    leaves = json_leaves(docs, ids, source, R.REDACT_DEPTH, stop_at_secrets=True)
    if value_shapes:
        leaves = leaves.withColumn("value", F.when(
            F.col("kind") == "string", redact_secrets(F.col("value"))).otherwise(F.col("value")))
    return leaves.select(*ids, "path", "value")


def stable_leaves(docs: DataFrame, ids: Sequence[str], source: str = "json") -> DataFrame:
    """ISO dates under keys that change per capture take one fixed date."""
    hit = F.col("key").rlike(R.VOLATILE_BODY_KEY) & F.col("value").rlike(R.ISO_DATE_VALUE)
    return json_leaves(docs, ids, source).select(
        *ids, "path", F.when(hit, F.lit(R.FIXED_DATE)).otherwise(F.col("value")).alias("value"))


def stable_counts(docs: DataFrame, ids: Sequence[str], source: str = "json") -> DataFrame:
    """``stable_leaves``, and numbers under count-like keys become 0, UUIDs and relative times placeholders."""
    dated = F.col("key").rlike(R.VOLATILE_BODY_KEY) & F.col("value").rlike(R.ISO_DATE_VALUE)
    counted = F.col("kind").isin("integer", "number") & F.col("key").rlike(R.COUNT_KEY)
    value = (F.when(dated, F.lit(R.FIXED_DATE)).when(counted, F.lit("0"))
             .when(F.col("kind") == "string", stabilize_text(F.col("value"))).otherwise(F.col("value")))
    return json_leaves(docs, ids, source).select(*ids, "path", value.alias("value"))


def infer_schema(docs: DataFrame, ids: Sequence[str], source: str = "json") -> DataFrame:
    """Schema rows of single documents: ids, shape, types."""
    nodes = json_nodes(docs, ids, source, R.SCHEMA_DEPTH, R.SCHEMA_ARRAY_SAMPLE)
    return nodes.groupBy(*ids, "shape").agg(_types().alias("types"))


def _types() -> Column:
    """Distinct kinds in name order; integers widen to numbers where both occur."""
    kinds = F.array_sort(F.collect_set("kind"))
    return F.array_join(F.filter(kinds, lambda k: ~(
        (k == "integer") & F.array_contains(kinds, "number"))), "|")


def merge_schemas(docs: DataFrame, group: Sequence[str], source: str = "json") -> DataFrame:
    """One schema per group over all its samples: group, shape, types, required.

    Only counts and kind sets per (group, shape) meet in the shuffle, so an
    endpoint holding most samples costs no more than any other. A property is
    required when every object at its parent place has it.
    """
    nodes = json_nodes(docs, group, source, R.SCHEMA_DEPTH, R.SCHEMA_ARRAY_SAMPLE)
    shapes = nodes.groupBy(*group, "shape").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("kind") == "object").alias("objects"),
        _types().alias("types"))
    parent = F.when(F.col("shape") != "$", F.regexp_replace("shape", r"(\[\]|\.[^.\[]*)$", ""))
    parents = shapes.select(*group, F.col("shape").alias("parent"), "objects")
    return (
        shapes.drop("objects").withColumn("parent", parent)
        .join(parents, [*group, "parent"], "left")
        .select(*group, "shape", "types",
                (~F.col("shape").endswith("[]") & (F.col("n") == F.coalesce("objects", F.lit(-1)))).alias("required"))
    )


def canonical_json(text: Column) -> Column:
    """JSON text with sorted keys at every level and no blanks; NULL if it is no JSON."""
    return F.to_json(F.try_parse_json(text))


# --- Arrow helper for nested output -------------------------------------------------------
_NAME = re.compile(R.SENSITIVE_NAME)
_SHAPES = [(re.compile(p.replace(R.B, r"\b").replace(R.WS, r"\s").replace("(?i)", ""), re.A | f), to) for p, to, f in (
    (R.SECRET_JWT, R.REDACTED, 0), (R.SECRET_BEARER, r"\1 " + R.REDACTED, 0),
    (R.SECRET_PREFIXED, R.REDACTED, 0), (R.SECRET_HEX, R.REDACTED, re.I), (R.SECRET_BASE64, R.REDACTED, 0))]


def _mask(value, shapes: bool):
    if isinstance(value, str):
        if shapes and len(value) >= R.MIN_SECRET_CHARS:
            for pattern, mark in _SHAPES:
                value = pattern.sub(mark, value)
        return value
    if isinstance(value, list):
        return [_mask(v, shapes) for v in value]
    if isinstance(value, dict):
        return {k: R.REDACTED if k.lower() in R.SENSITIVE_HEADERS or _NAME.search(k)
                else _mask(v, shapes) for k, v in value.items()}
    return value


def redact_json(text: Column, value_shapes: bool = True) -> Column:
    """Redacted JSON text of any nesting, key order kept; NULL when it does not parse.

    Rebuilding nested JSON has no built-in form, so this one runs as an
    Arrow-batched function on the few columns a sink writes.
    """
    @F.pandas_udf("string")
    def mask(texts: pd.Series) -> pd.Series:
        def one(raw):
            if raw is None:
                return None
            try:
                return json.dumps(_mask(json.loads(raw), value_shapes), ensure_ascii=False, separators=(",", ":"))
            except ValueError:
                return None
        return texts.map(one)
    return mask(text)
