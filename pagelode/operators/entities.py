"""Entity graph from JSON bodies and listing rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules as R
from ..functions import urls as U
from ..functions.core import first_items, let, lookup, once, strip

_RECORD = "array<struct<id:string,place:int,v:variant>>"


def path_entity(path: Column) -> Column:
    """struct(type, id) of a path: first known type word, then the next word if it is no type."""
    def typed(segs: Column) -> Column:
        marked = F.transform(segs, lambda s: F.struct(s.alias("s"), lookup(F.lower(s), R.ENTITY_TYPES).alias("t")))

        def pick(ms: Column) -> Column:
            at = F.array_position(F.transform(ms, lambda m: m["t"].isNotNull()), F.lit(True))
            return F.when(at > 0, F.struct(
                F.get(ms, (at - 1).cast("int"))["t"].alias("type"),
                let(F.get(ms, at.cast("int")), lambda m: F.when(m["t"].isNull(), m["s"])).alias("id")))
        return let(marked, pick)
    return let(F.filter(F.split(path, "/"), lambda s: (s != "") & ~s.startswith("{") & (s != "api")), typed)


def _first(keys: Column, pick) -> Column:
    """First non-NULL ``pick(key)`` over an array of keys; the expression is built once."""
    return F.get(F.filter(F.transform(keys, pick), lambda x: x.isNotNull()), F.lit(0))


def _words(names: list[str]) -> Column:
    return F.array(*[F.lit(n) for n in names])


def record_id(v: Column) -> Column:
    """First usable id of a record: a non-blank text or a number under a known key."""
    return let(_as_object(v), _id_in)


def _id_in(members: Column) -> Column:
    """``record_id`` of a record opened before."""
    def plain(x: Column) -> Column:
        return F.when(F.schema_of_variant(x).rlike("^(STRING|BIGINT|DOUBLE|DECIMAL.*)$"),
                      F.nullif(strip(F.try_variant_get(x, "$", "string")), F.lit("")))
    return _first(_words(R.ENTITY_ID_KEYS), lambda k: let(F.try_element_at(members, k), lambda x: F.when(x.isNotNull(), plain(x))))


def _as_object(v: Column) -> Column:
    return F.try_variant_get(v, "$", "map<string,variant>")


def document_records(docs: DataFrame) -> DataFrame:
    """Records of typed documents (path, seq, url, json): type, id, url, seq, place, v."""
    typed = once(docs, e=path_entity(F.col("path")), v=F.try_parse_json("json")).filter("e is not null and v is not null")
    typed = once(typed, _m=_as_object(F.col("v")))
    # A body without an id whose first list-valued field wraps the collection.
    keys = F.json_object_keys("json")
    wrapped = F.get(F.filter(F.transform(keys, lambda k: F.try_element_at("_m", k)),
                             lambda x: F.schema_of_variant(x).startswith("ARRAY")), F.lit(0))
    target = F.when(F.col("_m").isNotNull() & _id_in(F.col("_m")).isNull(), F.coalesce(wrapped, "v")).otherwise(F.col("v"))
    opened = once(once(typed, v=target), items=F.try_variant_get("v", "$", "array<variant>"))
    fallback = F.concat(F.coalesce("e.id", "e.type"), F.lit("-"))
    rows = F.when(F.col("items").isNotNull(), F.transform(first_items(F.col("items"), R.MAX_ENTITY_ITEMS), lambda x, i: F.struct(
        F.concat(fallback, i.cast("string")).alias("id"), (i + 1).alias("place"), x.alias("v")))).otherwise(
        F.array(F.struct(F.col("e.id").alias("id"), F.lit(0).alias("place"), F.col("v").alias("v"))))
    flat = once(opened.select(F.col("e.type").alias("type"), "url", "seq", F.inline(rows.cast(_RECORD))), _m=_as_object(F.col("v")))
    named = once(flat.filter("_m is not null"), id=F.coalesce(_id_in(F.col("_m")), "id")).filter("id is not null and id <> ''")
    return named.select("type", "id", F.when(F.col("place") == 0, F.col("url")).alias("url"), "seq", "place", "v")


def href_id(href: Column) -> Column:
    """``owner/name`` (or a bare name) of a detail link, section words dropped."""
    segs = F.filter(F.split(let(href, lambda h: F.coalesce(U.pathname(h), h)), "/"), lambda s: s != "")

    def cut(ss: Column) -> Column:
        plain = F.transform(ss, lambda s, i: F.when(lookup(F.lower(s), R.ENTITY_TYPES).isNull() | (i >= F.size(ss) - 2), i))
        start = F.array_min(F.filter(plain, lambda p: p.isNotNull()))
        return let(F.slice(ss, start + 1, F.size(ss)), lambda r: F.when(
            F.size(r) >= 2, F.concat_ws("/", F.element_at(r, -2), F.element_at(r, -1))).otherwise(F.get(r, F.lit(0))))
    return let(segs, lambda ss: F.when(F.size(ss) > 0, cut(ss)))


def listing_records(rows: DataFrame) -> DataFrame:
    """Records of listing rows (page, page_url, row_no, seq, fields, href)."""
    label = F.lower("page")
    by_label = F.coalesce(*[F.when(label.contains(w), F.lit(t)) for w, t in R.ENTITY_TYPES.items()])
    kind = F.coalesce(path_entity(U.pathname(F.col("page_url")))["type"], by_label, F.lit("item"))
    text = F.coalesce(F.nullif(F.try_element_at("fields", F.lit("title")), F.lit("")), F.try_element_at("fields", F.lit("link")), F.lit(""))
    ident = F.coalesce(href_id(F.nullif("href", F.lit(""))), F.nullif(text, F.lit("")), F.concat("page", F.lit("-"), "row_no"))
    return rows.select(kind.alias("type"), ident.alias("id"), F.nullif("href", F.lit("")).alias("url"), "seq",
                       F.col("row_no").alias("place"), F.to_variant_object("fields").alias("v"))


_LINKS = "array<struct<rel:string,dst_type:string,dst_id:string,dst:variant>>"


def _links_of(owners_of_ids: bool = True) -> Column:
    """All links of a record (type, id, v): rel, dst type and id, dst record."""
    def usable(x: Column) -> Column:
        return let(F.schema_of_variant(x), lambda kind: F.when(
            kind == "STRING", F.nullif(strip(F.try_variant_get(x, "$", "string")), F.lit(""))).when(kind.startswith("OBJECT"), record_id(x)))

    def related(raw: Column) -> Column:
        """Records a key points at; NULL when the key is of no use and the next one counts."""
        items = F.coalesce(F.try_variant_get(raw, "$", "array<variant>"), F.array(raw))
        found = F.filter(F.transform(first_items(items, R.MAX_RELATION_ITEMS), lambda x: F.struct(usable(x).alias("id"), x.alias("v"))),
                         lambda t: t["id"].isNotNull())
        return F.when(raw.isNotNull(), let(found, lambda f: F.when((F.size(f) > 0) | F.schema_of_variant(raw).startswith("ARRAY"), f)))

    rules = F.array(*[F.struct(_words(keys).alias("keys"), F.lit(rel).alias("rel"), F.lit(to).alias("to")) for keys, rel, to in R.RELATION_RULES])
    by_rule = let(_as_object(F.col("v")), lambda m: F.flatten(F.transform(rules, lambda r: F.transform(
        F.coalesce(_first(r["keys"], lambda k: let(F.try_element_at(m, k), related)), F.array().cast("array<struct<id:string,v:variant>>")),
        lambda t: F.struct(r["rel"].alias("rel"), r["to"].alias("dst_type"), t["id"].alias("dst_id"), t["v"].alias("dst"))))))
    parts = F.filter(F.split("id", "/"), lambda s: s != "")
    owner = F.when(F.col("type").isin(*R.OWNED_TYPES) & (F.size(parts) >= 2), F.array(F.struct(
        F.lit("author").alias("rel"), F.lit("user").alias("dst_type"), F.try_element_at(parts, F.lit(-2)).alias("dst_id"),
        F.lit(None).cast("variant").alias("dst")))).otherwise(F.array().cast(_LINKS))
    return F.concat(by_rule, owner) if owners_of_ids else by_rule


def relations(records: DataFrame, owners_of_ids: bool = True) -> DataFrame:
    """All links of records, repeats included: src type and id, rel, dst type and id, dst record.

    With ``owners_of_ids``, an id ``owner/name`` of an owned type links to its owner as well.
    """
    return records.select("type", "id", "seq", "place", F.inline(_links_of(owners_of_ids)))


def relation_edges(records: DataFrame) -> DataFrame:
    """Distinct edges ``type/id -> type/id`` with their relation."""
    return relations(records).select(F.concat_ws("/", "type", "id").alias("src"), F.concat_ws("/", "dst_type", "dst_id").alias("dst"), "rel").distinct()


def entities(records: DataFrame) -> DataFrame:
    """Distinct entities with their first URL; ends of relations are entities too."""
    # A record and its ends leave together, so records are made once.
    ends = F.transform(_links_of(), lambda t: F.struct(t["dst_type"].alias("type"), t["dst_id"].alias("id"), F.lit(None).cast("string").alias("url")))
    both = records.select("seq", "place", F.inline(F.concat(F.array(F.struct("type", "id", "url")), ends)))
    return both.groupBy("type", "id").agg(F.min_by("url", F.when(F.col("url").isNotNull(), F.struct("seq", "place"))).alias("url"))


def entity_fields(records: DataFrame) -> DataFrame:
    """Field values of entities, later records overwrite: type, id, field, value (JSON text).

    Scalars and lists of scalars count. One aggregate per
    (entity, field), so an entity seen in very many records is no hot spot.
    """
    named = F.transform(F.filter(_links_of(), lambda t: t["dst"].isNotNull()), lambda t: F.struct(
        t["dst_type"].alias("type"), t["dst_id"].alias("id"), F.lit(1).alias("turn"), t["dst"].alias("v")))
    rows = records.select("seq", "place", F.inline(F.concat(F.array(F.struct("type", "id", F.lit(0).alias("turn"), "v")), named)))

    def scalar(x: Column) -> Column:
        return let(F.schema_of_variant(x), lambda kind: ~(kind.startswith("OBJECT") | kind.startswith("ARRAY") | (kind == "VOID")))
    entry = F.map_entries(_as_object(F.col("v")))
    flat_list = lambda x: F.forall(F.try_variant_get(x, "$", "array<variant>"), lambda y: scalar(y) & (F.schema_of_variant(y) != "BOOLEAN"))
    kept = first_items(F.filter(entry, lambda e: scalar(e["value"]) | F.coalesce(flat_list(e["value"]), F.lit(False))), R.MAX_ENTITY_FIELDS)
    text = lambda x: F.coalesce(F.to_json(F.try_variant_get(x, "$", "array<variant>")), F.to_json(x))
    fields = rows.select("type", "id", F.struct("seq", "place", "turn").alias("at"), F.inline(kept)).select(
        "type", "id", "at", F.col("key").alias("field"), text(F.col("value")).alias("value"))
    return fields.groupBy("type", "id", "field").agg(F.max_by("value", "at").alias("value"))
