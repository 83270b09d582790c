"""Accessibility trees: flatten, parents, similarity, surplus, gate."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import rules as R
from ..functions.core import first_items, round_half_up, strip, top_per_group
from ..functions.redact import normalize_text

_FLAT = "array<struct<role:string,name:string,depth:int>>"


def tree_text_nodes(texts: DataFrame) -> DataFrame:
    """Nodes of snapshot text (tree_id, yaml): pos, role, name, depth. Row-local."""
    def parse(line: Column) -> Column:
        indent = F.regexp_extract(line, r"^([ \t]*)", 1)
        content = F.substring(line, F.length(indent) + 1, F.length(line))
        body = strip(F.regexp_replace(content, r"^- |^-", ""))
        skipped = content.isin("", "-", "---", "...") | (body == "")
        name = F.regexp_replace(F.regexp_extract(body, r'^[^"]*"((?:[^"]|(?<=\\)")*)', 1), r"(?s)\\(.)", "$1")
        role = strip(F.regexp_extract(body, r'^([^":\[]*)', 1))
        spaces = F.length(indent) + F.length(F.regexp_replace(indent, " ", ""))
        return F.struct(F.when(~skipped, role).alias("role"), name.alias("name"), F.floor(spaces / 2).cast("int").alias("depth"))
    nodes = F.filter(F.transform(F.split("yaml", r"\r?\n"), parse), lambda n: (
        F.coalesce(n["role"], F.lit("")) != "") & ~n["role"].startswith("/") & ~n["role"].isin(*R.ROOT_ROLES))
    return texts.select("tree_id", F.posexplode(first_items(nodes, R.MAX_TREE_NODES)).alias("pos", "n")).select("tree_id", "pos", "n.*")


def _flatten(tree) -> list[tuple]:
    """Pre-order nodes; a skipped node leaves its children at its own depth."""
    def text(value) -> str:
        if isinstance(value, bool):
            return str(value).lower()
        return str(value) if isinstance(value, (str, int, float)) else ""

    if isinstance(tree, dict) and "role" not in tree and "children" not in tree:
        tree = next((tree[k] for k in ("nodes", "tree", "root") if isinstance(tree.get(k), list) or (k != "nodes" and k in tree)), tree)
    out, stack = [], [(tree, 0)]
    while stack and (R.MAX_TREE_NODES is None or len(out) < R.MAX_TREE_NODES):
        node, depth = stack.pop()
        if R.MAX_TREE_DEPTH is not None and depth > R.MAX_TREE_DEPTH:
            continue
        if isinstance(node, list):
            stack.extend((child, depth) for child in reversed(node))
        elif isinstance(node, dict):
            role = text(node.get("role"))
            skip = role == "" or role.startswith("/") or role in R.ROOT_ROLES
            if not skip:
                out.append((role, text(node.get("name")).strip(), depth))
            if isinstance(node.get("children"), list):
                stack.extend((child, depth + (not skip)) for child in reversed(node["children"]))
    return out


def tree_json_nodes(trees: DataFrame) -> DataFrame:
    """Nodes of JSON trees (tree_id, json): pos, role, name, depth.

    Trees nest up to 60 deep, which built-in functions do not unfold, so each
    tree is read in an Arrow batch function and exploded.
    """
    @F.pandas_udf(_FLAT)
    def flat(texts: pd.Series) -> pd.Series:
        def one(raw):
            try:
                return [{"role": r, "name": n, "depth": d} for r, n, d in _flatten(json.loads(raw))]
            except (TypeError, ValueError):
                return []
        return texts.map(one)
    return trees.select("tree_id", F.posexplode(flat("json")).alias("pos", "n")).select("tree_id", "pos", "n.*")


def normalize_names(nodes: DataFrame) -> DataFrame:
    """Names without values that change between captures."""
    return nodes.withColumn("name", normalize_text(F.col("name")))


def with_parents(nodes: DataFrame) -> DataFrame:
    """Nearest earlier node with a smaller depth; the deepest node of the table sets how many levels are looked at."""
    levels = (nodes.agg(F.max("depth")).first()[0] or 0) + 1
    before = Window.partitionBy("tree_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    last = F.array(*[F.max(F.when(F.col("depth") == d, F.col("pos"))).over(before) for d in range(levels)])
    return nodes.withColumn("_last", last).withColumn("parent_pos", F.array_max(F.slice("_last", 1, F.col("depth")))).drop("_last")


def _counts(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("tree_id", "role", "name").agg(F.count(F.lit(1)).alias("n"))


def tree_scores(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Multiset Dice of the named pairs (expected_id, actual_id); two empty trees score 1.

    Only signature counts are joined, and only for the pairs asked for.
    """
    counts = _counts(nodes)
    sizes = counts.groupBy("tree_id").agg(F.sum("n").alias("size"))
    left = pairs.join(counts.withColumnRenamed("tree_id", "expected_id").withColumnRenamed("n", "e_n"), "expected_id")
    both = left.join(counts.withColumnRenamed("tree_id", "actual_id").withColumnRenamed("n", "a_n"), ["actual_id", "role", "name"])
    shared = both.groupBy("expected_id", "actual_id").agg(F.sum(F.least("e_n", "a_n")).alias("shared"))
    out = (
        pairs.join(sizes.select(F.col("tree_id").alias("expected_id"), F.col("size").alias("expected_nodes")), "expected_id", "left")
        .join(sizes.select(F.col("tree_id").alias("actual_id"), F.col("size").alias("actual_nodes")), "actual_id", "left")
        .join(shared, ["expected_id", "actual_id"], "left").fillna(0, ["expected_nodes", "actual_nodes", "shared"]))
    total = F.col("expected_nodes") + F.col("actual_nodes")
    score = F.when(total == 0, F.lit(1.0)).otherwise(round_half_up(F.col("shared") * 2.0 / total, 3))
    return out.withColumn("score", score).select("expected_id", "actual_id", "expected_nodes", "actual_nodes", "shared", "score")


def tree_surplus(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Nodes one side has beyond the other: first surplus instances in order."""
    counts = _counts(nodes)

    def side(own: str, other: str, name: str) -> DataFrame:
        mine = pairs.join(counts.withColumnRenamed("tree_id", own), own)
        theirs = counts.withColumnRenamed("tree_id", other).withColumnRenamed("n", "o_n")
        extra = mine.join(theirs, [other, "role", "name"], "left").withColumn(
            "quota", F.col("n") - F.coalesce("o_n", F.lit(0))).filter("quota > 0").select("expected_id", "actual_id", "role", "name", "quota")
        rows = extra.join(nodes.withColumnRenamed("tree_id", own), [own, "role", "name"])
        window = Window.partitionBy("expected_id", "actual_id", "role", "name").orderBy("pos")
        kept = rows.withColumn("k", F.row_number().over(window)).filter("k <= quota")
        return top_per_group(kept, ["expected_id", "actual_id"], [F.col("pos")], R.MAX_DIFF_ITEMS, "item_no").select(
            "expected_id", "actual_id", F.lit(name).alias("side"), "item_no", "pos", "role", "name")
    return side("expected_id", "actual_id", "removed").unionByName(side("actual_id", "expected_id", "added"))


def gate(scores: DataFrame, threshold: float, exact: bool = False) -> DataFrame:
    """Pass when the score is perfect (exact) or reaches the threshold."""
    test = F.col("score") >= (1 - 1e-9) if exact else F.col("score") >= threshold
    return scores.withColumn("pass", test)


_ROLES = {"a": "link", "li": "listitem", "h1": "heading", "nav": "navigation", "article": "article", "p": "paragraph"}


def nodes_from_dom(elements: DataFrame, *more: str) -> DataFrame:
    """Tree nodes of an element table: implied roles and text names; ``more`` columns are kept."""
    from ..functions.core import lookup
    return elements.withColumn("role", lookup(F.col("tag"), _ROLES)).filter("role is not null").select(
        F.col("page_id").alias("tree_id"), "pos", "role", F.col("text").alias("name"), "depth", *more)
