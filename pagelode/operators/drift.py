"""what differs between two captures, cell by cell, for tables of any kind."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import number_rows
from ..session import stage

#: Between the parts of a row as text, and in place of a null part.
PART, NULL = "\x01", "\x02"


class Pair(NamedTuple):
    """One table of two captures: rows are matched by ``keys`` and compared in ``fields``."""

    name: str
    before: DataFrame
    after: DataFrame
    keys: Sequence[str]
    fields: Sequence[str]


def _text(columns: Sequence[str]) -> Column:
    return F.array_join(F.array(*[F.translate(F.col(c).cast("string"), PART + NULL, "") for c in columns]), PART, NULL)


def _rows(pair: Pair) -> DataFrame:
    """Distinct rows of both sides with how often each has them."""
    sides = [df.select(F.lit(pair.name).alias("dataset"), F.array(*[F.lit(f) for f in pair.fields]).alias("fields"),
                       _text(pair.keys).alias("key"), _text(pair.fields).alias("row"), F.lit(side).alias("side"))
             for side, df in (("before", pair.before), ("after", pair.after))]
    return sides[0].unionByName(sides[1])


def drift(pairs: Sequence[Pair]) -> DataFrame:
    """Changed cells of all tables: ``dataset, entity, nth, change, field, before, after``.

    Rows may repeat and a key may have many rows: equal rows of both sides cancel out first, by counts that are added up on
    the map side. What is left of a key is numbered on each side, in the order of its md5, and rows of one number are a
    change; a row without a partner is ``added`` or ``removed`` with all its cells. Numbering goes in parts and the number is
    part of the join key, so a key with a third of all rows is spread over many tasks. Nulls are values: a cell that turns
    null is a change, two nulls are equal, and null keys match each other.
    """
    rows = reduce(DataFrame.unionByName, [_rows(p) for p in pairs])
    left = rows.groupBy("dataset", "key", "row").agg(
        F.first("fields").alias("fields"), (F.count_if(F.col("side") == "before") - F.count_if(F.col("side") == "after")).alias("more"))
    single = left.filter("more <> 0").select(
        "dataset", "key", "row", "fields", F.when(F.col("more") > 0, "before").otherwise("after").alias("side"),
        F.explode(F.sequence(F.lit(1).cast("long"), F.abs("more"))).alias("copy"))
    # Rows that differ are numbered from a table: numbering reads them several times, and the captures behind them cost much.
    placed = stage(single.withColumn("place", F.concat(F.md5("row"), F.lpad(F.col("copy").cast("string"), 12, "0"))), "drift-rows")
    numbered = number_rows(placed, ["dataset", "key", "side"], ["place"], F.conv(F.substring("place", 1, 2), 16, 10).cast("int"), "nth")
    sides = [numbered.filter(F.col("side") == side).select("dataset", "key", "nth", F.split("row", PART).alias(side),
                                                           F.col("fields").alias(f"{side}_fields")) for side in ("before", "after")]
    both = sides[0].join(sides[1], ["dataset", "key", "nth"], "full")
    change = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").otherwise("changed")
    cells = both.select("dataset", "key", "nth", change.alias("change"), F.posexplode(F.coalesce("before_fields", "after_fields")).alias(
        "at", "field"), "before", "after")
    value = lambda side: F.nullif(F.get(side, F.col("at")), F.lit(NULL))
    return cells.select("dataset", F.array_join(F.transform(F.split("key", PART), lambda k: F.when(k == NULL, "").otherwise(k)), " | ").alias(
        "entity"), "nth", "change", "field", value("before").alias("before"), value("after").alias("after")).filter(
        (F.col("change") != "changed") | ~F.col("before").eqNullSafe(F.col("after")))


def drift_summary(cells: DataFrame) -> DataFrame:
    """Per table and change: entities, rows and cells touched."""
    per_row = cells.groupBy("dataset", "change", "entity", "nth").agg(F.count("*").alias("n"))
    per_entity = per_row.groupBy("dataset", "change", "entity").agg(F.count("*").alias("rows"), F.sum("n").alias("n"))
    return per_entity.groupBy("dataset", "change").agg(
        F.count("*").alias("entities"), F.sum("rows").alias("rows"), F.sum("n").alias("cells"))
