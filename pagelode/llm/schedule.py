"""Mixing sources to target weights with a low-discrepancy schedule.

Golden-ratio points are mapped through the cumulative weights of the sources: point t names the source that slot t of
the mix takes from. Slots are ranked per source, and rank r takes block r of the source, whose documents are shuffled
and cut into blocks of equal numbers of tokens; after the last block the source starts again.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import number_rows, running
from ..session import stage
from .common import arrow_map, join_small, values

#: Golden-ratio points are t * GOLDEN modulo 2**40, in steps that fit a long.
BITS = 40
GOLDEN = round(0.6180339887498949 * 2 ** BITS) | 1
#: Documents of a source are dealt over 16**HEX buckets by the head of their shuffle key.
HEX = 3
CELLS = 1 << 12


def sizes(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns and ``_size``: words of the whole text, 0 for null."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = pa.array([len(t.split()) for t in values(batch.column(batch.num_columns - 1))], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], n], [*batch.schema.names[:-1], "_size"])

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema)
    return arrow_map(docs.withColumn("_text", F.col(text).cast("string")), run, f"{fields}_size long")


def targets(sized: DataFrame, source: str, weights: Sequence[int], share: float, most: float) -> DataFrame:
    """``source_rank, source, source_size, weight, target`` of every source.

    Sources by code point, null last, weigh ``weights`` in turn. They share ``share`` times all sizes by weight; a source
    stops at ``most`` times its size and the excess is shared again, until none is above.
    """
    sums = stage(sized.groupBy(F.col(source).cast("string").alias("source")).agg(F.sum("_size").alias("source_size")), "mix-sources")
    # One row per source: numbered over buckets of the first characters, so that no task holds all of them.
    order = F.struct(F.col("source").isNull().alias("absent"), F.substring(F.coalesce("source", F.lit("")), 1, 3).alias("head"))
    ranked = number_rows(sums.withColumns({"_absent": F.col("source").isNull(), "_all": F.lit(1)}), ["_all"],
                         ["_absent", "source"], order, "source_rank")
    kinds = F.array(*[F.lit(w) for w in weights])
    rows = stage(ranked.select("source_rank", "source", "source_size",
                               F.element_at(kinds, ((F.col("source_rank") - 1) % len(weights) + 1).cast("int")).alias("weight")), "mix-ranked")
    total = rows.agg(F.sum("source_size")).first()[0] or 0
    full, level = F.lit(False), None
    while True:
        # Each round caps at least one more source or ends.
        row = rows.agg(F.sum(F.when(full, F.col("source_size"))).alias("held"),
                       F.sum(F.when(~full, F.col("weight"))).alias("open")).first()
        if not row.open:
            break
        level = max(0.0, share * total - most * (row.held or 0)) / row.open
        above = full | (F.lit(level) * F.col("weight") > most * F.col("source_size"))
        if rows.filter(above & ~full).isEmpty():
            break
        full = above
    target = F.when(full, most * F.col("source_size")).otherwise(F.lit(level or 0.0) * F.col("weight"))
    return stage(rows.withColumn("target", target.cast("double")), "mix-targets")


def blocks(sized: DataFrame, source: str, key: str, block: int, seed: int) -> DataFrame:
    """``source, block, start, length`` and the columns of ``sized``: pieces of documents in blocks of ``block`` tokens.

    Documents are ordered by the MD5 of seed, key and size; ``start`` is a piece's place in its block. Running sums go over
    buckets of that hash, so a source with a third of all rows is spread over 4,096 buckets.
    """
    mixed = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(key).cast("string"), F.lit("null")), F.col("_size").cast("string")).cast("binary"))
    rows = sized.filter(F.col("_size") > 0).withColumns({"_source": F.col(source).cast("string"), "_mixed": mixed})
    placed = running(rows, ["_source"], ["_mixed"], F.substring("_mixed", 1, HEX), {"_end": ("sum", F.col("_size"))})
    first = F.col("_end") - F.col("_size")
    pieces = placed.withColumn("_first", first).withColumn(
        "_block", F.explode(F.sequence(F.floor(F.col("_first") / block), F.floor((F.col("_end") - 1) / block))))
    start = F.greatest(F.col("_first"), F.col("_block") * block)
    end = F.least(F.col("_end"), (F.col("_block") + 1) * block)
    return pieces.withColumns({"_start": start - F.col("_block") * block, "_length": end - start})


def point(slot: Column) -> Column:
    """The golden-ratio point of a slot as an integer below 2**BITS."""
    half, mask = BITS // 2, (1 << BITS) - 1
    high = F.shiftright(slot, half).bitwiseAND(F.lit((1 << half) - 1)) * F.lit((GOLDEN << half) & mask)
    low = slot.bitwiseAND(F.lit((1 << half) - 1)) * F.lit(GOLDEN)
    return (high + low).bitwiseAND(F.lit(mask))


def slots(sources: DataFrame, block: int) -> DataFrame:
    """``slot, source_rank, source, turn, block, take``: the schedule of the mix.

    A source takes the nearest whole number of tokens to its target and needs so many slots. Slots beyond its need are
    left out, and those that the points have not given it come at the end, so every source takes exactly its number.
    """
    taken = F.floor(F.col("target") + 0.5).cast("long")
    size = F.col("source_size")
    per_turn = F.ceil(size / block)
    plan = (sources.filter(size > 0).withColumns({"_taken": taken, "_per_turn": per_turn})
            .withColumns({"_turns": F.floor(F.col("_taken") / size), "_rest": F.col("_taken") % size})
            .withColumn("_need", F.col("_turns") * F.col("_per_turn") + F.ceil(F.col("_rest") / block)))
    plan = stage(plan, "mix-plan")
    total = plan.agg(F.sum("_need")).first()[0] or 0
    # Each source's part of the line of points, as cells that a point is matched with by equality first.
    ahead = running(plan.withColumn("_all", F.lit(1)), ["_all"], ["source_rank"],
                    F.floor(F.col("source_rank") / 4096).cast("long"), {"_upto": ("sum", F.col("_need"))})
    unit = float(1 << BITS) / max(1, total)
    edges = ahead.withColumns({"_low": F.floor((F.col("_upto") - F.col("_need")) * unit), "_high": F.floor(F.col("_upto") * unit)})
    wide = (1 << BITS) // CELLS
    cells = edges.filter(F.col("_high") > F.col("_low")).withColumn(
        "_cell", F.explode(F.sequence(F.floor(F.col("_low") / wide), F.floor((F.col("_high") - 1) / wide))))
    spark = sources.sparkSession
    points = spark.range(total).withColumnRenamed("id", "slot").withColumn("_point", point(F.col("slot") + 1))
    points = points.withColumn("_cell", F.floor(F.col("_point") / wide))
    given = points.join(cells, "_cell").filter((F.col("_point") >= F.col("_low")) & (F.col("_point") < F.col("_high")))
    ranked = number_rows(given.select("slot", "source_rank"), ["source_rank"], ["slot"],
                         F.floor(F.col("slot") / 4096).cast("long"), "_rank")
    held = plan.join(ranked.groupBy("source_rank").agg(F.count(F.lit(1)).alias("_given")), "source_rank", "left")
    missing = (held.filter(F.coalesce("_given", F.lit(0)) < F.col("_need"))
               .withColumn("_rank", F.explode(F.sequence(F.coalesce("_given", F.lit(0)) + 1, F.col("_need"))))
               .select((F.lit(total) + F.col("_rank")).alias("slot"), "source_rank", "_rank"))
    chosen = ranked.unionByName(missing).join(plan, "source_rank").filter(F.col("_rank") <= F.col("_need"))
    rank = F.col("_rank") - 1
    rest = F.when(rank < F.col("_turns") * F.col("_per_turn"), F.lit(block)).otherwise(
        F.least(F.lit(block), F.col("_rest") - (rank - F.col("_turns") * F.col("_per_turn")) * block))
    return chosen.select("slot", "source_rank", "source", F.floor(rank / F.col("_per_turn")).alias("turn"),
                         (rank % F.col("_per_turn")).alias("block"), rest.cast("long").alias("take"))


def mix(sized: DataFrame, sources: DataFrame, source: str = "source", key: str = "doc_id", block: int = 4096, seed: int = 11) -> DataFrame:
    """The mix, one row per slot and piece: ``slot, turn, start, words`` and the columns of ``sized``.

    In order of ``slot`` and ``start``, the rows are the training sequence: ``words`` words of the document from its place
    ``_from``. Block keys are unique on the side of the blocks, and slots of a source differ in block or turn.
    """
    pieces = blocks(sized, source, key, block, seed)
    plan = slots(sources, block).withColumnRenamed("source", "_source").withColumnRenamed("block", "_block")
    # Null-safe on the source: documents without one are a source of their own.
    key_of = F.struct(F.col("_source").isNull(), F.coalesce("_source", F.lit("")))
    joined = pieces.withColumn("_of", key_of).join(
        plan.withColumn("_of", key_of).select("_of", "_block", "slot", "turn", "take"), ["_of", "_block"])
    words = F.least(F.col("_length"), F.col("take") - F.col("_start"))
    return (joined.withColumn("words", words).filter(F.col("words") > 0)
            .withColumn("_from", F.greatest(F.lit(0), F.col("_block") * block - F.col("_first")))
            .select(*sized.columns, "slot", "turn", F.col("_start").alias("start"), "_from", "words"))


def mixed_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
                    weights: Sequence[int] = (3, 1, 2), share: float = 1.5, most: float = 2.0, block: int = 4096,
                    seed: int = 11) -> DataFrame:
    """Per row of ``docs``: ``key, size, source_size, target, taken``.

    Null texts have size 0 and are never taken; null sources are one source; rows with null or repeated keys are placed
    one by one, and rows alike in key, source and size are interchangeable. An empty table gives no rows.
    """
    narrow = sizes(docs.select(F.col(key).alias("key"), F.col(source).cast("string").alias("of"), F.col(text).alias("text")), "text").drop("text")
    # Equal rows are told apart by a number, so that what each takes can be summed up.
    sized = stage(narrow.withColumn("_row", F.monotonically_increasing_id()), "mix-sizes")
    sources = targets(sized, "of", weights, share, most)
    taken = mix(sized, sources, "of", "key", block, seed).groupBy("_row").agg(F.sum("words").alias("taken"))
    per_source = sources.select(F.struct(F.col("source").isNull(), F.coalesce("source", F.lit(""))).alias("_of"), "source_size", "target")
    rows = join_small(sized.join(taken, "_row", "left").withColumn("_of", F.struct(F.col("of").isNull(), F.coalesce("of", F.lit("")))), per_source, "_of")
    return rows.select(F.col("key").alias(key), F.col("_size").alias("size"), "source_size", "target",
                       F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
