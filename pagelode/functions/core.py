"""Small building blocks shared by all operators."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..rules import WS
from ..session import stage

# Rows per bucket in the two-level numbering helpers.
BUCKET_ROWS = 1 << 20
# Rows with costly work each (pages, documents) that one task is given.
TASK_ROWS = 5000
# The same for rows of tables that cost some tens of microseconds each (records, calls).
TABLE_TASK_ROWS = 50_000


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once and use it many times in ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with columns that are computed once per row, whatever reads them later.

    Spark merges projections, so a costly column that is read in five places is computed five times. It does not merge
    them across a generator, and a generator over one struct neither adds nor drops rows.
    """
    made = F.explode(F.array(F.struct(*[value.alias(name) for name, value in columns.items()])))
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, made.alias("_once")).select(*kept, *[F.col("_once")[name].alias(name) for name in columns])


def collapse(text: Column) -> Column:
    """Runs of white space become one blank; ends are trimmed."""
    # A single blank is what it becomes, and most white space is single blanks: they are not matched.
    return F.trim(F.regexp_replace(text, f" {WS}+|[{WS}&&[^ ]]{WS}*", " "))


def strip(text: Column) -> Column:
    """Trim every kind of web white space at both ends."""
    return F.regexp_replace(text, f"^{WS}+|{WS}+$", "")


def lookup(key: Column, table: dict[str, object]) -> Column:
    """Value of a fixed literal table, NULL when the key is absent."""
    pairs = [F.lit(part) for item in table.items() for part in item]
    return F.try_element_at(F.create_map(*pairs), key)


def position_in(value: Column, names: Sequence[str]) -> Column:
    """0-based position of ``value`` in a fixed list; the length when absent."""
    found = F.array_position(F.array(*[F.lit(n) for n in names]), value)
    return F.when(found > 0, found - 1).otherwise(len(names)).cast("int")


def round_half_up(value: Column, digits: int) -> Column:
    """floor(x * 10^d + 0.5) / 10^d, the rounding of the report numbers."""
    scale = float(10 ** digits)
    return F.floor(value * scale + 0.5).cast("double") / scale


def head(text: Column, n: int | None) -> Column:
    """The first ``n`` characters; the whole text without a limit."""
    return text if n is None else F.substring(text, 1, n)


def first_items(items: Column, n: int | None) -> Column:
    """The first ``n`` items of an array; all without a limit."""
    return items if n is None else F.slice(items, 1, n)


def first_rows(df: DataFrame, order: Sequence[Column | str], n: int | None) -> DataFrame:
    """The first ``n`` rows; all, unsorted, without a limit."""
    return df if n is None else df.orderBy(*order).limit(n)


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int | None,
                  rank: str = "rank") -> DataFrame:
    """First ``n`` rows of each group, numbered from 1; all rows without a limit.

    The filter on ``row_number`` lets Spark cut each group before the shuffle
    (window group limit), so a hot group sends at most ``n`` rows per task.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    numbered = df.withColumn(rank, F.row_number().over(window))
    return numbered if n is None else numbered.filter(F.col(rank) <= n)


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column,
            totals: dict[str, tuple[str, Column]]) -> DataFrame:
    """Running aggregates over groups of any size, without one task per group.

    ``totals`` maps an output name to ``(kind, value)`` with kind ``sum``,
    ``max`` or ``count``. ``bucket`` must grow with the first order column. Each
    (group, bucket) is aggregated on the map side; a window over these few
    summary rows gives what comes before the bucket; a second window stays
    inside one bucket. A group holding a third of all rows is so spread over
    its buckets.
    """
    keys = list(keys)
    inside = keys + ["_bucket"]
    work = df.withColumn("_bucket", bucket).withColumns(
        {f"_v_{name}": value for name, (_, value) in totals.items()}
    )
    summary = work.groupBy(*inside).agg(*[
        (F.count(F.lit(1)) if kind == "count" else
         F.sum(f"_v_{name}") if kind == "sum" else F.max(f"_v_{name}")).alias(f"_p_{name}")
        for name, (kind, _) in totals.items()
    ])
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(
        Window.unboundedPreceding, -1)
    summary = summary.select(*inside, *[
        (F.max if kind == "max" else F.sum)(f"_p_{name}").over(before).alias(f"_b_{name}")
        for name, (kind, _) in totals.items()
    ])
    # Null-safe on the keys: a row with a NULL key still belongs to a group.
    summary = summary.select(*[F.col(c).alias(f"_s_{c}") for c in inside],
                             *[f"_b_{name}" for name in totals])
    joined = work.join(summary, [F.col(c).eqNullSafe(F.col(f"_s_{c}")) for c in inside])
    upto = Window.partitionBy(*inside).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, 0)
    out = {}
    for name, (kind, _) in totals.items():
        carried = F.col(f"_b_{name}")
        if kind == "max":
            out[name] = F.greatest(F.max(f"_v_{name}").over(upto), carried)
        elif kind == "sum":
            out[name] = F.sum(f"_v_{name}").over(upto) + F.coalesce(carried, F.lit(0))
        else:
            out[name] = F.count(F.lit(1)).over(upto) + F.coalesce(carried, F.lit(0))
    return joined.withColumns(out).select(*df.columns, *totals)


def number_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column,
                name: str = "index") -> DataFrame:
    """1-based row number within groups of any size (see ``running``)."""
    return running(df, keys, order, bucket, {name: ("count", F.lit(1))})


def ranged(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """``df`` with ``_range``, a bucket for ``running`` that follows rows and not values.

    Rows are dealt over ranges of (keys, order) of about equal size, and a row's range is its bucket: a group with a third
    of all rows fills a third of the ranges, be its order values as crowded as they may. The table is written, so that a task
    run again finds the same ranges.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stage(df.repartitionByRange(parts, *keys, *order).withColumn("_range", F.spark_partition_id()), "ranged")


def rank_all(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], rank: str = "rank") -> DataFrame:
    """All rows of groups of any size, numbered from 1 in order; ``top_per_group`` without a limit, but spread."""
    placed = ranged(df, keys, order)
    return number_rows(placed, keys, order, F.col("_range"), rank).drop("_range")


def seq_bucket(seq: str = "seq", rows: int = BUCKET_ROWS) -> Column:
    """Bucket of a counting order column."""
    return F.floor(F.col(seq) / F.lit(rows)).cast("long")


def pad(number: Column, width: int) -> Column:
    """Zero-padded text of a number; longer numbers stay whole."""
    text = number.cast("string")
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0"))


def spread(df: DataFrame, *keys: str, task_rows: int = TASK_ROWS, counted: DataFrame | None = None) -> DataFrame:
    """Deal rows with costly work each over tasks by key: over all cores, and ``task_rows`` a task where there are many.

    ``counted`` is a plain table with about as many rows, where counting ``df`` itself would run a join.

    How an input is split says little about it: one Parquet row group holds up to a million rows and is one task, and the splits
    beside it are empty. So rows are counted, which of plain files reads the footers only.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    rows = df.select(*keys) if counted is None else counted
    return df.repartition(max(cores, -(-rows.count() // task_rows)), *keys)
