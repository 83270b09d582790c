"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package

# Words are runs of anything but these six characters; ``bytes.split()`` cuts at exactly these.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def values(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """The texts of an Arrow string column as UTF-8 bytes; null becomes empty."""
    return [v or b"" for v in column.cast(pa.binary()).to_pylist()]


def by_bytes(texts: list[bytes], limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about ``limit`` bytes; a longer text is a range of its own."""
    start = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text) > limit:
            yield start, i
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield start, len(texts)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, so that what is made of one at a time stays small."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def small_batches(batches: Iterator[pa.RecordBatch], column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches with about ``limit`` bytes of text in a column; a longer text is alone."""
    for batch in batches:
        texts = batch.column(column).cast(pa.binary())
        sizes = pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_pylist()
        start = held = 0
        for i, size in enumerate(sizes):
            if held and held + size > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        if start < len(sizes):
            yield batch.slice(start)


def release_memory() -> None:
    """Give freed memory back to the system, as the worker stays for later stages that may need much else."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def arrow_map(df: DataFrame, function, schema: str) -> DataFrame:
    """``mapInArrow`` with this package sent to the workers, which keep no memory of a task that has ended."""
    ship_package(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from function(batches)
        finally:
            release_memory()

    return df.mapInArrow(run, schema)


def under_other_names(docs: DataFrame, work: Callable[..., DataFrame], **columns: str) -> DataFrame:
    """``work`` on ``docs`` with its columns renamed, and its result under the names that they had.

    ``columns`` are the arguments that name columns. Whatever the caller's columns are called, none can clash with a helper
    column of ``work``, which has to return the columns of its input in their order.
    """
    inner = [f"column_{i}" for i in range(len(docs.columns))]
    given = {role: inner[docs.columns.index(name)] for role, name in columns.items()}
    return work(docs.toDF(*inner), **given).toDF(*docs.columns)


def fold(key: Column, folds: int = 3) -> Column:
    """crc32 of a key written as text, modulo ``folds``; a null key counts as the text ``null``."""
    return F.crc32(F.encode(F.coalesce(key.cast("string"), F.lit("null")), "utf-8")) % folds


def join_small(left: DataFrame, right: DataFrame, key: str, most: int = 100_000, salts: int = 64) -> DataFrame:
    """Left join with a table that has one row per key and is small as a rule.

    ``right`` is counted: up to ``most`` rows it is broadcast, beyond that its rows are repeated under ``salts``
    salts and the left rows dealt over these, so that a key with a third of all rows has many tasks. Null keys of
    ``left`` stay, without match.
    """
    if right.count() <= most:
        return left.join(F.broadcast(right), key, "left")
    salted = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    rest = [c for c in left.columns if c != key]
    return (left.withColumn("_salt", F.pmod(F.xxhash64(*rest), F.lit(salts)).cast("int"))
            .join(salted, [key, "_salt"], "left").drop("_salt"))
