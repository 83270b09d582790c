"""A Bloom filter of bounded size, for rows that a later join would drop anyway."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HASHES = 3


def _places(key: Column, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(seed), key), F.lit(bits)) for seed in range(HASHES)]


def bloom_filter(keys: DataFrame, key: str, bits: int = 1 << 20) -> DataFrame:
    """One row ``words``: the filter as an array of ``bits / 64`` numbers, a hundred kilobytes however many keys there are."""
    set_bits = keys.filter(F.col(key).isNotNull()).select(F.explode(F.array(*_places(F.col(key), bits))).alias("at"))
    words = set_bits.groupBy(F.shiftright("at", 6).alias("id")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("at").bitwiseAND(F.lit(63)).cast("int"))).alias("word"))
    every = keys.sparkSession.range(bits // 64)
    return every.join(words, "id", "left").agg(F.transform(F.array_sort(F.collect_list(F.struct(
        "id", F.coalesce("word", F.lit(0).cast("long")).alias("word")))), lambda w: w["word"]).alias("words"))


def might_hold(bloom: DataFrame, key: Column, bits: int = 1 << 20) -> Column:
    """Whether the filter may hold a key: false only for keys that are surely not there. A null key is not.

    The filter is a scalar subquery: it is computed once and sent with the tasks.
    """
    words = bloom.scalar()
    tests = [F.call_function("shiftright", F.get(words, F.shiftright(at, 6).cast("int")), at.bitwiseAND(F.lit(63)).cast("int"))
             .bitwiseAND(F.lit(1).cast("long")) == 1 for at in _places(key, bits)]
    held = tests[0]
    for test in tests[1:]:
        held = held & test
    return F.coalesce(key.isNotNull() & held, F.lit(False))
