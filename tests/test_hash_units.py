"""Hashes of many texts at once: long, short, empty and absent ones."""

from pyspark.sql import functions as F

from pagelode.functions.hashing import fnv1a


def plain(text):
    if text is None:
        return None
    h, raw = 0x811C9DC5, text.encode("utf-16-le")
    for i in range(0, len(raw), 2):
        h = (h ^ (raw[i] | raw[i + 1] << 8)) * 16777619 & 0xFFFFFFFF
    return f"{h:08x}"


def test_hashes_equal_a_plain_loop_and_null_stays_null(spark):
    texts = ["", None, "a", "é😀x", "long " * 20_000] + ["ab" * (i % 37) + chr(97 + i % 26) for i in range(200)] + [None, "", "z" * 5000]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string").coalesce(1)
    got = {r.i: r.h for r in rows.select("i", fnv1a(F.col("text")).alias("h")).collect()}
    assert got == {i: plain(t) for i, t in enumerate(texts)}
