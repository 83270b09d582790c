"""Importance resampling: hashed n-gram models of target and raw text, and Gumbel top-k.

Each text's weight is the ratio of its likelihoods under a model of the target text and a model of all text.
Adding Gumbel noise to the logarithms and taking the k largest draws k documents without replacement.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..session import stage
from .common import arrow_map, fold, small_batches, under_other_names, values

TOKEN = re.compile(rb"[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff\s]+")
#: Stands for a token that is equal to the one before it.
SAME = 1
_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)


class Hasher:
    """Buckets of word and word-pair occurrences; the hashes of recent words are kept up to a bound."""

    def __init__(self, buckets: int, most_words: int = 1 << 18):
        self.buckets, self.most, self.known = buckets, most_words, {}

    def __call__(self, text: bytes) -> np.ndarray:
        known, tokens = self.known, TOKEN.findall(text)
        if len(known) > self.most:
            known.clear()
        for token in set(tokens).difference(known):
            upper = token.isupper() and len(token) > 1
            # Case is kept as a trait: capitals throughout are another word.
            known[token] = zlib.crc32(token if upper else token.lower()) + 2
        ids = np.fromiter(map(known.__getitem__, tokens), np.uint64, len(tokens))
        if len(ids) > 1:
            ids[1:][ids[1:] == ids[:-1]] = SAME
        pairs = (ids[:-1] * np.uint64(1_000_003) + ids[1:]) * _MULTIPLY if len(ids) > 1 else ids[:0]
        both = np.concatenate([ids * _MULTIPLY, pairs])
        both ^= both >> np.uint64(32)
        return ((both * _MULTIPLY) >> np.uint64(33)) % np.uint64(self.buckets)


def bucket_counts(rows: DataFrame, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Occurrences per bucket in target rows and in all rows, from ``text, target``: two arrays of ``buckets`` numbers.

    Each task sends its sums as one pair of arrays' non-zero places, so the driver gets ``buckets`` rows in all.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, sums = Hasher(buckets), np.zeros((2, buckets), np.int64)
        for batch in small_batches(batches, "text"):
            for text, target in zip(values(batch.column(0)), batch.column(1).to_pylist()):
                n = np.bincount(hasher(text).astype(np.int64), minlength=buckets)
                sums[1] += n
                if target:
                    sums[0] += n
        at = np.flatnonzero(sums[1])
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[0][at]), pa.array(sums[1][at])], ["b", "t", "r"])

    summed = (arrow_map(rows.select("text", "target"), run, "b long, t long, r long")
              .groupBy("b").agg(F.sum("t").alias("t"), F.sum("r").alias("r")).toPandas())
    target, raw = np.zeros(buckets), np.zeros(buckets)
    target[summed["b"]], raw[summed["b"]] = summed["t"], summed["r"]
    return target, raw


class Ratio:
    """Log ratio of the two models for a text.

    Both get ``prior`` occurrences per bucket in proportion to their sizes, so a bucket with few occurrences says
    little. The text's own occurrences are left out of the raw counts: a text that is alone in using its words
    would else count against itself.
    """

    def __init__(self, target: np.ndarray, raw: np.ndarray, prior: float):
        share = target.sum() / max(1.0, raw.sum())
        self.raw, self.prior = raw, prior
        self.above = np.log(target / share + prior) if share else np.log(raw + prior)

    def __call__(self, buckets: np.ndarray) -> float:
        at, n = np.unique(buckets, return_counts=True)
        return float((n * (self.above[at] - np.log(self.raw[at] - n + self.prior))).sum())


def gumbel(*keys: Column, seed: int) -> Column:
    """Standard Gumbel noise that depends on the keys only."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *keys), 11)
    return -F.log(-F.log((bits + F.lit(0.5)) / F.lit(float(1 << 53))))


def kth_largest(df: DataFrame, value: str, k: int, width: int = 4096, most: int = 10_000) -> float | None:
    """The k-th largest of a column of doubles, by histograms that narrow down to at most ``most`` rows or one value."""
    low, high = df.agg(F.min(value), F.max(value)).first()
    if low is None or k <= 0:
        return None
    k = min(k, df.count())
    while low < high:
        inside = df.filter(F.col(value).between(low, high)).select(value)
        step = (high - low) / width
        bins = F.least(F.floor((F.col(value) - low) / step), F.lit(width - 1)) if step > 0 else F.lit(0)
        found = sorted(inside.groupBy(bins.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min(value).alias("lo"),
                                                           F.max(value).alias("hi")).collect(), key=lambda r: -r.lo)
        for row in found:
            if k <= row.n:
                break
            k -= row.n
        stuck, low, high = (row.lo, row.hi) == (low, high), row.lo, row.hi
        if row.n <= most or stuck:
            got = df.filter(F.col(value).between(low, high)).orderBy(F.col(value).desc()).limit(min(k, most)).tail(1)
            return got[0][value] if k <= most else low
    return low


def importance(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality",
               buckets: int = 1 << 16, prior: float = 5.0, held_out_fold: int = 1,
               max_target_docs: int = 200_000) -> DataFrame:
    """All columns of ``docs`` with ``_n_grams`` and ``_log_weight``.

    The target are the rows whose label is positive (every label, where there are several), without those of the fold
    ``held_out_fold``: at most ``max_target_docs`` keys, the first by hash, so that they can be broadcast and no text is
    shuffled. The raw text are all rows. Null and empty texts hold no n-grams and have a weight of 0.
    """
    marks = (labels.filter(F.col(key).isNotNull() & F.col(label).isNotNull()).filter(fold(F.col(key)) != held_out_fold)
             .groupBy(F.col(key).alias("_key")).agg((F.min(label) > 0).alias("target")).filter("target")
             .orderBy(F.xxhash64("_key"), "_key").limit(max_target_docs))
    rows = docs.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("text")).join(F.broadcast(marks), "_key", "left")
    target, raw = bucket_counts(rows.select("text", F.coalesce("target", F.lit(False)).alias("target")), buckets)
    ratio = Ratio(target, raw, prior)

    # A second copy of the text is sent to the workers only where it is not a string as it is.
    same = isinstance(docs.schema[text].dataType, StringType)
    source = docs if same else docs.withColumn("_text", F.col(text).cast("string"))
    width, read = len(docs.columns), text if same else "_text"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(buckets)
        for batch in small_batches(batches, read):
            grams = [hasher(t).astype(np.int64) for t in values(batch.column(batch.schema.names.index(read)))]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:width], pa.array([len(g) for g in grams], pa.int64()), pa.array([ratio(g) for g in grams], pa.float64())],
                [*batch.schema.names[:width], "_n_grams", "_log_weight"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return arrow_map(source, run, f"{fields}, _n_grams long, _log_weight double")


def draw_size(scored: DataFrame, margin: float) -> int:
    """How many documents are likely enough under the target: the weight is at least ``-margin``."""
    return scored.filter(F.col("_weight") >= -margin).count()


def weight(sharpness: float, shrink: float) -> Column:
    """Log ratio per n-gram times ``sharpness``; ``shrink`` more n-grams of ratio 0 steady short texts.

    A sum over the text would let its length alone decide against noise of unit scale.
    """
    return F.col("_log_weight") * sharpness / (F.col("_n_grams") + shrink)


def resample(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", k: int | None = None,
             margin: float = 25.0, sharpness: float = 50.0, shrink: float = 10.0, seed: int = 7, **options) -> DataFrame:
    """Every document with its weight and draw: ``key, n_grams, log_ratio, weight, gumbel_key, selected``.

    ``k`` documents are drawn; by default as many as have a weight of at least ``-margin``, so that what the target
    model does not explain goes and all else stays. Noise depends on key and text only: reruns agree, and repeated rows
    are drawn together. Ties at the cut are all drawn. Text is read twice, once for the models and once for the weights.
    """
    scored = importance(docs.select(key, text), labels, key, text, **options).withColumn("_weight", weight(sharpness, shrink))
    narrow = stage(scored.select(
        F.col(key).alias("key"), F.col("_n_grams").alias("n_grams"), F.col("_log_weight").alias("log_ratio"), "_weight",
        (F.col("_weight") + gumbel(F.col(key), F.col(text), seed=seed)).alias("gumbel_key")), "importance")
    cut = kth_largest(narrow, "gumbel_key", draw_size(narrow, margin) if k is None else k)
    chosen = F.col("gumbel_key") >= F.lit(cut) if cut is not None else F.lit(False)
    return narrow.select(F.col("key").alias(key), "n_grams", "log_ratio", F.col("_weight").alias("weight"), "gumbel_key",
                         chosen.alias("selected"))


def drop_unlikely(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", margin: float = 25.0,
                  sharpness: float = 50.0, shrink: float = 10.0, seed: int = 7, **options) -> DataFrame:
    """The rows of ``docs`` that ``resample`` draws, all columns as they are, whatever their names."""
    def work(rows: DataFrame, key: str, text: str) -> DataFrame:
        marks = labels.select(F.col(own_key).alias(key), *[c for c in labels.columns if c != own_key])
        return _drop_unlikely(rows, marks, key, text, margin, sharpness, shrink, seed, **options)

    own_key = key
    return under_other_names(docs, work, key=key, text=text)


def _drop_unlikely(docs: DataFrame, labels: DataFrame, key: str, text: str, margin: float, sharpness: float, shrink: float,
                   seed: int, **options) -> DataFrame:
    scored = importance(docs, labels, key, text, **options).withColumn("_weight", weight(sharpness, shrink))
    stored = stage(scored.withColumn("_gumbel_key", F.col("_weight") + gumbel(F.col(key), F.col(text), seed=seed)), "importance")
    cut = kth_largest(stored, "_gumbel_key", draw_size(stored, margin))
    return stored.filter(F.col("_gumbel_key") >= F.lit(cut) if cut is not None else F.lit(False)).select(*docs.columns)
