"""Hard-negative mining by Kronecker-packed products.

Components are whole numbers. Several candidates' components, made non-negative by a bias, sit in separated fields of one wide
integer; one multiplication by an anchor's component multiplies all of them, and the sum over components holds the exact scores
of all in its fields. Fields are as wide as the bounds of the table's components ask for: as many as fit go into 63 bits, and
where not even one does, Python's integers of any width take their place.

Anchors meet all rows in cells of a grid: both sides are dealt into groups of about ``GROUP`` rows, each row is sent to the cells
of its line, and a cell keeps the best few per anchor.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship_package, stage

#: Rows in a group of candidates or of anchors.
GROUP = 16384
#: Anchors whose products are kept at a time, so that they stay near the processor.
ANCHORS = 32
LONG = (1 << 63) - 1


class Packing:
    """Widths of fields for rows of ``size`` components between ``low`` and ``high``, and anchors of absolute sum ``norm``."""

    def __init__(self, size: int, low: float, high: float, norm: float):
        self.size, self.low = size, int(low)
        norm = int(norm * (1 + 1e-9)) + 1
        spread = int(high) - self.low
        self.middle = norm * spread + 1
        self.bound = norm * max(abs(self.low), abs(int(high)), 1) + 1
        self.width = (2 * self.middle).bit_length()
        self.narrow = self.width <= 63 and max(self.bound, self.middle) < 1 << 62
        self.fields = 63 // self.width if self.narrow else 8
        self.kind = np.int64 if self.narrow else object
        self.least = -self.bound - 1
        self.digits = len(str(2 * self.bound))

    def whole(self, rows: list[np.ndarray]) -> np.ndarray:
        """Rows as a matrix of whole components, rounded down; missing ones are 0."""
        out = np.zeros((len(rows), self.size), self.kind)
        for i, row in enumerate(rows):
            row = np.floor(row)
            out[i, :len(row)] = row if self.narrow else [int(x) for x in row]
        return out

    def pack(self, candidates: np.ndarray) -> np.ndarray:
        """One line per component: a word holds that component of ``fields`` candidates, biased."""
        short = -len(candidates) % self.fields
        biased = np.concatenate([candidates - self.low, np.zeros((short, self.size), self.kind)])
        words = np.zeros((self.size, len(biased) // self.fields), self.kind)
        for f in range(self.fields):
            words += biased[f::self.fields].T << (self.width * f)
        return words

    def scores(self, words: np.ndarray, anchors: np.ndarray, candidates: int) -> np.ndarray:
        """Exact inner products, anchors by candidates: one multiplication per anchor component and word."""
        total = np.zeros((len(anchors), words.shape[1]), self.kind)
        total += sum(self.middle << (self.width * f) for f in range(self.fields))
        for d in range(self.size):
            total += anchors[:, d, None] * words[d]
        out = np.zeros((len(anchors), words.shape[1] * self.fields), self.kind)
        mask = (1 << self.width) - 1
        for f in range(self.fields):
            out[:, f::self.fields] = (total >> (self.width * f)) & mask
        out = out[:, :candidates]
        return out + (self.low * anchors.sum(axis=1) - self.middle)[:, None]

    def best(self, scores: np.ndarray, allowed: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Anchors and candidates of the ``n`` best allowed scores per anchor; of equal ones, the first candidates."""
        kept = np.where(allowed, scores, self.least)
        if kept.shape[1] > n:
            edge = -(np.partition(-kept, n - 1, axis=1) if self.narrow else np.sort(-kept, axis=1))[:, n - 1]
            allowed = allowed & (kept >= edge[:, None])
        anchor, at = np.nonzero(allowed)
        order = np.lexsort((at, -kept[anchor, at], anchor)) if self.narrow else np.array(
            sorted(range(len(at)), key=lambda i: (anchor[i], -kept[anchor[i], at[i]], at[i])), np.int64)
        anchor, at = anchor[order], at[order]
        rank = np.arange(len(anchor)) - np.searchsorted(anchor, anchor)
        return anchor[rank < n], at[rank < n]

    def write(self, scores: np.ndarray) -> pa.Array:
        """Scores as longs, or as text of equal length that sorts like the numbers."""
        if self.narrow:
            return pa.array(scores.astype(np.int64))
        return pa.array([str(s + self.bound).zfill(self.digits) for s in scores], pa.string())

    def read(self, score: int | str) -> int:
        return score if self.narrow else int(score) - self.bound

    @property
    def sql(self) -> str:
        return "long" if self.narrow else "string"

    def shown(self, score: Column) -> Column:
        """A score as a long; one beyond the longs becomes the nearest of them."""
        if self.narrow:
            return score
        value = F.udf(lambda s: None if s is None else max(-LONG - 1, min(LONG, int(s) - self.bound)), "long")
        return value(score)


def _rows(column: pa.ChunkedArray) -> list[np.ndarray]:
    parts = []
    for chunk in column.chunks:
        flat, ends = chunk.values.to_numpy(zero_copy_only=False), chunk.offsets.to_numpy()
        parts += [flat[a:b] for a, b in zip(ends[:-1], ends[1:])]
    return parts


def _opened(candidates: pa.Table, packing: Packing) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids, row numbers, labels and packed words, ordered by id."""
    candidates = candidates.sort_by([("id", "ascending"), ("n", "ascending")])
    ids, numbers, labels = (candidates[c].to_numpy() for c in ("id", "n", "label"))
    return ids, numbers, labels, packing.pack(packing.whole(_rows(candidates["vector"])))


def mine(vectors: DataFrame, key: str, vector: str, label: str, anchor: Column, positives: int = 5, negatives: int = 10,
         low: int = 30, high: int = 90, scale: float = 256.0, group: int = GROUP) -> DataFrame:
    """For each anchor and each of its positives, the hardest negatives.

    ``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``. Components become ``floor(scale * x)``; a
    score is the inner product, exact at any size (a score beyond a long is shown as the nearest long). Higher scores come
    first, ties by smaller key. Positives of a row where ``anchor`` holds are its first ``positives`` other rows of the same
    label; negatives are the first ``negatives`` rows of other labels with
    ``low * positive_score <= 100 * negative_score <= high * positive_score``.

    Rows with a null key, label or vector, or with a component that is null or not finite once scaled, take no part. Missing
    components of a shorter vector count as 0. Repeated rows count one by one, as anchors too; a copy of an anchor under the same
    label is another row. Other columns are ignored. Without anchors or rows the result is empty.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    scaled = F.transform(F.col(vector), lambda x: F.lit(scale) * x.cast("double"))
    rows = (vectors.select(F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), scaled.alias("vector"),
                           F.coalesce(anchor, F.lit(False)).alias("anchor"))
            .filter(F.col("id").isNotNull() & F.col("label").isNotNull() &
                    F.forall("vector", lambda x: x.isNotNull() & (F.abs(x) < math.inf))))
    # Numbered in a table, so that a task run again finds the same numbers.
    rows = stage(rows.withColumn("n", F.monotonically_increasing_id()), "vectors")
    size, least, most, norm, total, chosen = rows.agg(
        F.max(F.size("vector")), F.min(F.array_min("vector")), F.max(F.array_max("vector")),
        F.max(F.when(F.col("anchor"), F.aggregate("vector", F.lit(0.0), lambda s, x: s + F.abs(x) + 1.0))), F.count("*"),
        F.count_if("anchor")).first()
    packing = Packing(size or 0, min(math.floor(least or 0.0), 0), max(math.floor(most or 0.0), 0), norm or 0.0)
    lines, columns = max(1, -(-chosen // group)), max(1, -(-total // group))

    def dealt(number: str, groups: int) -> Column:
        return F.pmod(F.xxhash64(F.lit(number), "n"), F.lit(groups)).cast("int")

    def every(groups: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))

    candidates = rows.select("n", "id", "label", F.col("vector"), dealt("column", columns).alias("column"),
                             every(lines).alias("line"))
    # Under new names and back, so that both sides of a cell have columns of their own.
    anchors = (rows.filter("anchor").select("n", "label", "vector", dealt("line", lines)).toDF("n", "label", "vector", "line"))

    def positives_of(a: pa.Table, c: pa.Table) -> pa.Table:
        ids, numbers, labels, words = _opened(c, packing)
        own, own_label = a["n"].to_numpy(), a["label"].to_numpy()
        parts = _rows(a["vector"])
        out: list[list] = [[], [], []]
        for s in range(0, len(own) if len(ids) else 0, ANCHORS):
            these = slice(s, s + ANCHORS)
            scores = packing.scores(words, packing.whole(parts[these]), len(ids))
            allowed = (labels == own_label[these, None]) & (numbers != own[these, None])
            i, j = packing.best(scores, allowed, positives)
            for part, found in zip(out, (own[these][i], ids[j], scores[i, j])):
                part.append(found)
        joined = [np.concatenate(p) if p else np.zeros(0, np.int64) for p in out]
        return pa.table({"n": pa.array(joined[0]), "other": pa.array(joined[1]), "score": packing.write(joined[2])})

    def negatives_of(a: pa.Table, c: pa.Table) -> pa.Table:
        ids, numbers, labels, words = _opened(c, packing)
        own, own_label = a["n"].to_numpy(), a["label"].to_numpy()
        targets = [[packing.read(s) for s in row] for row in a["scores"].to_pylist()]
        parts = _rows(a["vector"])
        out: list[list] = [[], [], [], []]
        for s in range(0, len(own) if len(ids) else 0, ANCHORS):
            these = slice(s, s + ANCHORS)
            scores = packing.scores(words, packing.whole(parts[these]), len(ids))
            other = labels != own_label[these, None]
            for p in range(positives):
                goal = [t[p] if p < len(t) else None for t in targets[these]]
                # Whole-number borders: 100 * s <= high * p, and low * p <= 100 * s; none at all without a positive.
                upper = np.array([packing.least if g is None else min(high * g // 100, packing.bound) for g in goal], packing.kind)
                lower = np.array([0 if g is None else max(-(-low * g // 100), -packing.bound) for g in goal], packing.kind)
                allowed = other & (scores <= upper[:, None]) & (scores >= lower[:, None])
                i, j = packing.best(scores, allowed, negatives)
                for part, found in zip(out, (own[these][i], np.full(len(i), p), ids[j], scores[i, j])):
                    part.append(found)
        joined = [np.concatenate(p) if p else np.zeros(0, np.int64) for p in out]
        return pa.table({"n": pa.array(joined[0]), "place": pa.array(joined[1].astype(np.int32)), "other": pa.array(joined[2]),
                         "score": packing.write(joined[3])})

    def meet(side: DataFrame, work, schema: str) -> DataFrame:
        side = side.withColumn("column", every(columns))
        return side.groupBy("line", "column").cogroup(candidates.groupBy("line", "column")).applyInArrow(work, schema)

    first = Window.partitionBy("n").orderBy(F.desc("score"), "other")
    found = (meet(anchors, positives_of, f"n long, other long, score {packing.sql}")
             .withColumn("place", F.row_number().over(first)).filter(F.col("place") <= positives))
    kept = stage(found, "positives")
    lists = kept.groupBy("n").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "score"))), lambda s: s["score"]).alias(
        "scores"))
    second = Window.partitionBy("n", "place").orderBy(F.desc("score"), "other")
    mined = (meet(anchors.join(lists, "n"), negatives_of, f"n long, place int, other long, score {packing.sql}")
             .withColumn("rank", F.row_number().over(second)).filter(F.col("rank") <= negatives)
             .select("n", (F.col("place") + 1).alias("place"), "rank", F.col("other").alias("negative_id"),
                     packing.shown(F.col("score")).alias("negative_score")))
    named = kept.select("n", "place", F.col("other").alias("positive_id"), packing.shown(F.col("score")).alias("positive_score"))
    names = rows.filter("anchor").select("n", F.col("id").alias("anchor_id"))
    return (mined.join(named, ["n", "place"]).join(names, "n")
            .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))
