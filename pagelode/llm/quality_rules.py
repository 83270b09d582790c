"""Quality rules with risk-controlled cutoffs.

Cutoffs are chosen on labelled holdouts: for each stratum and rule, exact binomial tests
bound the share of good documents that a cutoff rejects, with a correction for the number of tests.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import lgamma

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package, stage
from .common import arrow_map, fold, join_small, values

SYMBOLS = b"#*$%&|<>"
WHITE = b" \t\n\x0b\x0c\r"
CAPITALS = bytes(range(65, 91))
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_capitals")

#: Rules: a document is rejected where the count exceeds the cutoff times the other count, in thousandths.
#: Cutoffs tried: every thousandth up to the last one given; values beyond count as the last.
RULES = {
    "symbols": ("n_symbols", "n_words", 4000),
    "word_length": ("word_chars", "n_words", 40000),
    "repeat": ("n_repeat_words", "n_words", 1000),
    "capitals": ("n_capitals", "word_chars", 1000),
}
STEP = {"symbols": 10, "word_length": 100, "repeat": 5, "capitals": 5}


def repeated_words(words: list[bytes], width: int = 5) -> int:
    """Words inside windows of ``width`` words that the text holds twice or more."""
    n = len(words)
    if n <= width:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    # Exact ranks of growing windows; a window can only be repeated where its start is.
    alive = np.arange(n - width + 1)
    rank = ids[alive]
    for step in range(1, width):
        _, rank, counts = np.unique(rank * (len(seen) + 1) + ids[alive + step], return_inverse=True, return_counts=True)
        keep = counts[rank] > 1
        alive, rank = alive[keep], rank[keep]
        if not len(alive):
            return 0
    marks = np.zeros(n + 1, np.int64)
    np.add.at(marks, alive, 1)
    np.add.at(marks, alive + width, -1)
    return int((np.cumsum(marks) > 0).sum())


def text_counts(text: bytes) -> tuple[int, ...]:
    """The counts of ``COUNTS`` for one text."""
    words = text.split()
    n_points = len(text.decode())
    white = len(text) - len(text.translate(None, WHITE))
    seen, dup_lines = set(), 0
    for line in text.split(b"\n"):
        if line in seen:
            dup_lines += 1
        elif line.strip(WHITE):
            seen.add(line)
    return (len(words), n_points - white, len(text) - len(text.translate(None, SYMBOLS)), dup_lines,
            repeated_words(words), len(text) - len(text.translate(None, CAPITALS)))


def features(docs: DataFrame, key: str = "doc_id", text: str = "text", stratum: str = "lang") -> DataFrame:
    """``key``, ``stratum`` and the counts of every whole text. No shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [text_counts(t) for t in values(batch.column(2))]
            columns = [pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * len(COUNTS))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["key", "stratum", *COUNTS])

    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("stratum"),
                       F.col(text).cast("string").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    return arrow_map(rows, run, f"key {kind}, stratum string, " + ", ".join(f"{c} long" for c in COUNTS))


def base_failed(min_words: int = 10, max_repeat: int = 20):
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat * F.col("n_words"))


def _level(rule: str):
    """The step of the cutoff grid that a document reaches; 0 without words."""
    count, of, last = RULES[rule]
    top = last // STEP[rule]
    share = F.when(F.col(of) > 0, F.floor(F.col(count) * (1000 / STEP[rule]) / F.col(of))).otherwise(0)
    return F.least(share, F.lit(top)).cast("long")


def lower_tail(k: np.ndarray, n: int, p: float) -> np.ndarray:
    """P[Binomial(n, p) <= k], summed exactly term by term, for each k."""
    i = np.arange(n + 1)
    logs = lgamma(n + 1) - np.array([lgamma(v + 1) + lgamma(n - v + 1) for v in i]) + i * np.log(p) + (n - i) * np.log1p(-p)
    return np.minimum(np.cumsum(np.exp(logs)), 1.0)[np.asarray(k, np.int64)]


def choose_cutoff(levels: np.ndarray, good: np.ndarray, bad: np.ndarray, alpha: float, delta: float, cost: float) -> int | None:
    """The cutoff of one rule in one stratum from counts per level, or None.

    Cutoffs are tested in a fixed sequence from the mildest: each must show, by the exact binomial tail, a false
    rejection rate of at most ``alpha`` at error ``delta``; the first failure ends the sequence, so the sequence
    needs no further correction. Of those that hold, the one with most bad less ``cost`` times good rejections
    is taken, the mildest on ties; None where no cutoff gains.
    """
    order = np.argsort(-levels)
    levels, good, bad = levels[order], good[order], bad[order]
    n = int(good.sum())
    if n == 0:
        return None
    lost, caught = np.cumsum(good), np.cumsum(bad)  # rejected when the cutoff lies just below this level
    holds = np.cumprod(lower_tail(lost, n, alpha) <= delta).astype(bool)
    gain = np.where(holds, caught - cost * lost, 0)
    best = int(np.argmax(gain))
    return int(levels[best]) - 1 if gain[best] > 0 else None


def fit_cutoffs(counted: DataFrame, labels: DataFrame, key: str = "doc_id", good: str = "quality", alpha: float = 0.01,
                delta: float = 0.05, cost: float = 10.0, held_out_fold: int = 1) -> DataFrame:
    """One row per stratum with a cutoff per rule (null: rule off).

    With probability ``1 - delta`` over all strata and rules together (Bonferroni), each rule rejects at most a share
    ``alpha / number of rules`` of a stratum's good documents, so all rules at most ``alpha``. Labelled rows of the fold
    ``held_out_fold`` are left out for evaluation. A document with two labels counts as good if all are; null labels
    and keys are ignored.
    """
    labelled = (labels.filter(F.col(key).isNotNull() & F.col(good).isNotNull()).filter(fold(F.col(key)) != held_out_fold)
                .groupBy(F.col(key).alias("key")).agg(F.min(good).alias("good")))
    rows = counted.join(labelled, "key")
    pairs = F.array(*[F.struct(F.lit(name).alias("rule"), _level(name).alias("level")) for name in RULES])
    counts = stage(rows.select("stratum", "good", F.explode(pairs).alias("p")).groupBy("stratum", "p.rule", "p.level")
                   .agg(F.sum(F.when(F.col("good") > 0, 1).otherwise(0)).alias("n_good"),
                        F.sum(F.when(F.col("good") > 0, 0).otherwise(1)).alias("n_bad")), "rule-counts")
    tests = max(1, counts.select("stratum").distinct().count() * len(RULES))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        cutoff = choose_cutoff(part["level"].to_numpy(), part["n_good"].to_numpy(), part["n_bad"].to_numpy(),
                               alpha / len(RULES), delta / tests, cost)
        return pd.DataFrame({"stratum": part["stratum"][:1], "rule": part["rule"][:1],
                             "cutoff": pd.array([cutoff], dtype="Int64")})

    # A group has at most one row per level of its grid.
    ship_package(counted.sparkSession)
    chosen = counts.groupBy("stratum", "rule").applyInPandas(run, "stratum string, rule string, cutoff long")
    return chosen.groupBy("stratum").pivot("rule", list(RULES)).agg(F.max("cutoff"))


def quality_rules(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", stratum: str = "lang",
                  **options) -> DataFrame:
    """Counts and verdicts of every document: ``key``, counts, ``base_failed``, ``kept``.

    Null or empty texts have counts of 0 and fail; a null stratum is a stratum of its own (named empty); a stratum
    without enough labels has base rules only; repeated rows get equal results. Text passes through once; the
    counts are stored and serve both the choice of cutoffs and the verdicts.
    """
    counted = stage(features(docs, key, text, stratum), "rule-features")
    cutoffs = stage(fit_cutoffs(counted, labels, key, **options), "rule-cutoffs")
    judged = join_small(counted, cutoffs, "stratum")
    broken = F.lit(False)
    for name in RULES:
        broken = broken | F.coalesce(_level(name) > F.col(name), F.lit(False))
    return judged.select(F.col("key").alias(key), *COUNTS, base_failed().alias("base_failed"),
                         (~base_failed() & ~broken).alias("kept"))
