import math

import numpy as np
from pyspark.sql import functions as F

from pagelode.llm import resampling as R


def corpus(spark):
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("abcdefgh"), 4)) for _ in range(500)]
    docs, labels = [], []
    for i in range(2000):
        text = " ".join(rng.choice(words, int(rng.integers(10, 80))))
        if i % 9 == 0:
            text = " ".join(w + "$$$" for w in text.split())
        docs.append((i, text, "x"))
        labels.append((i, int(i % 9 != 0)))
    docs += [(None, None, "y"), (3000, "", "y"), (3001, docs[1][1], "y"), (3001, docs[1][1], "y"), (3002, "!!! " * 6000, "y")]
    return docs, spark.createDataFrame(docs, "doc_id long, text string, selected string"), spark.createDataFrame(labels, "doc_id long, quality int")


def test_hasher_against_plain_loop():
    hasher = R.Hasher(1000)
    text = "The cat, the CAT!! cat cat naïve".encode()
    tokens = [t for t in R.TOKEN.findall(text)]
    assert tokens == [b"The", b"cat", b",", b"the", b"CAT", b"!!", b"cat", b"cat", "naïve".encode()]
    got = hasher(text)
    assert len(got) == 2 * len(tokens) - 1 and got[0] == got[3] and got[1] != got[4]
    assert len(hasher(b"")) == 0


def test_held_out_accuracy_and_draw(spark):
    docs, frame, labels = corpus(spark)
    out = R.resample(frame, labels).collect()
    assert len(out) == len(docs)
    assert all(r.selected == (r.doc_id % 9 != 0) for r in out if r.doc_id is not None and r.doc_id < 2000)
    rest = [r for r in out if r.doc_id is None or r.doc_id == 3000]
    assert [r.weight for r in rest] == [0.0, 0.0] and all(r.selected for r in rest)
    twice = [r for r in out if r.doc_id == 3001]
    assert twice[0] == twice[1]
    ten = [r for r in R.resample(frame, labels, k=10).collect() if r.selected]
    keys = sorted((r.gumbel_key for r in out), reverse=True)
    assert min(r.gumbel_key for r in ten) == keys[9] and len(ten) >= 10


def test_kth_largest(spark):
    numbers = np.random.default_rng(1).normal(size=3000).round(2).tolist() + [1e9, -1e9] + [0.5] * 500
    df = spark.createDataFrame([(float(v),) for v in numbers], "v double")
    for k in (1, 2, 100, 1700, 3502, 9999):
        assert R.kth_largest(df, "v", k, width=8, most=50) == sorted(numbers, reverse=True)[min(k, len(numbers)) - 1]
    assert R.kth_largest(df.limit(0), "v", 3) is None and R.kth_largest(df, "v", 0) is None


def test_gumbel_is_standard(spark):
    draws = [r.g for r in spark.range(20000).withColumn("g", R.gumbel(F.col("id"), seed=1)).collect()]
    assert abs(np.mean(draws) - 0.5772) < 0.03 and abs(np.std(draws) - math.pi / math.sqrt(6)) < 0.03


def test_drop_unlikely_keeps_columns(spark):
    docs, frame, labels = corpus(spark)
    kept = R.drop_unlikely(frame, labels)
    assert kept.columns == frame.columns
    assert sum(1 for r in kept.collect() if r.doc_id is not None and r.doc_id < 2000) == sum(i % 9 != 0 for i in range(2000))


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert R.resample(spark.createDataFrame([], "doc_id long, text string"), none).count() == 0
    assert R.resample(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), none).first().selected


def test_text_is_sent_to_workers_once(spark):
    docs = spark.createDataFrame([(i, f"word {i % 7} and some more text") for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(40)], "doc_id long, quality int")
    found = R.importance(docs, labels)
    assert "_text" not in found._jdf.queryExecution().analyzed().toString()
    plain = {r.doc_id: r[2:] for r in found.collect()}
    other = R.importance(docs.withColumn("text", docs["text"].cast("binary")), labels)
    assert {r.doc_id: r[2:] for r in other.collect()} == plain
