"""drift between captures, and what is masked before comparing."""

import random

import pytest
from pyspark.sql import functions as F

from pagelode.functions.redact import stabilize_html, stabilize_text
from pagelode.operators import drift as V
from pagelode.operators import json_tables as J

ROW = "k string, part int, a string, b int"


def cells(spark, before, after):
    pair = V.Pair("t", spark.createDataFrame(before, ROW), spark.createDataFrame(after, ROW), ["k", "part"], ["a", "b"])
    return V.drift([pair])


def test_cells(spark):
    before = [("x", 1, "one", 1), ("y", 1, "two", None), ("z", 1, None, 3), ("gone", 1, "g", 4), (None, None, "n", 5), ("same", 2, None, None)]
    after = [("x", 1, "one", 2), ("y", 1, "two", 7), ("z", 1, "now", 3), ("came", 1, "c", 6), (None, None, "n", 8), ("same", 2, None, None)]
    got = sorted((r.entity, r.change, r.field, r.before or "", r.after or "") for r in cells(spark, before, after).collect())
    assert got == sorted([
        ("x | 1", "changed", "b", "1", "2"), ("y | 1", "changed", "b", "", "7"), ("z | 1", "changed", "a", "", "now"),
        ("gone | 1", "removed", "a", "g", ""), ("gone | 1", "removed", "b", "4", ""), ("came | 1", "added", "a", "", "c"),
        ("came | 1", "added", "b", "", "6"), (" | ", "changed", "b", "5", "8")])
    summary = {(r.change, r.entities, r.rows, r.cells) for r in V.drift_summary(cells(spark, before, after)).collect()}
    assert summary == {("changed", 4, 4, 4), ("removed", 1, 1, 2), ("added", 1, 1, 2)}


def test_a_key_with_most_rows(spark):
    rng = random.Random(3)
    before = [("hot", 1, f"v{rng.randrange(300)}", i % 5) for i in range(2000)]
    after = before[100:] + [("hot", 1, "new", 9)] * 150
    rng.shuffle(after)
    got = cells(spark, before, after)
    per_row = got.groupBy("change", "nth").count().groupBy("change").count().collect()
    assert {r.change: r["count"] for r in per_row} == {"changed": 100, "added": 50}
    assert got.filter("change = 'added'").select("after").distinct().count() == 2
    assert cells(spark, before, rng.sample(before, len(before))).count() == 0
    assert cells(spark, [], []).count() == 0 and cells(spark, before, []).count() == 4000


@pytest.mark.parametrize("text, want", [
    ("12,431 likes", "{{COUNT}} likes"), ("3 minutes ago", "{{RELATIVE_TIME}}"), ("an hour ago, Yesterday", "{{RELATIVE_TIME}}, {{RELATIVE_TIME}}"),
    ("in 2 days", "{{RELATIVE_TIME}}"), ("1.2k stars", "{{COUNT}} stars"), ("42 followers of 7 wonders", "{{COUNT}} followers of 7 wonders"),
    ("page 3 costs 5", "page 3 costs 5"), ("", ""), (None, None),
])
def test_stable_text(spark, text, want):
    once = spark.createDataFrame([(text,)], "t string").select(stabilize_text(F.col("t")).alias("t"))
    assert once.first().t == want and once.select(stabilize_text(F.col("t"))).first()[0] == want


def test_stable_markup_keeps_attributes(spark):
    html = '<a data-n="1,200" nonce="x">1,200</a> 2 < 3,000'
    got = spark.createDataFrame([(html,)], "h string").select(stabilize_html(F.col("h"))).first()[0]
    assert got == '<a data-n="1,200" nonce="">{{COUNT}}</a> 2 < {{COUNT}}'


def test_stable_json(spark):
    raw = '{"likes":3,"size":4,"n":{"viewCount":5.5,"total":"9"},"id":"123e4567-e89b-12d3-a456-426614174000","t":"5 days ago"}'
    docs = spark.createDataFrame([(1, raw)], "seq int, json string")
    got = {r.path: r.value for r in J.stable_counts(docs, ["seq"]).collect()}
    assert got == {"$.likes": "0", "$.size": "4", "$.n.viewCount": "0", "$.n.total": "9", "$.id": "{{UUID}}", "$.t": "{{RELATIVE_TIME}}"}


def test_captures_are_read_once(spark):
    reads = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            reads.add(batch.num_rows)
            yield batch

    tables = [spark.range(50).selectExpr("cast(id as string) k", "1 part", f"concat('a', id % {n}) a", "1 b").mapInArrow(seen, ROW) for n in (3, 4)]
    assert V.drift([V.Pair("t", *tables, ["k", "part"], ["a", "b"])]).count() > 0
    assert reads.value == 100
