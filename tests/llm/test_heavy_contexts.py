"""Passages that are everywhere: their occurrences are marked where they lie and do not meet in a join."""

import sys
from pathlib import Path

import pytest

from pagelode.llm import suffix_dedup as S

sys.path.insert(0, str(Path(__file__).parent))
from test_suffix_dedup import brute, fixture, key  # noqa: E402


@pytest.mark.parametrize("heavy, most", [(1, 1 << 16), (3, 2), (1 << 40, 1)])
def test_any_list_gives_the_same(spark, monkeypatch, heavy, most):
    monkeypatch.setattr(S, "HEAVY", heavy)
    monkeypatch.setattr(S, "MOST_HEAVY", most)
    docs = fixture()
    got = S.suffix_dedup(spark.createDataFrame(docs, "doc_id long, text string"), width=64).collect()
    assert sorted(map(tuple, got), key=key) == sorted(brute(docs, 64), key=key)


def test_a_frequent_context_is_not_joined(spark):
    rows = [(7, 70, i, 0, 5) for i in range(2000)] + [(8, i // 2, i, 0, 5) for i in range(40)]
    some = spark.createDataFrame(rows, "gram long, context long, number long, low int, high int")
    kinds = some.groupBy("gram", "context").agg({"*": "count"}).withColumnRenamed("count(1)", "copies")
    heavy, others = S.repeated_contexts(some, kinds)
    assert heavy.count() == 2000 and others.count() == 40
