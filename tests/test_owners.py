"""owners with evidence, and the filter before the shuffle."""

from pyspark.sql import functions as F

from pagelode.functions.bloom import bloom_filter, might_hold
from pagelode.operators import entities as E
from pagelode.operators import owners as O


def records(spark, rows):
    docs = spark.createDataFrame([(p, i, None, j) for i, (p, j) in enumerate(rows)], "path string, seq long, url string, json string")
    return E.document_records(docs)


def test_owners_need_evidence(spark):
    rows = [("/api/models/x", '{"id":"ann/m1"}'), ("/api/models/x", '{"id":"bob/m2","author":"Bob"}'), ("/api/models/x", '{"id":"docs/index"}'),
            ("/api/datasets/x", '{"id":"cat/d1"}'), ("/api/users/x", '{"id":"cat"}'), ("/api/spaces/x", '{"id":"s1","owner":"bob"}'),
            ("/api/models/x", '{"id":"transformers/index"}'), ("/api/orgs/x", '{"id":"unrelated"}'), ("/api/models/x", '{"id":"solo"}')]
    got = {(r.type, r.id): (r.owner, r.sources, r.records, r.score, r.first_source, r.linked) for r in O.evidenced_owners(records(spark, rows)).collect()}
    assert got == {
        ("model", "ann/m1"): ("ann", 0, 0, 0.0, None, False), ("model", "transformers/index"): ("transformers", 0, 0, 0.0, None, False),
        ("model", "bob/m2"): ("bob", 2, 0, 0.667, "model/bob/m2", True), ("dataset", "cat/d1"): ("cat", 0, 1, 0.75, "user/cat", True)}
    assert {tuple(r) for r in O.evidenced_edges(records(spark, rows)).collect()} == {
        ("model/bob/m2", "user/bob", "author"), ("dataset/cat/d1", "user/cat", "author")}
    none = records(spark, rows).filter("seq < 0")
    assert O.evidenced_owners(none).count() == 0 and O.evidenced_owners(records(spark, rows), none).count() == 4


def test_the_filter_never_loses_a_key(spark):
    keys = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("k"))
    asked = spark.range(6000).select(F.concat(F.lit("k"), "id").alias("k"), "id").unionAll(spark.createDataFrame([(None, -1)], "k string, id long"))
    for bits in (1 << 10, 1 << 20):
        kept = asked.filter(might_hold(bloom_filter(keys, "k", bits), F.col("k"), bits)).select("id").collect()
        ids = {r.id for r in kept}
        assert set(range(3000)) <= ids and -1 not in ids
    assert len(ids) < 3010
    empty = asked.filter(might_hold(bloom_filter(keys.filter("k = 'x'"), "k"), F.col("k")))
    assert empty.count() == 0


def test_the_filter_comes_before_the_shuffle(spark):
    rows = [("/api/models/x", '{"id":"bob/m2","author":"Bob"}'), ("/api/users/x", '{"id":"zed"}')]
    plan = O.evidenced_owners(records(spark, rows))._jdf.queryExecution().executedPlan().toString()
    lines = plan.splitlines()
    tested = [i for i, line in enumerate(lines) if "Filter" in line and "subquery" in line.lower()]
    # Plans print from the result down to the scans: the filter stands below the shuffle of the evidence.
    shuffled = [i for i, line in enumerate(lines) if "Exchange hashpartitioning(name" in line]
    assert tested and shuffled and min(shuffled) < min(tested)
