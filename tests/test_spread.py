"""Numbering and schedules of groups whose order values are crowded."""

from pyspark.sql import functions as F

from pagelode.sources import adapters as A
from pagelode.functions.core import rank_all, ranged
from pagelode.operators import capture


def test_a_host_with_all_requests_at_once_is_spread(spark):
    n = 4000
    rows = spark.range(n).select(F.lit("h").alias("host"), "id", F.lit(1000).cast("long").alias("arrival_ms"), F.col("id").alias("seq"))
    sizes = [r["count"] for r in ranged(rows, ["host"], ["arrival_ms", "seq"]).groupBy("_range").count().collect()]
    assert len(sizes) >= 6 and max(sizes) < n / 3
    got = {r.seq: r.slot_ms for r in capture.politeness_schedule(rows, 50).collect()}
    assert got == {i: 1000 + 50 * i for i in range(n)}


def test_schedule_equals_a_plain_loop(spark):
    rows = [(h, i, (i * 7919) % 5000) for i in range(300) for h in (["a"] if i % 3 else ["a", "b", None])]
    df = spark.createDataFrame(rows, "host string, seq long, arrival_ms long")
    want, last = {}, {}
    for host, seq, at in sorted(rows, key=lambda r: (r[2], r[1])):
        last[host] = max(at, last.get(host, -10 ** 9) + 40)
        want[host, seq] = last[host]
    assert {(r.host, r.seq): r.slot_ms for r in capture.politeness_schedule(df, 40).collect()} == want


def test_rank_all_numbers_every_group(spark):
    rows = [("x", i % 50, i) for i in range(900)] + [(None, 1, 5000), (None, 0, 5001)]
    df = spark.createDataFrame(rows, "k string, v int, id long")
    got = sorted((r.k or "", r.rank, r.v, r.id) for r in rank_all(df, ["k"], [F.desc("v"), F.col("id")]).collect())
    want = []
    for key in ("x", None):
        mine = sorted((r for r in rows if r[0] == key), key=lambda r: (-r[1], r[2]))
        want += [(key or "", i, v, id_) for i, (_, v, id_) in enumerate(mine, 1)]
    assert got == sorted(want)


def test_runs_of_attempts(spark):
    df = spark.createDataFrame([("u", i, 503 if i != 4 else 200, None) for i in range(8)], "url string, attempt int, status int, error string")
    got = sorted((r.run, r.ok, r.status, r.retries) for r in capture.fetch_outcomes(capture.in_runs(df)).collect())
    assert got == [(0, False, 503, 2), (1, True, 200, 1), (2, False, 503, 1)]


def test_asset_responses_are_dealt(spark):
    rows = A.asset_responses(spark, "/root/testdata/sf0.001")
    assert rows.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_values_of_a_page_are_not_shuffled_one_by_one(spark):
    from pagelode.plans import styles
    tally = styles.QUERIES["e12_page_tally"](spark, "/root/testdata/sf0.001")
    plan = tally._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(page_id" not in plan and "hashpartitioning(l_orderkey" in plan
