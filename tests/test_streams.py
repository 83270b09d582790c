"""Streams against their batch form, with one stream, key or record that holds most rows."""

import random

from pyspark.sql import functions as F

from pagelode.operators import calls as C
from pagelode.plans import streams as P
from pagelode.streaming import jobs as J


def test_record_store_equals_the_batch_fold(spark, tmp_path):
    rng = random.Random(8)
    ops = ["create", "replace", "merge", "merge", "merge", "delete", "reset"]
    rows = []
    for i in range(600):
        key = "hot" if i % 2 else f"r{rng.randrange(20)}"
        op = rng.choice(ops)
        body = rng.choice([None, '{"a":%d}' % i, '{"b":"x%d","id":"%s"}' % (i, key), '{"c":[1,2]}', "5"]) if op not in ("delete", "reset") else None
        rows.append(("res", key, i, op, body))
    log = spark.createDataFrame(rows, "resource string, id string, seq long, op string, body string")
    path = str(tmp_path)
    J.fold_batches(P._staged(spark, log, "seq", 7), path)
    got = sorted(map(tuple, J.record_state(spark, path).select("resource", "id", "field", "value").collect()))
    want = sorted(map(tuple, C.fold_state(log).select("resource", "id", "field", "value").collect()))
    assert got == want and len(got) > 20
    # A version holds touched records only, and a batch that runs again writes the same.
    assert spark.read.parquet(f"{path}/rows").select("batch").distinct().count() > 3


def test_frames_are_numbered_on(spark, tmp_path):
    rows = [("hot" if i % 3 else f"s{i % 5}", i, f"f{i}") for i in range(900)]
    frames = spark.createDataFrame(rows, "stream_key string, seq long, frame string")
    for cap, name in ((None, "all"), (10, "capped")):
        path = str(tmp_path / name)
        J.numbered_frames(P._staged(spark, frames, "seq", 5), path, cap)
        got = sorted((r.stream_key, r.frame_no, r.seq, r.frame) for r in spark.read.parquet(f"{path}/rows").collect())
        want, taken = [], {}
        for key, seq, frame in rows:
            taken[key] = taken.get(key, 0) + 1
            if cap is None or taken[key] <= cap:
                want.append((key, taken[key], seq, frame))
        assert got == sorted(want)


def test_first_calls_over_batches(spark, tmp_path):
    rows = [("GET", f"https://a.com/{'hot' if i % 2 else i % 40}", i, 200 + i % 3) for i in range(500)]
    calls = spark.createDataFrame(rows, "method string, url string, seq long, status int").withColumn("ts", F.timestamp_seconds("seq"))
    J.first_calls(P._staged(spark, calls, "seq", 4), str(tmp_path))
    got = {r.body_key: (r.seq, r.status) for r in spark.read.parquet(f"{tmp_path}/rows").collect()}
    want = {}
    for method, url, seq, status in rows:
        want.setdefault(f"{method} {url}", (seq, status))
    assert got == want
