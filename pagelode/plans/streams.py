"""Streaming queries: each stream runs to the end of what is there and is read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..session import shared_folder
from ..sources import adapters as A
from ..streaming import jobs as J
from . import sqltext as S
from .calls import ORACLES as _CALL_SQL
from .capture import ORACLES as _CAPTURE_SQL


def _folder(spark):
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def _events(spark, sf):
    """The events table as a file stream."""
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def _calls(spark, sf):
    calls = _events(spark, sf).selectExpr(*A.CALLS)
    return calls.withColumn("url", F.concat(F.lit("https://"), "host", "pathname"))


def _staged(spark, rows, order, files):
    """Rows as files in order of ``order``, read as a stream of about ``files`` batches.

    All files are written by one job, in ranges of the order; a batch is made of as many ranges as keep all cores busy. A file
    source takes the oldest file first, so their times are set in the order of their names; only names pass through the driver.
    """
    path = f"{_folder(spark)}/source"
    ranges = max(1, spark.sparkContext.defaultParallelism // files)
    rows.repartitionByRange(files * ranges, order).write.parquet(path)
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    parts = sorted((f.getPath() for f in system.listStatus(place) if f.getPath().getName().startswith("part-")), key=lambda p: p.getName())
    for i, part in enumerate(parts):
        system.setTimes(part, 1_700_000_000_000 + 1000 * i, -1)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", ranges).parquet(path)


def _done(spark, stream):
    path = _folder(spark)
    J.run_available(stream, path)
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")


def st1(spark, sf):
    path = _folder(spark)
    J.first_calls(_calls(spark, sf), path)
    return spark.read.parquet(f"{path}/rows").select("body_key", "seq", "status")


def st2(spark, sf):
    frames = A.table(spark, sf, "conversations").select(F.concat(F.lit("s"), F.col("conv_id") % 20).alias("stream_key"), (
        F.col("conv_id") * 1000 + F.col("turn")).alias("seq"), F.col("text").alias("frame"))
    path = _folder(spark)
    J.numbered_frames(_staged(spark, frames, "seq", 4), path)
    return spark.read.parquet(f"{path}/rows").select("stream_key", "frame_no", "seq", F.md5("frame").alias("digest"))


def st3_tumbling(spark, sf):
    out = _done(spark, J.endpoint_counts(_calls(spark, sf), "1 hour"))
    return out.select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"), "host", "calls", "errors")


def st3_sliding(spark, sf):
    out = _done(spark, J.endpoint_counts(_calls(spark, sf), "2 hours", "1 hour"))
    return out.select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"), "host", "calls", "errors")


def st3_sessions(spark, sf):
    out = _done(spark, J.host_sessions(_calls(spark, sf), "15 minutes"))
    return out.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "host", "calls")


def st4(spark, sf):
    path = _folder(spark)
    J.fold_batches(_staged(spark, A.crud_log(spark, sf), "seq", 3), path)
    return J.record_state(spark, path).select("resource", "id", "field", "value")


def st5_throttle(spark, sf):
    path = _folder(spark)
    J.throttle_batches(_staged(spark, A.arrivals(spark, sf).select("host", "seq", "arrival_ms"), "arrival_ms", 3), path, 2500)
    return spark.read.parquet(f"{path}/rows").select("host", "seq", "arrival_ms", "slot_ms")


def st5_relogin(spark, sf):
    events = _events(spark, sf).select(F.lit("site").alias("site"), "ts", F.when(F.col("event_id") % 5 == 0, "anonymous").otherwise("authed").alias("auth_state"))
    out = _done(spark, J.relogin_bursts(events, "5 minutes"))
    return out.select("site", F.date_format("login_at", "yyyy-MM-dd HH:mm:ss").alias("login_at"), "noticed")


QUERIES = {
    "st1_first_per_key": st1, "st2_capped_frames": st2, "st3_tumbling_counts": st3_tumbling, "st3_sliding_counts": st3_sliding, "st3_host_sessions": st3_sessions,
    "st4_folded_records": st4, "st5_throttle": st5_throttle, "st5_relogin": st5_relogin,
}

_CALLS = S.view("calls", A.CALLS, "events")
# A window closes once the watermark, ten minutes behind the newest row, passes its end.
_CLOSED = "<= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE"


def _sessions(source: str, keys: str, gap: str) -> str:
    return (f"g AS (SELECT {keys}, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL {gap} THEN 0 ELSE 1 END AS fresh FROM {source} WINDOW w AS (PARTITION BY {keys} ORDER BY ts)), n AS (SELECT {keys}, ts, "
            f"sum(fresh) OVER (PARTITION BY {keys} ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g), s AS (SELECT {keys}, k, min(ts) AS a, max(ts) + INTERVAL {gap} AS z, count(*) AS n FROM n GROUP BY {keys}, k)")


ORACLES = {
    "st1_first_per_key": f"WITH {_CALLS} SELECT method || ' https://' || host || pathname AS body_key, min(seq) AS seq, arg_min(status, seq) AS status FROM calls GROUP BY 1",
    "st2_capped_frames": "SELECT 's' || (conv_id % 20) AS stream_key, row_number() OVER (PARTITION BY conv_id % 20 ORDER BY conv_id * 1000 + turn) AS frame_no, conv_id * 1000 + turn AS seq, "
        "md5(text) AS digest FROM conversations",
    "st3_tumbling_counts": f"WITH {_CALLS} SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS window_start, host, count(*) AS calls, count(*) FILTER (status >= 500) AS errors FROM calls WHERE date_trunc('hour', ts) + INTERVAL 1 "
        f"HOUR {_CLOSED} GROUP BY 1, 2",
    "st3_sliding_counts": f"WITH {_CALLS}, w AS (SELECT host, status, date_trunc('hour', ts) - INTERVAL 1 HOUR * d AS a FROM calls, (VALUES (0), (1)) x(d)) SELECT strftime(a, '%Y-%m-%d %H:%M') AS window_start, host, count(*) AS calls, count(*) "
        f"FILTER (status >= 500) AS errors FROM w WHERE a + INTERVAL 2 HOUR {_CLOSED} GROUP BY 1, 2",
    "st3_host_sessions": f"WITH {_CALLS}, {_sessions('calls', 'host', '15 MINUTE')} SELECT strftime(a, '%Y-%m-%d %H:%M:%S') AS window_start, host, n AS calls FROM s WHERE z {_CLOSED}",
    "st4_folded_records": _CALL_SQL["c20_resource_state"],
    "st5_throttle": "SELECT host, seq, arrival_ms, slot_ms FROM (" + _CAPTURE_SQL["p01_politeness"] + ")",
    "st5_relogin": f"WITH e AS (SELECT 'site' AS site, ts FROM events WHERE event_id % 5 = 0), {_sessions('e', 'site', '5 MINUTE')} SELECT site, strftime(a, '%Y-%m-%d %H:%M:%S') AS login_at, n AS noticed FROM s WHERE z <= (SELECT max(ts) FROM "
        "e) - INTERVAL 10 MINUTE",
}
