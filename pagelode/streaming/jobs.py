"""Structured Streaming forms of the event operators. State is bounded by watermarks or caps."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import rules as R
from ..functions.core import TABLE_TASK_ROWS, head, rank_all, ranged, running, spread
from ..operators.calls import body_key, fold_fields, opened_log, replaced_records
from ..session import stage


def run_available(stream: DataFrame, path: str, mode: str = "append") -> None:
    """Drive a stream over what is there and store it as parquet below ``path``."""
    query = (stream.writeStream.outputMode(mode).format("parquet").option("path", f"{path}/rows")
             .option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start())
    query.awaitTermination()


def _versions(spark: SparkSession, path: str, schema: str, before: int) -> DataFrame:
    """Rows that the batches before one have written below ``path``, with their ``batch``."""
    if before <= 0:
        return spark.createDataFrame([], f"{schema}, batch int")
    return spark.read.schema(f"{schema}, batch int").parquet(path).filter(F.col("batch") < before)


def _each_batch(stream: DataFrame, path: str, work: Callable[[DataFrame, int], None]) -> None:
    stream.writeStream.foreachBatch(work).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()


def first_per_key(calls: DataFrame, delay: str = "1 hour") -> DataFrame:
    """ST1: calls whose (method, URL) was not seen before within the watermark; which of them is kept is open."""
    keyed = calls.withColumn("body_key", body_key(F.col("method"), F.col("url")))
    return keyed.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["body_key"])


def first_calls(calls: DataFrame, path: str) -> None:
    """ST1: the first call of each (method, URL) of all time, by ``seq``: ``body_key, seq, ts, status`` below ``path``/rows.

    What a batch adds is a version of the table, and the table is the state: a batch's first calls are aggregated with
    partial sums, and those of keys in earlier versions are dropped by an anti join. A batch that runs again writes the same.
    """
    spark, schema = calls.sparkSession, "body_key string, seq long, ts timestamp, status int"

    def merge(batch: DataFrame, number: int) -> None:
        keyed = batch.withColumn("body_key", body_key(F.col("method"), F.col("url")))
        first = keyed.groupBy("body_key").agg(F.min("seq").alias("seq"), F.min_by("ts", "seq").alias("ts"), F.min_by(
            F.col("status").cast("int"), "seq").alias("status"))
        seen = _versions(spark, f"{path}/rows", schema, number).select("body_key")
        first.join(seen, "body_key", "left_anti").write.mode("overwrite").parquet(f"{path}/rows/batch={number}")
    _each_batch(calls, path, merge)


def numbered_frames(frames: DataFrame, path: str, cap: int | None = R.MAX_FRAMES) -> None:
    """ST2: frames (stream_key, seq, frame), all or up to ``cap`` per stream, numbered on from batch to batch.

    ``stream_key, frame_no, seq, frame`` below ``path``/rows. Frames of a batch are numbered in ranges of rows, so a hot stream
    is spread; the state is one count per stream, of which each batch writes a version with the streams that it touched.
    """
    spark, schema = frames.sparkSession, "stream_key string, taken long"

    def merge(batch: DataFrame, number: int) -> None:
        taken = _versions(spark, f"{path}/counts", schema, number).groupBy("stream_key").agg(F.max_by("taken", "batch").alias("taken"))
        ranked = rank_all(batch.select("stream_key", "seq", "frame"), ["stream_key"], ["seq"], "place").join(taken, "stream_key", "left")
        placed = ranked.withColumn("frame_no", F.col("place") + F.coalesce("taken", F.lit(0))).select(
            "stream_key", "frame_no", "seq", head(F.col("frame"), R.MAX_FRAME_CHARS).alias("frame"))
        kept = placed if cap is None else placed.filter(F.col("frame_no") <= cap)
        kept.write.mode("overwrite").parquet(f"{path}/rows/batch={number}")
        placed.groupBy("stream_key").agg(F.max("frame_no").alias("taken")).write.mode("overwrite").parquet(f"{path}/counts/batch={number}")
    _each_batch(frames, path, merge)


def endpoint_counts(calls: DataFrame, size: str, slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """ST3: calls and errors per host and time window; late rows are dropped by the watermark."""
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    return calls.withWatermark("ts", delay).groupBy(window.alias("w"), "host").agg(
        F.count(F.lit(1)).alias("calls"), F.count_if(F.col("status") >= 500).alias("errors")).select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "host", "calls", "errors")


def host_sessions(calls: DataFrame, gap: str, delay: str = "10 minutes") -> DataFrame:
    """ST3: bursts of calls per host, split where a host is silent for ``gap``."""
    return calls.withWatermark("ts", delay).groupBy(F.session_window("ts", gap).alias("w"), "host").agg(F.count(F.lit(1)).alias("calls")).select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "host", "calls")


_FIELDS = "resource string, id string, field string, value string, seq long"


def record_state(spark: SparkSession, path: str, before: int = 1 << 30) -> DataFrame:
    """ST4: the record store after all batches, or after those before one: ``resource, id, field, value, seq``."""
    rows = _versions(spark, f"{path}/rows", _FIELDS, before)
    last = rows.groupBy("resource", "id").agg(F.max("batch").alias("batch"))
    return rows.join(last, ["resource", "id", "batch"]).drop("batch").filter("field is not null")


def fold_batches(log: DataFrame, path: str) -> None:
    """ST4: record store fed by create, replace, merge, delete and reset events (resource, id, seq, op, body).

    Each batch writes a version with all fields of the records that it touched, and a row without a field for a record that
    is gone. A batch is folded by the aggregates of C20; older fields stay where it has only merges. No event is looked at
    one by one, so a record with most of a batch's events is no more work than others.
    """
    spark = log.sparkSession

    def merge(batch: DataFrame, number: int) -> None:
        # Dealt by event, not by record, and opened once: three readers would each parse every body.
        log = spread(batch.select("resource", "id", "seq", "op", "body"), "resource", "id", "seq", task_rows=TABLE_TASK_ROWS)
        events = stage(opened_log(log).select("resource", "id", "seq", "op", "fields"), "events")
        touched = events.select("resource", "id").distinct()
        older = (record_state(spark, path, number).join(touched, ["resource", "id"], "left_semi")
                 .join(replaced_records(events), ["resource", "id"], "left_anti"))
        fields = fold_fields(events).unionByName(older).groupBy("resource", "id", "field").agg(
            F.max_by("value", "seq").alias("value"), F.max("seq").alias("seq"))
        touched.join(fields, ["resource", "id"], "left").write.mode("overwrite").parquet(f"{path}/rows/batch={number}")
    _each_batch(log, path, merge)


def throttle_batches(arrivals: DataFrame, path: str, delay_ms: int) -> None:
    """ST5: start slots of requests per host, carried from batch to batch.

    Each micro-batch uses the running-maximum form of the schedule, so a hot host
    is spread inside the batch; only the last slot per host is carried, as a small
    table under the shared folder. A batch that runs again writes the same files.
    """
    spark = arrivals.sparkSession

    def schedule(batch: DataFrame, number: int) -> None:
        rows = batch.select("host", "seq", "arrival_ms")
        if number > 0:
            carry = spark.read.parquet(f"{path}/carry/batch={number - 1}")
        else:
            carry = spark.createDataFrame([], "host string, last_ms long")
        order = ["arrival_ms", "seq"]
        turned = running(ranged(rows, ["host"], order), ["host"], order, F.col("_range"), {"turn": ("count", F.lit(1))})
        led = running(turned, ["host"], order, F.col("_range"), {"lead": ("max", F.col("arrival_ms") - F.col("turn") * delay_ms)})
        slots = led.join(carry, "host", "left").withColumn("slot_ms", F.col("turn") * delay_ms + F.greatest("lead", "last_ms"))
        slots.select("host", "seq", "arrival_ms", "slot_ms").write.mode("overwrite").parquet(f"{path}/rows/batch={number}")
        done = spark.read.parquet(f"{path}/rows/batch={number}").groupBy("host").agg(F.max("slot_ms").alias("last_ms"))
        carry.unionByName(done).groupBy("host").agg(F.max("last_ms").alias("last_ms")).write.mode("overwrite").parquet(f"{path}/carry/batch={number}")

    arrivals.writeStream.foreachBatch(schedule).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()


def relogin_bursts(events: DataFrame, gap: str, delay: str = "10 minutes") -> DataFrame:
    """ST5: one re-login per burst of anonymous answers (site, ts), however many calls notice it."""
    return events.filter("auth_state = 'anonymous'").withWatermark("ts", delay).groupBy(
        F.session_window("ts", gap).alias("w"), "site").agg(F.count(F.lit(1)).alias("noticed")).select(
        "site", F.col("w.start").alias("login_at"), "noticed")


