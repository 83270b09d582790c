"""Run health: fetch outcomes, politeness schedule, manifest, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules as R
from ..functions.core import number_rows, ranged, running


def run_manifest(captures: DataFrame) -> DataFrame:
    """Q03: totals of a run and the notes they lead to, in one aggregate."""
    retried = F.coalesce("retries", F.lit(0)) > 0
    limited = F.coalesce(F.col("status") == 429, F.lit(False))
    n = {
        "routes": F.count(F.lit(1)), "captured": F.count_if("ok"), "failed": F.count_if(~F.col("ok")),
        "throttled": F.count_if(limited | retried), "anonymous": F.count_if(F.col("auth_state") == "anonymous"),
        "challenged": F.count_if("challenged"), "retried": F.count_if(retried), "truncated": F.count_if("truncated"),
        "server_errors": F.count_if(F.col("status") >= 500), "rate_limited": F.count_if(limited),
    }
    totals = captures.agg(*[v.alias(k) for k, v in n.items()])
    note = lambda test, *parts: F.when(F.expr(test), F.concat(*[F.expr(p) for p in parts]))
    notes = F.array_compact(F.array(
        note("routes = 0", "'No routes were captured this run.'"),
        note("failed > 0", "failed", "' of '", "routes", "' route(s) failed to capture.'"),
        note("anonymous > 0", "anonymous", "' page(s) captured anonymously (no authenticated session detected — session may have expired or the site gated this content).'"),
        note("rate_limited > 0", "rate_limited", "' route(s) hit HTTP 429 (rate limiting) and were backed off.'"),
        note("server_errors > 0", "server_errors", "' route(s) returned a 5xx server error.'"),
        note("retried > 0", "retried", "' route(s) required one or more retries before succeeding.'"),
        note("truncated > 0", "truncated", "' route(s) were truncated / only partially captured (content may be incomplete).'"),
        note("challenged > 0", "challenged", "' of '", "routes", "' route(s) were bot-wall / CAPTCHA / compat / access-block pages (200 status, NOT the real site) — excluded from aggregates.'")))
    return totals.withColumn("notes", notes)


def without_challenged(rows: DataFrame, captures: DataFrame) -> DataFrame:
    """Q04: rows of pages that were not block pages."""
    return rows.join(captures.filter("challenged").select("url").distinct(), "url", "left_anti")


def in_runs(attempts: DataFrame, per_run: int = 3) -> DataFrame:
    """Attempts of a whole log as fetch runs: every ``per_run`` attempts of a URL are one, numbered ``run``."""
    return attempts.withColumn("run", F.floor(F.col("attempt") / per_run).cast("int")).withColumn(
        "attempt", (F.col("attempt") % per_run).cast("int"))


def fetch_outcomes(attempts: DataFrame, max_retries: int = 3) -> DataFrame:
    """Q05: final result per URL and run from its attempts (url, run, attempt, status, error).

    The first attempt that is not retryable, or the last one allowed, decides; attempts are counted within a run.
    """
    timeout = F.coalesce(F.col("error").rlike(R.RETRYABLE_ERROR), F.lit(False))
    retryable = timeout | F.coalesce((F.col("status") == 429) | (F.col("status") >= 500), F.lit(False))
    final = (~retryable) | (F.col("attempt") == max_retries - 1)
    rows = attempts.filter(F.col("attempt") < max_retries).withColumn("final", final)
    picked = rows.groupBy("url", "run").agg(
        F.coalesce(F.min_by(F.struct("attempt", "status", "error"), F.when(F.col("final"), F.col("attempt"))),
                   F.max_by(F.struct("attempt", "status", "error"), F.col("attempt"))).alias("r"))
    ok = F.col("r.error").isNull() & F.coalesce(F.col("r.status") < 500, F.lit(True))
    return picked.select("url", "run", ok.alias("ok"), F.col("r.status").alias("status"), F.col("r.attempt").alias("retries"),
                         F.when(~ok, F.coalesce("r.error", F.concat(F.lit("HTTP "), "r.status"))).alias("error"))


def artifact_summary(captures: DataFrame, actions: DataFrame) -> DataFrame:
    """Q06: screenshot, page, action and download counts of a run, one row."""
    pages = captures.agg(F.count_if("ok").alias("captured"), F.count_if(~F.col("ok")).alias("failed"),
                         F.count_if(F.col("ok") & F.col("screenshot").isNotNull()).alias("page_shots"))
    acts = actions.agg(F.count(F.lit(1)).alias("actions"), F.count_if(F.col("screenshot").isNotNull()).alias("action_shots"),
                       F.count_if(F.col("outcome") == "download").alias("downloads"))
    return pages.join(acts).withColumn("screenshots", F.col("page_shots") + F.col("action_shots"))


def politeness_schedule(arrivals: DataFrame, delay_ms: int, bucket_ms: int | None = None) -> DataFrame:
    """Start time per request so a host is asked at most every ``delay_ms``.

    slot_i = max(arrival_i, slot_(i-1) + d) equals i*d + max over j<=i of (arrival_j - j*d),
    so a running number and a running maximum do. Both are summed up per range of rows and carried over the ranges, so a
    host with all requests of a second is spread as evenly as any. With ``bucket_ms``, spans of time take the place of
    ranges, which saves a pass over requests that are known to be even.
    """
    order = ["arrival_ms", "seq"]
    placed = ranged(arrivals, ["host"], order) if bucket_ms is None else arrivals.withColumn(
        "_range", F.floor(F.col("arrival_ms") / bucket_ms).cast("int"))
    counted = number_rows(placed, ["host"], order, F.col("_range"), "turn")
    shifted = running(counted, ["host"], order, F.col("_range"), {"lead": ("max", F.col("arrival_ms") - F.col("turn") * delay_ms)})
    slot = F.col("turn") * delay_ms + F.col("lead")
    return shifted.select("host", "seq", "arrival_ms", slot.alias("slot_ms"), (slot - F.col("arrival_ms")).alias("wait_ms"))


def backoff_ms(base: Column, attempt: Column) -> Column:
    """Exponential backoff with a ceiling; none for a non-positive base."""
    return F.when(base <= 0, F.lit(0)).otherwise(F.least(F.lit(R.MAX_BACKOFF_MS), base * F.pow(F.lit(2), attempt))).cast("long")


def retry_after_ms(header: Column, now_ms: Column) -> Column:
    """A Retry-After value (seconds or HTTP date) as milliseconds, NULL when unusable."""
    seconds = F.trim(header).try_cast("double")
    when = F.unix_millis(F.try_to_timestamp(F.regexp_replace(header, "^[A-Za-z]{3}, ", ""), F.lit("dd MMM yyyy HH:mm:ss z")))
    wait = lambda ms: F.least(F.lit(R.MAX_BACKOFF_MS).cast("double"), ms.cast("double"))
    return F.when(F.coalesce(header, F.lit("")) == "", F.lit(None)).when(
        seconds.isNotNull(), F.when(seconds >= 0, wait(seconds * 1000))).otherwise(
        F.when(when <= now_ms, F.lit(0.0)).when(when > now_ms, wait(when - now_ms))).cast("long")
