"""Run-health queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import capture as H
from ..sources import adapters as A
from . import sqltext as S

NOW_MS = 1704067230000  # 2024-01-01T00:00:30Z


def q03(spark, sf):
    return H.run_manifest(A.captures(spark, sf)).withColumn("notes", F.array_join("notes", " | "))


def q04(spark, sf):
    return H.without_challenged(A.captures(spark, sf), A.captures(spark, sf)).groupBy("category").agg(F.count(F.lit(1)).alias("n"))


def p02_all(spark, sf):
    return A.attempts(spark, sf).select("url", "attempt", H.backoff_ms(F.col("user_id") % 7 * 1000, F.col("attempt")).alias("backoff_ms"))


def p02(spark, sf):
    """Backoff within fetch runs; ``p02_backoff_all`` lets it grow over the whole log of a URL."""
    return H.in_runs(A.attempts(spark, sf)).select("url", "run", "attempt", H.backoff_ms(F.col("user_id") % 7 * 1000, F.col("attempt")).alias("backoff_ms"))


def p03(spark, sf):
    return A.arrivals(spark, sf).select("seq", H.retry_after_ms(F.col("retry_after"), F.lit(NOW_MS)).alias("wait_ms"))


QUERIES = {
    "q03_run_manifest": q03,
    "q04_without_challenged": q04,
    "q05_fetch_outcomes": lambda spark, sf: H.fetch_outcomes(H.in_runs(A.attempts(spark, sf))),
    "q06_artifact_summary": lambda spark, sf: H.artifact_summary(A.captures(spark, sf), A.actions(spark, sf)),
    "p01_politeness": lambda spark, sf: H.politeness_schedule(A.arrivals(spark, sf), 2500),
    "p02_backoff": p02,
    "p02_backoff_all": p02_all,
    "p03_retry_after": p03,
}

_CAP = S.view("captures", A.CAPTURES, "events")
_ATT = (f"a0 AS ({A.select_sql(A.ATTEMPTS_BASE, 'events')}), a1 AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY seq) - 1 AS n FROM a0), att AS (SELECT *, n // 3 AS run, "
        "n % 3 AS attempt FROM a1)")
_NOTES = ("concat_ws(' | ', CASE WHEN failed > 0 THEN failed || ' of ' || routes || ' route(s) failed to capture.' END, CASE WHEN anonymous > 0 THEN anonymous || ' page(s) "
          "captured anonymously (no authenticated session detected — session may have expired or the site gated this content).' END, CASE WHEN rate_limited > 0 THEN "
          "rate_limited || ' route(s) hit HTTP 429 (rate limiting) and were backed off.' END, CASE WHEN server_errors > 0 THEN server_errors || ' route(s) returned a 5xx "
          "server error.' END, CASE WHEN retried > 0 THEN retried || ' route(s) required one or more retries before succeeding.' END, CASE WHEN truncated > 0 THEN truncated || "
          "' route(s) were truncated / only partially captured (content may be incomplete).' END, CASE WHEN challenged > 0 THEN challenged || ' of ' || routes || ' route(s) were "
          "bot-wall / CAPTCHA / compat / access-block pages (200 status, NOT the real site) — excluded from aggregates.' END)")

ORACLES = {
    "q03_run_manifest": f"WITH {_CAP}, t AS (SELECT count(*) AS routes, count(*) FILTER (ok) AS captured, count(*) FILTER (NOT ok) AS failed, count(*) FILTER (status = 429 OR "
        "retries > 0) AS throttled, count(*) FILTER (auth_state = 'anonymous') AS anonymous, count(*) FILTER (challenged) AS challenged, count(*) FILTER (retries > 0) AS retried, "
        "count(*) FILTER (truncated) AS truncated, count(*) FILTER (status >= 500) AS server_errors, count(*) FILTER (status = 429) AS rate_limited FROM captures) SELECT *, "
        f"{_NOTES} AS notes FROM t",
    "q04_without_challenged": f"WITH {_CAP} SELECT category, count(*) AS n FROM captures WHERE url NOT IN (SELECT url FROM captures WHERE challenged) GROUP BY category",
    "q05_fetch_outcomes": f"WITH {_ATT}, f AS (SELECT *, coalesce(contains(error, 'Timeout'), false) OR coalesce(status = 429 OR status >= 500, false) AS again FROM att), p AS (SELECT * "
        "FROM f QUALIFY row_number() OVER (PARTITION BY url, run ORDER BY CASE WHEN NOT again OR attempt = 2 THEN attempt ELSE 100 - attempt END) = 1) SELECT url, run, error IS NULL AND "
        "coalesce(status < 500, true) AS ok, status, attempt AS retries, CASE WHEN NOT (error IS NULL AND coalesce(status < 500, true)) THEN coalesce(error, 'HTTP ' || status) END AS "
        "error FROM p",
    "q06_artifact_summary": f"WITH {_CAP}, {S.view('actions', A.ACTIONS, 'events')}, c AS (SELECT count(*) FILTER (ok) AS captured, count(*) FILTER (NOT ok) AS failed, count(*) FILTER (ok "
        "AND screenshot IS NOT NULL) AS page_shots FROM captures), a AS (SELECT count(*) AS actions, count(screenshot) AS action_shots, count(*) FILTER (outcome = 'download') AS "
        "downloads FROM actions) SELECT *, page_shots + action_shots AS screenshots FROM c, a",
    "p01_politeness": f"WITH RECURSIVE a AS (SELECT host, seq, arrival_ms, row_number() OVER (PARTITION BY host ORDER BY arrival_ms, seq) AS n FROM ({A.select_sql(A.ATTEMPTS_BASE, 'events')})), "
        "w AS (SELECT host, seq, arrival_ms, n, arrival_ms AS slot_ms FROM a WHERE n = 1 UNION ALL SELECT a.host, a.seq, a.arrival_ms, a.n, greatest(a.arrival_ms, w.slot_ms + 2500) "
        "FROM w JOIN a ON a.host = w.host AND a.n = w.n + 1) SELECT host, seq, arrival_ms, slot_ms, slot_ms - arrival_ms AS wait_ms FROM w",
    "p02_backoff": f"WITH {_ATT} SELECT url, run, attempt, CAST(least(30000, user_id % 7 * 1000 * pow(2, attempt)) AS BIGINT) AS backoff_ms FROM att",
    "p02_backoff_all": f"WITH a AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY seq) - 1 AS attempt FROM ({A.select_sql(A.ATTEMPTS_BASE, 'events')})) SELECT url, attempt, "
        "CAST(least(30000, user_id % 7 * 1000 * pow(2, least(attempt, 40))) AS BIGINT) AS backoff_ms FROM a",
    "p03_retry_after": f"WITH a AS ({A.select_sql(A.ATTEMPTS_BASE, 'events')}) SELECT seq, CAST(CASE seq % 6 WHEN 0 THEN least(30000, seq % 60 * 1000) WHEN 3 THEN greatest(0, (seq % 60 - 30) * 1000) END AS BIGINT) AS "
        "wait_ms FROM a",
}
