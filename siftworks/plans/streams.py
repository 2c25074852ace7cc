"""Queries that run streams over the tables to their end."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import tables as T
from ..sources.io import new_folder
from ..streaming import stream as st
from .registry import query
from .scans import _TEXT, R, W, scan_sql


@query("k1_stream_rule_scan", W + _TEXT + " " + scan_sql(R.RULES, "text_lines"))
def k1(spark, d):
    return st.run_to_table(st.scan_documents(st.source(spark, f"{d}/documents.parquet")), "stream-scan")


@query("k2_stream_dedupe", "SELECT DISTINCT user_id, event_type FROM events")
def k2(spark, d):
    """A bound that covers the whole table, so that the result is known: each key once."""
    events = st.source(spark, f"{d}/events.parquet").select("ts", "user_id", "event_type")
    return st.run_to_table(st.dedupe(events, ["user_id", "event_type"], "36500 days"), "stream-dedupe").select("user_id", "event_type")


@query("k3_stream_counts", "SELECT hour, event_type, count(*) AS n FROM (SELECT date_trunc('hour', ts) AS hour, event_type FROM events) WHERE hour + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 2 HOUR FROM events) GROUP BY hour, event_type")
def k3(spark, d):
    return st.run_to_table(st.counts_by_hour(st.source(spark, f"{d}/events.parquet"), "event_type"), "stream-counts")


SLICES, DAYS = 6, 5
_SLICED = f"""ev AS (SELECT *, least({SLICES - 1}, CAST(floor((epoch(ts) - epoch((SELECT min(ts) FROM events))) / {DAYS * 86400}) AS BIGINT)) AS k FROM events),
 seen AS (SELECT k, max(max(ts)) OVER (ORDER BY k) AS m FROM ev GROUP BY k)"""


def arrivals(spark, d) -> str:
    """Events cut by time into SLICES files that arrive one after another; from the fourth on, each brings rows of the slice three before it again, under other ids and users."""
    events = T.read(spark, d, "events").select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    first = events.agg(F.min("ts")).first()[0]
    k = F.least(F.lit(SLICES - 1), F.floor((F.col("ts").cast("double") - F.lit(first).cast("double")) / (DAYS * 86400))).cast("int")
    sliced, folder = events.withColumn("k", k), new_folder(spark, "arrivals")
    for i in range(SLICES):
        late = sliced.filter((F.col("k") == i - 3) & (F.col("event_id") % 20 == 0)).withColumns({"event_id": F.col("event_id") + 10**9, "user_id": F.col("user_id") + 10**6})
        sliced.filter(F.col("k") == i).unionByName(late).drop("k").coalesce(1).sortWithinPartitions("ts").write.parquet(f"{folder}/slice{i}")
    return folder


@query("k2_stream_dedupe_within", f"""WITH RECURSIVE {_SLICED}, firsts AS (SELECT user_id, event_type, k, min(ts) AS t FROM ev GROUP BY ALL),
 r AS (SELECT DISTINCT CAST(-1 AS BIGINT) AS k, user_id, event_type, CAST(NULL AS TIMESTAMP) AS t, false AS out FROM firsts UNION ALL
  SELECT r.k + 1, r.user_id, r.event_type, CASE WHEN f.t IS NOT NULL AND (r.t IS NULL OR s.m - INTERVAL 2 DAY >= r.t) THEN f.t ELSE r.t END, f.t IS NOT NULL AND (r.t IS NULL OR coalesce(s.m - INTERVAL 2 DAY >= r.t, false))
  FROM r LEFT JOIN firsts f ON f.user_id = r.user_id AND f.event_type = r.event_type AND f.k = r.k + 1 LEFT JOIN seen s ON s.k = r.k - 1 WHERE r.k + 1 < {SLICES})
 SELECT user_id, event_type, t AS ts FROM r WHERE out""")
def k2_within(spark, d):
    """Six batches and a bound of a day: repeats within it are dropped, later ones come out, and late rows never do."""
    return st.run_to_table(st.dedupe(st.source(spark, arrivals(spark, d), 1), ["user_id", "event_type"], "1 day"), "stream-within").select("user_id", "event_type", "ts")


@query("k3_stream_counts_late", "SELECT hour, event_type, count(*) AS n FROM (SELECT date_trunc('hour', ts) AS hour, event_type FROM events) WHERE hour + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 2 HOUR FROM events) GROUP BY hour, event_type")
def k3_late(spark, d):
    """Six batches: the watermark moves between them, and rows that come after it aren't counted."""
    return st.run_to_table(st.counts_by_hour(st.source(spark, arrivals(spark, d), 1), "event_type"), "stream-late")


@query("k4_stream_stalls", """WITH r AS (SELECT user_id AS key, event_id AS step, event_type AS digest, ts FROM events),
 n AS (SELECT *, CASE WHEN lag(digest) OVER w IS DISTINCT FROM digest OR ts - lag(ts) OVER w > INTERVAL 1 DAY THEN 1 ELSE 0 END AS new FROM r WINDOW w AS (PARTITION BY key ORDER BY step)),
 u AS (SELECT *, sum(new) OVER (PARTITION BY key ORDER BY step) AS run FROM n) SELECT key, digest, min(step) AS from_step, count(*) AS n FROM u GROUP BY key, run, digest HAVING count(*) >= 2""")
def k4_stream(spark, d):
    """Runs that go on over six batches; users silent for a day begin anew."""
    e = st.source(spark, arrivals(spark, d), 1).select(F.col("user_id").alias("key"), F.col("event_id").alias("step"), F.col("event_type").alias("digest"), "ts")
    return st.longest_runs(st.run_to_table(st.stalls(e), "stream-stalls"))
