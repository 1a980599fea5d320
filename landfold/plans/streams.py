"""Queries of streaming jobs: each runs a stream over the events to its end; the SQL twin is the batch result."""

from __future__ import annotations

from pyspark.sql import functions as F

from landfold.operators import metrics as M
from landfold.plans.base import Registry
from landfold.sources.staging import staged_path
from landfold.streaming import jobs as J

R = Registry()
QUERIES, ORACLE_SQL = R.queries, R.oracle


#: Files in which the events come, one a batch.
FILES = 4


def events(s):
    """The events as a stream of files in the order of their time."""
    return J.file_stream(s.spark, s.events.schema, J.event_files(s.events, "ts", FILES, staged_path(s.spark, "event-files")))


def metric_events(s):
    kind = F.when(F.col("event_type").isin("view", "click"), "counter").when(F.col("event_type") == "error", "gauge").otherwise("histogram")
    return events(s).select(F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), kind.alias("kind"), F.col("event_type").alias("name"), (F.col("user_id") % 10).alias("label"), "value")


@R.add("st01_live_metrics", "SELECT kind, name, label, count(*) AS n, round(sum(value), 4) AS total FROM v_metric_event GROUP BY ALL")
def st01(s):
    return J.run(J.live_metrics(metric_events(s)), "complete", "st01").withColumn("total", F.round("total", 4))


@R.add("st01_windowed_metrics", "SELECT date_trunc('hour', ts) AS start, name, count(*) AS n, round(sum(value), 4) AS total FROM v_metric_event WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM v_metric_event) - INTERVAL 10 MINUTE GROUP BY ALL")
def st01_windowed(s):
    """Only windows that are over, as the watermark tells."""
    return J.run(J.windowed_metrics(metric_events(s), "1 hour", "10 minutes"), "append", "st01w").select(F.col("start").cast("timestamp_ntz").alias("start"), "name", "n", F.round("total", 4).alias("total"))


@R.add("st02_gauges", "SELECT name, label, arg_max(value, seq) AS value FROM v_metric_event GROUP BY name, label")
def st02(s):
    return J.run(J.last_values(metric_events(s)), "complete", "st02")


@R.add("st03_tile_completion", "SELECT DISTINCT user_id % 20 AS run_id, event_id % 400 AS tile FROM events")
def st03(s):
    tiles = events(s).select((F.col("user_id") % 20).alias("run_id"), (F.col("event_id") % 400).alias("tile"), F.col("ts").cast("timestamp").alias("ts"))
    return J.run(J.completed_once(tiles, "1 hour"), "append", "st03", once=("run_id", "tile")).select("run_id", "tile")


@R.add("st04_run_progress", "SELECT run_id, n AS done, spent, rate, 0.0::DOUBLE AS eta FROM (SELECT user_id % 20 AS run_id, count(*) AS n, round(sum(value), 3) AS spent, round(count(*) / sum(value) * 1000, 6) AS rate FROM events GROUP BY 1)")
def st04(s):
    """The last row of each run: all done, nothing left."""
    totals = s.events.groupBy((F.col("user_id") % 20).alias("run_id")).agg(F.count("*").alias("total"))
    tiles = events(s).select((F.col("user_id") % 20).alias("run_id"), F.col("value").alias("ms")).join(totals, "run_id")
    rows = J.run(J.run_progress(tiles, 50), "append", "st04")
    last = rows.groupBy("run_id").agg(F.max_by(F.struct("done", "spent", "rate", "eta"), "done").alias("r")).select("run_id", "r.*")
    return last.select("run_id", "done", F.round("spent", 3).alias("spent"), F.round("rate", 6).alias("rate"), "eta")


@R.add("st05_job_states", "SELECT job_id, arg_max(status, (ts, event_id)) AS status, min(ts) FILTER (WHERE status = 'running') AS started_at, min(ts) FILTER (WHERE status IN ('completed', 'failed')) AS completed_at FROM v_job GROUP BY job_id")
def st05(s):
    status = F.when(F.col("event_type") == "view", "queued").when(F.col("event_type") == "click", "running").when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "error", "failed").otherwise("progress")
    jobs = events(s).select("event_id", F.col("user_id").alias("job_id"), "ts", status.alias("status"))
    return J.run(J.job_states(jobs), "complete", "st05")


@R.add("st08_event_audit", "SELECT project, count(*) AS events, count(*) FILTER (WHERE event = 'error.loaded') = 0 AS accepted FROM v_client_event WHERE received_at >= TIMESTAMP '2024-01-05' GROUP BY project")
def st08(s):
    e = events(s).select(F.col("ts").cast("timestamp_ntz").alias("received_at"), F.concat("event_type", F.lit(".loaded")).alias("event"), F.col("user_id").alias("project"))
    return J.run(J.audit(e, "2024-01-05"), "complete", "st08")


@R.add("st09_timing_refresh", "SELECT f.field, count(ms) AS n, round(avg(ms), 6) AS mean, round(quantile_cont(ms, 0.5), 6) AS median, round(quantile_cont(ms, 0.95), 6) AS p95, round(max(ms), 6) AS most FROM (SELECT DISTINCT field FROM v_timing UNION SELECT 'absent') f LEFT JOIN v_timing USING (field) GROUP BY f.field")
def st09(s):
    """The summary is worked out anew each time that 25 further tiles are in."""
    t = events(s).select(F.lit("run").alias("run"), F.col("event_type").alias("field"), F.col("value").alias("ms"))
    fields = s.events.select(F.col("event_type").alias("field")).distinct().union(s.spark.sql("SELECT 'absent'"))
    found = J.refreshed(t, "st09", lambda rows: M.timing_summary(rows, fields, "field", "ms", ["run"], digits=6), 25)
    return found.select("field", "n", "mean", "median", "p95", "most")
