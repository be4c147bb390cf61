"""Streams over the given tables, run to the end of the present input."""

import datetime as dt

from pyspark.sql import functions as F

from ..session import Scratch
from ..streaming import jobs
from .registry import query
from .work_queries import LIVE


def stream(t, name):
    """A table as a stream, whether it is one file or a folder; times without a zone are taken as UTC."""
    rows = jobs.read_folder(t.spark, f"{t.sf_dir}/{name}.parque[t]", getattr(t, name).schema)
    return rows.withColumns({f.name: F.col(f.name).cast("timestamp") for f in rows.schema.fields if f.dataType.typeName().startswith("timestamp")})


@query("R1_ingest_stream")
def _(t):
    at = Scratch(t.spark, "ingest").base
    jobs.ingest(stream(t, "documents").select(F.col("doc_id").alias("id"), F.regexp_replace("text", "\n", "\n\n").alias("text")), at)
    return jobs.current_chunks(t.spark, at).select("id", "position", F.md5("content").alias("digest"))


@query("R2_debounce_updates", """WITH m AS (SELECT user_id AS thread_id, event_id, ts, event_type = 'error' AS e, max(ts) OVER () AS newest, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS gap FROM events),
s AS (SELECT *, sum(CASE WHEN gap <= INTERVAL 30 SECOND THEN 0 ELSE 1 END) OVER (PARTITION BY thread_id ORDER BY ts) AS k FROM m)
SELECT thread_id, arg_max(event_id, ts) AS payload, bool_or(e) AS flag, count(*) AS n FROM s GROUP BY thread_id, k HAVING max(ts) + INTERVAL 30 SECOND <= any_value(newest) - INTERVAL 1 MINUTE""")
def _(t):
    updates = stream(t, "events").select(F.col("user_id").alias("thread_id"), "ts", F.col("event_id").alias("payload"), (F.col("event_type") == "error").alias("flag"))
    return jobs.run_available(jobs.debounce(updates), "debounce").select("thread_id", "payload", "flag", "n")


@query("R3_usage_windows", """SELECT date_trunc('hour', ts) AS hour, count(*) AS n, round(avg(value), 6) AS avg_duration FROM events GROUP BY 1
HAVING date_trunc('hour', any_value(ts)) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE""")
def _(t):
    requests = stream(t, "events").select(F.col("ts").alias("created_at"), F.col("value").alias("duration"))
    return jobs.run_available(jobs.usage_windows(requests), "usage").withColumn("avg_duration", F.round("avg_duration", 6))


@query("R4_loop_detector", """WITH w AS (SELECT thread_id, event_id, ts, call_hash, list(call_hash) OVER (PARTITION BY thread_id ORDER BY ts, event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS l FROM tool_calls),
c AS (SELECT thread_id, event_id, ts, call_hash, len(list_filter(l, lambda h: h = call_hash)) AS n FROM w),
r AS (SELECT *, row_number() OVER (PARTITION BY thread_id, call_hash, n IN (3, 4) ORDER BY ts, event_id) AS place FROM c)
SELECT thread_id, event_id, CAST(n AS INT) AS n, CASE WHEN n >= 5 THEN 'stop' WHEN n >= 3 AND place = 1 THEN 'warn' ELSE 'ok' END AS verdict FROM r""")
def _(t):
    calls = stream(t, "events").select(F.col("user_id").alias("thread_id"), "event_id", "ts", F.md5(F.concat("event_type", (F.col("event_id") % 3).cast("string"))).alias("call_hash"))
    return jobs.run_available(jobs.loop_detector(calls, threads=1 << 20, idle="3650 days"), "loops")


@query("R5_live_issue_stream", LIVE)
def _(t):
    e = stream(t, "events")
    number, kind = F.col("event_id"), F.col("event_type")
    log = e.select(
        number.alias("id"), F.concat(F.lit("bd-"), F.col("user_id").cast("string")).alias("issue_id"),
        F.when(number % 4 != 0, "status_changed").when(number % 20 == 8, "label_removed").otherwise("label_added").alias("event_type"),
        F.when(number % 4 == 1, "in_progress").when(number % 4 == 2, "closed").when(number % 4 == 3, "open").when(number % 12 == 0, F.concat(F.lit("state:"), kind)).when(number % 12 == 4, F.concat(F.lit("mode:"), kind)).otherwise(kind).alias("new_value"),
        F.col("ts").alias("created_at"),
    )
    return jobs.merge_updates(jobs.live_state(log), "live", "issue_id").withColumn("labels", F.array_join("labels", ","))


@query("R6_first_seen_stream", "SELECT user_id, event_type FROM events GROUP BY 1, 2")
def _(t):
    rows = stream(t, "events").select("user_id", "event_type", F.concat_ws(":", "user_id", "event_type").alias("key"), "ts")
    return jobs.run_available(jobs.first_seen(rows, "key", "3650 days"), "first").select("user_id", "event_type")


@query("R7_new_events_since", "SELECT event_id, event_type FROM events WHERE ts > TIMESTAMP '2024-01-20 00:00:00'")
def _(t):
    rows = stream(t, "events").withColumnRenamed("ts", "created_at")
    return jobs.run_available(jobs.new_events_since(rows, dt.datetime(2024, 1, 20)), "poll").select("event_id", "event_type")
