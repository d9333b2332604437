"""Event statistics and fault experiments."""

from __future__ import annotations

from pyspark.sql import functions as F

from oddlines.operators import events as e, experiments as x
from oddlines.plans import tables as t
from oddlines.plans.registry import query


@query(
    "event_status",
    f"""WITH {t.EVENTS} SELECT count(*) AS total_events, count(*) FILTER (status = 'error') AS total_errors,
      arg_max(ts, id) AS last_event FROM ev""",
)
def event_status(spark, sf_dir):
    return e.event_status(t.event_frame(spark, sf_dir))


@query(
    "recent_events",
    f"""WITH {t.EVENTS} SELECT id, pod, type, message, status, round(latency, 6) AS latency, ts FROM ev
    ORDER BY id DESC LIMIT 50""",
)
def recent_events(spark, sf_dir):
    return e.recent_events(t.event_frame(spark, sf_dir)).withColumn("latency", F.round("latency", 6))


@query("events_by_type", f"WITH {t.EVENTS} SELECT type, count(*) AS n FROM ev GROUP BY type")
def events_by_type(spark, sf_dir):
    return e.count_by(t.event_frame(spark, sf_dir), "type")


@query("events_by_status", f"WITH {t.EVENTS} SELECT status, count(*) AS n FROM ev GROUP BY status")
def events_by_status(spark, sf_dir):
    return e.count_by(t.event_frame(spark, sf_dir), "status")


@query(
    "avg_latency_ms",
    f"""WITH {t.EVENTS} SELECT floor(coalesce(avg(latency) FILTER (latency > 0), 0) * 1000 * 100 + 0.5) / 100
      AS avg_latency_ms FROM ev""",
)
def avg_latency_ms(spark, sf_dir):
    return e.avg_latency_ms(t.event_frame(spark, sf_dir))


@query(
    "request_events",
    """SELECT event_id AS id, 'http' AS type, method || ' ' || path AS message,
      CASE WHEN code < 400 THEN 'ok' ELSE 'error' END AS status, round(latency, 6) AS latency
    FROM (SELECT event_id, CASE WHEN user_id % 2 = 0 THEN 'GET' ELSE 'POST' END AS method,
            CASE event_type WHEN 'view' THEN '/health' WHEN 'click' THEN '/favicon.ico' ELSE '/api/' || event_type END AS path,
            200 + (user_id % 4) * 100 AS code, value / 1000 AS latency FROM events)
    WHERE path NOT IN ('/health', '/favicon.ico')""",
)
def request_events(spark, sf_dir):
    kind = F.col("event_type")
    requests = t.table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.when(F.col("user_id") % 2 == 0, "GET").otherwise("POST").alias("method"),
        F.when(kind == "view", "/health").when(kind == "click", "/favicon.ico")
        .otherwise(F.concat(F.lit("/api/"), kind)).alias("path"),
        (200 + (F.col("user_id") % 4) * 100).alias("code"),
        (F.col("value") / 1000).alias("latency"),
    )
    return e.request_events(requests).withColumn("latency", F.round("latency", 6))


@query(
    "event_display",
    f"""WITH {t.EVENTS} SELECT id, strftime(ts, '%H:%M:%S') AS time, type, status,
      CASE WHEN latency * 1000 > 0
        THEN (floor(floor(latency * 1000 * 10 + 0.5) / 10)::BIGINT)::VARCHAR || '.'
             || (floor(latency * 1000 * 10 + 0.5)::BIGINT % 10)::VARCHAR || 'ms'
        ELSE '—' END AS latency_text,
      latency * 1000 > 200 AS slow, message, pod FROM ev""",
)
def event_display(spark, sf_dir):
    return e.event_display(t.event_frame(spark, sf_dir))


def _checks(spark, sf_dir):
    return t.table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), (F.col("event_type") == "error").alias("failed"),
        (F.col("value") * 10).alias("latency_ms"), F.col("props").alias("message"),
    )


_HEALTH = """SELECT event_id AS id, props AS message,
  CASE WHEN event_type = 'error' THEN 'failed connection' WHEN value * 10 > 500 THEN 'latency' ELSE 'healthy' END AS health
  FROM events"""


@query("health_class", f"SELECT id, health FROM ({_HEALTH})")
def health_class(spark, sf_dir):
    return e.health_class(_checks(spark, sf_dir)).select("id", "health")


@query(
    "health_log_lines",
    f"""SELECT id, CASE health WHEN 'failed connection' THEN 'ERROR' WHEN 'latency' THEN 'WARNING' ELSE 'INFO' END AS level,
      'CAOS: ' || message AS line FROM ({_HEALTH})""",
)
def health_log_lines(spark, sf_dir):
    return e.health_log_lines(e.health_class(_checks(spark, sf_dir))).select("id", "level", "line")


@query(
    "latest_messages",
    f"""WITH {t.EVENTS} SELECT id, '[' || strftime(ts, '%H:%M:%S') || '] ' || message AS line FROM ev
    ORDER BY ts DESC, id DESC LIMIT 5""",
)
def latest_messages(spark, sf_dir):
    return e.latest_messages(t.event_frame(spark, sf_dir))


@query(
    "latest_messages_per_type",
    f"""WITH {t.EVENTS} SELECT type, id, '[' || strftime(ts, '%H:%M:%S') || '] ' || message AS line FROM ev
    QUALIFY row_number() OVER (PARTITION BY type ORDER BY ts DESC, id DESC) <= 5""",
)
def latest_messages_per_type(spark, sf_dir):
    return e.latest_messages(t.event_frame(spark, sf_dir), per=["type"])


@query(
    "hit_counter",
    f"""WITH {t.EVENTS} SELECT id, ts::DATE AS day,
      row_number() OVER (PARTITION BY ts::DATE ORDER BY ts, id) AS hits FROM ev""",
)
def hit_counter(spark, sf_dir):
    return e.hit_counter(t.event_frame(spark, sf_dir))


@query("experiment_markers", f"WITH {t.MARKERS} SELECT id, ts, kind, file, resource FROM marks")
def experiment_markers(spark, sf_dir):
    return x.experiment_markers(t.marker_lines(spark, sf_dir))


def _windows(spark, sf_dir):
    return x.experiment_windows(experiment_markers(spark, sf_dir), duration=t.planned_seconds())


@query("experiment_windows", f"WITH {t.WINDOWS} SELECT id, resource, file, start_ts, end_ts FROM wins")
def experiment_windows(spark, sf_dir):
    return _windows(spark, sf_dir)


_DURATIONS = """SELECT event_id AS id, CASE user_id % 4 WHEN 0 THEN user_id::VARCHAR || 's' WHEN 1 THEN user_id::VARCHAR || 'm'
  WHEN 2 THEN user_id::VARCHAR || 'h' ELSE 'soon' END AS text, user_id FROM events"""


@query(
    "duration_seconds",
    f"""SELECT id, text, CASE user_id % 4 WHEN 0 THEN user_id WHEN 1 THEN user_id * 60 ELSE 60 END AS seconds
    FROM ({_DURATIONS})""",
)
def duration_seconds(spark, sf_dir):
    user, turn = F.col("user_id").cast("string"), F.col("user_id") % 4
    text = (
        F.when(turn == 0, F.concat(user, F.lit("s"))).when(turn == 1, F.concat(user, F.lit("m")))
        .when(turn == 2, F.concat(user, F.lit("h"))).otherwise("soon")
    )
    return t.table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), text.alias("text")).withColumn(
        "seconds", x.duration_seconds(F.col("text"))
    )


@query(
    "pod_restarts",
    r"""SELECT id, snapshot_ts, pod, status, ready, restarts,
      greatest(restarts - coalesce(lag(restarts) OVER (PARTITION BY pod ORDER BY snapshot_ts, id), restarts), 0) AS new_restarts
    FROM (SELECT event_id AS id, ts AS snapshot_ts, 'demo-app-' || user_id::VARCHAR AS pod,
            CASE WHEN event_type = 'error' THEN 'Failed' ELSE 'Running' END AS status, event_type <> 'error' AS ready,
            regexp_extract(props, '(\d+)', 1)::INTEGER AS restarts FROM events)""",
)
def pod_restarts(spark, sf_dir):
    failed = F.col("event_type") == "error"
    lines = t.table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.col("ts").alias("snapshot_ts"),
        F.concat(
            F.lit("demo-app-"), F.col("user_id").cast("string"), F.lit("   "),
            F.when(failed, "Failed   false   ").otherwise("Running   true   "), F.regexp_extract("props", r"(\d+)", 1),
        ).alias("value"),
    )
    return x.pod_restarts(x.parse_pod_lines(lines))


@query(
    "label_fault_windows",
    f"""WITH {t.WINDOWS},
    active AS (SELECT e.event_id AS seq, count(w.id) AS active_faults FROM events e
               LEFT JOIN wins w ON e.ts >= w.start_ts AND e.ts < w.end_ts GROUP BY e.event_id),
    open_last AS (SELECT e.event_id AS seq, w.resource FROM events e JOIN wins w ON e.ts >= w.start_ts AND e.ts < w.end_ts
                  QUALIFY row_number() OVER (PARTITION BY e.event_id ORDER BY w.start_ts DESC, w.id DESC) = 1)
    SELECT seq, e.ts, active_faults, active_faults > 0 AS y_true, resource AS fault
    FROM active JOIN events e ON e.event_id = seq LEFT JOIN open_last USING (seq)""",
)
def label_fault_windows(spark, sf_dir):
    rows = t.table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), "ts")
    return x.label_fault_windows(rows, _windows(spark, sf_dir))
