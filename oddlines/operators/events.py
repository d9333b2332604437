"""Statistics over the event table: id, pod, type, message, status, latency (s), ts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from oddlines.functions.numbers import round_half_up
from oddlines.operators.ordering import with_running

# Requests that leave no event, and the limits of the displays.
SKIPPED_PATHS = ("/health", "/favicon.ico")
SLOW_MS = 200
HIGH_LATENCY_MS = 500


def event_status(events: DataFrame) -> DataFrame:
    """Total events, errors, and the time of the newest event."""
    return events.agg(
        F.count(F.lit(1)).alias("total_events"),
        F.count_if(F.col("status") == "error").alias("total_errors"),
        F.max_by("ts", "id").alias("last_event"),
    )


def recent_events(events: DataFrame, limit: int = 50) -> DataFrame:
    return events.orderBy(F.desc("id")).limit(limit)


def count_by(events: DataFrame, column: str) -> DataFrame:
    return events.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def avg_latency_ms(events: DataFrame) -> DataFrame:
    """Mean of the positive latencies in ms, 2 decimals, 0 when there are none."""
    mean = F.avg(F.when(F.col("latency") > 0, F.col("latency")))
    return events.agg(round_half_up(F.coalesce(mean, F.lit(0.0)) * 1000, 2).alias("avg_latency_ms"))


def request_events(requests: DataFrame) -> DataFrame:
    """Requests (``method``, ``path``, ``code``, ``latency``, ...) as events; probes of the service are left out."""
    return requests.filter(~F.col("path").isin(*SKIPPED_PATHS)).select(
        *[c for c in requests.columns if c not in ("method", "path", "code", "latency")],
        F.lit("http").alias("type"),
        F.concat_ws(" ", "method", "path").alias("message"),
        F.when(F.col("code") < 400, "ok").otherwise("error").alias("status"),
        "latency",
    )


def event_display(events: DataFrame) -> DataFrame:
    """The table as shown: time of day, latency text and a slow flag."""
    ms = F.col("latency") * 1000
    tenths = F.floor(ms * 10 + 0.5)
    text = F.concat(
        F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit("ms")
    )
    return events.select(
        "id",
        F.date_format("ts", "HH:mm:ss").alias("time"),
        "type",
        "status",
        F.when(ms > 0, text).otherwise("—").alias("latency_text"),
        (ms > SLOW_MS).alias("slow"),
        "message",
        "pod",
    )


def health_class(checks: DataFrame, failed: str = "failed", latency_ms: str = "latency_ms") -> DataFrame:
    """Add ``health``: failed connection, high latency or healthy."""
    return checks.withColumn(
        "health",
        F.when(F.col(failed), "failed connection")
        .when(F.col(latency_ms) > HIGH_LATENCY_MS, "latency")
        .otherwise("healthy"),
    )


def health_log_lines(classed: DataFrame, message: str = "message") -> DataFrame:
    """Log level of each class and the line it writes."""
    return classed.withColumn(
        "level",
        F.when(F.col("health") == "failed connection", "ERROR")
        .when(F.col("health") == "latency", "WARNING")
        .otherwise("INFO"),
    ).withColumn("line", F.concat(F.lit("CAOS: "), F.col(message)))


def latest_messages(events: DataFrame, n: int = 5, per: Sequence[str] = ()) -> DataFrame:
    """The newest messages, as ``[HH:MM:SS] msg``; of each ``per`` group if given."""
    shown = F.concat(F.lit("["), F.date_format("ts", "HH:mm:ss"), F.lit("] "), "message").alias("line")
    if not per:
        return events.orderBy(F.desc("ts"), F.desc("id")).limit(n).select("id", shown)
    rank = F.row_number().over(W.partitionBy(*per).orderBy(F.desc("ts"), F.desc("id")))
    return events.withColumn("_rank", rank).filter(F.col("_rank") <= n).select(*per, "id", shown)


def hit_counter(events: DataFrame) -> DataFrame:
    """Running number of hits of each day: ``id``, ``day``, ``hits``."""
    days = events.select("id", "ts", F.to_date("ts").alias("day"))
    counted = with_running(days, [F.col("ts"), F.col("id")], ["day"], sums={"hits": F.lit(1)})
    return counted.select("id", "day", "hits")
