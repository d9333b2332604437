"""Streaming jobs run over what a table holds, then stopped."""

from __future__ import annotations

from pyspark.sql import functions as F

from oddlines.operators import features
from oddlines.plans import detect, tables as t
from oddlines.plans.decision_queries import document_rows
from oddlines.plans.registry import query
from oddlines.plans.restart_queries import TEMPLATES
from oddlines.storage import new_path
from oddlines.streaming import jobs


def _events(spark, sf_dir):
    return jobs.stream_table(spark, f"{sf_dir}/events.parquet")


@query(
    "stream_ingest",
    r"SELECT event_type || ' ' || props AS value, count(*) AS n FROM events GROUP BY ALL",
)
def stream_ingest(spark, sf_dir):
    """Event messages written as log files, picked up file by file."""
    folder = new_path(spark, "incoming")
    t.event_frame(spark, sf_dir).select("message").write.text(folder)
    out = jobs.run_once(
        spark, lambda out, progress: jobs.append_records(jobs.stream_lines(spark, folder), out, progress, None), "ingest"
    )
    return spark.read.parquet(out).groupBy("value").agg(F.count(F.lit(1)).alias("n"))


@query("stream_append", "SELECT event_id, event_type, value FROM events")
def stream_append(spark, sf_dir):
    records = _events(spark, sf_dir).select("event_id", "event_type", "value")
    out = jobs.run_once(spark, lambda out, progress: jobs.append_records(records, out, progress, None), "append")
    return spark.read.parquet(out)


@query(
    "stream_event_counts",
    f"WITH {t.EVENTS} SELECT type, status, count(*) AS n FROM ev GROUP BY ALL",
)
def stream_event_counts(spark, sf_dir):
    status = (
        F.when(F.col("event_type") == "error", "error").when(F.col("value") > 100, "warn").otherwise("ok").alias("status")
    )
    events = _events(spark, sf_dir).select(F.col("event_type").alias("type"), status)
    out = jobs.run_once(
        spark, lambda out, progress: jobs.live_counts(events, ["type", "status"], out, progress, None), "counts"
    )
    return jobs.newest_version(spark, out)


@query("stream_latest", "SELECT event_id AS seq, event_type, value FROM events ORDER BY event_id DESC LIMIT 500")
def stream_latest(spark, sf_dir):
    rows = _events(spark, sf_dir).select(F.col("event_id").alias("seq"), "event_type", "value")
    out = jobs.run_once(spark, lambda out, progress: jobs.keep_latest(rows, out, progress, every=None), "latest")
    return jobs.newest_version(spark, out)


@query("stream_scores")
def stream_scores(spark, sf_dir):
    """A model fitted on the stored documents flags the same documents as they stream in."""
    model, _ = detect.fit_text_model(document_rows(spark, sf_dir))
    docs = jobs.stream_table(spark, f"{sf_dir}/documents.parquet").select(
        F.col("doc_id").alias("seq"), F.col("lang").alias("level"), "source", F.col("text").alias("event")
    )
    rows = features.prepare_text(docs).select(F.lit("all").alias("model"), "seq", "combined")
    out = jobs.run_once(spark, lambda out, progress: jobs.score_lines(rows, model, out, progress, None), "scores")
    return spark.read.parquet(out).select(
        "seq", "anomaly_label", "is_anomaly", F.round("anomaly_score", 9).alias("anomaly_score")
    )


@query("stream_templates", TEMPLATES)
def stream_templates(spark, sf_dir):
    lines = _events(spark, sf_dir).select(
        F.col("event_type").alias("file_path"), F.col("event_id").alias("seq"),
        F.concat_ws(" ", "event_type", F.lit("user"), "user_id", "props").alias("value"),
    )
    out = jobs.run_once(spark, lambda out, progress: jobs.mine_stream(lines, out, progress, every=None), "templates")
    return spark.read.parquet(f"{out}/rows").select("file_path", "seq", "template")
