"""Jobs that stop and go on: growing files, repeated batches, kept state, model versions."""

from __future__ import annotations

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, functions as F

from oddlines.plans import detect, tables as t
from oddlines.plans.registry import query
from oddlines.sources.growing import follow_lines
from oddlines.sources.store import EventStore
from oddlines.storage import new_path
from oddlines.streaming import jobs, stateful

PARTS = 3
LINES_A_FILE = 5000


def _parts(events: DataFrame) -> list[DataFrame]:
    """The events cut at places of their id range, in order."""
    low, high = events.agg(F.min("event_id"), F.max("event_id")).first()
    part = F.floor((F.col("event_id") - F.lit(low)) * PARTS / (F.lit(high) - F.lit(low) + 1))
    return [events.filter(part == i) for i in range(PARTS)] if low is not None else []


def _events(spark, sf_dir) -> DataFrame:
    return t.table(spark, sf_dir, "events")


def _write_logs(lines: DataFrame, folder: str, share: float) -> None:
    """Write the first ``share`` of the bytes of each ``file``, whose lines are ordered by ``event_id``."""

    def write(rows: pd.DataFrame) -> pd.DataFrame:
        content = "".join(line + "\n" for line in rows.sort_values("event_id")["message"]).encode()
        system, root = fs.FileSystem.from_uri(folder)
        with system.open_output_stream(f"{root}/{rows['file'].iloc[0]}") as out:
            out.write(content[: int(share * len(content))])
        return pd.DataFrame({"bytes": [len(content)]})

    system, root = fs.FileSystem.from_uri(folder)
    system.create_dir(root)
    lines.groupBy("file").applyInPandas(write, "bytes long").write.format("noop").mode("overwrite").save()


@query(
    "stream_growing_files",
    "SELECT event_type || ' ' || props AS value, count(*) AS n FROM events GROUP BY ALL",
)
def stream_growing_files(spark, sf_dir):
    """Log files that are read when 0, 35 and 100 % of their bytes are there, mostly up to the middle of a line."""
    folder = new_path(spark, "growing")
    file = F.concat_ws("-", "event_type", F.floor(F.col("event_id") / LINES_A_FILE))
    lines = _events(spark, sf_dir).select(file.alias("file"), "event_id", F.concat_ws(" ", "event_type", "props").alias("message"))
    out, progress = new_path(spark, "grown"), new_path(spark, "grown-progress")
    for share in (0.0, 0.35, 1.0):
        _write_logs(lines, folder, share)
        jobs.append_records(follow_lines(spark, folder, 1 << 16), out, progress, None).awaitTermination()
    return spark.read.parquet(out).groupBy("value").agg(F.count(F.lit(1)).alias("n"))


_NUMBERED = """SELECT row_number() OVER (ORDER BY event_id) AS id, 'pod-' || user_id::VARCHAR AS pod, event_type AS type,
    props AS message, 'ok' AS status, floor(value / 1000 * 10000 + 0.5) / 10000 AS latency, ts FROM events"""


def _event_rows(events: DataFrame) -> DataFrame:
    return events.select(
        "event_id", F.concat(F.lit("pod-"), F.col("user_id").cast("string")).alias("pod"),
        F.col("event_type").alias("type"), F.col("props").alias("message"), F.lit(None).cast("string").alias("status"),
        (F.col("value") / 1000).alias("latency"), "ts",
    )


@query("append_batches", _NUMBERED)
def append_batches(spark, sf_dir):
    """Batches of events, each appended twice under its key."""
    store = EventStore(spark, new_path(spark, "store"))
    for i, part in enumerate(_parts(_events(spark, sf_dir))):
        store.append(_event_rows(part), ["event_id"], f"batch-{i}")
        EventStore(spark, store.path).append(_event_rows(part), ["event_id"], f"batch-{i}")
    return store.read()


@query("stream_append_numbered", _NUMBERED)
def stream_append_numbered(spark, sf_dir):
    """A stream that is stopped and restarted between batches gives its events ids in a store."""
    store = EventStore(spark, new_path(spark, "store"))

    def begin(source, out, progress):
        rows = _event_rows(jobs.stream_table(spark, source))
        return jobs.append_numbered(rows, store, ["event_id"], progress, "events", None)

    jobs.run_parts(spark, _parts(_events(spark, sf_dir)), begin, "numbered")
    return store.read()


# Each type is a file whose lines have five tokens of which at most three vary, so they share one template:
# a token stands in it as long as all lines up to there have it.
TEMPLATES = """
WITH tokens AS (
    SELECT event_type AS file_path, event_id AS seq,
        string_split(event_type || ' user ' || user_id::VARCHAR || ' ' || props, ' ') AS w FROM events
),
places AS (SELECT file_path, seq, unnest(w) AS token, generate_subscripts(w, 1) AS i FROM tokens),
forms AS (
    SELECT file_path, seq, i, CASE WHEN min(token) OVER upto = max(token) OVER upto THEN token ELSE '<*>' END AS token
    FROM places WINDOW upto AS (PARTITION BY file_path, i ORDER BY seq ROWS UNBOUNDED PRECEDING)
)
SELECT file_path, seq, string_agg(token, ' ' ORDER BY i) AS template FROM forms GROUP BY file_path, seq
"""


def _lines(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("event_type").alias("file_path"), F.col("event_id").alias("seq"),
        F.concat_ws(" ", "event_type", F.lit("user"), "user_id", "props").alias("value"),
    )


@query("stream_templates_restarted", TEMPLATES)
def stream_templates_restarted(spark, sf_dir):
    """Templates kept in tables over the stops of a stream."""

    def begin(source, out, progress):
        return jobs.mine_stream(_lines(jobs.stream_table(spark, source)), out, progress, every=None)

    out = jobs.run_parts(spark, _parts(_events(spark, sf_dir)), begin, "restarted")
    return spark.read.parquet(f"{out}/rows").select("file_path", "seq", "template")


@query("stream_template_state", TEMPLATES)
def stream_template_state(spark, sf_dir):
    """Templates kept in the engine's state store over the stops of a stream."""

    def begin(source, out, progress):
        return stateful.mine_with_store(_lines(jobs.stream_table(spark, source)), out, progress, every=None)

    out = jobs.run_parts(spark, _parts(_events(spark, sf_dir)), begin, "state")
    return spark.read.parquet(out).select("file_path", "seq", "template")


@query(
    "stream_counts_restarted",
    f"WITH {t.EVENTS} SELECT type, status, count(*) AS n FROM ev GROUP BY ALL",
)
def stream_counts_restarted(spark, sf_dir):
    """Running counts over the stops of a stream."""
    status = (
        F.when(F.col("event_type") == "error", "error").when(F.col("value") > 100, "warn").otherwise("ok").alias("status")
    )

    def begin(source, out, progress):
        rows = jobs.stream_table(spark, source).select(F.col("event_type").alias("type"), status)
        return jobs.live_counts(rows, ["type", "status"], out, progress, None)

    return jobs.newest_version(spark, jobs.run_parts(spark, _parts(_events(spark, sf_dir)), begin, "counted"))


@query("stream_latest_restarted", "SELECT event_id AS seq, event_type, value FROM events ORDER BY event_id DESC LIMIT 500")
def stream_latest_restarted(spark, sf_dir):
    """The latest rows over the stops of a stream."""

    def begin(source, out, progress):
        rows = jobs.stream_table(spark, source).select(F.col("event_id").alias("seq"), "event_type", "value")
        return jobs.keep_latest(rows, out, progress, every=None)

    return jobs.newest_version(spark, jobs.run_parts(spark, _parts(_events(spark, sf_dir)), begin, "latest"))


@query(
    "model_versions",
    """SELECT v AS version, event_type AS model, count(*) AS terms, count(DISTINCT user_id) AS nodes, max(value) AS threshold
    FROM events, range(2) r(v) WHERE v = 1 OR value > 50 GROUP BY ALL""",
)
def model_versions(spark, sf_dir):
    """Two models saved in one place, and what each version holds when it is loaded."""
    path, events = new_path(spark, "models"), _events(spark, sf_dir).withColumn("model", F.col("event_type"))
    for rows in (events.filter("value > 50"), events):
        vocabulary = rows.select("model", F.col("event_id").alias("term"))
        nodes = rows.select("model", F.col("user_id").alias("node")).distinct()
        detect.Model(vocabulary, nodes, rows.groupBy("model").agg(F.max("value").alias("threshold"))).save(path)
    found = []
    for version in range(2):
        model = detect.Model.load(spark, path, version)
        counts = [x.groupBy("model").agg(F.count(F.lit(1)).alias(n)) for x, n in ((model.vocabulary, "terms"), (model.nodes, "nodes"))]
        whole = counts[0].join(counts[1], "model").join(model.thresholds, "model")
        found.append(whole.withColumn("version", F.lit(version).cast("long")))
    return found[0].unionByName(found[1])
