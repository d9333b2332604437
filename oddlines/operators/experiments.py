"""Fault experiments: markers, windows, labels, restarts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from oddlines.operators.ordering import with_running
from oddlines.storage import materialize

# The marker line, the duration texts understood, and the fallback.
MARKER = r"^\[(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2})\] EXPERIMENT_(START|END) file=(\S+) resource=(\S+)$"
SECONDS, MINUTES = r"^(\d+)s$", r"^(\d+)m$"
DEFAULT_SECONDS = 60


def duration_seconds(text: Column) -> Column:
    """``30s`` or ``2m`` in seconds; 60 for any other text."""
    return (
        F.when(text.rlike(SECONDS), F.regexp_extract(text, SECONDS, 1).try_cast("long"))
        .when(text.rlike(MINUTES), F.regexp_extract(text, MINUTES, 1).try_cast("long") * 60)
        .otherwise(F.lit(DEFAULT_SECONDS).cast("long"))
    )


def experiment_markers(lines: DataFrame, column: str = "value") -> DataFrame:
    """Start and end markers: ``ts``, ``kind``, ``file``, ``resource``; other lines are dropped."""
    line = F.col(column)
    return lines.filter(line.rlike(MARKER)).select(
        *[c for c in lines.columns if c != column],
        F.to_timestamp_ntz(F.regexp_extract(line, MARKER, 1), F.lit("yyyy-MM-dd HH:mm:ss")).alias("ts"),
        F.lower(F.regexp_extract(line, MARKER, 2)).alias("kind"),
        F.regexp_extract(line, MARKER, 3).alias("file"),
        F.regexp_extract(line, MARKER, 4).alias("resource"),
    )


def experiment_windows(markers: DataFrame, key: str = "id", duration: Column | None = None) -> DataFrame:
    """Each start with the next end of its resource; an open one ends after ``duration`` seconds.

    Markers of the same instant count in key order.
    """
    seconds = F.lit(DEFAULT_SECONDS) if duration is None else duration
    ends = F.when(F.col("kind") == "end", F.col("ts"))
    paired = with_running(
        markers, [F.desc("ts"), F.desc(key)], ["resource"], lasts={"_next_end": ends}, include_current=False
    )
    planned = F.col("ts") + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))
    return paired.filter(F.col("kind") == "start").select(
        key,
        "resource",
        "file",
        F.col("ts").alias("start_ts"),
        F.coalesce("_next_end", planned).alias("end_ts"),
    )


def label_fault_windows(
    rows: DataFrame, windows: DataFrame, key: str = "seq", window_key: str = "id", bucket_seconds: int = 3600
) -> DataFrame:
    """Tag each row (key, ``ts``) with the experiments running at its time, ends excluded.

    Adds ``active_faults`` (windows open at that time), ``y_true`` (any open)
    and ``fault``, the resource of the open window that started last (of equal
    starts the one of the largest key). Edges and rows are swept once in time order for the
    count. The open windows come from the sweep too: the window that started last
    is right while it is open; rows it has left are matched with the
    windows that are still open in their time bucket.
    """
    windows = windows.filter("end_ts > start_ts")  # others are never open
    starts = windows.select(
        F.col("start_ts").alias("ts"), F.lit(1).alias("_kind"), F.col(window_key).alias("_key"), F.lit(1).alias("_delta"),
        F.struct("end_ts", "resource").alias("_open"),
    )
    open_type = starts.schema["_open"].dataType
    stops = windows.select(
        F.col("end_ts").alias("ts"), F.lit(0).alias("_kind"), F.col(window_key).alias("_key"),
        F.lit(-1).alias("_delta"), F.lit(None).cast(open_type).alias("_open"),
    )
    points = rows.select(
        "ts", F.lit(2).alias("_kind"), F.col(key).alias("_key"), F.lit(0).alias("_delta"),
        F.lit(None).cast(open_type).alias("_open"),
    )
    swept = with_running(
        starts.unionByName(stops).unionByName(points),
        [F.col("ts"), F.col("_kind"), F.col("_key")],
        sums={"active_faults": F.col("_delta")},
        lasts={"_last": F.col("_open")},
    ).filter(F.col("_kind") == 2)
    swept = materialize(swept.select("_key", "ts", "active_faults", "_last"), "swept")
    last_open = F.coalesce(F.col("ts") < F.col("_last.end_ts"), F.lit(False))
    bucket = lambda at: F.floor(F.unix_seconds(at.cast("timestamp")) / bucket_seconds)
    spread = windows.select(
        F.col(window_key).alias("_w"), "start_ts", "end_ts", "resource",
        F.explode(F.sequence(bucket(F.col("start_ts")), bucket(F.col("end_ts")))).alias("_bucket"),
    )
    missed = swept.filter((F.col("active_faults") > 0) & ~last_open).select("_key", "ts", bucket(F.col("ts")).alias("_bucket"))
    found = missed.join(spread, "_bucket").filter((F.col("start_ts") <= F.col("ts")) & (F.col("ts") < F.col("end_ts")))
    found = found.groupBy(F.col("_key").alias("_found")).agg(F.max_by("resource", F.struct("start_ts", "_w")).alias("_resource"))
    labelled = swept.join(found, F.col("_key") == F.col("_found"), "left")
    return labelled.select(
        F.col("_key").alias(key),
        "ts",
        "active_faults",
        (F.col("active_faults") > 0).alias("y_true"),
        F.when(last_open, F.col("_last.resource")).otherwise(F.col("_resource")).alias("fault"),
    )


def parse_pod_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """``NAME STATUS READY RESTARTS`` lines: ``pod``, ``status``, ``ready``, ``restarts``."""
    parts = F.split(F.trim(F.col(column)), r"\s+")
    return lines.withColumn("_parts", parts).filter(F.size("_parts") == 4).select(
        *[c for c in lines.columns if c != column],
        F.col("_parts")[0].alias("pod"),
        F.col("_parts")[1].alias("status"),
        (F.col("_parts")[2] == "true").alias("ready"),
        F.col("_parts")[3].try_cast("int").alias("restarts"),
    )


def pod_restarts(snapshots: DataFrame, key: str = "id") -> DataFrame:
    """Restarts of each pod since its snapshot before; 0 at the first."""
    seen = with_running(
        snapshots,
        [F.col("snapshot_ts"), F.col(key)],
        ["pod"],
        lasts={"_before": F.col("restarts")},
        include_current=False,
    )
    grown = F.greatest(F.col("restarts") - F.coalesce("_before", "restarts"), F.lit(0))
    return seen.withColumn("new_restarts", grown).drop("_before")
