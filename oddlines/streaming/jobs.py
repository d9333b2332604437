"""Structured Streaming jobs over log files and event tables.

Jobs that keep something between micro-batches write it as ``version=<batch id>``
below their output folder and read the version before, so a batch that is run
again after a failure gives the same outcome. The last two versions are kept.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from oddlines.operators import reports, templates
from oddlines.plans.detect import Model, detect_prepared, score_with_model
from oddlines.sources.store import EventStore
from oddlines.storage import new_path

REFRESH = "120 seconds"
DISPLAY_REFRESH = "5 seconds"
FLUSH = "1 second"
KEPT_ROWS = 500


def stream_lines(spark: SparkSession, folder: str, max_files: int | None = None) -> DataFrame:
    """New log files of a folder as lines.

    A file is read once; ``sources.growing.follow_lines`` follows files that grow.
    """
    reader = spark.readStream.schema("value string")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.text(folder).select("*", F.col("_metadata.file_path").alias("file_path"))


def stream_table(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """A parquet table, a folder of parts or one file, as a stream of its files."""
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    if fs.getFileStatus(hadoop_path).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", hadoop_path.getName()).parquet(hadoop_path.getParent().toString())


def start(writer: DataStreamWriter, every: str | None) -> StreamingQuery:
    """Start on a timer, or with ``every=None`` work off what is there and stop."""
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.start()


def append_records(stream: DataFrame, out: str, checkpoint: str, every: str | None = FLUSH) -> StreamingQuery:
    """Append records to a parquet table, each exactly once."""
    writer = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    return start(writer.outputMode("append"), every)


def append_numbered(
    stream: DataFrame, store: EventStore, order: list[str], checkpoint: str, label: str, every: str | None = FLUSH
) -> StreamingQuery:
    """Append events with ids to a store, each batch once even if it runs again; ``label`` names this stream there."""

    def add(batch: DataFrame, batch_id: int) -> None:
        if not batch.isEmpty():
            store.append(batch, order, f"{label}-{batch_id}")

    return _each_batch(stream, add, checkpoint, every)


def _each_batch(
    stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str, every: str | None, mode: str = "append"
) -> StreamingQuery:
    writer = stream.writeStream.outputMode(mode).foreachBatch(work).option("checkpointLocation", checkpoint)
    return start(writer, every)


def _version(out: str, batch_id: int) -> str:
    return f"{out}/version={batch_id}"


def drop_old_versions(spark: SparkSession, out: str, batch_id: int, kept: int = 2) -> None:
    """Delete all but the last ``kept`` versions up to ``batch_id``; a batch that is run again needs the one before it."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(out).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    old = batch_id - kept
    while old >= 0 and fs.exists(hadoop(_version(out, old))):
        fs.delete(hadoop(_version(out, old)), True)
        old -= 1


def newest_version(spark: SparkSession, out: str) -> DataFrame | None:
    """The latest complete version below ``out``."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    root = hadoop(out)
    fs = root.getFileSystem(conf)
    if not fs.exists(root):
        return None
    names = [s.getPath().getName() for s in fs.listStatus(root)]
    done = [
        int(n.removeprefix("version=")) for n in names
        if n.startswith("version=") and fs.exists(hadoop(f"{out}/{n}/_SUCCESS"))
    ]
    return spark.read.parquet(_version(out, max(done))) if done else None


def live_counts(
    stream: DataFrame, columns: list[str], out: str, checkpoint: str, every: str | None = DISPLAY_REFRESH
) -> StreamingQuery:
    """Running counts by ``columns`` (few distinct values, so the state stays small)."""
    counts = stream.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(_version(out, batch_id))
        drop_old_versions(batch.sparkSession, out, batch_id)

    return _each_batch(counts, keep, checkpoint, every, "complete")


def keep_latest(
    stream: DataFrame, out: str, checkpoint: str, n: int = KEPT_ROWS, key: str = "seq", every: str | None = DISPLAY_REFRESH
) -> StreamingQuery:
    """The ``n`` rows with the highest key seen so far."""

    def keep(batch: DataFrame, batch_id: int) -> None:
        rows = batch
        if batch_id > 0:
            rows = rows.unionByName(batch.sparkSession.read.parquet(_version(out, batch_id - 1)))
        reports.latest_rows(rows, n, key).write.mode("overwrite").parquet(_version(out, batch_id))
        drop_old_versions(batch.sparkSession, out, batch_id)

    return _each_batch(stream, keep, checkpoint, every)


def score_lines(
    stream: DataFrame, model: Model, out: str, checkpoint: str, every: str | None = REFRESH
) -> StreamingQuery:
    """Flag prepared rows with a fitted model; results go to one folder a batch."""

    def score(batch: DataFrame, batch_id: int) -> None:
        score_with_model(batch, model).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return _each_batch(stream, score, checkpoint, every)


def refit_lines(
    stream: DataFrame, store: str, out: str, checkpoint: str, contamination: float = 0.03, every: str | None = REFRESH
) -> StreamingQuery:
    """Add each batch to ``store``, then fit and flag the whole table anew."""

    def refit(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{store}/batch={batch_id}")
        result, _ = detect_prepared(spark.read.parquet(store).drop("batch"), contamination)
        result.write.mode("overwrite").parquet(_version(out, batch_id))
        drop_old_versions(spark, out, batch_id)

    return _each_batch(stream, refit, checkpoint, every)


def mine_stream(
    stream: DataFrame,
    out: str,
    checkpoint: str,
    rows_per_chunk: int = templates.ROWS_PER_CHUNK,
    every: str | None = REFRESH,
) -> StreamingQuery:
    """Mine templates of ``file_path``, ``seq``, ``value`` rows, keeping them across batches.

    Rows of a file arrive in ``seq`` order from batch to batch. Templates are a
    table, not operator state, so a batch is mined in the same bounded chunks
    as a stored file.
    """

    def mine(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        entry = spark.read.parquet(_version(f"{out}/templates", batch_id - 1)) if batch_id > 0 else None
        rows, states = templates.mine_with_state(batch, entry, rows_per_chunk)
        rows.write.mode("overwrite").parquet(f"{out}/rows/batch={batch_id}")
        states.write.mode("overwrite").parquet(_version(f"{out}/templates", batch_id))
        drop_old_versions(spark, f"{out}/templates", batch_id)

    return _each_batch(stream, mine, checkpoint, every)


def run_parts(spark: SparkSession, parts: list[DataFrame], begin: Callable[[str, str, str], StreamingQuery], label: str) -> str:
    """Run a job from its last stop once for each part, which is put into its input folder before; returns the output folder.

    ``begin`` is given the input, output and progress folders.
    """
    source, out, checkpoint = (new_path(spark, f"{label}{kind}") for kind in ("-parts", "", "-progress"))
    for part in parts:
        part.write.mode("append").parquet(source)
        begin(source, out, checkpoint).awaitTermination()
    return out


def run_once(spark: SparkSession, begin: Callable[[str, str], StreamingQuery], label: str) -> str:
    """Run a job over what is there, in folders of its own; returns the output folder."""
    out, checkpoint = new_path(spark, label), new_path(spark, f"{label}-progress")
    begin(out, checkpoint).awaitTermination()
    return out
