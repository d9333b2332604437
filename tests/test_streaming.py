"""Streams over several micro-batches equal one batch run."""

from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

from oddlines.operators import templates
from oddlines.plans import detect
from oddlines.streaming import jobs


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    """Rows in four files, in order of writing."""
    folder = str(tmp_path_factory.mktemp("parts"))
    for batch in range(4):
        rows = [
            (s, "app.log", f"user u{s % 5} did {['read', 'write', 'scan'][s % 3]} in {s % 7} ms" if s % 11 else f"{batch} fault {s}")
            for s in range(batch * 60, batch * 60 + 60)
        ]
        df = spark.createDataFrame(rows, "seq long, file_path string, value string")
        df.coalesce(1).write.mode("append").parquet(folder)
        time.sleep(1.1)  # file order is by modification time
    return folder


def stream(spark, parts):
    return jobs.stream_table(spark, parts, max_files=1)


def batches(progress):
    return len({p["batchId"] for p in progress if p["numInputRows"]})


def test_append(spark, parts, tmp_path):
    q = jobs.append_records(stream(spark, parts), f"{tmp_path}/out", f"{tmp_path}/cp", None)
    q.awaitTermination()
    assert batches(q.recentProgress) == 4
    assert spark.read.parquet(f"{tmp_path}/out").exceptAll(spark.read.parquet(parts)).isEmpty()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 240
    # nothing new: nothing added
    jobs.append_records(stream(spark, parts), f"{tmp_path}/out", f"{tmp_path}/cp", None).awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 240


def test_counts(spark, parts, tmp_path):
    rows = stream(spark, parts).withColumn("type", F.split("value", " ")[2])
    jobs.live_counts(rows, ["type"], f"{tmp_path}/out", f"{tmp_path}/cp", None).awaitTermination()
    got = {tuple(r) for r in jobs.newest_version(spark, f"{tmp_path}/out").select("type", "n").collect()}
    batch = spark.read.parquet(parts).groupBy(F.split("value", " ")[2].alias("type")).count()
    assert got == {tuple(r) for r in batch.collect()}


def test_latest(spark, parts, tmp_path):
    assert jobs.newest_version(spark, f"{tmp_path}/out") is None
    jobs.keep_latest(stream(spark, parts), f"{tmp_path}/out", f"{tmp_path}/cp", n=70, every=None).awaitTermination()
    got = sorted(r["seq"] for r in jobs.newest_version(spark, f"{tmp_path}/out").collect())
    assert got == list(range(170, 240))


def test_templates(spark, parts, tmp_path):
    jobs.mine_stream(stream(spark, parts), f"{tmp_path}/out", f"{tmp_path}/cp", every=None).awaitTermination()
    got = {r["seq"]: r["template"] for r in spark.read.parquet(f"{tmp_path}/out/rows").collect()}
    whole = templates.mine_templates(spark.read.parquet(parts))
    assert got == {r["seq"]: r["template"] for r in whole.collect()}


def prepared(df):
    return df.select(F.lit("all").alias("model"), "seq", F.col("value").alias("combined"))


def test_scores(spark, parts, tmp_path):
    result, model = detect.detect_prepared(prepared(spark.read.parquet(parts)), trees=20)
    jobs.score_lines(prepared(stream(spark, parts)), model, f"{tmp_path}/out", f"{tmp_path}/cp", None).awaitTermination()
    columns = ["seq", "anomaly_label", "anomaly_score"]
    got = sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").select(columns).collect()))
    assert got == sorted(map(tuple, result.select(columns).collect()))


def test_refit(spark, parts, tmp_path):
    jobs.refit_lines(
        prepared(jobs.stream_table(spark, parts, max_files=2)), f"{tmp_path}/store", f"{tmp_path}/out", f"{tmp_path}/cp", every=None
    ).awaitTermination()
    result, _ = detect.detect_prepared(prepared(spark.read.parquet(parts)))
    columns = ["seq", "anomaly_label", "anomaly_score"]
    got = sorted(map(tuple, jobs.newest_version(spark, f"{tmp_path}/out").select(columns).collect()))
    assert got == sorted(map(tuple, result.select(columns).collect()))


def test_text_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / "in" / f"{i}.log").write_text(f"line {i}\n")
    q = jobs.append_records(jobs.stream_lines(spark, f"{tmp_path}/in", max_files=1), f"{tmp_path}/out", f"{tmp_path}/cp", None)
    q.awaitTermination()
    assert {r["value"] for r in spark.read.parquet(f"{tmp_path}/out").collect()} == {"line 0", "line 1", "line 2"}
