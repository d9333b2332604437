from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from oddlines.operators import events, experiments
from oddlines.sources import lines, results


@pytest.fixture
def folders(tmp_path):
    for name, files in {"web": {"a.log": "one\n  two \n\nthree", "b.log": "four\r\nfive\n"}, "db": {"c.log": "six\n"}}.items():
        (tmp_path / name / "nested").mkdir(parents=True)
        (tmp_path / name / "nested" / "deep.log").write_text("never\n")
        for file, text in files.items():
            (tmp_path / name / file).write_text(text, newline="")
    return tmp_path


def test_read_is_not_recursive(spark, folders):
    names = [f"{folders}/web", f"{folders}/db", f"{folders}/absent"]
    read = lines.strip_blank_lines(lines.read_log_lines(spark, names))
    got = {(r["source_folder"], r["value"]) for r in read.collect()}
    assert got == {(names[0], v) for v in ("one", "two", "three", "four", "five")} | {(names[1], "six")}


def test_absent_folders_give_nothing(spark, folders):
    read = lines.read_log_lines(spark, [f"{folders}/absent"])
    assert read.isEmpty() and "value" in read.columns


def test_lines_keep_file_order(spark, tmp_path):
    (tmp_path / "big").mkdir()
    for f in range(3):
        (tmp_path / "big" / f"{f}.log").write_text("".join(f"{f} {i}\n" for i in range(20_000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")  # many splits a file
    try:
        read = lines.with_file_sequence(lines.read_log_lines(spark, [f"{tmp_path}/big"]))
        wrong = read.filter(F.col("value") != F.concat_ws(" ", F.regexp_extract("file_path", r"(\d)\.log", 1), "seq"))
        assert read.count() == 60_000 and wrong.isEmpty()
        assert lines.read_log_lines(spark, [f"{tmp_path}/big"]).select("block_start").distinct().count() > 5
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_union_needs_a_source():
    with pytest.raises(ValueError):
        lines.union_sources({})


def test_no_selection_gives_no_rows(spark):
    df = spark.createDataFrame([("a",)], "source_folder string")
    assert lines.select_sources(df, []).isEmpty() and lines.select_sources(df, ["a"]).count() == 1


def test_csv_keeps_awkward_text(spark, tmp_path):
    rows = [(1, 'say "hi", ok', ["a", "b,c"], True), (2, "back\\slash", [], False), (3, "ü;\t", None, True)]
    df = spark.createDataFrame(rows, "seq long, template string, parameters array<string>, is_anomaly boolean")
    path = results.write_results_csv(df, f"file://{tmp_path}/out", datetime.date(2024, 1, 2))
    assert path.endswith("run_date=2024-01-02")
    back = results.read_results_csv(spark, path, "seq long, template string, parameters string, is_anomaly boolean")
    got = [tuple(r) for r in back.orderBy("seq").collect()]
    assert [(r[0], r[1], r[3]) for r in got] == [(1, 'say "hi", ok', True), (2, "back\\slash", False), (3, "ü;\t", True)]
    assert got[0][2] == '["a","b,c"]'


def test_append_continues_ids(spark, tmp_path):
    schema = "pod string, type string, message string, status string, latency double, ts timestamp_ntz, k long"
    t = datetime.datetime(2024, 1, 1)
    first = spark.createDataFrame([("p", "db", "m", None, None, t, 2), ("p", "db", "n", "warn", 0.12345, None, 1)], schema)
    path = f"file://{tmp_path}/events"
    added = results.append_events(first, path, ["k"]).orderBy("id").collect()
    assert [(r["id"], r["message"], r["status"], r["latency"]) for r in added] == [
        (1, "n", "warn", 0.1235), (2, "m", "ok", 0.0),
    ]
    assert added[0]["ts"] is not None
    again = results.append_events(first.limit(1), path, ["k"]).collect()
    assert [r["id"] for r in again] == [3] and spark.read.parquet(path).count() == 3


def test_mean_latency(spark):
    df = spark.createDataFrame([(0.0,), (0.1,), (0.3,)], "latency double")
    assert events.avg_latency_ms(df).first()[0] == 200.0
    assert events.avg_latency_ms(df.filter("latency > 9")).first()[0] == 0.0


def test_health(spark):
    df = spark.createDataFrame([(True, 900.0, "a"), (False, 500.01, "b"), (False, 500.0, "c")], "failed boolean, latency_ms double, message string")
    rows = events.health_log_lines(events.health_class(df)).orderBy("message").collect()
    assert [(r["health"], r["level"], r["line"]) for r in rows] == [
        ("failed connection", "ERROR", "CAOS: a"), ("latency", "WARNING", "CAOS: b"), ("healthy", "INFO", "CAOS: c"),
    ]


def test_experiments(spark):
    text = [
        "[2024-01-01 00:00:07] EXPERIMENT_START file=01-pod-kill.yaml resource=podchaos/pod-kill-demo",
        "[2024-01-01 00:00:37] EXPERIMENT_END file=01-pod-kill.yaml resource=podchaos/pod-kill-demo",
        "[2024-01-01 00:02:00] EXPERIMENT_START file=01-pod-kill.yaml resource=podchaos/pod-kill-demo",
        "noise",
    ]
    df = spark.createDataFrame(list(enumerate(text)), "id long, value string")
    windows = experiments.experiment_windows(experiments.experiment_markers(df), duration=F.lit(30))
    got = [(r["start_ts"].second, (r["end_ts"] - r["start_ts"]).seconds) for r in windows.orderBy("start_ts").collect()]
    assert got == [(7, 30), (0, 30)]
    at = [datetime.datetime(2024, 1, 1, 0, 0, s) for s in (6, 7, 36, 37)]
    rows = spark.createDataFrame(list(enumerate(at)), "seq long, ts timestamp_ntz")
    tagged = experiments.label_fault_windows(rows, windows).orderBy("seq").collect()
    assert [(r["y_true"], r["fault"]) for r in tagged] == [
        (False, None), (True, "podchaos/pod-kill-demo"), (True, "podchaos/pod-kill-demo"), (False, None),
    ]


def test_pod_lines(spark):
    rows = [(1, "demo-app-1   Running   true   2"), (2, "demo-app-1 Running false 5"), (3, "bad line")]
    df = spark.createDataFrame([(i, datetime.datetime(2024, 1, 1, 0, i), v) for i, v in rows], "id long, snapshot_ts timestamp_ntz, value string")
    got = experiments.pod_restarts(experiments.parse_pod_lines(df)).orderBy("id").collect()
    assert [(r["pod"], r["ready"], r["restarts"], r["new_restarts"]) for r in got] == [
        ("demo-app-1", True, 2, 0), ("demo-app-1", False, 5, 3),
    ]


def test_numbers_over_many_splits_with_blank_lines(spark, tmp_path):
    text = [f"line {i}" if i % 2 else "" for i in range(2000)]
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.log").write_text("\n".join(text) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        read = lines.read_log_lines(spark, [str(tmp_path / "a")])
        first = lines.strip_blank_lines(lines.with_file_sequence(read)).select("seq", "value").collect()
        last = lines.with_file_sequence(lines.strip_blank_lines(read)).select("seq", "value").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted((r.seq, r.value) for r in first) == [(i, f"line {i}") for i in range(1, 2000, 2)]
    assert [r.value for r in sorted(last)] == [f"line {i}" for i in range(1, 2000, 2)] and len({r.seq for r in last}) == 1000
