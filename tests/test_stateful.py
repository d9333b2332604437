"""Templates in the state store, over stops, equal one batch run."""

from __future__ import annotations

import time

from pyspark.sql import functions as F

from oddlines.operators import templates
from oddlines.streaming import jobs, stateful


def part(spark, low, high):
    rows = []
    for s in range(low, high):
        value = f"user u{s % 5} did {['read', 'write', 'scan'][s % 3]} in {s % 7} ms" if s % 11 else f"{s} fault at {s % 4}"
        rows.append((s, f"app{s % 2}.log", value))
    return spark.createDataFrame(rows, "seq long, file_path string, value string")


def test_equals_one_run_over_stops(spark, tmp_path):
    incoming, out, progress = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/progress"
    for low, high in ((0, 70), (70, 71), (71, 200)):
        part(spark, low, high).write.mode("append").parquet(incoming)
        stateful.mine_with_store(jobs.stream_table(spark, incoming), out, progress, every=None).awaitTermination()
    got = {r["seq"]: (r["template"], r["closed"]) for r in spark.read.parquet(out).collect()}
    whole = templates.mine_templates(spark.read.parquet(incoming))
    assert got == {r["seq"]: (r["template"], False) for r in whole.collect()}


def test_a_silent_file_is_closed(spark, tmp_path):
    incoming, out, progress = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/progress"
    part(spark, 1, 10).filter("file_path = 'app1.log'").write.parquet(incoming)
    stateful.use_store(spark)
    rows = stateful.template_rows(jobs.stream_table(spark, incoming), idle=1)
    query = jobs.append_records(rows, out, progress, "1 second")
    try:  # batches without rows let due timers fire
        deadline = time.time() + 70
        while time.time() < deadline and not (tmp_path / "out").is_dir():
            time.sleep(1)
        while time.time() < deadline and spark.read.schema(stateful._ROWS).parquet(out).filter("closed").isEmpty():
            time.sleep(2)
    finally:
        query.stop()
    closed = spark.read.schema(stateful._ROWS).parquet(out).filter("closed AND file_path = 'app1.log'").collect()
    last = templates.mine_templates(part(spark, 1, 10).filter("file_path = 'app1.log'"), final=True)
    assert {(r.template, r.seq) for r in closed} == {(r.template, None) for r in last.select("template").collect()}
