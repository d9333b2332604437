"""Stores that are written by several writers, and again."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from oddlines.plans.detect import MODEL_TABLES, Model
from oddlines.sources.store import EventStore
from oddlines.storage import CommitLog


def rows(spark, low, high):
    numbered = spark.range(low, high).withColumnRenamed("id", "k")
    return numbered.select(
        "k", F.lit("pod").alias("pod"), F.lit("db").alias("type"), F.col("k").cast("string").alias("message"),
        F.lit(None).cast("string").alias("status"), F.lit(0.5).alias("latency"), F.lit(None).cast("timestamp_ntz").alias("ts"),
    )


def test_a_batch_is_added_once(spark, tmp_path):
    store = EventStore(spark, f"file://{tmp_path}/store")
    assert store.read() is None
    assert sorted(r.id for r in store.append(rows(spark, 0, 5), ["k"], "a").collect()) == [1, 2, 3, 4, 5]
    again = EventStore(spark, store.path).append(rows(spark, 0, 5), ["k"], "a").collect()
    assert sorted((r.id, r.message) for r in again) == [(i + 1, str(i)) for i in range(5)]
    store.append(rows(spark, 0, 0), ["k"], "none")
    store.append(rows(spark, 5, 7), ["k"], "b")
    assert sorted((r.id, r.message) for r in store.read().collect()) == [(i + 1, str(i)) for i in range(7)]
    with pytest.raises(ValueError):
        store.append(rows(spark, 0, 4), ["k"], "a")


def test_writers_share_no_ids(spark, tmp_path):
    path = f"file://{tmp_path}/store"

    def write(i):
        EventStore(spark, path).append(rows(spark, 10 * i, 10 * i + 4), ["k"], f"w{i % 6}" if i >= 6 else f"w{i}")

    with ThreadPoolExecutor(6) as pool:
        list(pool.map(write, range(6)))
    found = EventStore(spark, path).read().collect()
    assert sorted(r.id for r in found) == list(range(1, 25)) and len({r.message for r in found}) == 24


def test_a_writer_that_dies_leaves_nothing_half(spark, tmp_path):
    store = EventStore(spark, f"file://{tmp_path}/store")
    store._taken("dead", 3)  # it dies before its rows are written
    store.append(rows(spark, 0, 2), ["k"], "next")
    assert sorted(r.id for r in store.read().collect()) == [4, 5]
    store.append(rows(spark, 7, 10), ["k"], "dead")
    assert sorted((r.id, r.message) for r in store.read().collect()) == [(1, "7"), (2, "8"), (3, "9"), (4, "0"), (5, "1")]


def test_numbers_are_given_once(spark, tmp_path):
    folder = f"file://{tmp_path}/log"
    one, two = CommitLog(spark, folder), CommitLog(spark, folder)
    assert one.entries() == [] and one.add({"w": 1}) and not two.add({"w": 2})
    assert two.entries() == [{"w": 1}] and two.add({"w": 2}) and one.entries() == [{"w": 1}, {"w": 2}]

    def add(i):
        log = CommitLog(spark, folder)
        log.entries()
        while not log.add({"w": i}):
            log.entries()

    with ThreadPoolExecutor(8) as pool:
        list(pool.map(add, range(3, 19)))
    assert sorted(e["w"] for e in one.entries()) == list(range(1, 19))


def test_loading_during_a_save_gives_a_whole_model(spark, tmp_path):
    path = f"file://{tmp_path}/model"
    with pytest.raises(ValueError):
        Model.load(spark, path)

    def model(n):
        return Model(*[spark.range(n).withColumn("table", F.lit(name)) for name in MODEL_TABLES])

    def sizes(found):
        return [getattr(found, name).count() for name in MODEL_TABLES]

    model(3).save(path)
    held = Model.load(spark, path)
    # a save that stops midway
    model(9).vocabulary.write.parquet(f"{path}/version-unfinished/vocabulary")
    assert sizes(Model.load(spark, path)) == [3, 3, 3]
    model(5).save(path)
    assert sizes(Model.load(spark, path)) == [5, 5, 5] and sizes(held) == [3, 3, 3]
    assert sizes(Model.load(spark, path, 0)) == [3, 3, 3]
