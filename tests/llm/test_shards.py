from __future__ import annotations

import random
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from oddlines.llm.queries import QUERIES
from oddlines.llm.shards import assign_shards


def laws(rows, shards, heaviest):
    sizes, slots = defaultdict(int), defaultdict(list)
    for r in rows:
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    mean = sum(sizes.values()) / shards
    assert all(abs(s - mean) <= max(2 * heaviest, 0.02 * mean) for s in sizes.values()), dict(sizes)


def test_documents(spark, sf_dir):
    rows = QUERIES["op5_kd_shards"](spark, sf_dir).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    assert len(rows) == len(texts) and {r["shard"] for r in rows} <= set(range(8))
    of_text = defaultdict(set)
    for r in rows:
        raw = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(raw) + 1, zlib.crc32(raw))
        of_text[raw].add(r["shard"])
    assert all(len(s) == 1 for s in of_text.values())
    laws(rows, 8, max(map(len, of_text)))


def test_shares_copies_nulls_and_long_texts(spark):
    rng = random.Random(9)
    rows = [(i, "x" * rng.randint(0, 40), 1) for i in range(300)] + [(i, "same", 2) for i in range(300, 500)]
    rows += [(None, None, 3), (1, None, 3), (2, "", 3), (7, "y" * 5000, 4), (7, "y" * 5000, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard long")
    dims = {"n": F.length("text"), "id": F.col("doc_id")}
    for shards in (1, 3, 8):
        out = assign_shards(docs, dims, shards=shards).collect()
        assert len(out) == len(rows)
        laws(out, shards, 10_002)
    by_bytes = assign_shards(docs, dims, target_bytes=6000).collect()
    assert max(r["shard"] for r in by_bytes) + 1 <= -(-sum(r["size"] for r in by_bytes) // 6000)


def test_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert assign_shards(docs, {"id": F.col("doc_id")}, shards=8).count() == 0


def test_no_python_in_the_plan(spark, sf_dir):
    plan = QUERIES["op5_kd_shards"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
