from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from oddlines.llm import vectors
from oddlines.llm.queries import QUERIES


def plain(ids, rows, queries, k=5):
    out = {}
    norms = np.sqrt((rows * rows).sum(axis=1))
    for q in queries:
        v = rows[ids == q][0]
        score = (rows * v).sum(axis=1) / norms / np.sqrt((v * v).sum())
        keep = ids != q
        order = np.lexsort((ids[keep], -np.round(score[keep], 12)))[:k]
        out[q] = list(zip(ids[keep][order].tolist(), score[keep][order].tolist()))
    return out


def test_recall_over_the_test_vectors(spark, sf_dir):
    pdf = spark.read.parquet(f"{sf_dir}/embeddings.parquet").toPandas()
    ids, rows = pdf["vec_id"].to_numpy(), np.stack(pdf["embedding"]).astype(np.float64)
    want = plain(ids, rows, [i for i in ids.tolist() if i % 50 == 0])
    found = QUERIES["op8_nearest_vectors"](spark, sf_dir).toPandas()
    hits = 0
    for query, group in found.groupby("query_id"):
        assert sorted(group["rank"]) == list(range(1, len(group) + 1)) and len(group) == 5
        for r in group.itertuples():
            truth = (rows[ids == r.vec_id][0] * rows[ids == query][0]).sum()
            truth /= np.sqrt((rows[ids == r.vec_id][0] ** 2).sum()) * np.sqrt((rows[ids == query][0] ** 2).sum())
            assert abs(truth - r.score) < 1e-12
        hits += len({v for v, _ in want[query]} & set(group["vec_id"]))
    assert len(want) == found["query_id"].nunique() and hits >= 0.9 * 5 * len(want)


@pytest.mark.parametrize("block", [4096, 7])
def test_ties_copies_and_rows_without_part(spark, monkeypatch, block):
    monkeypatch.setattr(vectors, "BLOCK", block)
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(0, 200)]
    rows += [(i, [1.0] * 8) for i in range(1000, 1060)] + [(2000, [2.0] * 8)]
    odd = [(3000, None), (3001, [0.0] * 8), (3050, [float("nan")] * 8), (3100, [float("inf")] + [1.0] * 7), (3150, [None] + [1.0] * 7), (3200, [1.0]), (None, [1.0] * 8), (3250, [])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows + odd], "vec_id long, embedding array<double>, id int")
    found = vectors.nearest(df, F.col("id") % 50 == 0, recall=1.0).orderBy("query_id", "rank").collect()
    want = plain(np.array([i for i, _ in rows]), np.array([v for _, v in rows]), [i for i, _ in rows if i % 50 == 0])
    assert [(r.query_id, r.vec_id) for r in found if r.query_id >= 1000] == [(q, v) for q in sorted(want) if q >= 1000 for v, _ in want[q]]
    hits = sum(r.vec_id in {v for v, _ in want[r.query_id]} for r in found)
    assert len(found) == 5 * len(want) and hits >= 0.9 * len(found)


def test_few_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (1, [1.0, 1.0])], "vec_id long, embedding array<float>")
    assert [(r.query_id, r["rank"], r.vec_id) for r in vectors.nearest(df, F.col("id") % 50 == 0).collect()] == [(0, 1, 1), (0, 2, 1)]
    assert vectors.nearest(df.limit(0), F.col("id") % 50 == 0).count() == 0
