from __future__ import annotations

import math
from collections import Counter

import pytest

from oddlines.operators import graph
from oddlines.operators.reports import top_templates


def result(spark, counts):
    rows = [(odd, text) for (odd, text), n in counts.items() for _ in range(n)]
    return spark.createDataFrame(rows, "is_anomaly boolean, template string")


def test_node_sizes(spark):
    df = result(spark, {(True, "rare"): 1, (False, "common"): 100, (False, "rare"): 1})
    nodes = graph.graph_nodes(df).orderBy("id").collect()
    assert [(n["id"], n["text"], n["is_anomaly"], n["size"]) for n in nodes] == [
        (0, "rare", True, 11.5), (1, "common", False, 25.0), (2, "rare", False, 11.5),
    ]
    assert nodes[0]["title"] == "🔴 ANOMALIA\n\nLog Completo:\nrare\n\nOcorrências: 1"
    assert nodes[1]["color"] == "#1BBB06"


def test_rank_is_by_frequency_then_text(spark):
    df = result(spark, {(False, "b"): 2, (False, "a"): 2, (False, "c"): 3, (False, "d"): 1})
    got = top_templates(df, n=3).orderBy("rank").collect()
    assert [r["text"] for r in got] == ["c", "a", "b"]


def plain_edges(texts, stops):
    docs = [Counter(w for w in text.lower().split() if len(w) > 1 and w not in stops) for text in texts]
    n, df = len(texts), Counter(w for d in docs for w in d)
    vectors = []
    for d in docs:
        x = {w: c * (math.log((1 + n) / (1 + df[w])) + 1) for w, c in d.items()}
        length = math.sqrt(sum(v * v for v in x.values()))
        vectors.append({w: v / length for w, v in x.items()})
    out = {}
    for i in range(n):
        for j in range(i + 1, n):
            sim = sum(v * vectors[j].get(w, 0) for w, v in vectors[i].items())
            if sim > 0.05:
                out[i, j] = sim
    return out


def test_edges_against_all_pairs(spark):
    texts = ["disk read error", "disk write error", "user login ok", "user logout ok ok", "the of and", "network down"]
    nodes = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {(r["i"], r["j"]): r for r in graph.similarity_edges(nodes).collect()}
    expected = plain_edges(texts, {"the", "of", "and", "down"})
    assert set(got) == set(expected)
    for pair, sim in expected.items():
        assert got[pair]["sim"] == pytest.approx(sim)
        assert got[pair]["weight"] == pytest.approx(8 * sim)
        assert got[pair]["title"] == f"Similaridade: {sim:.0%}"


def test_no_words_no_edges(spark):
    nodes = spark.createDataFrame([(0, "the of"), (1, "and a")], "id int, text string")
    assert graph.similarity_edges(nodes).isEmpty()
