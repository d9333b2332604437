from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from oddlines.llm import quality
from oddlines.llm.common import kth_largest


def corpus(n=600, seed=1):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(n):
        text = rng.choices(words, k=60)
        bad = i % 5 == 0
        if bad:
            text[rng.randrange(60)] = "worthless"
            text[rng.randrange(60)] = rng.choice(["idiot", "scum"])
        rows.append((i, " ".join(text), int(bad)))
    return rows


@pytest.fixture(scope="module")
def drawn(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows + [(9000, None, 0), (9001, "", 0), (None, "w1 w2", 0)], "doc_id long, text string, log_weight long")
    labels = spark.createDataFrame([(i, 1, bad) for i, _, bad in rows if i % 2], "doc_id long, quality int, toxic int")
    return rows, quality.resample(docs, quality.good_ids(labels)).select("doc_id", "log_weight").collect()


def test_keeps_clean_texts_and_drops_marked_ones(drawn):
    rows, kept = drawn
    ids = {r.doc_id for r in kept}
    clean, bad = [i for i, _, b in rows if not b], [i for i, _, b in rows if b]
    assert sum(i in ids for i in clean) >= 0.99 * len(clean)
    assert sum(i in ids for i in bad) <= 0.05 * len(bad)
    assert {9000, 9001} <= ids


def test_weights_against_a_plain_count(spark):
    rows = corpus(200)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    target = spark.createDataFrame([(i,) for i, _, b in rows if not b and i % 3 == 0], "doc_id long")
    model = quality.fit(docs, target)
    raw, wanted = np.zeros(quality.BUCKETS), np.zeros(quality.BUCKETS)
    for i, text, b in rows:
        one, two, _ = quality.buckets([text])
        for at in (*one, *two):
            raw[at] += 1
            wanted[at] += not b and i % 3 == 0
    expected = raw * wanted.sum() / raw.sum()
    tested = expected >= quality.FREQUENT
    for at in np.flatnonzero(tested):
        ratio = np.log((wanted[at] + 1) / (expected[at] + 1))
        deviance = 2 * ((wanted[at] * np.log(wanted[at] / expected[at]) if wanted[at] else 0) - wanted[at] + expected[at])
        says = ratio < -quality.LEAST_LOG and deviance > 2 * np.log(tested.sum() / quality.FALSE)
        assert np.isclose(model[at], ratio if says else 0, atol=1e-6)
    assert not model[~tested].any() and model.any()


def test_no_clean_text_is_lost_to_rejected_ones(spark, monkeypatch):
    """A third of the rows has weight 0.3: all others stay, and 0.3 of these."""
    model = np.zeros(quality.BUCKETS, np.float32)
    one, two, _ = quality.buckets(["hot"])
    model[[*one[:1], *two[:1]]] = np.log(0.3)
    assert np.isclose(quality.log_weights(["hot", "cold"], model), [np.log(0.3), 0], atol=1e-5).all()
    monkeypatch.setattr(quality, "fit", lambda *_: model)
    docs = spark.createDataFrame([(i, "hot" if i % 3 == 0 else f"cold {i}") for i in range(6000)], "doc_id long, text string")
    for kept in (quality.resample(docs, docs), quality.draw(docs, docs)):
        ids = {r.doc_id for r in kept.collect()}
        assert {i for i in range(6000) if i % 3} <= ids
        assert sum(i % 3 == 0 for i in ids) == 600


def test_buckets_do_not_depend_on_the_batch():
    texts = ["a b a b", "", None, "x", "the the the cat", "é" * 10]
    one, two, owner = quality.buckets(texts)
    for i, text in enumerate(texts):
        alone = quality.buckets([text])
        assert sorted(alone[0]) == sorted(one[owner == i]) and sorted(alone[1]) == sorted(two[owner == i])


def test_without_labels_and_without_rows(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "a"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long")
    assert quality.fit(docs, none) is None
    assert quality.resample(docs, none).count() == 3
    assert quality.resample(docs.limit(0), none).count() == 0


@pytest.mark.parametrize("k", [1, 2, 500, 999, 1000, 5000])
def test_kth_largest(spark, monkeypatch, k):
    monkeypatch.setattr("oddlines.llm.common.FEW", 5)
    df = spark.range(1000).select((F.pow("id", F.lit(3)) % 977).alias("v"))
    want = sorted((i**3 % 977 for i in range(1000)), reverse=True)
    assert kth_largest(df, "v", k) == want[min(k, 1000) - 1]
