from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from oddlines.llm import repeats
from oddlines.llm.queries import QUERIES


def plain(rows, length=repeats.LENGTH):
    """Every string of every text, counted."""
    raw = [(t or "").encode() for _, t in rows]
    count = Counter(t[i : i + length] for t in raw for i in range(len(t) - length + 1))
    out = []
    for (doc, _), t in zip(rows, raw):
        gone = np.zeros(len(t) + 1, np.int64)
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                gone[i] += 1
                gone[i + length] -= 1
        gone = np.cumsum(gone[:-1]) > 0
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
        out.append((doc, len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def texts(rng):
    word = lambda: "".join(rng.choices("abcdeé", k=rng.randint(1, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared = [prose(60) for _ in range(3)]
    rows = [(None, None), (None, prose(80)), (1, ""), (1, "x" * 199), (2, "x" * 200), (3, "y" * 500), (4, "ab" * 300), (5, "ab" * 110)]
    for i in range(60):
        parts = [prose(rng.randint(5, 80)), rng.choice(shared)[rng.randint(0, 60) :], prose(20)]
        if i % 5 == 0:
            parts.append(parts[1])
        rows.append((10 + i, " ".join(parts)))
    rows += [(200 + i, rows[-1 - i][1]) for i in range(5)] + [rows[20], rows[20]]
    rows += [(300, "\0" * 250 + prose(10)), (301, prose(5) + "\0" * 230)]
    return rows


@pytest.mark.parametrize("hot, stretch, batch", [(5000, 1 << 20, 12_000), (3, 700, 20)])
def test_same_as_counting_every_string(spark, monkeypatch, hot, stretch, batch):
    monkeypatch.setattr(repeats, "HOT", hot)
    monkeypatch.setattr(repeats, "STRETCH", stretch)
    monkeypatch.setattr(repeats, "ROWS", batch)
    rows = texts(random.Random(3))
    docs = spark.createDataFrame([(d, t, 0) for d, t in rows], "doc_id long, text string, t int")
    assert sorted(map(tuple, repeats.remove_repeats(docs).collect()), key=repr) == plain(rows)


def test_one_text_with_many_pieces_on_one_anchor(spark, monkeypatch):
    """6000 pieces of one anchor in one text: no task gets them as one group."""
    rng = random.Random(6)
    gram = min((rng.randbytes(12).hex().encode() for _ in range(20_000)), key=lambda g: repeats.span_hashes(np.frombuffer(g, np.uint8), np.array([0]), np.array([24]))[0])
    block = lambda: rng.randbytes(90).hex().encode()
    twice = block() + gram + block()
    text = b"".join([twice, *(gram + block() for _ in range(6000)), twice]).decode()
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    cut, judged = [], repeats.repeats_of
    monkeypatch.setattr(repeats, "repeats_of", lambda df: cut.append(df) or judged(df))
    found = [tuple(r) for r in repeats.remove_repeats(docs).collect()]
    assert found == plain([(1, text)])
    assert len(cut) > 1  # the anchor's pieces went in parts
    assert all((df.groupBy("key").count().agg(F.max("count")).first()[0] or 0) <= repeats.HOT for df in cut)


def test_one_hot_passage_is_one_piece(spark, monkeypatch):
    rng = random.Random(9)
    passage = " ".join(rng.randbytes(4).hex() for _ in range(60))
    rows = [(i, f"{rng.randbytes(8).hex()} {passage} {rng.randbytes(200).hex()}") for i in range(300)]
    monkeypatch.setattr(repeats, "HOT", 100)
    found = repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, found.collect()), key=repr) == plain(rows)


def test_documents(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    found = sorted(map(tuple, QUERIES["op10_repeated_strings"](spark, sf_dir).collect()), key=repr)
    assert found == plain(rows)


def test_kept_bytes_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "a" * 50 + "b" * 300), (2, "c" * 10)], "doc_id long, text string")
    assert {r.doc_id: bytes(r.kept) for r in repeats.remove_repeats(docs, keep_bytes=True).collect()} == {1: b"a" * 50, 2: b"c" * 10}
    assert repeats.remove_repeats(docs.limit(0)).count() == 0
