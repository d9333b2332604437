from __future__ import annotations

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from oddlines.llm import setjoin
from oddlines.llm.queries import QUERIES


def shingles(text, size):
    words = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return frozenset()
    return frozenset([tuple(words)] if len(words) < size else (tuple(words[i : i + size]) for i in range(len(words) - size + 1)))


def plain(rows, size, percent):
    sets = [(doc, shingles(text, size)) for doc, text in rows]
    parent, links = list(range(len(sets))), [0] * len(sets)

    def find(i):
        return i if parent[i] == i else find(parent[i])

    for i, (_, a) in enumerate(sets):
        for j, (_, b) in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                links[i] += 1
                links[j] += 1
                parent[find(i)] = find(j)
    out = []
    for i, (doc, s) in enumerate(sets):
        ids = [d for k, (d, _) in enumerate(sets) if find(k) == find(i) and d is not None]
        out.append((doc, len(s), min(ids) if ids else None, links[i]))
    return sorted(out, key=repr)


def copies(rng, n):
    rows = [(10_000, None), (10_001, ""), (10_002, " \n"), (10_003, "one"), (10_004, "ONE"), (10_005, "one two"), (None, "one two"), (None, "zz")]
    for base in range(n):
        words = [f"w{rng.randrange(4000)}" for _ in range(rng.choice([3, 5, 12, 25, 60, 150]))]
        for copy in range(rng.choice([1, 2, 3, 8])):
            edited = list(words)
            for _ in range(rng.randrange(0, max(1, len(words) // 12) + 1)):
                edited[rng.randrange(len(edited))] = f"e{rng.randrange(4000)}"
            edited = edited[rng.randrange(2) :] if rng.random() < 0.5 else edited
            rows.append((len(rows), " ".join(edited)))
    rows.append((rows[-1][0], rows[-1][1]))
    return rows


@pytest.mark.parametrize("size, percent, group", [(3, 90, 2000), (5, 80, 2000), (2, 60, 4)])
def test_same_as_all_pairs(spark, size, percent, group):
    rows = copies(random.Random(size), 60)
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, sid int")
    found = sorted(map(tuple, setjoin.near_duplicates(docs, size, percent, group).collect()), key=repr)
    assert found == plain(rows, size, percent)


@pytest.mark.parametrize("cell, most", [(2, 40), (5, 10_000), (4096, 40)])
def test_hot_lists_stay_together(spark, cell, most):
    rows = copies(random.Random(cell), 40)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    found = setjoin._classes(docs, 5, 80, 50, cell, most).select("doc_id", "n_shingles", "component_id", "n_links")
    assert sorted(map(tuple, found.collect()), key=repr) == plain(rows, 5, 80)


def test_sketches_leave_no_link_out():
    rng = np.random.default_rng(7)
    for n in (1, 5, 40, 300, 5000):
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        for k in range(0, len(a) + 1, max(1, len(a) // 20)):
            b = np.unique(np.append(a[k:], rng.integers(0, 1 << 63, k // 2, dtype=np.uint64)))
            common = len(np.intersect1d(a, b))
            bits = [np.frombuffer(setjoin.sketch(s), np.uint64) for s in (a, b)]
            sizes = np.array([len(b)])
            if len(b) and 100 * common >= 80 * (len(a) + len(b) - common):
                assert setjoin.may_link(bits[1][None], sizes, bits[0], len(a), 80).all()


def test_derived_answers_equal_plain_ones():
    rng = np.random.default_rng(8)
    base = rng.integers(0, 500, 80)
    sets = [np.unique(np.append(rng.permutation(base)[rng.integers(0, 40) :], rng.integers(0, 500, 15))).astype(np.uint64) for _ in range(60)]
    for i, others in setjoin.linked(sets, 60):
        told = [j for j in range(60) if j != i and 100 * len(np.intersect1d(sets[i], sets[j])) >= 60 * len(np.union1d(sets[i], sets[j]))]
        assert others.tolist() == told


def test_rows_without_ids_and_shared_ids(spark):
    same, other = "a b c d e f g h", "one two three four five six"
    rows = [(None, same)] * 300 + [(None, other), (4, other), (4, same), (4, same), (9, "x y z"), (9, "x y z"), (9, "quite another text"), (None, "")]
    docs = spark.createDataFrame([(d, t, 1, "k") for d, t in rows], "doc_id long, text string, id int, digest string")
    kept = sorted(((r.doc_id, r.text) for r in setjoin.keep_one(docs).collect()), key=repr)
    assert kept == sorted([(4, same), (4, other), (9, "x y z"), (9, "quite another text"), (None, "")], key=repr)
    found = [tuple(r)[:3] for r in setjoin.near_duplicates(docs, 5, 80).collect()]
    assert sorted(found, key=repr) == sorted((r[:3] for r in plain(rows, 5, 80)), key=repr)


def test_documents_against_all_pairs(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    found = sorted((tuple(r)[:4] for r in QUERIES["op2_set_join"](spark, sf_dir).collect()), key=repr)
    assert found == plain(rows, 3, 90)


@pytest.mark.parametrize("percent", [60, 80, 90])
def test_similar_sets_always_meet(percent):
    rng = np.random.default_rng(percent)
    for n in [*range(1, 40), 100, 333]:
        for _ in range(12):
            a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
            drop = rng.integers(0, n + 1)
            b = np.unique(np.concatenate([rng.permutation(a)[drop:], rng.integers(0, 1 << 63, rng.integers(0, drop + 1), dtype=np.uint64)]))
            common = len(np.intersect1d(a, b))
            if len(b) and 100 * common >= percent * (len(a) + len(b) - common) and setjoin.set_id(a) != setjoin.set_id(b):
                assert len(np.intersect1d(setjoin.keys_of(a, percent), setjoin.keys_of(b, percent)))


def test_keep_one_and_no_rows(spark):
    docs = spark.createDataFrame([(3, "a b c d e f"), (1, "A b c d e f"), (2, None), (None, "q"), (5, "")], "doc_id long, text string")
    assert sorted((r.doc_id for r in setjoin.keep_one(docs).collect()), key=repr) == [1, 2, 5, None]
    assert setjoin.near_duplicates(docs.limit(0)).count() == 0


@pytest.mark.parametrize("percent", [60, 80, 90])
def test_similar_sets_meet_without_common_blocks(percent):
    rng = np.random.default_rng(percent)
    spared = 0
    for n in [5, 20, 60, 100, 333, 900, 2000]:
        for _ in range(12):
            a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
            differ = 2 * n * (100 - percent) // (100 + percent)
            drop = rng.integers(0, differ + 1)
            b = np.unique(np.append(rng.permutation(a)[drop:], rng.integers(0, 1 << 63, rng.integers(0, differ - drop + 1), dtype=np.uint64)))
            shared = len(np.intersect1d(a, b))
            if 100 * shared < percent * (len(a) + len(b) - shared) or setjoin.set_id(a) == setjoin.set_id(b):
                continue
            both = np.intersect1d(setjoin.keys_of(a, percent), setjoin.keys_of(b, percent))
            for part in (1, 10, 50, 99):
                often = np.sort(both[rng.random(len(both)) < part / 100])
                left = [setjoin.keys_of(s, percent, often) for s in (a, b)]
                assert len(np.intersect1d(*left))
                spared += len(setjoin.keys_of(a, percent)) - len(left[0])
    assert spared


def long_texts(rng, n, words=4000):
    """Unlike texts with one passage in common, two of them near copies."""
    passage = [f"p{i}" for i in range(300)]
    texts = [[f"w{rng.randrange(10**6)}" for _ in range(words)] + passage for _ in range(n)]
    texts[1] = texts[0][:-40] + ["other"] * 40
    return [(i, " ".join(t)) for i, t in enumerate(texts)]


def test_long_texts_with_a_passage_in_common_are_told_apart(spark):
    docs = spark.createDataFrame(long_texts(random.Random(5), 24), "doc_id long, text string")
    docs = docs.withColumn("digest", F.xxhash64("text"))
    sets = setjoin.index_rows(docs, 5, 80)
    ids = {r.doc_id: r.sid for r in sets.collect()}
    found = setjoin.lists(setjoin.list_entries(docs, 5, 80, 8), setjoin.CELL, setjoin.HELD)
    assert max(len(r.sids) for r in found.collect()) > 2
    pairs = {frozenset(r) for r in setjoin.candidate_pairs(found, sets, 80).collect()}
    assert pairs == {frozenset((ids[0], ids[1]))}


def test_long_texts_stay_out_of_common_lists(spark):
    docs = spark.createDataFrame(long_texts(random.Random(6), 24), "doc_id long, text string")
    docs = docs.withColumn("digest", F.xxhash64("text"))
    often = setjoin.common_keys(docs, 5, 80, 1, 5)
    assert len(often)
    found = setjoin.lists(setjoin.list_entries(docs, 5, 80, 8, often), setjoin.CELL, setjoin.HELD)
    assert max(len(r.sids) for r in found.collect()) < 5


def test_only_texts_of_groups_are_moved(spark):
    docs = spark.range(3000).select(F.xxhash64("id").alias("digest"), F.lit("x").alias("text"))
    some = docs.filter(F.pmod("digest", F.lit(100)) == 0)
    wanted = {r.digest for r in some.collect()}
    moved = [r.digest for r in setjoin.with_digest_among(docs, some.select("digest")).collect()]
    assert wanted <= set(moved) and len(moved) == len(set(moved)) < 2 * len(wanted)
