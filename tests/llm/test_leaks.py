from __future__ import annotations

import random

from oddlines.llm import leaks
from oddlines.llm.queries import QUERIES
from oddlines.llm.words import hashed_words

BENCH = "item_id long, text string"


def plain(docs, bench):
    """Every document against every item, without passages or a latent space."""
    items = leaks.read_items(bench)
    out = {}
    for doc, text in zip(docs["doc_id"], docs["text"]):
        words = items.known(hashed_words([text], leaks.LETTERS)[0])
        for item, own in zip(items.ids, items.words):
            hit, cover = leaks.is_leak(own, words)
            if hit:
                out[doc, item] = max(cover, out.get((doc, item), 0))
    return out


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_common_subsequence():
    rng = random.Random(1)
    for _ in range(300):
        item, text = rng.choices(range(6), k=rng.randint(1, 9)), rng.choices(range(-1, 6), k=rng.randint(0, 30))
        width = rng.randint(1, 14)
        want = max((lcs(item, text[i : i + width]) for i in range(len(text))), default=0)
        assert leaks.common_length(item, text, width) == want


def test_documents_against_all_pairs(spark, sf_dir):
    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet").toPandas() for t in ("documents", "benchmark"))
    found = {(r.doc_id, r.item_id): r.cover for r in QUERIES["op9_decontamination"](spark, sf_dir).collect()}
    assert found == plain(docs, bench)
    exact = {d for d, t in zip(docs["doc_id"], docs["text"]) if any(b in (t or "") for b in bench["text"])}
    assert exact and exact <= {d for d, _ in found}


def test_paraphrases_and_clean_texts(spark):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(3000)]
    items = [[rng.choice(vocabulary) for _ in range(rng.randint(12, 50))] for _ in range(40)]
    rows, want = [], set()
    for i in range(300):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(0, 400))]
        if i % 3 == 0:
            item = rng.randrange(40)
            edited = [w if rng.random() > 0.12 else "other" for w in items[item]]
            at = rng.randint(0, len(words))
            words[at:at] = edited
            if lcs(items[item], edited) >= leaks.COVER * len(edited):
                want.add((i, item))
        rows.append((i, " ".join(words), 1))
    rows += [(900, None, 1), (901, "", 1), (None, " ".join(items[3]), 1), (902, "tiny", 1), (902, "so TINY it is", 1)]
    bench = [(k, " ".join(w)) for k, w in enumerate(items)] + [(50, "tiny it"), (51, None), (52, "?"), (53, " ".join(items[0]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id int")
    found = {(r.doc_id, r.item_id) for r in leaks.find_leaks(docs, spark.createDataFrame(bench, BENCH)).collect()}
    assert want <= found and (None, 3) in found and (902, 50) in found
    assert {(d, 53) for d, k in found if k == 0} == {(d, k) for d, k in found if k == 53}
    assert {d for d, _ in found} - {None, 902} <= {i for i in range(300) if i % 3 == 0}
    clean = leaks.without_leaks(docs, spark.createDataFrame(bench, BENCH))
    left = {(r.doc_id, r.text) for r in clean.collect()}
    assert clean.columns == ["doc_id", "text", "item_id"] and {(900, None), (901, ""), (902, "tiny")} <= left
    assert not {(902, "so TINY it is"), (None, " ".join(items[3]))} & left


def test_every_item_of_a_large_benchmark_is_found(spark):
    """3000 items of 4 to 600 words, each once and word for word in a document of its own."""
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(4000)]
    weights = [1 / (i + 20) for i in range(4000)]
    lengths = [600, 600, 200, *(rng.choice([4, 5, 6, 12, 25, 40]) for _ in range(2997))]
    words = lambda n: " ".join(rng.choices(vocabulary, weights, k=n))
    bench = [(k, words(n)) for k, n in enumerate(lengths)]
    docs = [(k, f"{words(rng.randint(0, 300))} {text} {words(rng.randint(0, 300))}") for k, text in bench]
    found = leaks.find_leaks(
        spark.createDataFrame(docs, "doc_id long, text string").repartition(8), spark.createDataFrame(bench, BENCH)
    )
    held = {r.doc_id for r in found.filter("doc_id = item_id AND cover = 1").collect()}
    assert held == set(range(3000))


def test_nothing_to_search(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a b")], BENCH)
    assert leaks.find_leaks(docs, bench.limit(0)).count() == 0
    assert leaks.find_leaks(docs.limit(0), bench).count() == 0
    assert [tuple(r) for r in leaks.find_leaks(docs, bench).collect()] == [(1, 1, 1.0)]
