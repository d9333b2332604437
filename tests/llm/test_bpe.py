from __future__ import annotations

import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from oddlines.llm import bpe as module
from oddlines.llm.bpe import Bpe, encode_texts, token_digests

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def ids_of(bpe, text):
    joined = b"".join(next(bpe.encode([text])))
    return [int.from_bytes(joined[i : i + 4], "little") for i in range(0, len(joined), 4)]


def texts():
    rng = random.Random(7)
    made = ["", " ", "a<|endoftext|>b <|endoftext|>", "it's we'll 'S", "\x1c a\x85　 x", "中文 😀 12345", "a" * 3000, "aA1!" * 900]
    signs = "abcdefgh ABC123\n\t.,'’éß中🎉 "
    return made + ["".join(rng.choice(signs) for _ in range(rng.randint(1, 300))) for _ in range(400)]


def test_same_ids_as_the_library(library):
    bpe = Bpe(PATH)
    together = [b"".join(p) for p in bpe.encode(texts())]
    for text, mine in zip(texts(), together):
        want = library.encode(text, add_special_tokens=False).ids
        assert ids_of(bpe, text) == want
        assert mine == b"".join(i.to_bytes(4, "little") for i in want)
        assert bpe.decode(mine).decode() == library.decode(want, skip_special_tokens=False)


def test_exact_merging_of_blocks_and_of_single_words(library):
    bpe, rng = Bpe(PATH), random.Random(3)
    words = [bytes(rng.choice(b"theraning ") for _ in range(rng.randint(1, 60))) for _ in range(300)]
    assert bpe.merged_all(words) == [bpe.merged(w) for w in words]


def test_rows_nulls_and_clashing_columns(spark):
    rows = [(1, None, 5), (2, "", 6), (2, "", 6), (None, "the cat", 7)]
    out = token_digests(spark.createDataFrame(rows, "doc_id long, text string, ids int"), PATH).collect()
    empty = hashlib.sha256().hexdigest()
    assert sorted((r.doc_id or 0, r.n_tokens, r.ids_sha256 == empty) for r in out) == [(0, 2, False), (1, 0, True), (2, 0, True), (2, 0, True)]
    whole = encode_texts(spark.createDataFrame(rows, "doc_id long, text string, ids int"), PATH, keep_decoded=True)
    assert [f.name for f in whole.schema] == ["doc_id", "text", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"]
    assert {r.decoded for r in whole.collect()} == {"", "the cat"}
    assert token_digests(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_workers_keep_no_words(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts())], "doc_id long, text string").repartition(4)
    assert encode_texts(docs, PATH).count() == docs.count()

    def held(batches):
        sizes = [len(b.cache) + len(b.known) for b in module._LOADED.values()]
        for batch in batches:
            yield batch.from_pydict({"n": [sum(sizes)]})

    assert max(r.n for r in spark.range(0, 8, 1, 8).mapInArrow(held, "n long").collect()) == 0
