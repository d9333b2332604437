import random
import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from oddlines.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string"
ODD = (
    "Don't STOP'S 'RE x'lly ''s 12a34 <|endoftext|>x<|startoftext|> é É é ́a İstanbul ΑΣ ß ﬁ a b c d\x1ce "
    "\x00\x85z ﻿q 日本語テキスト \U0001f600‍\U0001f600 <|endof text|> %%%!!! \t\r\n\x0b\x0c tail"
)


def reference(texts):
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.no_truncation(), tokenizer.no_padding()
    return [np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [2], "<u4") for t in texts]


def hold(rows, pieces, window):
    """Every id in one piece, pieces gapless in their sequence, sequences full or a power of two long."""
    ids = defaultdict(list)
    for (doc_id, *_), found in zip(rows, reference([r[1] for r in rows])):
        ids[doc_id].append(found)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    assert by_doc.keys() == ids.keys()
    for doc_id, own in by_doc.items():
        assert sum(p.length for p in own) == sum(map(len, ids[doc_id]))
        if len(ids[doc_id]) == 1:
            (found,), at = ids[doc_id], 0
            for p in sorted(own, key=lambda p: p.start):
                assert (p.start, p.doc_tokens) == (at, len(found))
                at += p.length
                assert p.ids_crc32 == zlib.crc32(found[p.start : at].tobytes())
    for own in by_sequence.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at and p.length > 0
            at += p.length
        assert at == window or (at < window and at & (at - 1) == 0)
    return by_sequence


def packed(spark, rows, schema=SCHEMA, window=4096, shard=packing.SHARD, parts=4):
    docs = spark.createDataFrame(rows, schema).repartition(parts)
    return packing.pack(docs, PATH, window, shard=shard).collect()


def texts(seed, n):
    rng = random.Random(seed)
    topics = [[f"{rng.choice('bcdfg')}{a}{b}" for a in "aeiou" for b in "lmnrst"] for _ in range(6)]
    for i in range(n):
        yield i, " ".join(rng.choice(topics[i % 6]) for _ in range(rng.randint(1, 60)))


def test_ids_equal_the_library():
    texts = [ODD, ODD.lower(), ODD[::-1], "a" * 3000, "", " \t ", "x" + "́" * 40, "́y", "long wörd " * 200_000, "\ufeff \x85 .", "tail"]
    found = packing.WordIds(PATH).of([t.encode() for t in texts])
    for ids, told in zip(found, reference(texts), strict=True):
        assert ids.tolist() == told[:-1].tolist()


def test_ids_of_documents_equal_the_library(sf_dir):
    texts = pd.read_parquet(f"{sf_dir}/documents.parquet").text.tolist()
    for ids, told in zip(packing.WordIds(PATH).of([(t or "").encode() for t in texts]), reference(texts), strict=True):
        assert ids.tolist() == told[:-1].tolist()


def test_pieces_of_any_signs_equal_the_library(monkeypatch):
    monkeypatch.setattr(packing, "PORTION", 300)
    monkeypatch.setattr(packing, "CACHE", 20_000)  # all is forgotten again and again
    rng = random.Random(8)
    signs = ["'", "'", "s", "T", "re", "VE", "ll", "d", "m", "!", "\"", "7", "12", "é", "ÉŸ", "ſ", "\x00", "\x1c", "a" * 14, " ", "  ", "\n"]
    odd = ["×", "÷", "İ", "µ", "\u0301", "語", "<|endoftext|>", "<|ENDOFTEXT|>", "\xa0", "\ufffd", "\u212a"]
    texts = ["".join(rng.choices(signs + odd * (i % 2), k=rng.randint(0, 60))) for i in range(1500)]
    words = packing.WordIds(PATH)
    for text, ids, told in zip(texts, words.of([t.encode() for t in texts]), reference(texts), strict=True):
        assert ids.tolist() == told[:-1].tolist(), text
    (broken,) = words.of([b"a \xff\xc3 b\xe2\x82"])
    assert broken.tolist() == reference(["a \ufffd\ufffd b\ufffd"])[0][:-1].tolist()
    for text in ("", " ", "é"):
        assert [ids.tolist() for ids in words.of([text.encode()])] == [reference([text])[0][:-1].tolist()]


def test_plain_pieces_are_asked_once_and_only_merged():
    words, asked = packing.WordIds(PATH), []
    words.tokenizer = None  # with its normaliser and pattern
    ask = words._ids
    words._ids = lambda text, *by: asked.append(text) or ask(text, *by)
    texts = ["Don't ask twice, Élan!", "don't ASK; élan 12", "a longer piece thanSixteenSignsHold"] * 50
    assert [ids.tolist() for ids in words.of([t.encode() for t in texts])] == [t[:-1].tolist() for t in reference(texts)]
    list(words.of([t.encode() for t in texts]))
    (text,) = asked
    pieces = text.split(" ")
    assert sorted(set(pieces)) == sorted(pieces) and {"'t", "ask", "élan", "1", "thansixteensignshold"} < set(pieces)


def test_numbers_of_pieces_hold_when_tables_grow():
    known, rng = packing.Pieces(bits=3), np.random.default_rng(4)
    # keys that share one half, or all but a bit, are different keys
    all_keys = [np.append(rng.integers(0, 1 << 63, 500), np.arange(500)).astype(np.uint64), (np.arange(1000) // 3).astype(np.uint64)]
    for a in range(0, 1000, 50):
        keys = [own[a : a + 50] for own in all_keys]
        assert (known.find(keys) == -1).all()
        known.add(keys, [b"a long name %d" % a])
    told = np.arange(1000) + np.arange(1000) // 50
    assert (known.find(all_keys) == told).all() and known.names[b"a long name 950"] == known.count - 1 == 1019


def test_counts_and_weightiest_tokens():
    rng = np.random.default_rng(9)
    for kind in ("<u2", "<u4"):
        found = [rng.integers(0, 60_000, n).astype(kind) % m for n, m in ((1, 5), (300, 7), (4000, 60_000), (2, 1))]
        owner, terms, tf = packing.counted(np.array(list(map(len, found))), np.concatenate(found))
        weight = tf / (tf + 1.2)
        first = packing.heaviest(owner, weight, len(found))
        for i, ids in enumerate(found):
            own, n = np.unique(ids, return_counts=True)
            assert terms[owner == i].tolist() == own.tolist() and tf[owner == i].tolist() == n.tolist()
            assert terms[first[i]] == own[n.argmax()]
    assert all(len(x) == 0 for x in packing.counted(np.zeros(0, np.int64), np.zeros(0, "<u2")))


def test_used_texts_leave_the_index(monkeypatch):
    held, scores = [], packing.Bm25.scores

    def watched(self, terms):
        held.append(len(self.owner))
        return scores(self, terms)

    class Context:
        get = staticmethod(lambda: Context)
        partitionId = staticmethod(lambda: 0)

    def pieces():
        found = [f.astype("<u2") for f in reference([t for _, t in texts(6, 300)])]
        rows, out = [(i, 0, f, len(f)) for i, f in enumerate(found)], packing._Pieces()
        packer = packing._Packer(np.linspace(1, 2, 1 << 16), 40.0, 256)
        packer.shard(rows, out)
        packer.finish(out)
        return out.columns

    monkeypatch.setattr(packing, "TaskContext", Context)
    monkeypatch.setattr(packing.Bm25, "scores", watched)
    shrinking = pieces()
    assert held[-1] < held[0] / 2 and held == sorted(held, reverse=True)
    monkeypatch.setattr(packing, "USED", 0)
    assert pieces() == shrinking


def test_every_id_lies_in_one_piece(spark):
    rows = [*texts(1, 400), (1000, None), (1001, ""), (1002, ODD), (1003, "word " * 9000), (1004, "so 7 " * 2048)]
    by_sequence = hold(rows, packed(spark, rows), 4096)
    assert sum(1 for own in by_sequence.values() if sum(p.length for p in own) < 4096) <= 4 * 12


@pytest.mark.parametrize("shard", [7, 64])
def test_small_windows_and_shards(spark, shard):
    rows = list(texts(2, 300))
    hold(rows, packed(spark, rows, window=128, shard=shard), 128)


def test_repeated_rows_null_ids_and_other_columns(spark):
    rows = [(*r, 5, b"x") for r in texts(3, 50)] + [(7, "the same row", 5, b"x")] * 40 + [(None, "no id", 5, b"x")] * 3
    hold(rows, packed(spark, rows, SCHEMA + ", row int, ids binary", window=64), 64)


def test_hot_text(spark):
    rows = [(i, "one hot text that a third of all rows hold") for i in range(500)] + [(i + 500, t) for i, t in texts(4, 1000)]
    hold(rows, packed(spark, rows, window=256, shard=100), 256)


def test_empty_table(spark):
    assert packed(spark, []) == []


def test_scores_are_bm25_and_windows_hold_like_texts(spark):
    rows = list(texts(5, 240))
    found = [f.astype(np.int64) for f in reference([t for _, t in rows])]
    size = max(map(max, found)) + 1
    df = np.array([sum(t in f for f in map(set, found)) for t in range(size)])
    idf = np.log1p((len(found) - df + 0.5) / (df + 0.5))
    mean = np.mean([len(f) for f in found])
    index = packing.Bm25(found, idf, mean)
    for q in (0, 17, 101):
        scores = index.scores(index.query(q))
        for d in (0, 5, 17, 200):
            tf = {t: int((found[d] == t).sum()) for t in set(found[q].tolist())}
            norm = packing.K1 * (1 - packing.B + packing.B * len(found[d]) / mean)
            assert scores[d] == pytest.approx(sum(idf[t] * n * (packing.K1 + 1) / (n + norm) for t, n in tf.items() if n))
    order = list(packing.neighbours(scores, np.arange(240) % 3 > 0))
    assert order == sorted((i for i in range(240) if i % 3), key=lambda i: (-scores[i], i))
    by_sequence = hold(rows, packed(spark, rows, window=256, parts=1), 256)
    same = total = 0
    for own in by_sequence.values():
        topics = [p.doc_id % 6 for p in own]
        same, total = same + max(map(topics.count, topics)), total + len(topics)
    assert same > 0.7 * total
