from __future__ import annotations

import hashlib

import pandas as pd
import public_tokenizers
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from oddlines.llm import secrets
from tests.llm import test_leaks, test_secrets, test_setjoin


def test_stages_against_plain_versions(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, kept = docs.columns, docs
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    seen = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = kept.toPandas()
        kept = stage(spark, kept, sf_dir).cache()
        after = kept.toPandas()
        seen.append(len(after))
        if k < 4:
            assert kept.columns == columns
        if k == 0:
            labels = pd.read_parquet(f"{sf_dir}/labels.parquet")
            clean = set(labels[(labels.quality == 1) & (labels.toxic == 0)].doc_id)
            assert len(clean & set(after.doc_id)) >= 0.95 * len(clean)
        if k == 1:
            told = test_setjoin.plain(list(zip(before.doc_id, before.text)), 5, 80)
            assert sorted(after.doc_id) == sorted(d for d, _, c, _ in told if d == c)
        if k == 2:
            leaks = test_leaks.plain(before, pd.read_parquet(f"{sf_dir}/benchmark.parquet"))
            assert leaks and sorted(after.doc_id) == sorted(set(before.doc_id) - {d for d, _ in leaks})
        if k == 3:
            texts = dict(zip(after.doc_id, after.text))
            assert sorted(texts) == sorted(before.doc_id) and (after.n_chars == after.text.str.len()).all()
            for doc, text in zip(before.doc_id, before.text):
                for start, kind, end in test_secrets.plain(text):
                    assert secrets.credential(text, (start, kind, end)) not in texts[doc]
                if not test_secrets.plain(text) and "[SECRET]" not in texts[doc]:
                    assert texts[doc] == text
        if k == 4:
            for r in after.itertuples():
                ids = tokenizer.encode(r.text, add_special_tokens=False).ids
                assert list(r.ids) == ids and r.n_tokens == len(ids)
                assert r.decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest()
    assert seen[0] > seen[1] > seen[2] == seen[3] == seen[4] > 0
    whole = entry.queries()["pipeline"](spark, sf_dir).select("doc_id", "ids_sha256")
    assert sorted(map(tuple, whole.collect())) == sorted(zip(after.doc_id, after.ids_sha256))


def test_registry():
    names = entry.queries()
    assert sum(n.startswith("op") and n.split("_")[0][2:].isdigit() for n in names) == 13
    assert set(entry.oracle_sql()) <= set(names) and "op4_chat_formatting" in entry.oracle_sql()
