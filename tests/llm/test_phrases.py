import random
import re
from collections import Counter

import pytest

from oddlines.llm import phrases

SCHEMA = "doc_id long, text string, lang string"


def plain(rows, least=30, percent=80, top=2000):
    counts, totals = {}, Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        lower = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for m in range(1, 5):
                for i in range(len(words) - m + 1):
                    counts.setdefault(lang, Counter())[tuple(words[i : i + m])] += 1
    out = []
    for lang, f in counts.items():
        often = {p: c for p, c in f.items() if len(p) > 1 and c >= least}
        found = []
        for p, a in often.items():
            longer = (
                c for q, c in often.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))
            )
            if any(100 * c >= percent * a for c in longer):
                continue
            score, k = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), a, f[p[:k]], f[p[k:]], score))
        for rank, (_, _, phrase, a, left, right, score) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), a, left, right, totals[lang], score))
    return sorted(out)


def mined(spark, rows, schema=SCHEMA, **options):
    return sorted(tuple(r) for r in phrases.collocations(spark.createDataFrame(rows, schema), **options).collect())


def texts(seed, n=120):
    rng = random.Random(seed)
    words = ["alpha", "Beta", "gamma", "été", "\x00odd", "delta's", "ÀB", "x" * 50, "ß", "zeta"]
    marks = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", "\x0b", "!", " ? "]
    for i in range(n):
        text = "".join(rng.choice(words) + rng.choice(marks) for _ in range(rng.randint(0, 120)))
        yield i, text, rng.choice(["en", "en", "en", "de", None, "und"])


@pytest.mark.parametrize("bits", [1 << 6, 1 << 20])
def test_equals_plain_counts(spark, bits):
    rows = [*texts(1), (500, None, "en"), (501, "", None), (7, "new york city " * 90, "en"), (7, "new york city " * 90, "en")]
    assert mined(spark, rows, least=5, bits=bits) == plain(rows, least=5)


def test_ranks_are_cut_with_ties(spark):
    rows = list(texts(2))
    assert mined(spark, rows, least=3, top=17) == plain(rows, least=3, top=17)


def test_long_text_and_hot_language(spark):
    rng = random.Random(3)
    long = " ".join(rng.choice(["of", "the", "a", "cat", "dog"]) + rng.choice(["", "", "."]) for _ in range(400_000))
    rows = [(1, long, "en"), *texts(4, 30), (2, "w" * 3_000_000, "en")]
    assert mined(spark, rows) == plain(rows)


def test_clashing_columns(spark):
    rows = [(*r, 1, "k") for r in texts(5, 60)]
    schema = SCHEMA + ", words int, hash string"
    assert mined(spark, rows, schema, least=4) == plain(rows, least=4)


@pytest.mark.parametrize("rows", [[], [(1, None, None)], [(None, " .,\t", "en")]])
def test_no_words(spark, rows):
    assert mined(spark, rows, least=1) == []


def test_products_beyond_64_bits(spark):
    big = 10**17
    words = spark.createDataFrame(
        [("en", "a", 1, 1, big + 3), ("en", "b", 2, 2, big + 8)], "lang string, word string, hash long, key long, f long"
    )
    pair = spark.createDataFrame([("en", [1, 2], 3, big)], "lang string, words array<long>, key long, f long")
    row = phrases.scored(words, pair).first()
    assert (row.score, row.l, row.r) == (2000000 * big // (2 * big + 11), big + 3, big + 8)
