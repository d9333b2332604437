import hashlib
import math
import random

import pytest

from oddlines.llm import codes


def plain(rows, parts=8, entries=16, rounds=6):
    """Lloyd rounds with every part compared with every entry; rows are (id, vector, label)."""
    kept = [r for r in rows if r[1] is not None and all(v is not None and math.isfinite(v) for v in r[1])]
    kept.sort(key=lambda r: (r[0] is None, r[0], r[1]))
    width = len(kept[0][1]) // parts
    cut = lambda v: [[math.floor(4096 * x) for x in v[p * width : (p + 1) * width]] for p in range(parts)]
    vectors = [cut(r[1]) for r in kept]
    book = [[v[p] for v in vectors[:entries]] for p in range(parts)]

    def nearest():
        return [
            [min((sum((a - b) ** 2 for a, b in zip(v[p], e)), j) for j, e in enumerate(book[p])) for p in range(parts)]
            for v in vectors
        ]

    for _ in range(rounds):
        told = nearest()
        for p in range(parts):
            for j in range(len(book[p])):
                own = [v[p] for v, t in zip(vectors, told) if t[p][1] == j]
                if own:
                    book[p][j] = [sum(c) // len(own) for c in zip(*own)]
    told = nearest()
    digest = hashlib.sha256(",".join(str(x) for part in book for e in part for x in e).encode()).hexdigest()
    errors = [sum(d for d, _ in t) for t in told]
    by_label = {}
    for r, e in zip(kept, errors):
        by_label[r[2]] = by_label.get(r[2], 0) + e
    return sorted(
        (str(r[0]), "".join(f"{j:02x}" for _, j in t), e, by_label[r[2]], digest) for r, t, e in zip(kept, told, errors)
    )


def coded(spark, rows, schema="vec_id long, embedding array<float>, label int"):
    return [(str(r[0]), *r[1:]) for r in codes.code_rows(spark.createDataFrame(rows, schema)).collect()]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_plain_rounds(spark, seed):
    rng = random.Random(seed)
    grid = [i / 8 for i in range(-8, 9)]  # coarse values give many ties
    rows = [(i * 3, [rng.choice(grid) for _ in range(16)], rng.choice([None, 0, 1])) for i in range(300)]
    rows += [(i, [rng.gauss(i % 4, 0.3) for _ in range(16)], 7) for i in range(1, 200, 3)]
    rows = [(i, [float(f"{x:.4f}") for x in v], label) for i, v, label in rows]
    expected = plain(rows)
    found = coded(spark, rows, "vec_id long, embedding array<double>, label int")
    assert sorted(found) == expected


def test_hard_rows(spark):
    rng = random.Random(5)
    good = [(i, [rng.uniform(-2, 2) for _ in range(8)], i % 2) for i in range(9)]
    good += [(4, [0.5] * 8, None), (4, [0.5] * 8, None), (None, [1.0] * 8, None)]
    bad = [(50, None, 1), (51, [1.0] * 7 + [None], 1), (52, [1.0] * 7 + [math.nan], 1), (53, [math.inf] + [0.0] * 7, 1)]
    other = [(60, [], 1), (61, [1.0] * 16, 1), (62, [1e30] + [0.0] * 7, 1)]
    schema = "vec_id long, embedding array<double>, label int, id int, code int, error string"
    rows = [(*r, 1, 2, "x") for r in [*bad, *good, *other]]
    assert sorted(coded(spark, rows, schema)) == plain([*good])


@pytest.mark.parametrize("rows", [[], [(1, None, 0)], [(1, [1.0, 2.0], 0)]])
def test_nothing_to_code(spark, rows):
    found = codes.code_rows(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))
    assert found.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert found.collect() == []


def test_large_values_stay_exact(spark):
    rows = [(i, [(-1) ** i * (20000.0 + i / 4096)] * 8, 0) for i in range(40)]
    assert sorted(coded(spark, rows, "vec_id long, embedding array<double>, label int")) == plain(rows)
