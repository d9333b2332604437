from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from oddlines.operators import ordering


@pytest.fixture(scope="module")
def rows(spark):
    """One group holds half of all rows."""
    rnd = random.Random(3)
    data = [(i, "hot" if rnd.random() < 0.5 else f"g{rnd.randrange(5)}", rnd.choice([None, 1, 2, 3])) for i in range(900)]
    rnd.shuffle(data)
    return spark.createDataFrame(data, "id long, g string, x int").repartition(7)


def test_positions(rows):
    got = ordering.with_position(rows, [F.desc("id")]).select("id", "pos").collect()
    assert {(r[0], r[1]) for r in got} == {(i, 899 - i) for i in range(900)}


@pytest.mark.parametrize("include_current", [True, False])
@pytest.mark.parametrize("group", [[], ["g"]])
@pytest.mark.parametrize("rows_per_chunk", [50, 10_000])
def test_running(rows, group, include_current, rows_per_chunk):
    got = ordering.with_running(
        rows, [F.col("id")], group, sums={"s": F.col("x")}, lasts={"l": F.col("x")},
        include_current=include_current, rows_per_chunk=rows_per_chunk,
    ).collect()
    total, last, expected = {}, {}, {}
    for r in sorted(rows.collect()):
        key = r["g"] if group else None
        before = (total.get(key, 0), last.get(key))
        total[key] = total.get(key, 0) + (r["x"] or 0)
        last[key] = r["x"] if r["x"] is not None else last.get(key)
        expected[r["id"]] = (total[key], last[key]) if include_current else before
    assert {r["id"]: (r["s"], r["l"]) for r in got} == expected


def test_lowest_rows(rows):
    got = ordering.lowest_rows(rows, [F.desc("id")], F.lit(3)).collect()
    assert sorted(r["id"] for r in got) == [897, 898, 899]


@pytest.mark.parametrize("fractions", [[0.0, 0.03, 0.5, 0.999, 1.0]])
def test_percentiles(spark, fractions):
    rnd = random.Random(5)
    values = [(rnd.choice("ab"), rnd.choice([1.0, rnd.random() * 1e6, rnd.random()]), rnd.randrange(1, 4)) for _ in range(500)]
    df = spark.createDataFrame(values, "g string, v double, n long").repartition(5)
    got = {(r["g"], r["fraction"]): r["percentile"] for r in ordering.percentiles(df, "v", fractions, "n", ["g"]).collect()}
    for g in "ab":
        spread = [v for k, v, n in values if k == g for _ in range(n)]
        for f in fractions:
            assert got[g, f] == pytest.approx(np.percentile(spread, 100 * f))
    whole = {r["fraction"]: r["percentile"] for r in ordering.percentiles(df, "v", fractions).collect()}
    for f in fractions:
        assert whole[f] == pytest.approx(np.percentile([v for _, v, _ in values], 100 * f))


def test_null_keys_are_a_group(spark):
    rows = [(1, None, 5.0), (2, "a", 1.0), (3, None, 7.0), (4, "a", 2.0)]
    df = spark.createDataFrame(rows, "id int, g string, v double")
    got = ordering.with_running(df, [F.col("id")], ["g"], sums={"s": F.col("v")}).collect()
    assert sorted((r.id, r.s) for r in got) == [(1, 5.0), (2, 1.0), (3, 12.0), (4, 3.0)]
    found = ordering.percentiles(df, "v", [1.0], group=["g"]).collect()
    assert {(r.g, r.percentile) for r in found} == {(None, 7.0), ("a", 2.0)}


def test_values_at_ranks_by_counting(spark, monkeypatch):
    monkeypatch.setattr(ordering, "FEW", 5)
    monkeypatch.setattr(ordering, "BINS", 8)
    rng = np.random.default_rng(4)
    for values in (
        rng.normal(size=500), np.repeat([1.0, 2.0, 3.0], [400, 3, 90]), np.array([7.0]), np.array([-1e308, 0.0, 5e-324, 1e308]),
        np.concatenate([rng.exponential(1e-9, 300), [1e12]]), np.array([0.1, np.nextafter(0.1, 1)] * 40),
    ):
        weights = rng.integers(1, 4, len(values))
        df = spark.createDataFrame([(float(v), int(w)) for v, w in zip(values, weights)] + [(None, 1)], "v double, w long")
        fractions = [0.0, 0.03, 0.25, 0.5, 0.999, 1.0]
        found = {r.fraction: r.percentile for r in ordering.percentiles(df, "v", fractions, "w").collect()}
        spread = np.sort(np.repeat(values, weights))
        for f in fractions:
            rank = f * (len(spread) - 1)
            low, high = spread[int(np.floor(rank))], spread[int(np.ceil(rank))]
            assert found[f] == pytest.approx(low + (high - low) * (rank - np.floor(rank)), rel=1e-12)
    assert ordering.percentiles(df.limit(0), "v", [0.5]).collect() == []
