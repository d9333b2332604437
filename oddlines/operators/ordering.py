"""Positions, running totals and carried values over one global order.

A plain ``Window.orderBy`` pulls every row (or every row of a hot key) into one
task. Here the rows are range-partitioned on the order columns, which are
unique and therefore split evenly whatever the skew; positions follow from the
partition sizes, and running values are taken inside chunks of bounded size
and completed from a table with one row per chunk.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from math import ceil, floor, inf, isfinite

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from oddlines.storage import materialize

ROWS_PER_CHUNK = 1 << 19
BINS = 1024  # into which a range of values is counted at a time
FEW = 10_000  # rows of one bin that are looked at one by one
_ROW_BITS = 33  # layout of monotonically_increasing_id: partition above, row below


def with_position(df: DataFrame, order: Sequence[str | Column], name: str = "pos") -> DataFrame:
    """Add the 0-based position of each row in ``order``, which must be unique."""
    stored = materialize(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_slot", F.monotonically_increasing_id()),
        "ordered",
    )
    part = F.shiftright("_slot", _ROW_BITS)
    # one row per range partition, so the count is bounded by the partition setting
    starts = (
        stored.groupBy(part.alias("_part"))
        .agg(F.count(F.lit(1)).alias("_rows"))
        .withColumn(
            "_start",
            F.coalesce(F.sum("_rows").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)),
        )
        .select("_part", "_start")
    )
    row = F.col("_slot").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return (
        stored.withColumn("_part", part)
        .join(F.broadcast(starts), "_part")
        .withColumn(name, F.col("_start") + row)
        .drop("_part", "_start", "_slot")
    )


def with_running(
    df: DataFrame,
    order: Sequence[str | Column],
    group: Sequence[str] = (),
    sums: Mapping[str, Column] | None = None,
    lasts: Mapping[str, Column] | None = None,
    include_current: bool = True,
    rows_per_chunk: int = ROWS_PER_CHUNK,
) -> DataFrame:
    """Running sums and last non-null values along ``order``, restarting per group.

    ``order`` must be unique within a group. ``sums`` and ``lasts`` map a new
    column name to the expression taken up to the current row, or up to the row
    before it when ``include_current`` is false.
    """
    sums, lasts, group = dict(sums or {}), dict(lasts or {}), list(group)
    prepared = df.select(
        "*",
        *[expr.alias(f"_in_{name}") for name, expr in {**sums, **lasts}.items()],
    )
    placed = with_position(prepared, [*[F.col(g) for g in group], *order], "_pos").withColumn(
        "_chunk", F.floor(F.col("_pos") / F.lit(rows_per_chunk))
    )

    per_chunk = placed.groupBy(*group, "_chunk").agg(
        *[F.coalesce(F.sum(f"_in_{n}"), F.lit(0)).alias(f"_cs_{n}") for n in sums],
        *[
            F.max_by(f"_in_{n}", F.when(F.col(f"_in_{n}").isNotNull(), F.col("_pos"))).alias(f"_cl_{n}")
            for n in lasts
        ],
    )
    before = W.partitionBy(*group).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    carried = per_chunk.select(
        *group,
        "_chunk",
        *[F.coalesce(F.sum(f"_cs_{n}").over(before), F.lit(0)).alias(f"_cs_{n}") for n in sums],
        *[F.last(f"_cl_{n}", ignorenulls=True).over(before).alias(f"_cl_{n}") for n in lasts],
    )

    inside = (
        W.partitionBy(*group, "_chunk")
        .orderBy("_pos")
        .rowsBetween(W.unboundedPreceding, 0 if include_current else -1)
    )
    local = placed.select(
        "*",
        *[F.coalesce(F.sum(f"_in_{n}").over(inside), F.lit(0)).alias(f"_ls_{n}") for n in sums],
        *[F.last(f"_in_{n}", ignorenulls=True).over(inside).alias(f"_ll_{n}") for n in lasts],
    )
    # a null key is a group like any other
    carried = carried.withColumnsRenamed({k: f"_of_{k}" for k in [*group, "_chunk"]})
    match = F.col("_chunk") == F.col("_of__chunk")
    for k in group:
        match = match & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    joined = local.join(carried, match)
    return joined.select(
        *df.columns,
        *[(F.col(f"_cs_{n}") + F.col(f"_ls_{n}")).alias(n) for n in sums],
        *[F.coalesce(F.col(f"_ll_{n}"), F.col(f"_cl_{n}")).alias(n) for n in lasts],
    )


def lowest_rows(df: DataFrame, order: Sequence[str | Column], count: Column) -> DataFrame:
    """The first ``count`` rows in ``order``, for counts that grow with the data."""
    return with_position(df, order, "_rank").filter(F.col("_rank") < count).drop("_rank")


def values_at(rows: DataFrame, ranks: Iterable[int], low: float, high: float) -> dict[int, float]:
    """The values at ranks (from 0) of finite values ``v`` that count ``w`` times and lie between ``low`` and ``high``.

    Counts by bins narrow the range round each rank until it holds one value or
    few rows; nothing is ordered or moved but counts, at most ``BINS`` a range and round.
    """
    found: dict[int, float] = {}
    around = {r: (low, high, 0) for r in ranks}  # range of a rank and how many rows lie below it
    while around:
        ranges = sorted(set(around.values()))
        place = F.lit(None).cast("struct<k:int,bin:long>")
        for k, (a, b, _) in enumerate(ranges):
            step = F.floor((F.col("v") - F.lit(a)) / F.lit(b - a) * BINS) if 0 < b - a < inf else F.lit(0).cast("long")
            if b - a == inf:  # too wide for a difference
                step = F.floor((F.col("v") / BINS - F.lit(a / BINS)) / F.lit(b / BINS - a / BINS) * BINS)
            here = F.struct(F.lit(k).alias("k"), F.least(step, F.lit(BINS - 1).cast("long")).alias("bin"))
            place = F.when(F.col("v").between(a, b), here).otherwise(place)
        counts = rows.groupBy(place.alias("at")).agg(F.sum("w"), F.min("v"), F.max("v"), F.count("v")).filter("at IS NOT NULL")
        cells = sorted((r[0].k, r[0].bin, *r[1:]) for r in counts.collect())
        few: dict[tuple[float, float], list[tuple[int, int]]] = {}
        for rank, (a, b, below) in list(around.items()):
            k = ranges.index((a, b, below))
            for _, _, n, least, most, held in (c for c in cells if c[0] == k):
                if rank < below + n:
                    break
                below += n
            del around[rank]
            if least == most:
                found[rank] = least
            elif held <= FEW:
                few.setdefault((least, most), []).append((rank, below))
            else:
                around[rank] = (least, most, below)
        for (a, b), wanted in few.items():
            values = rows.filter(F.col("v").between(a, b)).groupBy("v").agg(F.sum("w")).collect()  # at most FEW
            upto = 0
            for v, n in sorted(values):
                for rank, below in wanted:
                    if upto <= rank - below < upto + n:
                        found[rank] = v
                upto += n
    return found


def percentiles(
    df: DataFrame,
    value: str,
    fractions: Sequence[float],
    freq: str | None = None,
    group: Sequence[str] = (),
) -> DataFrame:
    """Exact linear-interpolated percentiles: columns ``group``, ``fraction``, ``percentile``.

    ``freq`` says how often a row counts. Without groups the wanted values are
    found by counting, see ``values_at``; with groups equal values are folded together
    before anything is ordered.
    """
    group = list(group)
    weight = F.col(freq) if freq else F.lit(1).cast("long")
    present = df.filter(F.col(value).isNotNull())
    if not group:
        rows = present.select(F.col(value).cast("double").alias("v"), weight.cast("long").alias("w"))
        low, high, wild, n = rows.agg(F.min("v"), F.max("v"), F.max(F.isnan("v")), F.sum("w")).first()
        if n and not wild and isfinite(low) and isfinite(high):
            ranks = {float(f): float(f) * (n - 1) for f in fractions}
            found = values_at(rows, {r for x in ranks.values() for r in (floor(x), ceil(x))}, low, high)
            told = [(f, found[floor(x)] + (found[ceil(x)] - found[floor(x)]) * (x - floor(x))) for f, x in ranks.items()]
            return df.sparkSession.createDataFrame(told, "fraction double, percentile double")
    folded = present.groupBy(*group, F.col(value).alias("_value")).agg(F.sum(weight).alias("_freq"))
    running = with_running(folded, [F.col("_value")], group, sums={"_upto": F.col("_freq")})
    total = F.max("_upto")
    wanted = F.array(*[F.lit(float(f)) for f in fractions])
    if group:
        totals = running.groupBy(*group).agg(total.alias("_n"))
        match = F.lit(True)
        for k in group:
            match = match & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
        totals = totals.withColumnsRenamed({k: f"_of_{k}" for k in group})
        placed = running.join(totals, match).drop(*[f"_of_{k}" for k in group])
    else:
        placed = running.withColumn("_n", running.agg(total).scalar())
    placed = placed.select("*", F.explode(wanted).alias("fraction"))
    rank = F.col("fraction") * (F.col("_n") - 1)
    first = F.col("_upto") - F.col("_freq")
    covers_low = (first <= F.floor(rank)) & (F.floor(rank) < F.col("_upto"))
    covers_high = (first <= F.ceil(rank)) & (F.ceil(rank) < F.col("_upto"))
    low, high = F.max(F.when(covers_low, F.col("_value"))), F.max(F.when(covers_high, F.col("_value")))
    part = F.max(rank - F.floor(rank))
    return (
        placed.filter(covers_low | covers_high)
        .groupBy(*group, "fraction")
        .agg((low + (high - low) * part).alias("percentile"))
    )
