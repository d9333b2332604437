"""Shards of near equal bytes by a k-d tree over metadata, with SQL functions only.

Rows with equal texts are one group and stay together. A cell that is to hold
m shards is cut in two, m // 2 and the rest, at the weighted quantile of its
bytes along its widest dimension (the widest share of the whole range; the
first of equals), until every cell is one shard. The quantile is found by
counts over 1024 bins that narrow around it, for all cells of a level at
once; what reaches the driver is a row a cell. A group never straddles a cut,
so sizes are equal but for about the heaviest group.

Coordinates are 62-bit integers, the dimension's value above and the group's
hash below, so groups with equal values can be cut apart.

Null texts count as empty and as equal to empty ones, a null dimension as the
smallest value. Repeated rows are separate rows of one group. An empty table
gives no rows. Further columns may have any name; only the ones named are read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from oddlines.storage import materialize

BINS = 1024
EXACT = 0.0002  # a bin of at most this share of its cell's bytes is not looked into further
SLOT_ROWS = 1 << 14


def groups_of(rows: DataFrame, dims: Sequence[str]) -> DataFrame:
    """(key, bytes, c0..): one row for each distinct text with its coordinates."""
    grouped = rows.groupBy("key").agg(F.sum("size").alias("bytes"), *(F.min(d).cast("double").alias(d) for d in dims))
    grouped = materialize(grouped, "groups")
    ends = grouped.agg(*(f(d).alias(f"{d}_{k}") for d in dims for k, f in (("low", F.min), ("high", F.max)))).first()
    low32 = F.col("key").bitwiseAND(F.lit((1 << 32) - 1))
    coordinates = []
    for k, d in enumerate(dims):
        low, high = ends[f"{d}_low"], ends[f"{d}_high"]
        width = (high - low) if low is not None and high > low else 1.0
        share = F.coalesce((F.col(d) - F.lit(low or 0.0)) / F.lit(width), F.lit(0.0))
        coordinates.append((F.shiftleft(F.floor(share * (1 << 29)), 32).bitwiseOR(low32)).cast("long").alias(f"c{k}"))
    return grouped.select("key", "bytes", *coordinates)


def _pick(column: str, count: int) -> Column:
    """The coordinate along the dimension a cell is cut in."""
    found = F.col("c0")
    for k in range(1, count):
        found = F.when(F.col(column) == k, F.col(f"c{k}")).otherwise(found)
    return found


def kd_cells(groups: DataFrame, shards: int, dims: int) -> DataFrame:
    """(key, shard) of every group."""
    spark = groups.sparkSession
    tree = groups.withColumn("cell", F.lit(0))
    sizes = {0: shards}  # first shard of each cell: number of shards
    while any(m > 1 for m in sizes.values()):
        tree = materialize(tree, "cells")
        ranges = tree.groupBy("cell").agg(
            F.sum("bytes").alias("bytes"),
            *(f(f"c{k}").alias(f"{n}{k}") for k in range(dims) for n, f in (("low", F.min), ("high", F.max))),
        )
        cuts = {}
        for r in ranges.collect():
            if (m := sizes[r["cell"]]) > 1:
                dim = max(range(dims), key=lambda k: (r[f"high{k}"] - r[f"low{k}"], -k))
                goal = r["bytes"] * (m // 2) / m
                cuts[r["cell"]] = {"dim": dim, "low": r[f"low{dim}"], "high": r[f"high{dim}"], "goal": goal, "bytes": r["bytes"], "below": 0, "at": None}
        while open_cells := {c: x for c, x in cuts.items() if x["at"] is None}:
            for c, x in open_cells.items():
                x["width"] = (x["high"] - x["low"]) // BINS + 1
            state = [(c, x["dim"], x["low"], x["high"], x["width"], x["goal"] - x["below"]) for c, x in open_cells.items()]
            now = spark.createDataFrame(state, "cell int, dim int, low long, high long, width long, goal double")
            placed = tree.join(F.broadcast(now), "cell").withColumn("c", _pick("dim", dims))  # a row a cell
            placed = placed.filter("c BETWEEN low AND high").withColumn("bin", F.expr("(c - low) div width"))
            counts = placed.groupBy("cell", "bin").agg(
                F.sum("bytes").alias("inside"), F.min("c").alias("first"), F.max("c").alias("last"), F.first("goal").alias("goal")
            )
            upto = F.sum("inside").over(W.partitionBy("cell").orderBy("bin"))
            hit = counts.withColumn("upto", upto).filter("upto >= goal")  # the bin in which the goal is reached
            hit = hit.groupBy("cell").agg(F.min_by(F.struct("inside", "first", "last", "upto"), "bin").alias("hit"))
            for r in hit.collect():
                x, h = cuts[r["cell"]], r["hit"]
                before = x["below"] + h["upto"] - h["inside"]
                if h["first"] == h["last"] or h["inside"] <= EXACT * x["bytes"]:
                    whole = x["goal"] - before > before + h["inside"] - x["goal"]  # the nearer side of the bin
                    x["at"] = h["last"] + 1 if whole else h["first"]
                else:
                    x["low"], x["high"], x["below"] = h["first"], h["last"], before
        state = [(c, x["dim"], x["at"], c + sizes[c] // 2) for c, x in cuts.items()]
        now = spark.createDataFrame(state, "cell int, dim int, at long, upper int")
        tree = tree.join(F.broadcast(now), "cell", "left").withColumn(
            "cell", F.when(F.col("at").isNotNull() & (_pick("dim", dims) >= F.col("at")), F.col("upper")).otherwise(F.col("cell"))
        )
        tree = tree.drop("dim", "at", "upper")
        for c, m in list(sizes.items()):
            if m > 1:
                sizes[c], sizes[c + m // 2] = m // 2, m - m // 2
    return tree.select("key", F.col("cell").alias("shard"))


def with_slots(rows: DataFrame, order: Sequence[str], rows_per_chunk: int = SLOT_ROWS) -> DataFrame:
    """Add ``slot``, a gapless number from 0 within each ``shard``, without a window over a whole shard."""
    shards, n = rows.agg(F.count_distinct("shard"), F.count("*")).first()
    chunks = max(1, -(-n // (rows_per_chunk * max(1, shards))))
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64(*order), F.lit(chunks)))
    counts = rows.groupBy("shard", "chunk").agg(F.count("*").alias("here"))
    before = F.sum("here").over(W.partitionBy("shard").orderBy("chunk")) - F.col("here")
    counts = counts.select("shard", "chunk", before.alias("before"))
    number = F.row_number().over(W.partitionBy("shard", "chunk").orderBy(*order)) - 1
    return rows.withColumn("number", number).join(counts, ["shard", "chunk"]).withColumn(
        "slot", (F.col("before") + F.col("number")).cast("long")
    ).drop("chunk", "number", "before")


def assign_shards(docs: DataFrame, dims: dict[str, Column], shards: int | None = None, target_bytes: int | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of every row; ``shards``, or as many as ``target_bytes`` asks for."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.xxhash64(text).alias("key"),
        *(expr.alias(f"d{k}") for k, expr in enumerate(dims.values())),
    )
    groups = groups_of(rows, [f"d{k}" for k in range(len(dims))])
    if shards is None:
        total = groups.agg(F.sum("bytes")).first()[0] or 0
        shards = max(1, -(-total // target_bytes))
    cells = kd_cells(groups, shards, len(dims))
    placed = materialize(rows.select("doc_id", "size", "text_crc32", "key").join(cells, "key"), "shards")
    return with_slots(placed, ["key", "doc_id"]).select("doc_id", "size", "text_crc32", "shard", "slot")
