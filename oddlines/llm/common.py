"""What several operators share: tables, thresholds of a rank, connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from oddlines.storage import materialize

BINS = 4096
FEW = 20_000  # values of one bin that are sorted outright
ROWS_AT_ONCE = 1000  # rows that go to a Python worker at once: of long texts the usual 10,000 are too many


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Let no more than ``ROWS_AT_ONCE`` rows go to a Python worker at once."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if now <= 0 or now > ROWS_AT_ONCE:
        spark.conf.set(name, ROWS_AT_ONCE)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def kth_largest(df: DataFrame, value: str, k: int) -> float | None:
    """The k-th largest value of a double column, exactly, without sorting the rows.

    Counts by bins narrow the range until it holds few values; each round
    returns at most ``BINS`` counts to the driver. None if ``k`` is 0 or no
    value is there; the smallest value if there are fewer than ``k``.
    """
    df = df.select(F.col(value).cast("double").alias("v")).filter("v IS NOT NULL")
    low, high, n = df.agg(F.min("v"), F.max("v"), F.count("v")).first()
    if not n or k <= 0:
        return None
    if k >= n:
        return low
    while low < high:
        width = (high - low) / BINS
        at = F.least(F.floor((F.col("v") - low) / width), F.lit(BINS - 1))
        inside = df.filter(F.col("v").between(low, high))
        counts = inside.groupBy(at.alias("bin")).agg(F.count("v"), F.min("v"), F.max("v")).collect()
        for _, found, bin_low, bin_high in sorted(counts, reverse=True):
            if k <= found:
                break
            k -= found
        if found <= FEW:
            values = df.filter(F.col("v").between(bin_low, bin_high)).collect()
            return sorted((r[0] for r in values), reverse=True)[k - 1]
        low, high = bin_low, bin_high
    return low


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node in ``edges``; the root is the smallest id of its component.

    Large-star and small-star steps take turns until nothing moves; each
    round is written to the shared work folder, and only its size and checksum
    reach the driver.
    """
    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u != v").distinct()
    pairs, before = materialize(pairs, "edges"), None
    while True:
        both = pairs.union(pairs.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            least.select("u", F.col("m").alias("v"))
        )
        pairs = materialize(small.filter("u != v").distinct(), "edges")
        now = pairs.agg(F.count("u"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))
