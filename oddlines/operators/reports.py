"""Top lists and the data behind the charts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from oddlines.operators.decisions import project_existing
from oddlines.operators.ordering import with_running


def preview_rows(df: DataFrame, columns: Sequence[str], order: Sequence[str] = ("seq",), n: int = 5) -> DataFrame:
    """The first rows, with those of the listed columns that exist."""
    return project_existing(df.orderBy(*order).limit(n), columns)


def lowest_scores(result: DataFrame, k: int, score: str = "anomaly_score", key: str = "seq") -> DataFrame:
    """The ``k`` lowest-scored rows, ties by key."""
    return result.orderBy(score, key).limit(k)


def latest_rows(df: DataFrame, n: int = 500, key: str = "seq") -> DataFrame:
    """The ``n`` rows with the highest key."""
    return df.orderBy(F.desc(key)).limit(n)


def top_templates(result: DataFrame, text: str | None = None, n: int = 100) -> DataFrame:
    """The ``n`` most frequent texts of each class, ties by text: ``is_anomaly``, ``text``, ``freq``, ``rank``."""
    text = text or ("template" if "template" in result.columns else "event")
    counts = result.groupBy("is_anomaly", F.col(text).alias("text")).agg(F.count(F.lit(1)).alias("freq"))
    # the rank filter is pushed below the shuffle: each partition sends n rows a class at most
    rank = F.row_number().over(W.partitionBy("is_anomaly").orderBy(F.desc("freq"), "text"))
    return counts.withColumn("rank", rank).filter(F.col("rank") <= n)


def score_timeline(result: DataFrame, score: str = "anomaly_score") -> DataFrame:
    """One point a row: sequence, score, class."""
    return result.select("seq", score, "is_anomaly")


def score_timeline_bands(result: DataFrame, rows_per_point: int, score: str = "anomaly_score") -> DataFrame:
    """The timeline folded to one point per ``rows_per_point`` rows and class."""
    return result.groupBy(
        F.floor(F.col("seq") / F.lit(rows_per_point)).alias("point"), "is_anomaly"
    ).agg(
        F.min(score).alias("low"), F.avg(score).alias("mean"), F.max(score).alias("high"),
        F.count(F.lit(1)).alias("n"),
    )


def score_histogram(result: DataFrame, bins: int = 40, score: str = "anomaly_score") -> DataFrame:
    """Rows per equal-width bin of the whole score range and class; the top edge belongs to the last bin."""
    ends = result.agg(F.struct(F.min(score).alias("low"), F.max(score).alias("high"))).scalar()
    low, high = ends["low"], ends["high"]
    width = (high - low) / F.lit(bins)
    place = F.floor(F.coalesce(F.try_divide(F.col(score) - low, width), F.lit(0.0)))
    return (
        result.groupBy(F.least(place, F.lit(bins - 1)).cast("int").alias("bin"), "is_anomaly")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("bin_start", low + F.col("bin") * width)
    )


def align_series(df: DataFrame, series: str, names: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Lay series side by side by position: ``pos`` and one column a series, short ones padded with null."""
    chosen = df.filter(F.col(series).isin(list(names)))
    placed = with_running(chosen, [F.col(c) for c in order], [series], sums={"_nth": F.lit(1)})
    return (
        placed.withColumn("pos", F.col("_nth") - 1)
        .groupBy("pos")
        .pivot(series, list(names))
        .agg(F.max(value))  # one row a position and series
    )
