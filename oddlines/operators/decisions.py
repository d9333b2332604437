"""From raw scores to labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from oddlines.operators.ordering import percentiles

CONTAMINATION = 0.02


def contamination_threshold(
    scores: DataFrame,
    contamination: float = CONTAMINATION,
    score: str = "raw_score",
    freq: str | None = None,
    group: Sequence[str] = (),
) -> DataFrame:
    """Score below which the ``contamination`` share of rows lies: ``group``, ``threshold``."""
    return percentiles(scores, score, [contamination], freq, group).select(
        *group, F.col("percentile").alias("threshold")
    )


def label_scores(scored: DataFrame, threshold: Column, score: str = "raw_score") -> DataFrame:
    """Add ``anomaly_score`` (score above threshold), ``anomaly_label`` (-1 or 1), ``is_anomaly``."""
    return (
        scored.withColumn("anomaly_score", F.col(score) - threshold)
        .withColumn("anomaly_label", F.when(F.col("anomaly_score") < 0, -1).otherwise(1))
        .withColumn("is_anomaly", F.col("anomaly_label") == -1)
    )


def split_anomalies(result: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The anomalous rows and the others."""
    return result.filter("is_anomaly"), result.filter(~F.col("is_anomaly"))


def rows_in(df: DataFrame, chosen: DataFrame, key: str = "seq", columns: Sequence[str] | None = None) -> DataFrame:
    """Rows whose key is among the chosen ones."""
    return project_existing(df.join(chosen.select(key), key, "left_semi"), columns)


def rows_not_in(df: DataFrame, chosen: DataFrame, key: str = "seq", columns: Sequence[str] | None = None) -> DataFrame:
    """Rows whose key is not among the chosen ones."""
    return project_existing(df.join(chosen.select(key), key, "left_anti"), columns)


def project_existing(df: DataFrame, columns: Sequence[str] | None) -> DataFrame:
    """Those of the listed columns that exist; all of them for no list."""
    return df if columns is None else df.select(*[c for c in columns if c in df.columns])
