"""Run summaries and quality measures."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from oddlines.operators.ordering import lowest_rows, percentiles

TOP_SHARE = 0.85


def run_summary(result: DataFrame, contamination: float) -> DataFrame:
    """Total, anomalous and normal rows, and the contamination as a percentage."""
    return result.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("is_anomaly").alias("anomalies"),
        F.count_if(~F.col("is_anomaly")).alias("normals"),
    ).withColumn("contamination_pct", F.lit(contamination * 100))


def class_counts(result: DataFrame) -> DataFrame:
    return result.groupBy("is_anomaly").agg(F.count(F.lit(1)).alias("n"))


def score_describe(result: DataFrame, score: str = "anomaly_score") -> DataFrame:
    """Count, mean, sample deviation, extremes and exact quartiles of the anomalous rows' scores."""
    scores = result.filter("is_anomaly").select(F.col(score).alias("_score"))
    quartiles = percentiles(scores, "_score", [0.25, 0.5, 0.75])

    def quartile(fraction: float):
        return quartiles.filter(F.col("fraction") == fraction).select("percentile").scalar()

    return scores.agg(
        F.count("_score").alias("count"),
        F.avg("_score").alias("mean"),
        F.stddev_samp("_score").alias("std"),
        F.min("_score").alias("min"),
        F.max("_score").alias("max"),
    ).select(
        "count", "mean", "std", "min",
        quartile(0.25).alias("p25"), quartile(0.5).alias("p50"), quartile(0.75).alias("p75"),
        "max",
    )


def classification_metrics(labelled: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    """Precision, recall and F1 of boolean columns, 0 where undefined."""
    true, pred = F.col(y_true), F.col(y_pred)
    counts = labelled.agg(
        F.count_if(true & pred).alias("tp"),
        F.count_if(~true & pred).alias("fp"),
        F.count_if(true & ~pred).alias("fn"),
        F.count_if(~true & ~pred).alias("tn"),
    )

    def ratio(top, bottom):
        return F.coalesce(F.try_divide(top.cast("double"), bottom.cast("double")), F.lit(0.0))

    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.select(
        "*",
        ratio(tp, tp + fp).alias("precision"),
        ratio(tp, tp + fn).alias("recall"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )


def confusion_matrix(labelled: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    """All four cells ``y_true``, ``y_pred``, ``n``, empty ones included."""
    metrics = classification_metrics(labelled, y_true, y_pred)
    cells = [(False, False, "tn"), (False, True, "fp"), (True, False, "fn"), (True, True, "tp")]
    rows = F.array(
        *[F.struct(F.lit(t).alias("y_true"), F.lit(p).alias("y_pred"), F.col(c).alias("n")) for t, p, c in cells]
    )
    return metrics.select(F.inline(rows))


def top_share(result: DataFrame, share: float = TOP_SHARE, score: str = "anomaly_score", key: str = "seq") -> DataFrame:
    """The lowest-scored part of the anomalous rows: at least one, ``floor(share * n)``."""
    anomalies = result.filter("is_anomaly")
    k = F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) * F.lit(share)))
    return lowest_rows(anomalies, [score, key], anomalies.agg(k).scalar())


def precision_at_share(
    result: DataFrame, verdicts: DataFrame, share: float = TOP_SHARE, score: str = "anomaly_score", key: str = "seq"
) -> DataFrame:
    """Share of the top rows that experts confirm; rows without a verdict count as confirmed.

    No anomalies give no row.
    """
    top = top_share(result, share, score, key).select(key)
    judged = top.join(verdicts.select(key, "is_real_fault"), key, "left")
    confirmed = F.count_if(F.coalesce("is_real_fault", F.lit(True)))
    return (
        judged.agg(F.count(F.lit(1)).alias("k"), confirmed.alias("validated"))
        .filter("k > 0")
        .select("k", "validated", (F.col("validated") / F.col("k")).alias("precision_at_k"))
    )
