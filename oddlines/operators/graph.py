"""Similarity graph of the most frequent templates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from oddlines.functions.stopwords import english_stop_words
from oddlines.functions.text import shorten
from oddlines.operators.features import corpus_counts, stopped_rows, term_counts
from oddlines.operators.reports import top_templates

# Look of a node and of an edge.
BASE_SIZE, SIZE_STEP, SIZE_CAP = 10.0, 1.5, 25.0
ANOMALY = ("#FF6B6B", "🔴 ANOMALIA")
NORMAL = ("#1BBB06", "🟢 NORMAL")
MIN_SIMILARITY = 0.05
EDGE_SCALE = 8.0


def graph_nodes(result: DataFrame, text: str | None = None, per_class: int = 100) -> DataFrame:
    """Nodes ``id``, ``text``, ``freq``, ``is_anomaly``, ``size``, ``label``, ``title``, ``color``.

    Anomalous templates come first, each class by frequency; a text of both
    classes is two nodes. There are ``2 * per_class`` nodes at most.
    """
    top = top_templates(result, text, per_class)
    number = F.row_number().over(W.orderBy(F.desc("is_anomaly"), "rank")) - 1
    status = F.when(F.col("is_anomaly"), ANOMALY[1]).otherwise(NORMAL[1])
    return top.select(
        number.alias("id"),
        "text",
        "freq",
        "is_anomaly",
        F.least(F.lit(BASE_SIZE) + F.sqrt("freq") * F.lit(SIZE_STEP), F.lit(SIZE_CAP)).alias("size"),
        shorten(F.col("text")).alias("label"),
        F.concat(
            status, F.lit("\n\nLog Completo:\n"), "text", F.lit("\n\nOcorrências: "), F.col("freq").cast("string")
        ).alias("title"),
        F.when(F.col("is_anomaly"), ANOMALY[0]).otherwise(NORMAL[0]).alias("color"),
    )


def similarity_edges(nodes: DataFrame, stop_words: Sequence[str] | None = None) -> DataFrame:
    """Edges ``i`` < ``j`` between nodes whose TF-IDF cosine exceeds 0.05.

    Nodes meet through the terms they share. The node list is bounded by the
    number of templates shown, which bounds the pairs as well.
    """
    rows = stopped_rows(nodes, ["id"], "text", stop_words or english_stop_words())
    counts = term_counts(rows, ["id"])
    n = nodes.agg(F.count(F.lit(1))).scalar()
    idf = corpus_counts(counts).select("term", (F.log((1 + n) / (1 + F.col("df"))) + 1).alias("idf"))
    raw = counts.join(idf, "term").select("id", "term", (F.col("tf") * F.col("idf")).alias("x"))
    length = F.sqrt(F.sum(F.col("x") * F.col("x")).over(W.partitionBy("id")))
    weights = raw.select("id", "term", (F.col("x") / length).alias("w"))
    left = weights.select(F.col("id").alias("i"), "term", F.col("w").alias("wi"))
    right = weights.select(F.col("id").alias("j"), "term", F.col("w").alias("wj"))
    return (
        left.join(right, (left["term"] == right["term"]) & (F.col("i") < F.col("j")))
        .groupBy("i", "j")
        .agg(F.sum(F.col("wi") * F.col("wj")).alias("sim"))
        .filter(F.col("sim") > MIN_SIMILARITY)
        .select(
            "i",
            "j",
            "sim",
            (F.col("sim") * EDGE_SCALE).alias("weight"),
            F.concat(F.lit("Similaridade: "), F.bround(F.col("sim") * 100).cast("int").cast("string"), F.lit("%")).alias(
                "title"
            ),
        )
    )
