"""Forest, labels, metrics, top lists, graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from oddlines.functions.stopwords import english_stop_words
from oddlines.operators import decisions, features, forest, graph, metrics, reports
from oddlines.plans import detect, tables as t
from oddlines.plans.registry import CHECKS, query
from oddlines.storage import materialize, spread


def _embedding_vectors(spark, sf_dir):
    vectors = forest.dense_vectors(t.table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return vectors, vectors.select("model", F.col("vec_id").alias("row_id"), "vec_id")


@query("forest_nodes")
def forest_nodes(spark, sf_dir):
    vectors, rows = _embedding_vectors(spark, sf_dir)
    return forest.fit_forest(rows, vectors, "vec_id")


@query("isolation_scores")
def isolation_scores(spark, sf_dir):
    vectors, rows = _embedding_vectors(spark, sf_dir)
    nodes = forest.fit_forest(rows, vectors, "vec_id")
    return forest.score_vectors(vectors, nodes).select("vec_id", F.round("raw_score", 9).alias("raw_score"))


RULE_TREES, RULE_DEPTH = 8, 5


def _rule_nodes(spark, sf_dir):
    """A node table made by rule: full trees whose features, cuts and leaf sizes follow from tree and node."""
    tree, node = F.col("tree_id"), F.col("node_id")
    inner = node < 2**RULE_DEPTH - 1
    grid = spark.range(RULE_TREES * (2 ** (RULE_DEPTH + 1) - 1)).select(
        F.floor(F.col("id") / (2 ** (RULE_DEPTH + 1) - 1)).cast("int").alias("tree_id"),
        F.pmod("id", F.lit(2 ** (RULE_DEPTH + 1) - 1)).cast("int").alias("node_id"),
    )
    child = lambda step: F.when(inner, 2 * node + step).otherwise(-1).cast("int")
    return grid.select(
        F.lit("all").alias("model"), "tree_id", "node_id",
        F.when(inner, F.pmod(7 * tree + 11 * node, F.lit(64))).otherwise(-1).cast("int").alias("feature_id"),
        ((F.pmod(31 * tree + 17 * node, F.lit(41)) - 20).cast("double") / 100).alias("cut"),
        child(1).alias("left"), child(2).alias("right"),
        F.when(inner, 256).otherwise(F.pmod(tree + node, F.lit(9)) + 1).cast("long").alias("size"),
    )


def _rule_sql() -> str:
    steps = ["at0 AS (SELECT vec_id, embedding AS e, t, 0 AS node FROM embeddings, range(8) r(t))"]
    for d in range(RULE_DEPTH):
        steps.append(
            f"at{d + 1} AS (SELECT vec_id, e, t, 2 * node + CASE WHEN e[(7 * t + 11 * node) % 64 + 1]::DOUBLE"
            f" <= ((31 * t + 17 * node) % 41 - 20)::DOUBLE / 100 THEN 1 ELSE 2 END AS node FROM at{d})"
        )
    length = "CASE WHEN n = 2 THEN 1 WHEN n > 2 THEN 2 * (ln(n - 1) + 0.5772156649) - 2 * (n - 1) / n ELSE 0 END"
    return f"""WITH {", ".join(steps)},
    leaves AS (SELECT vec_id, ((t + node) % 9 + 1)::DOUBLE AS n FROM at{RULE_DEPTH}),
    norm AS (SELECT {length} AS norm FROM (SELECT 256::DOUBLE AS n))
    SELECT vec_id, round(-pow(2, -avg({RULE_DEPTH} + {length}) / any_value(norm)), 9) AS raw_score FROM leaves, norm
    GROUP BY vec_id"""


@query("forest_walk", _rule_sql())
def forest_walk(spark, sf_dir):
    """Scores of the embeddings under trees made by rule."""
    vectors, _ = _embedding_vectors(spark, sf_dir)
    scored = forest.score_vectors(vectors, _rule_nodes(spark, sf_dir))
    return scored.select("vec_id", F.round("raw_score", 9).alias("raw_score"))


@query("contamination_threshold", "SELECT round(quantile_cont(value, 0.03), 6) AS threshold FROM events")
def contamination_threshold(spark, sf_dir):
    events = t.table(spark, sf_dir, "events").select("value")
    found = decisions.contamination_threshold(events, 0.03, score="value")
    return found.select(F.round("threshold", 6).alias("threshold"))


@query(
    "anomaly_labels",
    f"WITH {t.SCORED} SELECT seq, round(anomaly_score, 6) AS anomaly_score, anomaly_label, is_anomaly FROM scored",
)
def anomaly_labels(spark, sf_dir):
    return t.scored_events(spark, sf_dir).select(
        "seq", F.round("anomaly_score", 6).alias("anomaly_score"), "anomaly_label", "is_anomaly"
    )


RESULT = ["file_path", "seq", "value", "cluster_id", "template", "event_clean", "anomaly_label", "is_anomaly", "anomaly_score"]


@query("detect_log_anomalies")
def detect_log_anomalies(spark, sf_dir):
    result, _ = detect.detect_log_anomalies(lambda: t.source_files(spark, sf_dir))
    return result.select(*RESULT)


@query("detect_per_source")
def detect_per_source(spark, sf_dir):
    result, _ = detect.detect_per_source(lambda: t.source_files(spark, sf_dir))
    return result.select("source_folder", *RESULT)


def document_rows(spark, sf_dir):
    """Whole documents as log rows: ``model``, ``seq``, ``combined``."""
    docs = t.table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("seq"), F.col("lang").alias("level"), "source", F.col("text").alias("event")
    )
    # fitting reads its rows several times, so they are stored once masked
    rows = features.prepare_text(spread(docs, "seq")).select(F.lit("all").alias("model"), "seq", "combined")
    return materialize(rows, "rows")


@query("score_with_saved_model")
def score_with_saved_model(spark, sf_dir):
    """A model fitted on the documents, saved, loaded and applied to the conversations."""
    from oddlines.storage import new_path

    rows = document_rows(spark, sf_dir)
    model, _ = detect.fit_text_model(rows)
    path = new_path(spark, "model")
    model.save(path)
    talks = t.table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.col("role").alias("level"), F.lit("conversations").alias("source"), F.col("text").alias("event")
    )
    new = features.prepare_text(talks).select(F.lit("all").alias("model"), "conv_id", "turn", "combined")
    scored = detect.score_with_model(new, detect.Model.load(spark, path))
    return scored.select("conv_id", "turn", "anomaly_label", "is_anomaly", F.round("anomaly_score", 9).alias("anomaly_score"))


@query(
    "split_anomalies",
    f"""WITH {t.SCORED}
    SELECT 'anomaly' AS part, seq, event FROM scored WHERE is_anomaly
    UNION ALL SELECT 'normal', seq, event FROM scored WHERE NOT is_anomaly""",
)
def split_anomalies(spark, sf_dir):
    odd, usual = decisions.split_anomalies(t.scored_events(spark, sf_dir))
    return odd.select(F.lit("anomaly").alias("part"), "seq", "event").unionByName(
        usual.select(F.lit("normal").alias("part"), "seq", "event")
    )


def _event_log(spark, sf_dir):
    return t.event_frame(spark, sf_dir).withColumnRenamed("id", "seq")


@query(
    "semi_join_anomalies",
    f"WITH {t.SCORED}, {t.EVENTS} SELECT id AS seq, status, message FROM ev WHERE id IN (SELECT seq FROM scored WHERE is_anomaly)",
)
def semi_join_anomalies(spark, sf_dir):
    odd, _ = decisions.split_anomalies(t.scored_events(spark, sf_dir))
    return decisions.rows_in(_event_log(spark, sf_dir), odd, columns=["seq", "status", "message"])


@query(
    "anti_join_normals",
    f"WITH {t.SCORED}, {t.EVENTS} SELECT id AS seq, status, message FROM ev WHERE id NOT IN (SELECT seq FROM scored WHERE is_anomaly)",
)
def anti_join_normals(spark, sf_dir):
    odd, _ = decisions.split_anomalies(t.scored_events(spark, sf_dir))
    return decisions.rows_not_in(_event_log(spark, sf_dir), odd, columns=["seq", "status", "message"])


SERIES = ["click", "error", "purchase", "signup", "view"]
_SERIES_SQL = ", ".join(f"max(CASE WHEN event_type = '{s}' THEN value END) AS {s}" for s in SERIES)


@query(
    "align_series",
    f"""SELECT pos, {_SERIES_SQL} FROM (
      SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS pos FROM events)
    GROUP BY pos""",
)
def align_series(spark, sf_dir):
    events = t.table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    return reports.align_series(events, "event_type", SERIES, ["event_id"], "value")


@query(
    "run_summary",
    f"""WITH {t.SCORED} SELECT count(*) AS total, count(*) FILTER (is_anomaly) AS anomalies,
      count(*) FILTER (NOT is_anomaly) AS normals, 3.0::DOUBLE AS contamination_pct FROM scored""",
)
def run_summary(spark, sf_dir):
    return metrics.run_summary(t.scored_events(spark, sf_dir), 0.03)


@query("class_counts", f"WITH {t.SCORED} SELECT is_anomaly, count(*) AS n FROM scored GROUP BY is_anomaly")
def class_counts(spark, sf_dir):
    return metrics.class_counts(t.scored_events(spark, sf_dir))


@query(
    "score_describe",
    f"""WITH {t.SCORED} SELECT count(anomaly_score) AS count, round(avg(anomaly_score), 6) AS mean,
      round(stddev_samp(anomaly_score), 6) AS std, round(min(anomaly_score), 6) AS min,
      round(quantile_cont(anomaly_score, 0.25), 6) AS p25, round(quantile_cont(anomaly_score, 0.5), 6) AS p50,
      round(quantile_cont(anomaly_score, 0.75), 6) AS p75, round(max(anomaly_score), 6) AS max
    FROM scored WHERE is_anomaly""",
)
def score_describe(spark, sf_dir):
    found = metrics.score_describe(t.scored_events(spark, sf_dir))
    return found.select("count", *[F.round(c, 6).alias(c) for c in ("mean", "std", "min", "p25", "p50", "p75", "max")])


_CELLS = """cells AS (SELECT count(*) FILTER (y_true AND y_pred) AS tp, count(*) FILTER (NOT y_true AND y_pred) AS fp,
  count(*) FILTER (y_true AND NOT y_pred) AS fn, count(*) FILTER (NOT y_true AND NOT y_pred) AS tn FROM judged)"""


@query(
    "classification_metrics",
    f"""WITH {t.JUDGED}, {_CELLS}
    SELECT tp, fp, fn, tn, round(coalesce(tp / nullif(tp + fp, 0), 0), 6)::DOUBLE AS precision,
      round(coalesce(tp / nullif(tp + fn, 0), 0), 6)::DOUBLE AS recall,
      round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6)::DOUBLE AS f1 FROM cells""",
)
def classification_metrics(spark, sf_dir):
    found = metrics.classification_metrics(t.judged_documents(spark, sf_dir))
    return found.select("tp", "fp", "fn", "tn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query(
    "confusion_matrix",
    f"""WITH {t.JUDGED}, {_CELLS}
    SELECT false AS y_true, false AS y_pred, tn AS n FROM cells UNION ALL SELECT false, true, fp FROM cells
    UNION ALL SELECT true, false, fn FROM cells UNION ALL SELECT true, true, tp FROM cells""",
)
def confusion_matrix(spark, sf_dir):
    return metrics.confusion_matrix(t.judged_documents(spark, sf_dir))


@query(
    "precision_at_share",
    """WITH cut AS (SELECT quantile_cont(-n_chars::DOUBLE, 0.1) AS threshold FROM documents),
    odd AS (SELECT doc_id, -n_chars - threshold AS score FROM documents, cut WHERE -n_chars - threshold < 0),
    size AS (SELECT greatest(1, floor(count(*) * 0.85))::BIGINT AS k FROM odd),
    top AS (SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY score, doc_id) AS r FROM odd), size WHERE r <= k)
    SELECT count(*) AS k, count(*) FILTER (coalesce(quality, 1) = 1) AS validated,
           round(count(*) FILTER (coalesce(quality, 1) = 1) / count(*), 6)::DOUBLE AS precision_at_k
    FROM top LEFT JOIN labels USING (doc_id) HAVING count(*) > 0""",
)
def precision_at_share(spark, sf_dir):
    verdicts = t.table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("seq"), (F.col("quality") == 1).alias("is_real_fault")
    )
    found = metrics.precision_at_share(t.scored_documents(spark, sf_dir), verdicts)
    return found.withColumn("precision_at_k", F.round("precision_at_k", 6))


@query(
    "lowest_scores",
    "SELECT event_id AS seq, -value AS raw_score FROM events ORDER BY -value, event_id LIMIT 25",
)
def lowest_scores(spark, sf_dir):
    scores = t.table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), (-F.col("value")).alias("raw_score"))
    return reports.lowest_scores(scores, 25, score="raw_score")


TOP = """ranked AS (
  SELECT *, row_number() OVER (PARTITION BY is_anomaly ORDER BY freq DESC, text) AS rank
  FROM (SELECT is_anomaly, {text} AS text, count(*) AS freq FROM {rows} GROUP BY ALL)),
top AS (SELECT is_anomaly, text, freq, rank::INTEGER AS rank FROM ranked WHERE rank <= 100)"""


@query(
    "top_templates",
    f"WITH {t.SCORED}, {TOP.format(text='event', rows='scored')} SELECT is_anomaly, text, freq, rank FROM top",
)
def top_templates(spark, sf_dir):
    return reports.top_templates(t.scored_events(spark, sf_dir))


@query("latest_rows", f"WITH {t.SCORED} SELECT seq, event, is_anomaly FROM scored ORDER BY seq DESC LIMIT 500")
def latest_rows(spark, sf_dir):
    return reports.latest_rows(t.scored_events(spark, sf_dir).select("seq", "event", "is_anomaly"))


@query("score_timeline", f"WITH {t.SCORED} SELECT seq, round(anomaly_score, 6) AS anomaly_score, is_anomaly FROM scored")
def score_timeline(spark, sf_dir):
    return reports.score_timeline(t.scored_events(spark, sf_dir)).withColumn("anomaly_score", F.round("anomaly_score", 6))


@query(
    "score_timeline_bands",
    f"""WITH {t.SCORED} SELECT seq // 1000 AS point, is_anomaly, round(min(anomaly_score), 6) AS low,
      round(avg(anomaly_score), 6) AS mean, round(max(anomaly_score), 6) AS high, count(*) AS n
    FROM scored GROUP BY ALL""",
)
def score_timeline_bands(spark, sf_dir):
    bands = reports.score_timeline_bands(t.scored_events(spark, sf_dir), 1000)
    return bands.withColumns({c: F.round(c, 6) for c in ("low", "mean", "high")})


@query(
    "score_histogram",
    f"""WITH {t.SCORED}, ends AS (SELECT min(raw_score) AS low, max(raw_score) AS high FROM scored)
    SELECT least(floor((raw_score - low) / ((high - low) / 40)), 39)::INTEGER AS bin, is_anomaly, count(*) AS n,
           round(low + least(floor((raw_score - low) / ((high - low) / 40)), 39) * ((high - low) / 40), 6) AS bin_start
    FROM scored, ends GROUP BY ALL""",
)
def score_histogram(spark, sf_dir):
    bars = reports.score_histogram(t.scored_events(spark, sf_dir), 40, score="raw_score")
    return bars.withColumn("bin_start", F.round("bin_start", 6))


NODES = (
    TOP.format(text="template", rows="flagged")
    + r""",
folded AS (
  SELECT *, (row_number() OVER (ORDER BY is_anomaly DESC, rank) - 1)::INTEGER AS id,
         trim(regexp_replace(text, '[\s\x0b\x1c-\x1f\x85\p{Z}]+', ' ', 'g')) AS flat FROM top),
nodes AS (
  SELECT id, text, freq, is_anomaly, least(10 + sqrt(freq) * 1.5, 25) AS size,
         CASE WHEN length(flat) <= 40 THEN flat
              ELSE rtrim(regexp_extract(flat, '^(.{0,37})(?:\s|$)', 1)) || '...' END AS label,
         CASE WHEN is_anomaly THEN '🔴 ANOMALIA' ELSE '🟢 NORMAL' END || chr(10) || chr(10) || 'Log Completo:' || chr(10)
           || text || chr(10) || chr(10) || 'Ocorrências: ' || freq::VARCHAR AS title,
         CASE WHEN is_anomaly THEN '#FF6B6B' ELSE '#1BBB06' END AS color
  FROM folded)"""
)


@query(
    "graph_nodes",
    f"WITH {t.FLAGGED}, {NODES} SELECT id, text, freq, is_anomaly, round(size, 6) AS size, label, title, color FROM nodes",
)
def graph_nodes(spark, sf_dir):
    return graph.graph_nodes(t.flagged_lines(spark, sf_dir)).withColumn("size", F.round("size", 6))


@query("similarity_edges")
def similarity_edges(spark, sf_dir):
    """Edges between the graph's nodes over all document lines."""
    nodes = materialize(graph.graph_nodes(t.flagged_lines(spark, sf_dir)), "nodes")
    edges = graph.similarity_edges(nodes)
    return edges.select("i", "j", F.round("sim", 6).alias("sim"), F.round("weight", 5).alias("weight"), "title")


def edges_sql() -> str:
    stops = ", ".join(f"'{w}'" for w in english_stop_words())
    return rf"""WITH {t.FLAGGED}, {NODES},
    words AS (SELECT id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]{{2,}}')) AS term FROM nodes),
    tf AS (SELECT id, term, count(*) AS tf FROM words WHERE term NOT IN ({stops}) GROUP BY ALL),
    idf AS (SELECT term, ln((1 + (SELECT count(*) FROM nodes))::DOUBLE / (1 + count(*))) + 1 AS idf FROM tf GROUP BY term),
    raw AS (SELECT id, term, tf * idf AS x FROM tf JOIN idf USING (term)),
    w AS (SELECT id, term, x / sqrt(sum(x * x) OVER (PARTITION BY id)) AS w FROM raw),
    pairs AS (SELECT a.id AS i, b.id AS j, sum(a.w * b.w) AS sim FROM w a JOIN w b ON a.term = b.term AND a.id < b.id
              GROUP BY ALL)
    SELECT i, j, round(sim, 6) AS sim, round(sim * 8, 5) AS weight,
           'Similaridade: ' || round_even(sim * 100, 0)::INTEGER::VARCHAR || '%' AS title
    FROM pairs WHERE sim > 0.05"""


CHECKS["similarity_edges"] = edges_sql()
