"""Frames of the library's shapes out of the test tables, in Spark and in SQL.

Every frame covers its whole table. The SQL twins are CTEs that the queries'
checking statements start from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from oddlines.functions.text import split_lines, strip_blanks
from oddlines.operators.experiments import duration_seconds

# The three fault experiments and how long each runs.
EXPERIMENTS = (
    ("01-pod-kill.yaml", "podchaos/pod-kill-demo", "30s"),
    ("02-network-delay.yaml", "networkchaos/network-delay-demo", "60s"),
    ("03-cpu-stress.yaml", "stresschaos/cpu-stress-demo", "45s"),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, pod, type, message, status, latency, ts."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.concat(F.lit("pod-"), F.col("user_id").cast("string")).alias("pod"),
        F.col("event_type").alias("type"),
        F.concat_ws(" ", "event_type", "props").alias("message"),
        F.when(F.col("event_type") == "error", "error").when(F.col("value") > 100, "warn").otherwise("ok").alias("status"),
        (F.col("value") / 1000).alias("latency"),
        "ts",
    )


EVENTS = """ev AS (
  SELECT event_id AS id, 'pod-' || user_id::VARCHAR AS pod, event_type AS type,
         event_type || ' ' || props AS message,
         CASE WHEN event_type = 'error' THEN 'error' WHEN value > 100 THEN 'warn' ELSE 'ok' END AS status,
         value / 1000 AS latency, ts
  FROM events)"""


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, lang, source_folder, pos, value: the stripped, non-blank lines of all documents."""
    physical = table(spark, sf_dir, "documents").select(
        "doc_id", "lang", F.col("source").alias("source_folder"),
        F.posexplode(split_lines(F.col("text"))).alias("pos", "value"),
    )
    return physical.withColumn("value", strip_blanks(F.col("value"))).filter("value <> ''")


SQL_SPACE = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"
SQL_WORD = r"[\p{L}\p{N}_]"
SQL_NOT_WORD = r"[^\p{L}\p{N}_]"

# numbering of physical lines starts at 0, as posexplode does
LINES = rf"""physical AS (
  SELECT doc_id, lang, source AS source_folder,
         unnest(string_split_regex(text, '\r\n|\n|\r')) AS line,
         unnest(range(len(string_split_regex(text, '\r\n|\n|\r')))) AS pos
  FROM documents),
lines AS (
  SELECT doc_id, lang, source_folder, pos, value
  FROM (SELECT *, regexp_replace(line, '^{SQL_SPACE}+|{SQL_SPACE}+$', '', 'g') AS value FROM physical)
  WHERE value <> '')"""


def source_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file_path, source_folder, doc_id, seq, value: each source as one file, documents appended in id order.

    Lines are numbered from the line counts of the documents before, so only
    one narrow row a document is ordered.
    """
    from oddlines.operators.ordering import with_running
    from oddlines.storage import materialize, spread

    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    kept = F.filter(F.transform(split_lines(F.col("text")), strip_blanks), lambda line: line != "")
    counts = materialize(docs.select("doc_id", "source", F.size(kept).alias("n")), "documents")
    placed = with_running(counts, [F.col("doc_id")], ["source"], sums={"_before": F.col("n")}, include_current=False)
    # texts are moved whole and taken apart where they meet their numbers
    texts = spread(docs, "doc_id").join(placed.select("doc_id", "_before"), "doc_id")
    numbered = texts.select("doc_id", "source", "_before", F.posexplode(kept).alias("pos", "value"))
    return materialize(
        numbered.select(
            F.col("source").alias("file_path"), F.col("source").alias("source_folder"), "doc_id",
            (F.col("_before") + F.col("pos")).alias("seq"), "value",
        ),
        "files",
    )


def scored_events(spark: SparkSession, sf_dir: str, contamination: float = 0.03) -> DataFrame:
    """seq, event, value, raw_score, anomaly_score, anomaly_label, is_anomaly: high values are unusual."""
    from oddlines.operators.decisions import contamination_threshold, label_scores

    rows = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"),
        F.col("event_type").alias("source_folder"),
        F.concat_ws(" ", "event_type", "props").alias("event"),
        "ts",
        (-F.col("value")).alias("raw_score"),
    )
    threshold = contamination_threshold(rows, contamination).scalar()
    return label_scores(rows, threshold)


SCORED = """cut AS (SELECT quantile_cont(-value, 0.03) AS threshold FROM events),
scored AS (
  SELECT event_id AS seq, event_type AS source_folder, event_type || ' ' || props AS event, ts,
         -value AS raw_score, -value - threshold AS anomaly_score,
         CASE WHEN -value - threshold < 0 THEN -1 ELSE 1 END AS anomaly_label,
         -value - threshold < 0 AS is_anomaly
  FROM events, cut)"""


def format_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, value: one raw line an event, in the four known formats in turn and one unknown."""
    k = F.regexp_extract("props", r"(\d+)", 1)
    apache = F.concat(
        F.lit("["), F.date_format("ts", "EEE MMM dd HH:mm:ss yyyy"), F.lit("] ["), "event_type",
        F.lit("] client 10.0.0."), F.col("user_id").cast("string"), F.lit(" code "), k,
    )
    syslog = F.concat(
        F.date_format("ts", "MMM dd HH:mm:ss"), F.lit(" combo sshd(pam_unix)["), F.col("event_id").cast("string"),
        F.lit("]: "), "event_type", F.lit(" failed uid="), F.col("user_id").cast("string"),
    )
    spark_line = F.concat(
        F.date_format("ts", "yy/MM/dd HH:mm:ss"), F.lit(" WARN storage."), "event_type", F.lit(": block "), k,
        F.lit(" lost"),
    )
    json_line = F.concat(
        F.lit('x {"message":"14 '), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(" h1 api "),
        F.col("user_id").cast("string"), F.lit(" - - "), "event_type", F.lit(' failed"}'),
    )
    other = F.concat(F.lit("plain text "), k)
    turn = F.col("event_id") % 5
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.when(turn == 0, apache).when(turn == 1, syslog).when(turn == 2, spark_line).when(turn == 3, json_line)
        .otherwise(other).alias("value"),
    )


FORMAT_LINES = r"""fl AS (
  SELECT event_id AS id, CASE event_id % 5
    WHEN 0 THEN '[' || strftime(ts, '%a %b %d %H:%M:%S %Y') || '] [' || event_type || '] client 10.0.0.'
                || user_id::VARCHAR || ' code ' || regexp_extract(props, '(\d+)', 1)
    WHEN 1 THEN strftime(ts, '%b %d %H:%M:%S') || ' combo sshd(pam_unix)[' || event_id::VARCHAR || ']: '
                || event_type || ' failed uid=' || user_id::VARCHAR
    WHEN 2 THEN strftime(ts, '%y/%m/%d %H:%M:%S') || ' WARN storage.' || event_type || ': block '
                || regexp_extract(props, '(\d+)', 1) || ' lost'
    WHEN 3 THEN 'x {"message":"14 ' || strftime(ts, '%Y-%m-%dT%H:%M:%SZ') || ' h1 api ' || user_id::VARCHAR
                || ' - - ' || event_type || ' failed"}'
    ELSE 'plain text ' || regexp_extract(props, '(\d+)', 1) END AS value
  FROM events)"""


def app_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, value: application log lines of both bodies, every second one with the collector's time in front."""
    stamp = F.date_format("ts", "yyyy-MM-dd HH:mm:ss,SSS")
    collected = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z "))
    insert = F.concat(
        F.lit("[DB INSERT] type="), "event_type", F.lit(" status=ok msg=user "), F.col("user_id").cast("string")
    )
    millis = F.lpad((F.col("user_id") % 1000).cast("string"), 3, "0")
    request = F.concat(F.lit("GET /api/"), "event_type", F.lit(" → 200 (0."), millis, F.lit("s)"))
    even = F.col("event_id") % 2 == 0
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.concat(
            F.when(even, collected).otherwise(""), stamp, F.lit(" [INFO] "),
            F.when(F.col("event_id") % 3 == 0, request).otherwise(insert),
        ).alias("value"),
    )


APP_LINES = """al AS (
  SELECT event_id AS id,
    CASE WHEN event_id % 2 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ ') ELSE '' END
    || strftime(ts, '%Y-%m-%d %H:%M:%S,%g') || ' [INFO] '
    || CASE WHEN event_id % 3 = 0
         THEN 'GET /api/' || event_type || ' → 200 (0.' || lpad((user_id % 1000)::VARCHAR, 3, '0') || 's)'
         ELSE '[DB INSERT] type=' || event_type || ' status=ok msg=user ' || user_id::VARCHAR END AS value
  FROM events)"""


def marker_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, value: signups as experiment starts, purchases as ends, all other events as other lines."""
    which = F.col("user_id") % 3
    named = F.when(which == 0, F.lit(" file={} resource={}".format(*EXPERIMENTS[0][:2])))
    named = named.when(which == 1, F.lit(" file={} resource={}".format(*EXPERIMENTS[1][:2])))
    named = named.otherwise(F.lit(" file={} resource={}".format(*EXPERIMENTS[2][:2])))
    word = (
        F.when(F.col("event_type") == "signup", "EXPERIMENT_START")
        .when(F.col("event_type") == "purchase", "EXPERIMENT_END")
        .otherwise(F.col("event_type"))
    )
    stamp = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.concat(F.lit("["), stamp, F.lit("] "), word, named).alias("value")
    )


MARKERS = """marks AS (
  SELECT event_id AS id, date_trunc('second', ts) AS ts,
         CASE event_type WHEN 'signup' THEN 'start' ELSE 'end' END AS kind,
         CASE user_id % 3 WHEN 0 THEN '01-pod-kill.yaml' WHEN 1 THEN '02-network-delay.yaml'
                          ELSE '03-cpu-stress.yaml' END AS file,
         CASE user_id % 3 WHEN 0 THEN 'podchaos/pod-kill-demo' WHEN 1 THEN 'networkchaos/network-delay-demo'
                          ELSE 'stresschaos/cpu-stress-demo' END AS resource
  FROM events WHERE event_type IN ('signup', 'purchase'))"""

WINDOWS = MARKERS + """,
wins AS (
  SELECT id, resource, file, ts AS start_ts,
         coalesce(next_end, ts + to_seconds(CASE file WHEN '01-pod-kill.yaml' THEN 30
                                            WHEN '02-network-delay.yaml' THEN 60 ELSE 45 END)) AS end_ts
  FROM (SELECT *, first_value(CASE WHEN kind = 'end' THEN ts END IGNORE NULLS) OVER (
          PARTITION BY resource ORDER BY ts, id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_end
        FROM marks)
  WHERE kind = 'start')"""


def planned_seconds():
    """Planned duration of a marker's experiment."""
    texts = F.create_map(*[F.lit(x) for file, _, text in EXPERIMENTS for x in (file, text)])
    return duration_seconds(F.element_at(texts, F.col("file")))


def judged_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, y_true, y_pred: known toxicity against a rule on text length."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    return docs.join(labels, "doc_id").select(
        "doc_id", (F.col("toxic") == 1).alias("y_true"), (F.col("n_chars") > 2000).alias("y_pred")
    )


JUDGED = """judged AS (
  SELECT doc_id, toxic = 1 AS y_true, n_chars > 2000 AS y_pred FROM documents JOIN labels USING (doc_id))"""


def scored_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, anomaly_score, is_anomaly: long documents are unusual."""
    from oddlines.operators.decisions import contamination_threshold, label_scores

    rows = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("seq"), (-F.col("n_chars")).cast("double").alias("raw_score")
    )
    return label_scores(rows, contamination_threshold(rows, 0.1).scalar())


def flagged_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """is_anomaly, template: document lines with numbers masked, lines of English documents as anomalies."""
    from oddlines.functions.text import mask_tokens

    return document_lines(spark, sf_dir).select(
        (F.col("lang") == "en").alias("is_anomaly"), mask_tokens(F.col("value")).alias("template")
    )


def sql_mask(text: str, legacy: bool = False) -> str:
    """SQL twin of the mask functions. The dialect has no look-around, so bounded patterns run twice."""
    tag = (lambda t: f"<{t}>") if legacy else (lambda t: f"TAG_{t}")
    out = f"regexp_replace({text}, '0x[0-9a-fA-F]+', '{tag('HEX')}', 'g')"
    if legacy:
        out = rf"regexp_replace({out}, '\p{{Nd}}+\.\p{{Nd}}+\.\p{{Nd}}+\.\p{{Nd}}+', '{tag('IP')}', 'g')"
        bounded = [(r"\p{Nd}+", tag("NUM"))]
    else:
        bounded = [(r"\p{Nd}{1,3}(?:\.\p{Nd}{1,3}){3}", tag("IP")), (r"\p{Nd}+", tag("NUM"))]
    for pattern, name in bounded:
        for _ in range(2):
            out = rf"regexp_replace({out}, '(^|{SQL_NOT_WORD}){pattern}($|{SQL_NOT_WORD})', '\1{name}\2', 'g')"
    return f"lower({out})"


FLAGGED = f"""{LINES},
flagged AS (SELECT lang = 'en' AS is_anomaly, {sql_mask('value')} AS template FROM lines)"""
