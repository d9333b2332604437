"""Reading, writing and parsing lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from oddlines.functions import formats
from oddlines.functions.text import mask_tokens, split_lines, strip_blanks, template_parameters
from oddlines.operators import reports, templates
from oddlines.plans import tables as t
from oddlines.plans.registry import query
from oddlines.sources import lines as src, results
from oddlines.storage import new_path


@query(
    "read_log_lines",
    f"""WITH {t.LINES}
    SELECT source_folder, value, count(*) AS n FROM lines GROUP BY ALL""",
)
def read_log_lines(spark, sf_dir):
    """Documents written as text files, one folder a source, and read back as lines."""
    root = new_path(spark, "logs")
    t.table(spark, sf_dir, "documents").select("source", "text").write.partitionBy("source").text(root)
    sources = [r[0] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("source").distinct().collect()]
    lines = src.read_log_lines(spark, [f"{root}/source={s}" for s in sources] + [f"{root}/absent"])
    named = src.strip_blank_lines(lines).withColumn(
        "source_folder", F.regexp_replace("source_folder", "^.*/source=", "")
    )
    return named.groupBy("source_folder", "value").agg(F.count(F.lit(1)).alias("n"))


@query(
    "union_sources",
    f"""WITH {t.EVENTS}
    SELECT 'events' AS source_folder, message AS value FROM ev
    UNION ALL SELECT 'documents', text FROM documents
    UNION ALL SELECT 'conversations', text FROM conversations""",
)
def union_sources(spark, sf_dir):
    return src.union_sources(
        {
            "events": t.event_frame(spark, sf_dir).select(F.col("message").alias("value")),
            "documents": t.table(spark, sf_dir, "documents").select(F.col("text").alias("value")),
            "conversations": t.table(spark, sf_dir, "conversations").select(F.col("text").alias("value")),
        }
    ).select("source_folder", "value")


@query(
    "select_sources",
    """SELECT doc_id, source AS source_folder, n_chars FROM documents WHERE source IN ('src1', 'src4', 'src9')""",
)
def select_sources(spark, sf_dir):
    docs = t.table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("source_folder"), "n_chars")
    return src.select_sources(docs, ["src1", "src4", "src9"])


@query("strip_blank_lines", f"WITH {t.LINES} SELECT doc_id, pos::INTEGER AS pos, value FROM lines")
def strip_blank_lines(spark, sf_dir):
    physical = t.table(spark, sf_dir, "documents").select(
        "doc_id", F.posexplode(split_lines(F.col("text"))).alias("pos", "value")
    )
    return src.strip_blank_lines(physical)


@query(
    "global_sequence",
    f"""WITH {t.LINES}
    SELECT doc_id, pos::INTEGER AS pos, row_number() OVER (ORDER BY doc_id, pos) - 1 AS seq FROM lines""",
)
def global_sequence(spark, sf_dir):
    lines = t.document_lines(spark, sf_dir).select("doc_id", "pos")
    return src.global_sequence(lines, ["doc_id", "pos"])


@query(
    "csv_round_trip",
    f"""WITH {t.SCORED}
    SELECT seq, source_folder, event, anomaly_label, is_anomaly, round(anomaly_score, 6) AS anomaly_score,
           '["' || source_folder || '"]' AS parameters
    FROM scored""",
)
def csv_round_trip(spark, sf_dir):
    rows = t.scored_events(spark, sf_dir).select(
        "seq", "source_folder", "event", "anomaly_label", "is_anomaly", F.round("anomaly_score", 6).alias("anomaly_score"),
        F.array("source_folder").alias("parameters"),
    )
    path = results.write_results_csv(rows, new_path(spark, "results"))
    return results.read_results_csv(
        spark, path,
        "seq long, source_folder string, event string, anomaly_label int, is_anomaly boolean,"
        " anomaly_score double, parameters string",
    )


@query(
    "append_events",
    """SELECT row_number() OVER (ORDER BY event_id) AS id, 'pod-' || user_id::VARCHAR AS pod, event_type AS type,
      props AS message, CASE WHEN event_type = 'error' THEN 'error' ELSE 'ok' END AS status,
      CASE WHEN value > 100 THEN 0.0 ELSE floor(value / 1000 * 10000 + 0.5) / 10000 END AS latency, ts
    FROM events""",
)
def append_events(spark, sf_dir):
    """Events without status or with no known latency take the defaults."""
    rows = t.table(spark, sf_dir, "events").select(
        "event_id",
        F.concat(F.lit("pod-"), F.col("user_id").cast("string")).alias("pod"),
        F.col("event_type").alias("type"),
        F.col("props").alias("message"),
        F.when(F.col("event_type") == "error", "error").alias("status"),
        F.when(F.col("value") <= 100, F.col("value") / 1000).alias("latency"),
        "ts",
    )
    return results.append_events(rows, new_path(spark, "events"), ["event_id"])


@query(
    "route_records",
    """SELECT id, tag, record, CASE WHEN tag LIKE 'docker.syslog%' THEN 'logspout-capture' END AS service_name
    FROM (SELECT event_id AS id, props AS record,
            CASE event_type WHEN 'error' THEN 'docker.syslog.err' WHEN 'click' THEN 'docker.syslog'
              WHEN 'view' THEN 'docker.api' WHEN 'signup' THEN 'dockerless' ELSE 'host.purchase' END AS tag FROM events)
    WHERE tag LIKE 'docker.%'""",
)
def route_records(spark, sf_dir):
    kind = F.col("event_type")
    tag = (
        F.when(kind == "error", "docker.syslog.err").when(kind == "click", "docker.syslog")
        .when(kind == "view", "docker.api").when(kind == "signup", "dockerless").otherwise("host.purchase")
    )
    records = t.table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), tag.alias("tag"), F.col("props").alias("record")
    )
    return results.route_records(records)


@query("mine_templates")
def mine_templates(spark, sf_dir):
    return templates.mine_templates(t.source_files(spark, sf_dir)).select(
        "file_path", "seq", "value", "cluster_id", "template"
    )


@query("mine_templates_skeleton")
def mine_templates_skeleton(spark, sf_dir):
    """Mining of the distinct masked lines only, last form of each template."""
    return templates.mine_templates(t.source_files(spark, sf_dir), mode="skeleton", final=True).select(
        "file_path", "seq", "value", "cluster_id", "template"
    )


@query(
    "template_parameters",
    r"""SELECT event_id AS id, event_type || ' user <*> sent <*>' AS template,
      '["' || user_id::VARCHAR || '","' || regexp_extract(props, '(\d+)', 1) || '"]' AS parameters
    FROM events""",
)
def parameters(spark, sf_dir):
    user, k = F.col("user_id").cast("string"), F.regexp_extract("props", r"(\d+)", 1)
    rows = t.table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.concat("event_type", F.lit(" user "), user, F.lit(" sent "), k).alias("line"),
        F.concat("event_type", F.lit(" user <*> sent <*>")).alias("template"),
    )
    found = template_parameters(F.col("line"), F.col("template"))
    return rows.select("id", "template", F.to_json(found).alias("parameters"))


@query(
    "parse_summary",
    f"""WITH {t.LINES}
    SELECT source_folder AS file_path, count(*) AS lines, count(DISTINCT {t.sql_mask('value')}) AS clusters
    FROM lines GROUP BY source_folder""",
)
def parse_summary(spark, sf_dir):
    lines = t.document_lines(spark, sf_dir).select(
        F.col("source_folder").alias("file_path"), mask_tokens(F.col("value")).alias("cluster_id")
    )
    return templates.parse_summary(lines)


@query(
    "preview_rows",
    """SELECT doc_id AS seq, source, n_chars FROM documents ORDER BY doc_id LIMIT 5""",
)
def preview_rows(spark, sf_dir):
    docs = t.table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "seq")
    return reports.preview_rows(docs, ["seq", "source", "n_chars", "no_such_column"])


def _format_sql(pattern: str, date: str, level: str, source: str, event: str) -> str:
    return f"""WITH {t.FORMAT_LINES}
    SELECT id, {date} AS date, {level} AS level, {source} AS source, {event} AS event
    FROM fl WHERE regexp_matches(value, '{pattern}')"""


def _ext(pattern: str, group: int) -> str:
    return f"regexp_extract(value, '{pattern}', {group})"


# the SQL twins spell the patterns out once more, in the other dialect
# The line formats, spelled for DuckDB.
_APACHE = r"^\[([^\]]+)\]\s+\[([^\]]+)\]\s+(.*)$"
_SYSLOG = r"^([A-Za-z]{3}\s+\d{2}\s+\d{2}:\d{2}:\d{2})\s+[\w+:]+\s+([^\[\]]+)\[.*?\]: (.*)$"
_SPARK = r"^(\d{2}/\d{2}/\d{2}\s+\d{2}:\d{2}:\d{2})\s+(\w+)\s+([^:]+):\s+(.*)$"
_JSON = r'"message":"\d+\s+(\S+)\s+(\S+)\s+(\S+)\s+(\d+)\s+-\s+-\s+(.*?)"'
_JSON_EVENT = f"{_ext(_JSON, 4)} || ' ' || {_ext(_JSON, 5)}"


@query("parse_apache", _format_sql(_APACHE, _ext(_APACHE, 1), _ext(_APACHE, 2), "'apache'", _ext(_APACHE, 3)))
def parse_apache(spark, sf_dir):
    return _one_format(spark, sf_dir, "apache")


@query("parse_syslog", _format_sql(_SYSLOG, _ext(_SYSLOG, 1), "'info'", _ext(_SYSLOG, 2), _ext(_SYSLOG, 3)))
def parse_syslog(spark, sf_dir):
    return _one_format(spark, sf_dir, "syslog")


@query("parse_sparklog", _format_sql(_SPARK, *[_ext(_SPARK, i) for i in (1, 2, 3, 4)]))
def parse_sparklog(spark, sf_dir):
    return _one_format(spark, sf_dir, "spark")


@query("parse_json_syslog", _format_sql(_JSON, _ext(_JSON, 1), "''", _ext(_JSON, 3), _JSON_EVENT))
def parse_json_syslog(spark, sf_dir):
    return _one_format(spark, sf_dir, "json_syslog")


def _one_format(spark, sf_dir, name):
    return formats.parse_one(t.format_lines(spark, sf_dir), name).drop("value")


WHICH = f"""CASE WHEN regexp_matches(value, '{_APACHE}') THEN 'apache' WHEN regexp_matches(value, '{_SYSLOG}') THEN 'syslog'
  WHEN regexp_matches(value, '{_SPARK}') THEN 'spark' WHEN regexp_matches(value, '{_JSON}') THEN 'json_syslog'
  ELSE 'unmatched' END"""


@query(
    "parse_logs",
    f"""WITH {t.FORMAT_LINES}, tagged AS (SELECT id, value, {WHICH} AS format FROM fl)
    SELECT id, format,
      CASE format WHEN 'apache' THEN {_ext(_APACHE, 1)} WHEN 'syslog' THEN {_ext(_SYSLOG, 1)}
        WHEN 'spark' THEN {_ext(_SPARK, 1)} ELSE {_ext(_JSON, 1)} END AS date,
      CASE format WHEN 'apache' THEN {_ext(_APACHE, 2)} WHEN 'syslog' THEN 'info'
        WHEN 'spark' THEN {_ext(_SPARK, 2)} ELSE '' END AS level,
      CASE format WHEN 'apache' THEN 'apache' WHEN 'syslog' THEN {_ext(_SYSLOG, 2)}
        WHEN 'spark' THEN {_ext(_SPARK, 3)} ELSE {_ext(_JSON, 3)} END AS source,
      CASE format WHEN 'apache' THEN {_ext(_APACHE, 3)} WHEN 'syslog' THEN {_ext(_SYSLOG, 3)}
        WHEN 'spark' THEN {_ext(_SPARK, 4)} ELSE {_JSON_EVENT} END AS event
    FROM tagged WHERE format <> 'unmatched'""",
)
def parse_logs(spark, sf_dir):
    return formats.parse_logs(t.format_lines(spark, sf_dir)).drop("value")


@query(
    "parse_match_counts",
    f"WITH {t.FORMAT_LINES} SELECT {WHICH} AS format, count(*) AS lines FROM fl GROUP BY 1",
)
def parse_match_counts(spark, sf_dir):
    return formats.match_counts(t.format_lines(spark, sf_dir))


# The application's lines, spelled for DuckDB.
_APP = r"^(?:(\S+Z) )?(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2},\d{3}) \[(\w+)\] (.*)$"
_INSERT = r"^\[DB INSERT\] type=(\S+) status=(\S+) msg=(.*)$"
_REQUEST = r"^([A-Z]+) (\S+) → (\d{3}) \((\d+\.\d+)s\)$"


def _part(pattern: str, group: int) -> str:
    return f"nullif(regexp_extract(message, '{pattern}', {group}), '')"


@query(
    "parse_app_log",
    f"""WITH {t.APP_LINES},
    heads AS (
      SELECT id, nullif({_ext(_APP, 1)}, '') AS collected_at,
             strptime({_ext(_APP, 2)}, '%Y-%m-%d %H:%M:%S,%g') AS ts,
             {_ext(_APP, 3)} AS level, {_ext(_APP, 4)} AS message
      FROM al WHERE regexp_matches(value, '{_APP}'))
    SELECT id, collected_at, ts, level, message,
           {_part(_INSERT, 1)} AS event_type, {_part(_INSERT, 2)} AS status, {_part(_INSERT, 3)} AS event_message,
           {_part(_REQUEST, 1)} AS method, {_part(_REQUEST, 2)} AS path, {_part(_REQUEST, 3)}::INTEGER AS code,
           {_part(_REQUEST, 4)}::DOUBLE AS latency
    FROM heads""",
)
def parse_app_log(spark, sf_dir):
    return formats.parse_app_log(t.app_lines(spark, sf_dir)).drop("value")
