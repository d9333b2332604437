"""Structured fields out of raw log lines, one expression per line format.

The patterns are fixed values: which lines count as which format, and where
their fields lie, must agree with existing log collections. ``(?dU)`` lets Java
treat classes as Unicode and only LF as a line end.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

_FLAGS = "(?dU)"

APACHE = _FLAGS + r"^\[([^\]]+)\]\s+\[([^\]]+)\]\s+(.*)$"
SYSLOG = _FLAGS + r"^([A-Za-z]{3}\s+\d{2}\s+\d{2}:\d{2}:\d{2})\s+[\w+:]+\s+([^\[\]]+)\[.*?\]: (.*)$"
SPARK = _FLAGS + r"^(\d{2}/\d{2}/\d{2}\s+\d{2}:\d{2}:\d{2})\s+(\w+)\s+([^:]+):\s+(.*)$"
JSON_SYSLOG = _FLAGS + r'"message":"\d+\s+(\S+)\s+(\S+)\s+(\S+)\s+(\d+)\s+-\s+-\s+(.*?)"'

APP_LINE = _FLAGS + r"^(?:(\S+Z) )?(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2},\d{3}) \[(\w+)\] (.*)$"
INSERT_BODY = _FLAGS + r"^\[DB INSERT\] type=(\S+) status=(\S+) msg=(.*)$"
REQUEST_BODY = _FLAGS + r"^([A-Z]+) (\S+) → (\d{3}) \((\d+\.\d+)s\)$"

FIELDS = ("date", "level", "source", "event")


def _fields(date: Column, level: Column, source: Column, event: Column) -> tuple[Column, ...]:
    return tuple(c.alias(n) for c, n in zip((date, level, source, event), FIELDS))


def _group(line: Column, pattern: str, index: int) -> Column:
    return F.regexp_extract(line, pattern, index)


def apache_fields(line: Column) -> tuple[Column, ...]:
    return _fields(_group(line, APACHE, 1), _group(line, APACHE, 2), F.lit("apache"), _group(line, APACHE, 3))


def syslog_fields(line: Column) -> tuple[Column, ...]:
    return _fields(_group(line, SYSLOG, 1), F.lit("info"), _group(line, SYSLOG, 2), _group(line, SYSLOG, 3))


def spark_fields(line: Column) -> tuple[Column, ...]:
    return _fields(*[_group(line, SPARK, i) for i in (1, 2, 3, 4)])


def json_syslog_fields(line: Column) -> tuple[Column, ...]:
    event = F.concat_ws(" ", _group(line, JSON_SYSLOG, 4), _group(line, JSON_SYSLOG, 5))
    return _fields(_group(line, JSON_SYSLOG, 1), F.lit(""), _group(line, JSON_SYSLOG, 3), event)


# Tried in this order; the first format that fits a line wins.
FORMATS = (
    ("apache", APACHE, apache_fields),
    ("syslog", SYSLOG, syslog_fields),
    ("spark", SPARK, spark_fields),
    ("json_syslog", JSON_SYSLOG, json_syslog_fields),
)
UNMATCHED = "unmatched"


def line_format(line: Column) -> Column:
    """Name of the first format that fits, or ``unmatched``."""
    first, *rest = FORMATS
    chain = reduce(
        lambda acc, fmt: acc.when(line.rlike(fmt[1]), fmt[0]), rest, F.when(line.rlike(first[1]), first[0])
    )
    return chain.otherwise(UNMATCHED)


def parse_one(lines: DataFrame, format_name: str, column: str = "value") -> DataFrame:
    """Rows of one format with its four fields; other lines are dropped."""
    pattern, fields = next((p, f) for name, p, f in FORMATS if name == format_name)
    line = F.col(column)
    return lines.filter(line.rlike(pattern)).select("*", *fields(line))


def parse_logs(lines: DataFrame, column: str = "value") -> DataFrame:
    """Format cascade: ``format``, ``date``, ``level``, ``source``, ``event`` of each line that fits one."""
    line = F.col(column)
    tagged = lines.withColumn("format", line_format(line))
    by_format = {name: fields(line) for name, _, fields in FORMATS}

    def pick(index: int) -> Column:
        names = iter(by_format.items())
        name, fields = next(names)
        chain = F.when(F.col("format") == name, fields[index])
        for name, fields in names:
            chain = chain.when(F.col("format") == name, fields[index])
        return chain.alias(FIELDS[index])

    return tagged.filter(F.col("format") != UNMATCHED).select("*", *[pick(i) for i in range(len(FIELDS))])


def match_counts(lines: DataFrame, column: str = "value") -> DataFrame:
    """Lines per format, those that fit none included."""
    return lines.groupBy(line_format(F.col(column)).alias("format")).agg(F.count(F.lit(1)).alias("lines"))


def parse_app_log(lines: DataFrame, column: str = "value") -> DataFrame:
    """Application lines with their level and the fields of the two known message bodies."""
    line = F.col(column)
    head = lines.filter(line.rlike(APP_LINE)).select(
        "*",
        F.nullif(_group(line, APP_LINE, 1), F.lit("")).alias("collected_at"),
        F.to_timestamp_ntz(_group(line, APP_LINE, 2), F.lit("yyyy-MM-dd HH:mm:ss,SSS")).alias("ts"),
        _group(line, APP_LINE, 3).alias("level"),
        _group(line, APP_LINE, 4).alias("message"),
    )
    body = F.col("message")

    def part(pattern: str, index: int) -> Column:
        return F.nullif(_group(body, pattern, index), F.lit(""))

    return head.select(
        "*",
        part(INSERT_BODY, 1).alias("event_type"),
        part(INSERT_BODY, 2).alias("status"),
        part(INSERT_BODY, 3).alias("event_message"),
        part(REQUEST_BODY, 1).alias("method"),
        part(REQUEST_BODY, 2).alias("path"),
        part(REQUEST_BODY, 3).cast("int").alias("code"),
        part(REQUEST_BODY, 4).cast("double").alias("latency"),
    )
