from __future__ import annotations

import re
import textwrap

import pytest
from pyspark.sql import functions as F

from oddlines.functions import formats
from oddlines.functions.stopwords import english_stop_words
from oddlines.functions.text import (
    mask_tokens,
    mask_tokens_legacy,
    shorten,
    strip_blanks,
    template_parameters,
    with_bigrams,
    words,
)
from oddlines.operators import experiments, features


def column(spark, values, fn):
    """``fn`` applied to each value, in order."""
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.select("i", fn(F.col("v")).alias("out")).orderBy("i").select("out").collect()]


MASKS = [
    ("Addr 0xAF from 10.0.0.1 port 22", "addr tag_hex from tag_ip port tag_num", "addr <hex> from <ip> port <num>"),
    ("10x1F", "1tag_hex", "<num><hex>"),
    ("999.1.2.3.4", "tag_ip.tag_num", "<ip>.<num>"),
    ("1234.1.2.3", "tag_num.tag_num.tag_num.tag_num", "<ip>"),
    ("è12 a1 12 13", "è12 a1 tag_num tag_num", "è12 a1 <num> <num>"),
]


def test_masks(spark):
    lines = [m[0] for m in MASKS]
    assert column(spark, lines, mask_tokens) == [m[1] for m in MASKS]
    assert column(spark, lines, mask_tokens_legacy) == [m[2] for m in MASKS]


def test_strip_knows_unicode_blanks(spark):
    lines = ["  a b\t", "\x1c\x85x ", "　", "", "plain"]
    assert column(spark, lines, strip_blanks) == [x.strip() for x in lines]


def test_words_like_python(spark):
    lines = ["A b cd É_1 x-y ½½ ok", "", "a", "ﬁne ΣΑΣ 12 3", "don't"]
    expected = [re.findall(r"(?u)\b\w\w+\b", x.lower()) for x in lines]
    assert column(spark, lines, words) == expected
    pairs = [t + [f"{a} {b}" for a, b in zip(t, t[1:])] for t in expected]
    assert column(spark, lines, lambda c: with_bigrams(words(c))) == pairs


def test_shorten_like_textwrap(spark):
    lines = [
        "short", "a" * 60, "word " * 20, "  spaced\t out   text " * 5, "well-known-hyphenated words in a long line here",
        "x" * 37 + " tail tail", "x" * 38 + " tail tail", "exactly forty characters are in this row!",
        "alpha beta gamma delta epsilon-zeta-eta-theta iota", "one two three four five six 12-34-56-78-90 seven",
        "a-b-c-d-e-f-g-h-i-j-k-l-m-n-o-p-q-r-s-t-u-v-w", "and then it stopped--nobody had known it before", "well-known and semi-well-known-facts about-them all",
    ]
    assert column(spark, lines, shorten) == [textwrap.shorten(x, width=40, placeholder="...") for x in lines]


def test_parameters(spark):
    df = spark.createDataFrame([("user 7 sent 12 bytes", "user <*> sent <*> bytes"), ("a b", "a b")], "l string, t string")
    got = [r[0] for r in df.select(template_parameters(F.col("l"), F.col("t"))).collect()]
    assert got == [["7", "12"], []]


def test_stop_words():
    words = english_stop_words()
    assert len(words) == 318 and {"the", "cannot", "amoungst", "yourselves"} <= set(words)


FORMATS = [
    ("[Mon Jan 01 00:00:07 2024] [error] client 10.0.0.1 code 69",
     ("apache", "Mon Jan 01 00:00:07 2024", "error", "apache", "client 10.0.0.1 code 69")),
    ("Jan 01 00:00:07 combo sshd(pam_unix)[1946]: login failed uid=0",
     ("syslog", "Jan 01 00:00:07", "info", "sshd(pam_unix)", "login failed uid=0")),
    ("24/01/01 00:00:07 WARN storage.Block: block 69 lost",
     ("spark", "24/01/01 00:00:07", "WARN", "storage.Block", "block 69 lost")),
    ('x {"message":"14 2024-01-01T00:00:07Z h1 api 42 - - read failed"}',
     ("json_syslog", "2024-01-01T00:00:07Z", "", "api", "42 read failed")),
    ("plain text 69", None),
    ("Jan  1 00:00:07 combo sshd[1]: x", None),
    ("Jan 01 00:00:07 my-host sshd[1]: x", None),
]


def test_formats(spark):
    df = spark.createDataFrame([(i, line) for i, (line, _) in enumerate(FORMATS)], "i int, value string")
    got = {r["i"]: (r["format"], r["date"], r["level"], r["source"], r["event"]) for r in formats.parse_logs(df).collect()}
    assert got == {i: fields for i, (_, fields) in enumerate(FORMATS) if fields}
    counts = {r["format"]: r["lines"] for r in formats.match_counts(df).collect()}
    assert counts == {"apache": 1, "syslog": 1, "spark": 1, "json_syslog": 1, "unmatched": 3}
    assert formats.parse_logs(df.filter("i > 3")).isEmpty()


def test_app_lines(spark):
    lines = [
        "2024-01-01 00:00:07,179 [INFO] [DB INSERT] type=cache status=warn msg=Cache miss: product_7",
        "2024-01-01T00:00:07.5Z 2024-01-01 00:00:07,179 [ERROR] GET /api/orders → 200 (0.012s)",
    ]
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    first, second = formats.parse_app_log(df).orderBy("collected_at").collect()
    assert (first["event_type"], first["status"], first["event_message"]) == ("cache", "warn", "Cache miss: product_7")
    assert first["ts"].microsecond == 179000 and first["method"] is None
    assert (second["method"], second["path"], second["code"], second["latency"]) == ("GET", "/api/orders", 200, 0.012)
    assert second["level"] == "ERROR" and second["collected_at"] == "2024-01-01T00:00:07.5Z"


@pytest.mark.parametrize("text,seconds", [("30s", 30), ("2m", 120), ("1h", 60), ("", 60)])
def test_durations(spark, text, seconds):
    assert column(spark, [text], experiments.duration_seconds) == [seconds]


def test_prepare_text(spark):
    df = spark.createDataFrame([("GET 1", "apache"), (None, "linux")], "template string, source_folder string")
    rows = features.prepare_text(df).orderBy("source_folder").collect()
    assert [r["combined"] for r in rows] == ["INFO apache get tag_num", "INFO linux missing"]
    assert [r["event"] for r in rows] == ["GET 1", "missing"]
    legacy = features.prepare_text(df, legacy=True).orderBy("source_folder").first()
    assert legacy["combined"] == "INFO apache get <num>"
