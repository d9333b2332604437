from __future__ import annotations

import hashlib
import random

from pyspark.sql import functions as F

from oddlines.llm import chat
from oddlines.llm.queries import CHECKS, QUERIES
from tests.compare import connect, differences

LOG = "conv_id long, seq long, turn long, kind string, role string, text string"
MESSAGES = "conv_id long, turn long, role string, text string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_same_as_sql(spark, sf_dir):
    assert differences(spark, connect(sf_dir), QUERIES["op4_chat_formatting"], CHECKS["op4_chat_formatting"], sf_dir) == []


def test_fold(spark):
    log = [
        (1, 1, 0, "delta", "user", "Hel"), (1, 2, 0, None, "user", "lo"), (1, 3, 1, "delta", "assistant", "bad"),
        (1, 4, 2, "delta", "user", "gone"), (1, 5, 1, "regenerate", "assistant", "Go"), (1, 6, 1, "delta", "assistant", "od"),
        (1, 7, 2, "delta", "user", "more"), (1, 8, 0, "edit", "user", "Hi"), (1, 9, 3, "delta", "user", "x"),
        (1, 10, 3, "delete", "user", "y"), (2, 1, 0, "delta", None, None), (None, 1, 0, "delta", "user", "n"),
    ]
    rows = chat.fold_events(spark.createDataFrame(log, LOG)).collect()
    assert sorted(map(tuple, rows), key=repr) == sorted(
        [(1, 0, "user", "Hi"), (1, 1, "assistant", "Good"), (1, 2, "user", "more"), (2, 0, "", ""), (None, 0, "user", "n")], key=repr
    )


def test_round_trip_of_control_strings(spark):
    rng = random.Random(4)
    pieces = ["<|im_end|>", "<|im_start|>", "</s>", "[INST]", "<", "\\", "[", "|im_end|>", "s>", "\n", "é", "<<SYS>>", "<\\s>", "\x00"]
    rows = [(c, t, rng.choice(["user", "assistant", "a\\n\nb", ""]), "".join(rng.choices(pieces, k=rng.randint(0, 12)))) for c in range(60) for t in range(4)]
    rendered = chat.render(spark.createDataFrame(rows, MESSAGES))
    for r in rendered.select("conv_id", chat.read_back(rendered.formatted).alias("turns"), "formatted").collect():
        want = [(role, text) for c, _, role, text in rows if c == r.conv_id]
        assert [(t.role, t.text) for t in r.turns] == want
        assert r.formatted.count(chat.START) == 4 and "</s>" not in r.formatted
    for r in chat.digests(rendered).collect():
        turns = [(role, text) for c, _, role, text in rows if c == r.conv_id]
        loss = "".join(text for role, text in turns if role == "assistant")
        assert (r.n_turns, r.loss_chars, r.loss_sha256) == (4, len(loss), sha(loss))
        assert r.turns_sha256 == sha("".join(f"{a}\n{b}\n" for a, b in turns))


def test_equal_turns_nulls_and_no_rows(spark):
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (2, 0, None, None)]
    out = chat.digests(chat.render(chat.fold_events(chat.message_events(spark.createDataFrame(rows, MESSAGES)))))
    assert {r.conv_id: (r.n_turns, r.turns_sha256) for r in out.collect()} == {
        1: (3, sha("user\na\nuser\na\nuser\nb\n")), 2: (1, sha("\n\n"))
    }
    assert chat.digests(chat.render(chat.fold_events(spark.createDataFrame([], LOG)))).count() == 0


def test_no_python_in_the_plan(spark, sf_dir):
    plan = QUERIES["op4_chat_formatting"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_roles_with_nul_backslash_and_line_end(spark):
    roles = ["a\0b", "\\", "\\n", "\n", "a\\\n\\\\nb\0\\", "user"]
    frame = spark.createDataFrame([(r,) for r in roles], "role string")
    back = frame.select("role", chat.role_line(F.col("role")).alias("line"), chat.role_of(chat.role_line(F.col("role"))).alias("back"))
    assert all(r.role == r.back and "\n" not in r.line for r in back.collect())
