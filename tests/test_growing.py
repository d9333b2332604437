"""Files that grow between triggers give each whole line once."""

from __future__ import annotations

import random

import pyarrow as pa
import pytest

from oddlines.sources import growing
from oddlines.streaming import jobs


def run(spark, folder, tmp_path, length=growing.RANGE):
    stream = growing.follow_lines(spark, folder, length)
    jobs.append_records(stream, f"{tmp_path}/out", f"{tmp_path}/progress", None).awaitTermination()
    rows = spark.read.parquet(f"{tmp_path}/out").collect()
    return sorted((r.file_path.rsplit("/", 1)[1], r.start, r.value) for r in rows)


def test_lines_come_once_and_whole(spark, tmp_path):
    folder = tmp_path / "in"
    (folder / "below").mkdir(parents=True)
    (folder / ".hidden").write_text("no\n")
    (folder / "_hidden").write_text("no\n")
    (folder / "below" / "x.log").write_text("no\n")
    (folder / "empty.log").write_text("")
    log = folder / "a.log"
    log.write_bytes(b"one\ntw")
    assert run(spark, str(folder), tmp_path) == [("a.log", 0, "one")]
    assert len(run(spark, str(folder), tmp_path)) == 1
    with log.open("ab") as f:
        f.write(b"o\r\n\nb\xffd\nrest")
    (folder / "b.log").write_text("b\n")
    told = [("a.log", 0, "one"), ("a.log", 4, "two"), ("a.log", 9, ""), ("a.log", 10, "b�d"), ("b.log", 0, "b")]
    assert run(spark, str(folder), tmp_path) == told
    log.write_text("anew\nand a line that makes the file longer than it was\n")  # replaced
    (folder / "b.log").unlink()
    told += [("a.log", 0, "anew"), ("a.log", 5, "and a line that makes the file longer than it was")]
    assert run(spark, str(folder), tmp_path) == sorted(told)


@pytest.mark.parametrize("block", [3, 64, 1 << 20])
def test_ranges_meet_between_lines(monkeypatch, block):
    monkeypatch.setattr(growing, "BLOCK", block)
    rng = random.Random(block)
    content = b"".join(bytes(rng.choices(b"ab ", k=rng.choice([0, 1, 5, 40]))) + b"\n" for _ in range(60)) + b"open"
    with pa.BufferReader(content) as file:
        end = growing.last_line_end(file, 0, len(content))
        assert end == content.rfind(b"\n") + 1
        for first in (0, content.index(b"\n", 100) + 1):
            for length in (1, 7, 50, 5000):
                found = []
                for begin in range(first, end, length):
                    part = growing._Range("f", first, begin, min(begin + length, end))
                    for batch in growing.read_lines(file, part):
                        found += zip(batch["start"].to_pylist(), batch["value"].to_pylist())
                told, at = [], first
                for line in content[first:end].split(b"\n")[:-1]:
                    told.append((at, line.decode()))
                    at += len(line) + 1
                assert found == told


def test_replaced_files_are_noticed(tmp_path):
    log = tmp_path / "a.log"
    log.write_text("first\nsecond\n")
    reader = growing._Reader(f"file://{tmp_path}", 10)
    before = reader.latestOffset()
    log.write_text("other\nlines that are longer\n")
    after = reader.latestOffset()
    assert [(p.begin, p.end) for p in reader.partitions(before, after)] == [(0, 10), (10, 20), (20, 28)]
    assert reader.partitions(after, after) == []
    assert growing._Reader(f"file://{tmp_path}/absent", 10).latestOffset() == {}
