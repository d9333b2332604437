"""Template mining with its state kept by the engine: one state a (file, token count).

Templates live in the state store, under the ``seq`` of the line that created them, so a
batch loads the templates of the files it has lines of and writes back those
that its lines altered. After a failure the store goes back to the last whole batch
with everything else. A timer closes a file that had no line for some time: its templates
are given out in their last form and forgotten.

Lines of one (file, token count) are mined in ``seq`` order by one task a batch, since what a line
does depends on the line before it; batches must be bounded at the source. ``mine_stream`` has no such
bound and mines a batch in chunks, but keeps its templates in tables of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from oddlines.functions.text import token_count
from oddlines.operators.templates import Placer
from oddlines.streaming.jobs import REFRESH, append_records

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_ROWS = "file_path string, n_tokens int, seq long, born long, template string, closed boolean"


class _Mine(StatefulProcessor):
    def __init__(self, idle: int | None):
        self.idle = idle  # milliseconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.templates = handle.getMapState("templates", "born long", "leaf string, template string")

    def _stored(self) -> list[tuple[int, str, str]]:
        return sorted((born, leaf, template) for (born,), (leaf, template) in self.templates.iterator())

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        file_path, n_tokens = key
        placer = Placer(n_tokens, self._stored())
        frame = pd.concat(list(rows)).sort_values("seq", kind="stable")
        out = [(file_path, n_tokens, seq, *placer.place(text, seq), False) for seq, text in zip(frame["seq"], frame["value"])]
        for born, (leaf, template) in placer.altered.items():
            self.templates.updateValue((born,), (leaf, template))
        if self.idle is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle)
        yield pd.DataFrame(out, columns=["file_path", "n_tokens", "seq", "born", "template", "closed"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last = [(*key, None, born, template, True) for born, _, template in self._stored()]
        self.templates.clear()
        frame = pd.DataFrame(last, columns=["file_path", "n_tokens", "seq", "born", "template", "closed"])
        yield frame.astype({"seq": "Int64"})


def template_rows(lines: DataFrame, idle: int | None = None) -> DataFrame:
    """Stream of lines (``file_path``, ``seq``, ``value``) to rows with ``born`` and ``template`` as of the line.

    With ``idle``, in milliseconds, also the last form of the templates of files
    that were silent so long, with ``closed`` true and no ``seq``.
    """
    lines = lines.select("file_path", token_count(F.col("value")).alias("n_tokens"), "seq", "value")
    keyed = lines.groupBy("file_path", "n_tokens")
    mode = "ProcessingTime" if idle is not None else "None"
    return keyed.transformWithStateInPandas(_Mine(idle), _ROWS, "append", mode)


def mine_with_store(
    lines: DataFrame, out: str, checkpoint: str, idle: int | None = None, every: str | None = REFRESH
) -> StreamingQuery:
    """Mine a stream of lines into a parquet table, each line exactly once."""
    use_store(lines.sparkSession)
    return append_records(template_rows(lines, idle), out, checkpoint, every)


def use_store(spark: SparkSession) -> None:
    """Have the session's streams keep their state where this kind of state can be kept."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
