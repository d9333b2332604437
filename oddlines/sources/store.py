"""An event table to which every batch is added once, with ids that no two writers share.

A batch has a key. Its rows are counted, then an entry of the table's commit log gives it
the ids behind those of the entry before, and only then its rows are written, into a
folder of its own. A writer that dies in between leaves its ids taken; the
same batch, appended again, finds its entry and writes the same rows under the
same ids. Readers see whole batches only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from oddlines.sources.results import new_event_rows
from oddlines.storage import CommitLog, is_complete, materialize


class EventStore:
    """The table below ``path``; ``append`` may be called by many writers at once."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.log = CommitLog(spark, f"{path}/log")

    def _rows(self, entry: dict) -> str:
        return f"{self.path}/rows/{entry['first']:018d}-{entry['batch']}"

    def _taken(self, batch: str, n: int) -> dict:
        """The entry of a batch, a new one if it has none."""
        while True:
            entries = self.log.entries()
            found = next((e for e in entries if e["batch"] == batch), None)
            if found is None:
                first = entries[-1]["first"] + entries[-1]["rows"] if entries else 1
                found = {"batch": batch, "first": first, "rows": n}
                if not self.log.add(found):
                    continue  # another writer was first
            if found["rows"] != n:
                raise ValueError(f"batch {batch!r} was announced with {found['rows']} rows and now has {n}")
            return found

    def append(self, events: DataFrame, order: list[str], batch: str) -> DataFrame:
        """Add the events under the key ``batch`` unless they are there already; returns their stored rows.

        ``order`` is unique and gives the ids; ``batch`` names a folder, so it must be fit for one.
        """
        events = materialize(events, "events")  # what is counted is what is written
        entry = self._taken(batch, events.count())
        path = self._rows(entry)
        if not is_complete(self.spark, path):
            new_event_rows(events, order, entry["first"] - 1).write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)

    def read(self) -> DataFrame | None:
        """All rows of whole batches; None if there are none."""
        paths = [p for p in map(self._rows, self.log.entries()) if is_complete(self.spark, p)]
        return self.spark.read.parquet(*paths) if paths else None
