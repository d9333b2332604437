"""Work tables: where a job cuts its lineage and keeps an intermediate result.

Everything is written below the checkpoint folder the cluster names, so it is
shared by all executors and survives the loss of any of them.
"""

from __future__ import annotations

import json
import os
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def work_root(spark: SparkSession) -> str:
    """Shared folder for work tables of this application."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if configured is None:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
            configured = tempfile.mkdtemp(prefix="oddlines-")
        sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the work root; nothing is ever overwritten."""
    return f"{work_root(spark)}/{label}-{uuid.uuid4().hex}"


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is run inside go as soon as it has ended, not when the driver happens to collect its garbage."""
    before = spark.conf.get(_TIDY, None)
    spark.conf.set(_TIDY, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_TIDY)
        else:
            spark.conf.set(_TIDY, before)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as parquet and return the stored table."""
    path = new_path(df.sparkSession, label)
    if _made.tables is not None:
        _made.tables.append((label, path))
    with tidy(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition by ``keys`` for a stage whose work is far larger than its bytes.

    The session's shuffle partition count is taken as it is; sized by bytes
    alone, such a stage would be packed into a few tasks.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a work table that nothing reads any more."""
    if not path.startswith(work_root(spark)):
        raise ValueError(f"{path} is not below the work folder")
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop_path, True)


class _Made(threading.local):
    tables: list[tuple[str, str]] | None = None


_made = _Made()


@contextmanager
def scratch(spark: SparkSession, *kept: str) -> Iterator[None]:
    """Delete the work tables stored inside, when all went well, but those under the labels ``kept``.

    For steps whose result is stored and reads none of the others any more.
    """
    outer, _made.tables = _made.tables, []
    try:
        yield
        tables = _made.tables
    finally:
        _made.tables = outer
    for label, path in tables:
        if label not in kept:
            delete(spark, path)
        elif outer is not None:
            outer.append((label, path))


class CommitLog:
    """Numbered entries in a shared folder: each is written whole, and each number is given out once.

    An entry is written aside and then renamed to its number, which fails if
    another writer had it first. Entries never change, so each is read once.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._known: dict[int, dict] = {}

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def entries(self) -> list[dict]:
        """All entries in order."""
        root = self._jvm.org.apache.hadoop.fs.Path(self.folder)
        fs = root.getFileSystem(self._conf)
        if not fs.exists(root):
            return []
        for status in fs.listStatus(root):
            name = status.getPath().getName()
            if name.isdigit() and int(name) not in self._known:
                source = fs.open(status.getPath())
                try:
                    self._known[int(name)] = json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8"))
                finally:
                    source.close()
        return [self._known[n] for n in sorted(self._known)]

    def add(self, entry: dict) -> bool:
        """Add an entry behind those that ``entries`` last gave; False if another writer added one meanwhile."""
        number = max(self._known, default=-1) + 1
        aside, final = self._path(f".{uuid.uuid4().hex}"), self._path(f"{number:012d}")
        fs = aside.getFileSystem(self._conf)
        out = fs.create(aside)
        try:
            out.write(bytearray(json.dumps(entry).encode()))
        finally:
            out.close()
        if fs.getScheme() == "file":  # its rename looks before it leaps; a link is made or not
            try:
                os.link(aside.toUri().getPath(), final.toUri().getPath())
                won = True
            except FileExistsError:
                won = False
            fs.delete(aside, False)
        else:
            context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(aside.toUri(), self._conf)
            none = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
            try:
                context.rename(aside, final, none)
                won = True
            except Py4JJavaError as error:
                if not error.java_exception.getClass().getName().endswith("FileAlreadyExistsException"):
                    raise
                fs.delete(aside, False)
                won = False
        if won:
            self._known[number] = entry
        return won


def is_complete(spark: SparkSession, path: str) -> bool:
    """Whether the table at ``path`` was written to its end."""
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done)
