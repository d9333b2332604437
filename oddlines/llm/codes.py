"""Vector codes by active-entry Lloyd rounds over integer parts, exact to the last tie.

Every component x becomes floor(4096 * x), and vectors are cut into equal
consecutive parts, each with a codebook of its own. A part keeps the index of
its entry and the exact squared distance to it. In the next round a part whose
entry stayed where it was is compared with the entries that moved, and with
these alone: among the others its entry is still the nearest one and of equally near
ones that with the lowest index. A part whose entry moved is compared with all.

Rows travel in blocks of at most ``BLOCK`` vectors with their codes and
distances. A round reads the blocks of the round before, writes its own, with the sums
and counts of every entry, and adds these up over the blocks; only the codebooks
reach the driver and the tasks. A round's table is deleted once the next one is written.

Rows whose vector is null or holds null or non-finite components are dropped,
as are, since they have no parts to compare, vectors whose length is not that of
the vector with the smallest id or not a multiple of the number of parts. A vector
whose squared errors might pass 64 bits (for 64 components: one of about 45,000
or more) is dropped as well. Null ids come last; of equal ids the smaller vector comes
first. Fewer rows than entries give fewer entries, no rows give no rows. Rows
may repeat; each gets its code. Columns other than those named are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from oddlines.storage import delete, new_path

SCALE, BLOCK, SALTS = 4096, 4096, 16


def _scaled(values: np.ndarray) -> np.ndarray:
    return np.floor(values.astype(np.float64) * SCALE).astype(np.int64)


def _packed(x: np.ndarray) -> tuple[int, bytes]:
    """Item size and bytes of an integer array, in the narrowest type that holds it."""
    most = int(np.abs(x).max(initial=0))
    size = 2 if most < 1 << 15 else 4 if most < 1 << 31 else 8
    return size, x.astype(f"<i{size}").tobytes()


def _distances(x: np.ndarray, entry: np.ndarray) -> np.ndarray:
    return np.square(x - entry).sum(axis=1)


def assign(x: np.ndarray, book: np.ndarray, code: np.ndarray, dist: np.ndarray, moved: np.ndarray) -> None:
    """Bring the codes and distances of one part position up to date with its codebook, in place.

    ``moved`` tells which entries differ from those the codes and distances were made with.
    """
    stale = moved[code]
    if stale.any():
        rows = x[stale]
        best, at = _distances(rows, book[0]), np.zeros(len(rows), code.dtype)
        for j in range(1, len(book)):
            d = _distances(rows, book[j])
            nearer = d < best
            best[nearer], at[nearer] = d[nearer], j
        dist[stale], code[stale] = best, at
    fixed = np.flatnonzero(~stale)
    active = np.flatnonzero(moved)
    if len(fixed) and len(active):
        rows, best, at = x[fixed], dist[fixed], code[fixed]
        for j in active:
            d = _distances(rows, book[j])
            nearer = (d < best) | ((d == best) & (j < at))
            best[nearer], at[nearer] = d[nearer], j
        dist[fixed], code[fixed] = best, at


def _assigned(x: np.ndarray, codes: np.ndarray, dist: np.ndarray, book: np.ndarray, moved: np.ndarray) -> np.ndarray:
    """Sums of every entry's parts, then their counts, after all positions were brought up to date."""
    parts, entries, width = book.shape
    sums = np.zeros(book.shape, np.int64)
    counts = np.zeros((parts, entries), np.int64)
    for p in range(parts):
        assign(x[:, p], book[p], codes[:, p], dist[:, p], moved[p])
        held = codes[:, p] == np.arange(entries)[:, None]
        sums[p] = held.astype(np.int64) @ x[:, p]
        counts[p] = held.sum(axis=1)
    return np.concatenate([sums.ravel(), counts.ravel()])


class _Layout:
    """Schema of the block tables and how a block is read and written."""

    def __init__(self, id_type: str, label_type: str):
        self.ddl = (
            f"ids array<{id_type}>, labels array<{label_type}>, size int, vectors binary, codes binary, dist binary, "
            "totals array<long>"
        )

    @staticmethod
    def batch(ids: pa.Array, labels: pa.Array, x: np.ndarray, codes: np.ndarray, dist: np.ndarray, totals: np.ndarray):
        size, packed = _packed(x)
        ends = pa.array([0, len(ids)], pa.int32())
        return pa.RecordBatch.from_arrays(
            [
                pa.ListArray.from_arrays(ends, ids), pa.ListArray.from_arrays(ends, labels), pa.array([size], pa.int32()),
                pa.array([packed], pa.binary()), pa.array([codes.tobytes()], pa.binary()),
                pa.array([dist.astype("<i8").tobytes()], pa.binary()),
                pa.array([totals], pa.list_(pa.int64())),
            ],
            ["ids", "labels", "size", "vectors", "codes", "dist", "totals"],
        )

    @staticmethod
    def rows(batch: pa.RecordBatch, parts: int) -> Iterator[tuple[pa.Array, pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
        for i in range(batch.num_rows):
            ids, labels = batch.column("ids")[i].values, batch.column("labels")[i].values
            size = batch.column("size")[i].as_py()
            x = np.frombuffer(batch.column("vectors")[i].as_py(), f"<i{size}").astype(np.int64)
            codes = np.frombuffer(batch.column("codes")[i].as_py(), np.uint8).reshape(-1, parts).copy()
            dist = np.frombuffer(batch.column("dist")[i].as_py(), "<i8").reshape(-1, parts).copy()
            yield ids, labels, x.reshape(len(ids), parts, -1), codes, dist


def _usable(vector: Column, most: int) -> Column:
    return vector.isNotNull() & F.forall(
        vector, lambda v: v.isNotNull() & ~F.isnan(v) & F.abs(v).between(F.lit(0.0), F.lit(most / SCALE))
    )


def _bound(length: int) -> int:
    """The largest component for which the squared errors of a vector stay below 2**63."""
    return isqrt((2**63 - 1) // max(length, 1)) // 2 - 1


def compress(
    vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", label: str = "label",
    parts: int = 8, entries: int = 16, rounds: int = 6,
) -> tuple[DataFrame, np.ndarray]:
    """(id, label, codes binary, error long) of every kept vector, and the final codebooks by part and entry."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id).alias("id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("vec"))
    finite = rows.filter(_usable(F.col("vec"), 2**62))
    by_id = (F.col("id").asc_nulls_last(), F.col("vec"))
    first = finite.orderBy(*by_id).select("id", "vec").limit(1).collect()
    length = len(first[0].vec) if first else 0
    if length % parts:
        length = 0
    kept = finite.filter((F.size("vec") == length) & _usable(F.col("vec"), _bound(length))) if length else finite.limit(0)
    seeds = kept.orderBy(*by_id).select("id", "vec").limit(entries).collect()
    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    layout = _Layout(types["id"], types["label"])
    if not seeds:
        empty = spark.createDataFrame([], f"id {types['id']}, label {types['label']}, codes binary, error long")
        return empty, np.zeros((parts, 0, 0), np.int64)
    book = _scaled(np.array([r.vec for r in seeds]).reshape(len(seeds), parts, -1)).transpose(1, 0, 2)

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(begin, BLOCK)
                x = _scaled(batch.column("vec").flatten().to_numpy(zero_copy_only=False)).reshape(batch.num_rows, parts, -1)
                codes, dist = np.zeros((len(x), parts), np.uint8), np.zeros((len(x), parts), np.int64)
                totals = _assigned(x, codes, dist, book, np.ones(book.shape[:2], bool))
                yield layout.batch(batch.column("id"), batch.column("label"), x, codes, dist, totals)

    def step(book: np.ndarray, moved: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for ids, labels, x, codes, dist in layout.rows(batch, parts):
                    totals = _assigned(x, codes, dist, book, moved)
                    yield layout.batch(ids, labels, x, codes, dist, totals)

        return run

    path = new_path(spark, "codes")
    kept.mapInArrow(start, layout.ddl).write.parquet(path)
    for _ in range(rounds):
        state = spark.read.schema(layout.ddl).parquet(path)
        told = state.select(F.posexplode("totals").alias("at", "total")).groupBy("at")
        found = told.agg(F.sum(F.col("total").cast("decimal(20,0)")).alias("total")).collect()
        totals = np.zeros(book.size + book.shape[0] * book.shape[1], object)
        for at, total in found:
            totals[at] = int(total)
        sums, counts = totals[: book.size].reshape(book.shape), totals[book.size :].reshape(book.shape[:2])
        used = counts > 0
        after = book.copy()
        after[used] = (sums[used] // counts[used][:, None]).astype(np.int64)
        moved = (after != book).any(axis=2)
        book = after
        if not moved.any():
            break  # no entry will move again
        done, path = path, new_path(spark, "codes")
        state.mapInArrow(step(book, moved), layout.ddl).write.parquet(path)
        delete(spark, done)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, labels, _, codes, dist in layout.rows(batch, parts):
                columns = [ids, labels, pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(dist.sum(axis=1))]
                yield pa.RecordBatch.from_arrays(columns, ["id", "label", "codes", "error"])

    state = spark.read.schema(layout.ddl).parquet(path)
    return state.mapInArrow(unpack, f"id {types['id']}, label {types['label']}, codes binary, error long"), book


def codebook_digest(book: np.ndarray) -> str:
    """SHA-256 of all entries' components as decimals, by part, entry and position."""
    return hashlib.sha256(",".join(map(str, book.ravel().tolist())).encode()).hexdigest()


def code_rows(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(id, code, error, label_error, codebooks_sha256); errors of equal labels are added, nulls together."""
    coded, book = compress(vectors, id, vector, label)
    # a label may hold most rows: its rows are dealt over some salts, the totals are copied to each
    salt = F.pmod(F.xxhash64("id", "codes"), F.lit(SALTS))
    totals = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of")
    totals = totals.withColumn("of_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    coded = coded.withColumn("salt", salt)
    told = coded.join(totals, coded.label.eqNullSafe(totals.of) & (coded.salt == totals.of_salt))
    return told.select(
        F.col("id").alias(id), F.lower(F.hex("codes")).alias("code"), "error", "label_error",
        F.lit(codebook_digest(book)).alias("codebooks_sha256"),
    )
