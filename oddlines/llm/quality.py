"""Quality selection by importance resampling over hashed n-grams.

Two generative models of hashed words and word pairs are counted: one of
target texts (a bounded sample of rows labelled good), one of the raw corpus,
over all its rows. A text's log weight is the sum over its n-grams of
log(target probability / raw probability). Only buckets whose counts differ
beyond chance count, and only downwards: weights are at most 1, as for
rejection. Texts of weight 1 are all kept. Those of lower weight are drawn
without replacement by Gumbel top-k: the k largest of log weight plus Gumbel
noise, where k is the sum of their weights, the number of them that rejection
sampling would keep. Noise comes from a hash of id and text, so a draw can be
repeated.

The first bytes of a word are an n-gram of their own. An n-gram counts once a text. A pair of equal words is one n-gram whatever the word, so stuttering text
shows, and its share in eighths is one more. Null and empty texts have no evidence against them: weight 1. Repeated
rows get the same noise and are kept or dropped together; all rows that tie
with the k-th are kept. Without target rows every weight is 1. An empty table
gives no rows. Columns of the rows are kept as they are; only the named ones are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from oddlines.llm.common import bound_batches, kth_largest, partitions
from oddlines.llm.words import RUNS, arrow_portions, distinct, hashed_words, mix
from oddlines.storage import materialize

TABLE = 1 << 19  # buckets of each of two hash tables
BUCKETS = 2 * TABLE
CHUNK = 1 << 9
TARGET_SAMPLE = 20_000  # labelled rows the target model is counted on
LEAST_LOG = 1.0  # smaller log ratios of a bucket count as none
FREQUENT = 4.0  # expected count from which a bucket is tested at all
FALSE = 0.1  # buckets that may be taken for rare among target texts by chance
STEM = 6  # bytes of a word's beginning that count as one more n-gram
_STEM = np.uint64(0x2545F4914F6CDD1D)
_SAME = np.uint64(0x51ED270B7F4A7C15)


def buckets(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each distinct word, word beginning and word pair of each text its bucket in two tables, and the index of the text.

    An n-gram counts once a text: repeats within a text say nothing about the
    corpus. The second table's buckets follow the first's.
    """
    words, bounds, stems = hashed_words(texts, RUNS, stem=STEM)
    owner = np.repeat(np.arange(len(texts)), np.diff(bounds))
    bits = TABLE.bit_length() - 1
    shift = np.uint64(64 - 2 * bits)
    grams, owners = [mix(words) >> shift, mix(stems ^ _STEM) >> shift], [owner, owner]
    if len(words) > 1:
        first, second = words[:-1], words[1:]
        inside = owner[1:] == owner[:-1]
        pairs = np.where(first == second, _SAME, first * np.uint64(3) + second * np.uint64(0x9E3779B97F4A7C15))
        grams.append(mix(pairs)[inside] >> shift)
        owners.append(owner[1:][inside])
        # how much of a text its stuttering pairs are, in eighths
        stutter = np.bincount(owner[1:][inside & (first == second)], minlength=len(texts))
        share = (8 * stutter // np.maximum(1, np.diff(bounds))).astype(np.uint64)
        grams.append(mix(share ^ _SAME)[share > 0] >> shift)
        owners.append(np.flatnonzero(share > 0))
    keys = distinct(np.concatenate(owners) << 2 * bits | np.concatenate(grams).astype(np.int64))
    return keys >> bits & (TABLE - 1), (keys & (TABLE - 1)) + TABLE, keys >> 2 * bits


def count_models(docs: DataFrame, target: DataFrame, text: str = "text") -> DataFrame:
    """(chunk, raw, target): counts of ``CHUNK`` buckets a row, over all of ``docs``.

    ``target`` holds the ids of at most ``TARGET_SAMPLE`` target rows. Each task
    sends its counts once; they are added up as they come in.
    """
    rows = docs.select("doc_id", F.col(text).cast("string").alias("text"))
    rows = rows.join(F.broadcast(target.withColumn("wanted", F.lit(1))), "doc_id", "left")  # TARGET_SAMPLE ids at most

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a task counts fewer texts than fit 32 bits
        raw, wanted = np.zeros(BUCKETS, np.int32), np.zeros(BUCKETS, np.int32)
        for batch in batches:
            rows = batch.filter(pc.equal(batch.column("wanted"), 1))
            for part, into in ((batch.column("text"), raw), (rows.column("text"), wanted)):
                for _, texts in arrow_portions(part):
                    one, two, _ = buckets(texts)
                    into += np.bincount(np.concatenate([one, two]), minlength=BUCKETS).astype(np.int32)
        held = np.flatnonzero(raw.reshape(-1, CHUNK).any(axis=1))
        for some in np.array_split(held, max(1, len(held) // 64)):
            if len(some):
                ends = pa.array(np.arange(len(some) + 1, dtype=np.int32) * CHUNK)
                flat = [pa.ListArray.from_arrays(ends, pa.array(x.reshape(-1, CHUNK)[some].ravel())) for x in (raw, wanted)]
                yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), *flat], ["chunk", "raw", "target"])

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, raw, wanted in batch.itertuples(index=False):
                sums[chunk] = sums.get(chunk, 0) + np.stack([raw, wanted]).astype(np.int64)
        for chunk, (raw, wanted) in sums.items():
            yield pd.DataFrame({"chunk": [chunk], "raw": [raw], "target": [wanted]})

    spark = docs.sparkSession
    # each task sends all buckets: their number follows the cores, not the files
    rows = rows.select("text", "wanted").coalesce(4 * spark.sparkContext.defaultParallelism)
    counted = rows.mapInArrow(count, "chunk int, raw array<int>, target array<int>")
    counted = counted.repartition(partitions(spark), "chunk")
    return counted.mapInPandas(add, "chunk int, raw array<long>, target array<long>")


def contrast(wanted: np.ndarray, expected: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smoothed log ratio of counts, and the deviance of a Poisson count from what is expected."""
    part = wanted * np.log(np.maximum(wanted, 1) / np.maximum(expected, 1e-9))
    return np.log((wanted + 1) / (expected + 1)), 2 * (part - wanted + expected)


def fit(docs: DataFrame, target_ids: DataFrame, text: str = "text") -> np.ndarray | None:
    """The log ratio of each bucket (0 where it says nothing); ``BUCKETS`` single floats. None without target rows."""
    bound_batches(docs.sparkSession)
    ids = target_ids.select("doc_id").filter("doc_id IS NOT NULL").distinct()
    sample = materialize(ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TARGET_SAMPLE), "target")
    counts = materialize(count_models(docs, sample, text), "counts")
    sums = F.expr("aggregate(raw, 0L, (a, x) -> a + x) AS n"), F.expr("aggregate(target, 0L, (a, x) -> a + x) AS m")
    n, m = counts.select(*sums).agg(F.sum("n"), F.sum("m")).first()
    if not m:
        return None

    tested = F.size(F.filter("raw", lambda x: x * (m / n) >= FREQUENT))
    least = 2 * np.log(max(1, counts.agg(F.sum(tested)).first()[0]) / FALSE)

    def ratios(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for chunk, raw, wanted in batch.itertuples(index=False):
                raw, wanted = np.asarray(raw, float), np.asarray(wanted, float)
                expected = raw * (m / n)
                ratio, deviance = contrast(wanted, expected)
                at = np.flatnonzero((ratio < -LEAST_LOG) & (deviance > least) & (expected >= FREQUENT))
                yield pd.DataFrame({"bucket": at + chunk * CHUNK, "ratio": ratio[at].astype(np.float32)})

    found = counts.mapInPandas(ratios, "bucket long, ratio float").toPandas()  # at most BUCKETS rows
    model = np.zeros(BUCKETS, np.float32)
    model[found["bucket"].to_numpy(np.int64)] = found["ratio"]
    return model


def log_weights(texts: list[str | None], model: np.ndarray | None) -> np.ndarray:
    if model is None:
        return np.zeros(len(texts))
    one, two, owner = buckets(texts)
    ratio = np.maximum(model[one], model[two]).astype(np.float64)  # what only one table says is a collision there
    return np.round(np.bincount(owner, ratio, len(texts)), 6)


def weighted(docs: DataFrame, model: np.ndarray | None, seed: int = 0, text: str = "text") -> DataFrame:
    """Add ``log_weight`` and ``gumbel_key``, the log weight plus Gumbel noise; columns of these names are replaced."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # BUCKETS single floats

    @F.arrow_udf("double")
    def weight(texts: pa.Array) -> pa.Array:
        parts = [log_weights(part, shared.value) for _, part in arrow_portions(texts)]
        return pa.array(np.concatenate([*parts, np.zeros(0)]))

    noise: Column = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col(text))
    uniform = (F.shiftrightunsigned(noise, 12).cast("double") + 0.5) / float(1 << 52)
    docs = docs.drop("log_weight", "gumbel_key").withColumn("log_weight", weight(F.col(text).cast("string")))
    return docs.withColumn("gumbel_key", F.col("log_weight") - F.log(-F.log(uniform)))


def threshold(keys: DataFrame) -> float | None:
    """The Gumbel key of the last text drawn among those of weight below 1, from a stored table of weights and keys; None if none is."""
    below = keys.filter("log_weight < 0")
    k = below.agg(F.sum(F.exp("log_weight"))).first()[0]
    return kth_largest(below, "gumbel_key", round(k)) if k is not None else None


def chosen(last: float | None) -> Column:
    """Texts of weight 1, and those drawn among the others."""
    clean = F.col("log_weight") >= 0
    return clean if last is None else clean | (F.col("gumbel_key") >= F.lit(last))


def draw(docs: DataFrame, target_ids: DataFrame, seed: int = 0, text: str = "text") -> DataFrame:
    """(doc_id, log_weight, gumbel_key) of the rows that are drawn."""
    keys = materialize(weighted(docs, fit(docs, target_ids, text), seed, text).select("doc_id", "log_weight", "gumbel_key"), "keys")
    return keys.filter(chosen(threshold(keys)))


def resample(docs: DataFrame, target_ids: DataFrame, seed: int = 0, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that are drawn, with ``log_weight`` and ``gumbel_key``."""
    model = fit(docs, target_ids, text)
    scored = weighted(docs, model, seed, text)
    keys = materialize(scored.select("log_weight", "gumbel_key"), "keys")
    return scored.filter(chosen(threshold(keys)))


def good_ids(labels: DataFrame) -> DataFrame:
    """Ids of rows labelled good: of high quality and not toxic in every label they have."""
    ok = (F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)
    return labels.groupBy("doc_id").agg(F.min(F.coalesce(ok, F.lit(False)).cast("int")).alias("ok")).filter("ok = 1").select("doc_id")
