"""Phrase mining by stripes: every prefix keys a counter of the words that follow it.

A language's root stripe counts its words; the stripe of a prefix of one to three
words counts the words behind it. Every task keeps the stripes of the texts it has read,
cuts each into ``PARTS`` parts by the next word (what follows a very common word does not
meet in one place) and sends them on; the tasks that receive
them merge them element by element. An entry of a stripe is the count of prefix and next
word together, so merged stripes hold everything: extensions, totals of prefixes (the
entry one stripe higher) and, as the largest entry of a stripe and of the stripes one word to the left,
how much of a phrase any longer phrase takes up.

A phrase is frequent only if its words and word pairs are, so stripes go up by
length: words, pairs, then three and four words. What is frequent is noted in a
filter of ``BITS`` bits, the only thing that is broadcast. A filter never loses
a phrase and decides nothing; when there is more to note than it has room for, it spares less
and the shuffle grows, up to that of all phrases. Counts are exact at any size.

Null texts count as empty, a null language as ``und``; texts without words add
nothing. Repeated rows count every time. Rows of equal score and count are
ranked by phrase, in byte order. Texts are read whole, long ones in portions of
words. An empty table gives no rows. Columns other than those named are not
read. Words are told apart by 64-bit hashes on the way and come back as they are.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from oddlines.llm.common import bound_batches, partitions
from oddlines.llm.words import mix
from oddlines.storage import materialize

PARTS = 16  # parts of a stripe
BITS = 1 << 26  # size of a filter; a power of two
SEGMENT = 1 << 15  # bits of a filter that are put together at a time
WORDS, PORTION = 1 << 21, 1 << 20  # words counted, bytes taken apart at a time
CELLS = 1 << 20  # entries of stripes that a merging task takes in before it merges them
SALTS, SLICES = 16, 64
_STEP, _OTHER = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)

_CUT = bytearray(range(256))
for _byte in b".,;:!?\n\x0b\x0c\r":
    _CUT[_byte] = ord(".")
_CUT[9] = ord(" ")
_CUT = bytes(_CUT)


class Vocabulary(dict):
    """Codes of the words of a task in the order they came, with their hashes; 0 ends a piece."""

    def __init__(self):
        self.words: list[bytes] = []
        self.hashes: list[int] = []
        self[b"."]

    def __missing__(self, word: bytes) -> int:
        code = self[word] = len(self.words)
        self.words.append(word)
        self.hashes.append(int.from_bytes(blake2b(word, digest_size=8).digest(), "little"))
        return code

    def hash_array(self) -> np.ndarray:
        return np.array(self.hashes, np.uint64)


def coded(raw: list[bytes], vocabulary: Vocabulary) -> list[np.ndarray]:
    """Word codes of the texts in order, with a 0 behind each piece."""
    buf = b" . ".join([*raw, b""]).lower().translate(_CUT).replace(b".", b" . ")
    out, begin = [], 0
    while begin < len(buf):
        end = buf.find(b" ", begin + PORTION)
        end = len(buf) if end < 0 else end
        words = buf[begin:end].split()
        out.append(np.fromiter(map(vocabulary.__getitem__, words), np.int64, len(words)))
        begin = end
    return out


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, np.ndarray, Vocabulary]]:
    """(lang, codes, vocabulary) of about ``WORDS`` words at a time; a text is never cut."""
    vocabulary = Vocabulary()
    waiting: dict[str, list[bytes]] = defaultdict(list)
    ready: dict[str, list[np.ndarray]] = defaultdict(list)
    sizes: dict[str, int] = defaultdict(int)
    held = 0
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            if not text:
                continue
            waiting[lang].append(text)
            sizes[lang] += len(text)
            if sizes[lang] < PORTION:
                continue
            parts = coded(waiting.pop(lang), vocabulary)
            ready[lang] += parts
            held += sum(map(len, parts))
            sizes[lang] = 0
            if held >= WORDS:
                for name, arrays in ready.items():
                    yield name, np.concatenate(arrays), vocabulary
                ready.clear()
                held = 0
                if len(vocabulary) > WORDS // 2:
                    vocabulary = Vocabulary()  # texts that wait have no codes yet
    for lang, raw in waiting.items():
        ready[lang] += coded(raw, vocabulary)
    for name, arrays in ready.items():
        yield name, np.concatenate(arrays), vocabulary


def lang_hash(lang: str) -> np.ndarray:
    return np.array([int.from_bytes(blake2b(lang.encode(), digest_size=8).digest(), "little")], np.uint64)


def longer(key: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of a phrase of which ``key`` is the hash without its last word."""
    return mix(key * _STEP + word)


class Filter:
    """Which phrases are frequent, as two bits each; may answer yes for others."""

    def __init__(self, raw: bytes):
        self.bits = np.frombuffer(raw, np.uint8)

    @staticmethod
    def places(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        shift = np.uint64(64 - bits.bit_length() + 1)
        return (keys >> shift).astype(np.int64), (mix(keys ^ _OTHER) >> shift).astype(np.int64)

    def has(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), bool)
        for at in self.places(keys, 8 * len(self.bits)):
            out &= (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
        return out


def build_filter(spark: SparkSession, frequent: DataFrame, bits: int = BITS) -> bytes:
    """The filter of a table with a column ``key``; segments are put together on the executors."""
    segment = min(SEGMENT, bits)

    def notes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("key").to_numpy().view(np.uint64)
            at = np.unique(np.concatenate(Filter.places(keys, bits)))
            yield pa.RecordBatch.from_arrays([pa.array(at // segment), pa.array(at % segment)], ["segment", "bit"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            where, bit = batch.column("segment").to_numpy(), batch.column("bit").to_numpy()
            for s in np.unique(where).tolist():
                held.setdefault(s, np.zeros(segment, np.uint8))[bit[where == s]] = 1
        for s, found in held.items():
            packed = np.packbits(found, bitorder="little").tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([s]), pa.array([packed], pa.binary())], ["segment", "bits"])

    told = frequent.select("key").mapInArrow(notes, "segment long, bit long").distinct()
    told = told.repartition(partitions(spark), "segment").mapInArrow(join, "segment long, bits binary")
    out = bytearray(bits // 8)
    for s, packed in told.collect():  # as many bytes as the filter has, whatever the table's size
        out[s * segment // 8 : s * segment // 8 + len(packed)] = packed
    return bytes(out)


def root_stripes(docs: DataFrame, least: int) -> DataFrame:
    """(lang, word, hash, key, f) of the frequent words, and one row of a null word a language with all its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, codes, vocabulary in chunks(batches):
            counts = np.bincount(codes, minlength=1)
            counts[0] = 0
            used = np.flatnonzero(counts)
            words = [vocabulary.words[i] for i in used.tolist()]
            hashes = vocabulary.hash_array()[used]
            keys = longer(lang_hash(lang), hashes)
            columns = [
                pa.array([lang] * (len(used) + 1), pa.string()),
                pa.array([*words, None], pa.binary()).cast(pa.string()),
                pa.array(np.append(hashes, np.uint64(0)).view(np.int64)),
                pa.array(np.append(keys, np.uint64(0)).view(np.int64)),
                pa.array(np.append(counts[used], counts.sum())),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "word", "hash", "key", "f"])

    counted = docs.mapInArrow(run, "lang string, word string, hash long, key long, f long")
    merged = counted.groupBy("lang", "word", "hash", "key").agg(F.sum("f").alias("f"))
    return merged.filter((F.col("f") >= least) | F.col("word").isNull())


_STRIPES = "lang string, prefix binary, entries binary"
_ENTRY = np.dtype([("next", "<u8"), ("count", "<u4")])


def _binary(raw: bytes, ends: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(raw)])


def _stripes(lang: str, words: list[np.ndarray], counts: np.ndarray) -> pa.RecordBatch:
    """Stripes of the given phrases, each part of one a row; only what follows a single word is cut into parts."""
    size = len(words) - 1
    part = words[-1] % np.uint64(PARTS if size == 1 else 1)
    order = np.lexsort([words[-1], part, *words[-2::-1]])
    keys = np.stack([*(w[order] for w in words[:-1]), part[order]], axis=1)
    starts = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(axis=1)))
    entries = np.empty(len(order), _ENTRY)
    entries["next"], entries["count"] = words[-1][order], counts[order]
    # a prefix is its words' hashes and, last, the part in one byte
    prefixes = np.ascontiguousarray(keys[starts]).view(np.uint8).reshape(len(starts), -1)[:, : 8 * size + 1]
    columns = [
        pa.array([lang] * len(starts), pa.string()),
        _binary(prefixes.tobytes(), np.arange(len(starts) + 1) * (8 * size + 1)),
        _binary(entries.tobytes(), np.append(starts, len(order)) * _ENTRY.itemsize),
    ]
    return pa.RecordBatch.from_arrays(columns, ["lang", "prefix", "entries"])


def _phrases(batch: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """(lang, words of each phrase as a row, counts) of a batch of stripes, by language and length."""
    sizes = pc.binary_length(batch.column("prefix")).to_numpy()
    langs = batch.column("lang").dictionary_encode()
    which = langs.indices.to_numpy()
    for kind in np.unique(which.astype(np.int64) << 8 | sizes).tolist():
        rows = batch.filter(pa.array((which == kind >> 8) & (sizes == (kind & 255))))
        raw = np.frombuffer(b"".join(rows.column("prefix").to_pylist()), np.uint8).reshape(-1, kind & 255)
        prefix = np.ascontiguousarray(raw[:, :-1]).view(np.int64)
        entries = np.frombuffer(b"".join(rows.column("entries").to_pylist()), _ENTRY)
        held = pc.binary_length(rows.column("entries")).to_numpy() // _ENTRY.itemsize
        following = entries["next"].astype(np.uint64).view(np.int64)
        words = np.concatenate([np.repeat(prefix, held, axis=0), following[:, None]], axis=1)
        yield langs.dictionary[kind >> 8].as_py(), words, entries["count"].astype(np.int64)


def _marked(filter: Filter, lang: str, codes: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which positions hold a word that may be frequent."""
    used = np.unique(codes)
    good = np.zeros(len(hashes), bool)
    good[used] = filter.has(longer(lang_hash(lang), hashes[used]))
    good[0] = False
    return good[codes]


def pair_stripes(docs: DataFrame, words) -> DataFrame:
    """Stripes of one-word prefixes; ``words`` is the broadcast filter of frequent words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Filter(words.value)
        for lang, codes, vocabulary in chunks(batches):
            hashes = vocabulary.hash_array()
            good = _marked(known, lang, codes, hashes)
            at = np.flatnonzero(good[:-1] & good[1:])
            if len(at):
                pairs, counts = np.unique(codes[at] << 32 | codes[at + 1], return_counts=True)
                yield _stripes(lang, [hashes[pairs >> 32], hashes[pairs & 0xFFFFFFFF]], counts)

    return docs.mapInArrow(run, _STRIPES)


def long_stripes(docs: DataFrame, words, pairs) -> DataFrame:
    """Stripes of prefixes of two and three words whose pairs may all be frequent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word_filter, pair_filter = Filter(words.value), Filter(pairs.value)
        for lang, codes, vocabulary in chunks(batches):
            hashes = vocabulary.hash_array()
            good = _marked(word_filter, lang, codes, hashes)
            at = np.flatnonzero(good[:-1] & good[1:])
            if not len(at):
                continue
            found, which = np.unique(codes[at] << 32 | codes[at + 1], return_inverse=True)
            first, second = hashes[found >> 32], hashes[found & 0xFFFFFFFF]
            known = pair_filter.has(longer(longer(lang_hash(lang), first), second))
            pair = np.full(len(codes), -1, np.int64)  # number of the frequent pair that begins here
            pair[at] = np.where(known[which], which, -1)
            for reach in (1, 2):
                full = pair[:-reach] >= 0
                for step in range(1, reach + 1):
                    full = full & (pair[step : len(pair) - reach + step] >= 0)
                i = np.flatnonzero(full)
                if not len(i):
                    continue
                keys, counts = np.unique(pair[i] << 32 | pair[i + reach], return_counts=True)
                left, right = keys >> 32, keys & 0xFFFFFFFF
                row = [first[left], second[left], *([first[right]] if reach == 2 else []), second[right]]
                yield _stripes(lang, row, counts)

    return docs.mapInArrow(run, _STRIPES)


def _merged(words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal rows of ``words`` once, with their counts added."""
    order = np.lexsort(words.T[::-1])
    words, counts = words[order], counts[order]
    starts = np.flatnonzero(np.append(True, (words[1:] != words[:-1]).any(axis=1)))
    return words[starts], np.add.reduceat(counts, starts)


def merge_stripes(spark: SparkSession, stripes: DataFrame, least: int) -> DataFrame:
    """(lang, words, key, f) of every entry of the merged stripes that is frequent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], list[tuple[np.ndarray, np.ndarray]]] = defaultdict(list)
        entries: dict[tuple[str, int], int] = defaultdict(int)
        merged: dict[tuple[str, int], int] = defaultdict(int)
        for batch in batches:
            for lang, words, counts in _phrases(batch):
                kind = lang, words.shape[1]
                held[kind].append((words, counts))
                entries[kind] += len(words)
                if entries[kind] > 2 * merged[kind] + CELLS:
                    held[kind] = [_merged(*(np.concatenate(x) for x in zip(*held[kind])))]
                    entries[kind] = merged[kind] = len(held[kind][0][0])
        for (lang, size), parts in held.items():
            words, counts = _merged(*(np.concatenate(x) for x in zip(*parts)))
            words, counts = words[counts >= least], counts[counts >= least]
            key = np.repeat(lang_hash(lang), len(words))
            for k in range(size):
                key = longer(key, np.ascontiguousarray(words[:, k]).view(np.uint64))
            ends = pa.array(np.arange(len(words) + 1, dtype=np.int32) * size)
            columns = [
                pa.array([lang] * len(words), pa.string()), pa.ListArray.from_arrays(ends, pa.array(words.ravel())),
                pa.array(key.view(np.int64)), pa.array(counts),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "words", "key", "f"])

    dealt = stripes.repartition(partitions(spark), "lang", "prefix")
    return dealt.mapInArrow(run, "lang string, words array<long>, key long, f long")


def frequent_phrases(docs: DataFrame, least: int = 30, bits: int = BITS) -> tuple[DataFrame, DataFrame]:
    """Frequent words (as ``root_stripes`` gives them) and frequent phrases of two to four words."""
    spark = docs.sparkSession
    bound_batches(spark)
    docs = docs.select(
        F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"),
        F.col("text").cast("string").cast("binary").alias("text"),
    )
    words = materialize(root_stripes(docs, least), "words")
    known = spark.sparkContext.broadcast(build_filter(spark, words.filter("word IS NOT NULL"), bits))
    pairs = materialize(merge_stripes(spark, pair_stripes(docs, known), least), "pairs")
    paired = spark.sparkContext.broadcast(build_filter(spark, pairs, bits))
    more = materialize(merge_stripes(spark, long_stripes(docs, known, paired), least), "phrases")
    return words, pairs.union(more)


def scored(words: DataFrame, phrases: DataFrame, percent: int = 80) -> DataFrame:
    """(lang, words, a, l, r, score) of the phrases that no longer phrase takes up."""
    roots = words.filter("word IS NOT NULL").select("lang", F.array("hash").alias("words"), "f")
    # a common word ends many phrases: single words are looked up under several salts
    single = roots.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    totals = single.unionByName(phrases.select("lang", "words", "f", F.lit(0).cast("long").alias("salt")))

    sub = phrases.filter(F.size("words") > 2).select(
        "lang", "f", F.explode(F.array(
            F.expr("slice(words, 1, size(words) - 1)"), F.expr("slice(words, 2, size(words) - 1)")
        )).alias("words"),
    )
    taken = sub.groupBy("lang", "words").agg(F.max("f").alias("taken"))
    free = phrases.join(taken, ["lang", "words"], "left").filter(
        F.col("taken").isNull() | (F.col("taken") * F.lit(100).cast("decimal(3,0)") < F.col("f") * F.lit(percent).cast("decimal(3,0)"))
    )
    cuts = free.select(
        "lang", "words", F.col("f").alias("a"), F.explode(F.expr("sequence(1, size(words) - 1)")).alias("k")
    ).select(
        "lang", "words", "a", "k", F.expr("slice(words, 1, k)").alias("head"),
        F.expr("slice(words, k + 1, size(words) - k)").alias("tail"), F.pmod(F.xxhash64("words"), F.lit(SALTS)).alias("salt"),
    )

    def total(part: str, name: str) -> DataFrame:
        return totals.select("lang", F.col("words").alias(part), F.col("f").alias(name), F.col("salt").alias(f"{part}_salt"))

    for part in ("head", "tail"):
        cuts = cuts.withColumn(f"{part}_salt", F.when(F.size(part) == 1, F.col("salt")).otherwise(F.lit(0)))
    cuts = cuts.join(total("head", "l"), ["lang", "head", "head_salt"]).join(total("tail", "r"), ["lang", "tail", "tail_salt"])
    cuts = cuts.withColumn("score", F.expr(
        "(CAST(a AS DECIMAL(20,0)) * CAST(2000000 AS DECIMAL(7,0))) div (CAST(l AS DECIMAL(20,0)) + CAST(r AS DECIMAL(20,0)))"
    ))
    least = F.min(F.struct("score", "k", "l", "r")).alias("cut")
    return cuts.groupBy("lang", "words", "a").agg(least).select("lang", "words", "a", "cut.l", "cut.r", "cut.score")


def collocations(docs: DataFrame, least: int = 30, percent: int = 80, top: int = 2000, bits: int = BITS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first ``top`` phrases of every language."""
    words, phrases = frequent_phrases(docs, least, bits)
    found = scored(words, phrases, percent)
    order = (F.desc("score"), F.desc("a"))
    # two steps, so that a language's phrases do not meet in one task; ties stay until the words are known
    for keys in (["lang", F.pmod(F.xxhash64("words"), F.lit(SLICES))], ["lang"]):
        found = found.withColumn("place", F.rank().over(W.partitionBy(*keys).orderBy(*order)))
        found = found.filter(F.col("place") <= top).drop("place")
    found = materialize(found, "first")
    names = words.filter("word IS NOT NULL").select("lang", "hash", "word")
    spelled = found.select("lang", "words", F.posexplode("words").alias("pos", "hash")).join(names, ["lang", "hash"])
    spelled = spelled.groupBy("lang", "words").agg(F.array_sort(F.collect_list(F.struct("pos", "word"))).alias("spelled"))
    spelled = spelled.withColumn("phrase", F.concat_ws(" ", F.col("spelled.word"))).drop("spelled")
    all_words = words.filter("word IS NULL").select("lang", F.col("f").alias("n"))
    told = found.join(spelled, ["lang", "words"]).join(all_words, "lang")
    rank = F.row_number().over(W.partitionBy("lang").orderBy(*order, F.asc("phrase")))
    return told.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= top).select(
        "lang", "rank", "phrase", "a", "l", "r", "n", "score"
    )
